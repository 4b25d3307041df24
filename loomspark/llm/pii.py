"""Personal data: base patterns, and disguised identifiers found in an offset-preserving normalised form.

Base spans come from four patterns over the text as it stands. Then transducers rewrite the text: homoglyphs and
full-width or other digits become ASCII, invisible characters vanish, "at" and "dot" disguises become signs, runs of
spelled digits become digits. Each output character keeps the source span that it came from, so identifiers
detected in the rewritten text map back to source characters. Such a span is added if it does not lie
within a span of its kind and if the rewriting changed something inside it; base spans always stay.

Defined results: a null text counts as empty; rows are judged one by one, repeated ones alike; an empty table gives
an empty result; other columns pass through ``find`` and ``mask`` (``find``'s own column replaces a clashing one).

A bare " at " counts only together with a " dot " in words: "joe at example.com" stays, as "meet at noon.sharp" must.
All patterns take time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import in_arrow

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: each @ takes the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans by kind, then start: leftmost non-overlapping matches of each pattern that pass its test."""
    out: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# Cyrillic and Greek letters drawn like Latin ones, in pairs.
_ALIKE = dict(
    zip(
        "аеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοАВЕКМНОРСТХ",
        "aeopcyxijsdhABEZHIKMNOPTYXoABEKMHOPCTX",
        strict=True,
    )
)
# Digits in words.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_HIDDEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")

_DIGIT = re.compile("[0-9]")
#: What the transducers would change, for a quick look at a text: a superset, so that skipped texts are ones that stay.
_ODD = re.compile(r"[\xad\u0370-\u052f\u200b-\u200d\u2010-\u2015\u2024\u2060\u2212\ufeff\uff01-\uff5e\d](?<![0-9])")
_BRACKETED = re.compile(r"[(\[{<]\s*(?:at|dot)\s*[)\]}>]")
_DOT = re.compile(r"\bdot\b")
_NUMBER_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_NUMBER = re.compile(rf"(?<![A-Za-z0-9]){_NUMBER_WORD}[ ,-]+(?:{_NUMBER_WORD}|[0-9])|[0-9][ ,-]+{_NUMBER_WORD}|(?<![A-Za-z0-9])plus[ -]+[0-9]", re.I)


def _cue(text: str) -> bool:
    """Whether a transducer may change the text; each one's own test holds for the text as it stands where none before it did."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    if any(c in low for c in "([{<") and _BRACKETED.search(low):
        return True
    return ("dot" in low and bool(_DOT.search(low))) or bool(_NUMBER.search(text))


_SIGN = re.compile(r"[(\[{<]\s*+(at|dot)\s*+[)\]}>]\s*+", re.I)
# "x at y dot z": bare words count only together
_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ +at +[A-Za-z0-9-]+(?:(?: +dot +|\.)[A-Za-z0-9-]+)* +dot +[A-Za-z0-9-]+", re.I)
_BARE = re.compile(r" +(at|dot) +", re.I)
_LONE_DOT = re.compile(r"(?<=[0-9]) +dot +(?=[0-9])|(?<=[A-Za-z0-9]) +dot +(?=[A-Za-z0-9-]+$)", re.I)
_AFTER_AT = re.compile(r"@[A-Za-z0-9.-]+((?: +dot +[A-Za-z0-9-]+)+)", re.I)
_DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLING = re.compile(rf"(?<![A-Za-z0-9])(?:(?:double|triple)[ -]+)?(?:{_DIGIT_WORD}|[0-9]+)(?:[ ,-]+(?:(?:double|triple)[ -]+)?(?:{_DIGIT_WORD}|[0-9]+))+(?![A-Za-z0-9])", re.I)
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus[ -]+(?=[0-9])", re.I)


class Tape:
    """A text and, for each of its characters, the source span [start, end) that it came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text))
        self.end = np.arange(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by a string, for each of the ascending disjoint edits; the new characters stand for all of [a, b)."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.repeat(self.start[a], len(new))]
            end += [self.end[at:a], np.repeat(self.end[b - 1], len(new))]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*start, self.start[at:]])
        self.end = np.concatenate([*end, self.end[at:]])


def _plain(c: str) -> str:
    """The ASCII form of one character, "" for an invisible one, or itself."""
    if c < "\x80":
        return c
    if c in _HIDDEN:
        return ""
    if c in _ALIKE:
        return _ALIKE[c]
    if "\uff01" <= c <= "\uff5e":
        return chr(ord(c) - 0xFEE0)
    if "\u2010" <= c <= "\u2015" or c == "\u2212":
        return "-"
    if c == "\u2024":
        return "."
    return str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c


def _spelled(run: str) -> str:
    """The digits of a run of spelled digits, digits, "double" and "triple"."""
    out, times = [], 1
    for w in re.findall(r"[A-Za-z]+|[0-9]+", run):
        w = w.lower()
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out.append(_SPELLED.get(w, w) * times)
            times = 1
    return "".join(out)


def normalised(text: str) -> Tape:
    """The text after all transducers."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(i, i + 1, p) for i, c in enumerate(tape.text) if (p := _plain(c)) != c])
    # " dot " and "(at)" forms; a bare "at" or "dot" only within a whole disguised address
    tape.rewrite(_signs(tape.text))
    edits = []
    for whole in _WORDS.finditer(tape.text):
        edits += [(m.start(), m.end(), "@" if m[1].lower() == "at" else ".") for m in _BARE.finditer(tape.text, whole.start(), whole.end())]
    edits += [(m.start(), m.end(), ".") for m in _LONE_DOT.finditer(tape.text)]
    for whole in _AFTER_AT.finditer(tape.text):
        edits += [(m.start(), m.end(), ".") for m in _BARE.finditer(tape.text, whole.start(1), whole.end(1)) if m[1].lower() == "dot"]
    tape.rewrite(_disjoint(edits))
    tape.rewrite([(m.start(), m.end(), _spelled(m.group())) for m in _SPELLING.finditer(tape.text) if re.search("[A-Za-z]", m.group())])
    tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    return tape


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of bracketed signs, each with the blanks around it; the pattern cannot look for those before it in linear time."""
    out: list[tuple[int, int, str]] = []
    for m in _SIGN.finditer(text):
        start, least = m.start(), out[-1][1] if out else 0
        while start > least and text[start - 1].isspace():
            start -= 1
        out.append((start, m.end(), "@" if m[1].lower() == "at" else "."))
    return out


def _disjoint(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits in order; of overlapping ones the first to start."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(set(edits)):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans)."""
    base = base_spans(text)
    if not _cue(text):
        return base, []
    tape = normalised(text)
    if tape.text == text:
        return base, []
    have: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for k, a, b in base:
        have[k].append((a, b))
    far = dict.fromkeys(KINDS, (0, 0))  # of a kind's added spans, which come in order, the one that ends last
    added = []
    for kind, a, b in base_spans(tape.text):
        s, e = int(tape.start[a]), int(tape.end[b - 1])
        if text[s:e] == tape.text[a:b]:
            continue
        before = bisect_right(have[kind], (s, len(text) + 1)) - 1  # base spans of a kind are disjoint
        if (before >= 0 and e <= have[kind][before][1]) or (far[kind][0] <= s and e <= far[kind][1]):
            continue
        far[kind] = max(far[kind], (s, e), key=lambda x: x[1])
        added.append((kind, s, e))
    return base, added


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with a column pii: kind, start, stop (code points, end exclusive) and base of each span, by kind and start."""
    docs = docs.drop("pii")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField("pii", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                base, added = all_spans(t or "")
                own = set(base)
                out.append([{"kind": k, "start": a, "stop": b, "base": (k, a, b) in own} for k, a, b in _ordered(base + added)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW)], names=schema.names)

    return in_arrow(docs, run, schema)


def mask(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the first to start wins and takes in the rest."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, t in enumerate(texts):
                base, added = all_spans(t or "")
                if base or added:
                    texts[i] = masked(t, base + added)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return in_arrow(docs, run, docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (all, as kind:start:end), n_added."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    count = [of(k) for k in KINDS]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
