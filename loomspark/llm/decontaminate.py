"""Benchmark decontamination: n-gram windows of benchmark items looked for in every document.

Items are normalised to words (A-Z lower-cased; runs of a-z, 0-9 and non-ASCII characters). Every run of ``size``
item words is a window; an item with fewer words is one window. All windows' 64-bit hashes are broadcast to the
scans of documents, where rolling window hashes are looked up; hits are verified word for word. That set is bounded:
windows are counted first, and beyond ``max_windows`` the hashes of the documents' windows are joined to the benchmark's
by a shuffle instead, and hits are verified where their texts are, with the same result.

Defined results: null and empty texts have no words and no hits; items without words give no window; windows of an
item with a null id hit but are not listed; repeated items and documents count once per id and once per row; an empty
benchmark leaves every document clean; other columns pass through ``annotate`` (its own columns replace clashing ones).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import ALNUM, chunks, in_arrow, runs, stored, words

#: Windows that may be broadcast: a few hundred bytes each in a task.
MAX_WINDOWS = 500_000

_HIT = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def windows(items: DataFrame, size: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, h, w): each distinct window of each item, its length, hash and normalised words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                w = words(data, offsets, ALNUM)
                low = data.tobytes().lower()
                item, n, h, t = [], [], [], []
                for i in range(b - a):
                    first, last = int(w.first[i]), int(w.first[i + 1])
                    length = min(size, last - first)
                    if length:
                        hashes = runs(w.hash[first:last], length).view(np.int64)
                        for k, x in enumerate(hashes):
                            item.append(a + i)
                            n.append(length)
                            h.append(int(x))
                            t.append(b" ".join(low[w.start[j] : w.end[j]] for j in range(first + k, first + k + length)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(t, pa.binary())], ["item", "n", "h", "w"])

    return in_arrow(items.select(F.col(key).cast("string"), F.col(text)), run, "item string, n int, h long, w binary").distinct()


class _Windows:
    """Windows for look-up: a bit table over hashes, then hash to words to items."""

    def __init__(self, rows: pa.Table) -> None:
        self.by: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for item, n, h, w in zip(*(rows.column(c).to_pylist() for c in ("item", "n", "h", "w")), strict=True):
            self.by.setdefault(n, {}).setdefault(h, {}).setdefault(w, []).append(item)
        self.bits = {}
        for n, found in self.by.items():
            bits = np.zeros(1 << 22, dtype=bool)
            bits[np.fromiter(found, np.int64, len(found)).view(np.uint64) >> np.uint64(42)] = True
            self.bits[n] = bits


def _scan(data: np.ndarray, offsets: np.ndarray, known: _Windows) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Words in each text, merged spans of hit words, items found."""
    w = words(data, offsets, ALNUM)
    rows = len(offsets) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    for n, found in known.by.items():
        h = runs(w.hash, n)
        for i in np.flatnonzero(known.bits[n][h >> np.uint64(42)]):
            same = found.get(int(h[i].view(np.int64)))
            if same is None:
                continue
            d = int(np.searchsorted(w.first, i, "right")) - 1
            if i + n > w.first[d + 1]:
                continue
            text = b" ".join(data[w.start[j] : w.end[j]].tobytes().lower() for j in range(i, i + n))
            if text in same:
                at = int(i - w.first[d])
                spans[d].append((at, at + n))
                items[d].update(x for x in same[text] if x is not None)
    return np.diff(w.first), [_merged(s) for s in spans], items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _annotated(columns: list[pa.Array], n: np.ndarray, spans: list[list[tuple[int, int]]], items: list[set[str]], names: list[str]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=names)


def annotate(docs: DataFrame, items: DataFrame, *, text: str = "text", size: int = 13, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, spans (hit words, from 0, end exclusive) and items (sorted ids found)."""
    docs = docs.drop("n_words", "spans", "items")
    found = windows(items, size)
    rows = found.limit(max_windows + 1).toArrow()  # bounded by max_windows
    if rows.num_rows > max_windows:
        return _annotate_by_join(docs, found, text, size)
    known = docs.sparkSession.sparkContext.broadcast(_Windows(rows))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema, *T.StructType.fromDDL(_HIT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                n, spans, items = _scan(data, offsets, known.value)
                yield _annotated([c.slice(a, b - a) for c in batch.columns], n, spans, items, schema.names)

    return in_arrow(docs, run, schema)


def _annotate_by_join(docs: DataFrame, found: DataFrame, text: str, size: int) -> DataFrame:
    """The same for window sets too large to broadcast: hashes of document windows are joined to them, hits alone meet their texts."""
    aside = {c: f"_own{c}" for c in ("_row", "_hits") if c in docs.columns}
    keyed = stored(docs.withColumnsRenamed(aside).withColumn("_row", F.monotonically_increasing_id()), "documents")
    text = aside.get(text, text)
    lengths = [r["n"] for r in found.select("n").distinct().collect()]  # 1 to size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for a, b, data, offsets in chunks(batch.column(1)):
                w = words(data, offsets, ALNUM)
                owner = np.repeat(np.arange(b - a), np.diff(w.first))
                for n in lengths:
                    h = runs(w.hash, n)
                    at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
                    d = owner[at]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a + d]), pa.array((at - w.first[d]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(h[at].view(np.int64))], ["_row", "p", "n", "h"])

    own = in_arrow(keyed.select("_row", text), run, "_row long, p int, n int, h long")
    met = own.join(found, ["n", "h"]).groupBy("_row").agg(F.collect_list(F.struct("p", "n", "item", "w")).alias("_hits"))
    pair = keyed.join(met, "_row", "left")
    at, hits_at = pair.columns.index(text), pair.columns.index("_hits")
    keep = [i for i, c in enumerate(pair.columns) if c not in ("_row", "_hits")]
    schema = T.StructType([*(pair.schema[i] for i in keep), *T.StructType.fromDDL(_HIT)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                w = words(data, offsets, ALNUM)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
                items: list[set[str]] = [set() for _ in range(b - a)]
                for d, hits in enumerate(batch.column(hits_at).slice(a, b - a)):
                    for x in hits.as_py() or ():
                        i = int(w.first[d]) + x["p"]
                        if b" ".join(data[w.start[j] : w.end[j]].tobytes().lower() for j in range(i, i + x["n"])) == x["w"]:
                            spans[d].append((x["p"], x["p"] + x["n"]))
                            items[d] |= {x["item"]} - {None}
                yield _annotated([batch.column(i).slice(a, b - a) for i in keep], np.diff(w.first), [_merged(s) for s in spans], items, schema.names)

    return in_arrow(pair, verify, schema).withColumnsRenamed({v: k for k, v in aside.items()})


def hit_words() -> Column:
    """Words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))


def contaminated() -> Column:
    """Contamination rule: a hit, and a twentieth of the words or more in hits."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("n_words"))


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like annotations renamed, and their new names to the old ones."""
    names = {c: f"_own_{c}" for c in ("n_words", "spans", "items") if c in docs.columns}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    own, back = _aside(docs)
    return annotate(own, items, size=size).filter(~contaminated()).select(*own.columns).withColumnsRenamed(back)


def without_spans(docs: DataFrame, items: DataFrame, *, text: str = "text", size: int = 13) -> DataFrame:
    """``docs`` with each hit span cut out of the text, in place of dropping documents."""
    own, back = _aside(docs)
    marked = annotate(own, items, text=text, size=size)
    at = marked.columns.index(text)
    spans_at = marked.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column(spans_at).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(hit):
                if spans:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    w = words(data, np.array([0, len(data)]), ALNUM)
                    keep = np.ones(len(data), dtype=bool)
                    for s in spans:
                        keep[w.start[s["start"]] : w.end[s["stop"] - 1]] = False
                    texts[i] = data[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return in_arrow(marked, run, marked.schema).select(*own.columns).withColumnsRenamed(back)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    marked = annotate(docs.select("doc_id", "text"), items, size=13)
    return marked.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], size: int = 13) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) by plain search, for tests."""
    import re

    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for item, s in items:
            v = split(s)
            n = min(size, len(v))
            for k in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit.update(range(i, i + n))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
