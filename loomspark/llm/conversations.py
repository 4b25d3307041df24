"""Repair of conversations' structure by the cheapest edits, solved once for each shared prefix of what is wrong with them.

A conversation is reduced to its signature: a character for each turn, by the initial of its role and by its fault. What
edits are cheapest depends on the signature alone. Signatures are sorted over the cluster and dealt by range, so that a task
walks a prefix trie in order: a node holds a layer of the dynamic program (for each state of the role grammar the cheapest
edits so far), a layer is computed once for all signatures that go through it, and answers are given at terminal nodes.
Conversations with one signature are spread over as many tasks as the range needs.

Roles' initials are to give ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate
turns must go), Insert a turn without text (2); a truncated turn that is not deleted costs 1 more. Of the cheapest edits
those whose initials come first in ASCII order are taken.

Two edit sequences that have consumed the same turns and end in different states differ before either ends (inserts are
counted to the turn that follows), so their order is known from the order of their beginnings: a layer keeps ranks, not
strings, and takes constant time. A state that another one can replace at less cost is dropped, which leaves few different
layers; the path through the trie holds references to those.

Texts are shuffled once, in the order of their conversations, and stream through the edits: a task holds an Arrow batch and
one conversation's signature and audit (a byte for each turn), never its texts. A conversation is hashed as a whole, so its
texts pass through one task.

Defined results: null texts and roles count as one space, null numbers as one space in the key of the damage; turns are
ordered by turn (nulls first), then role, then the SHA-256 of the text; a null conv_id is a conversation like others;
repeated rows are turns of equal content, the later ones duplicates; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.text import in_arrow, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: A signature's character for turns that must go; others are the role's initial (o: any other), upper case if truncated.
MUST_GO = "-"

# States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
#: (dropped state, the state that replaces it, what the replacement costs at most).
_REPLACES = [(0, 3, 3), (0, 2, 5), (1, 3, 0), (1, 2, 2), (2, 3, 2), (2, 1, 2), (2, 0, 2), (3, 2, 2), (3, 1, 4), (3, 0, 4)]

_BLANK = r"[^\x20\x09-\x0D]"


# ---- the damage


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after the damage; a row that it drops stays as one that is gone."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", number("conv_id"), number("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.explode(times)).drop("col")


# ---- faults and signatures


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with a key that is never null and the hash that orders turns of one number."""
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    return rows.withColumns({"_k": key, "_h": F.unhex(F.sha2("text", 256))})


_ORDER = ["turn", "role", "_h"]  # ascending, nulls first


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, _k, signature, gaps, blank, duplicate, truncated, illegal) of rows (conv_id, turn, role, text, gone)."""
    words = F.col("text").rlike(_BLANK)
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    marked = _named(rows).select("conv_id", "_k", "turn", "role", "_h", "gone", (~words).alias("_blank"), (words & ~last.isin(".", "!", "?")).alias("_cut"))
    dealt = marked.repartition("_k")  # the windows and the order below keep to it
    nth = F.row_number().over(Window.partitionBy("_k", "gone", "role", "_h").orderBy("turn"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(F.col("_blank"), "b").when(F.col("_n") > 1, "d").when(F.col("_cut"), "t").otherwise("k")
    ready = dealt.withColumn("_n", nth).withColumns({"_f": fault, "_i": known}).sortWithinPartitions("_k", *_ORDER, "_n")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return in_arrow(ready.select("conv_id", "_k", F.col("turn").cast("long").alias("turn"), "gone", "_f", "_i"), _summed, f"conv_id {kind}, _k string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


_LEGAL = {"su", "ua", "au"}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows of one key."""
    names = ["conv_id", "_k", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]
    done: list[list] = [[] for _ in names]
    key, own, kind = None, None, None
    marks, first, last, turns = bytearray(), None, None, 0
    counts = {"b": 0, "d": 0, "t": 0, "k": 0}
    illegal, before = 0, ""

    def end() -> None:
        gaps = 0 if first is None else last - first + 1 - turns
        for column, value in zip(done, (own, key, marks.decode(), gaps, counts["b"], counts["d"], counts["t"], illegal), strict=True):
            column.append(value)

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(done[0], kind), *[pa.array(c, pa.string()) for c in done[1:3]], *[pa.array(c, pa.int64()) for c in done[3:]]], names)
        for c in done:
            c.clear()
        return out

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, k, turn, gone, fault, initial in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
            if k != key:
                if key is not None:
                    end()
                key, own, marks, first, last, turns = k, conv, bytearray(), None, None, 0
                counts, illegal, before = dict.fromkeys("bdtk", 0), 0, ""
            if gone:
                continue
            counts[fault] += 1
            marks += (MUST_GO if fault in "bd" else initial.upper() if fault == "t" else initial).encode()
            if turn is not None:
                first = turn if first is None else first
                turns += turn != last
                last = turn
            illegal += bool(before) and before + initial not in _LEGAL
            before = initial
        if len(done[0]) >= 4096:
            yield batch()
    if key is not None:
        end()
    if done[0]:
        yield batch()


# ---- the trie


START = ((0, 0), None, None, None)


@lru_cache(maxsize=1 << 14)
def layer(states: tuple, mark: str) -> tuple[tuple, int, tuple]:
    """The layer below ``states`` (cost less the least cost, rank) at a turn: its states, what the least cost grew by, its edits.

    Edits are (state before, letters) for each state.
    """
    best: list = [None] * 4
    for s, held in enumerate(states):
        if held is None:
            continue
        at, cost = s, held[0]
        for n in range(3):
            for letter in DELETE + ("" if mark == MUST_GO else KEEP + REROLE):
                if letter == DELETE:
                    to = at
                elif letter == KEEP:
                    to = _NEXT.get((at, mark.lower()))
                else:
                    to = _INSERTED[at]
                if to is None:
                    continue
                c = cost + COST[letter] + (TRUNCATED if letter != DELETE and mark.isupper() else 0)
                found = (c, held[1], INSERT * n + letter, s)
                if best[to] is None or found < best[to]:
                    best[to] = found
            at, cost = _INSERTED[at], cost + COST[INSERT]
    for dropped, other, most in _REPLACES:
        if best[dropped] is not None and best[other] is not None and best[dropped][0] > best[other][0] + most:
            best[dropped] = None
    least = min(b[0] for b in best if b is not None)
    order = sorted((b[1], b[2]) for b in best if b is not None)
    down = tuple(None if b is None else (b[0] - least, order.index((b[1], b[2]))) for b in best)
    return down, least, tuple(None if b is None else (b[3], b[2]) for b in best)


class Trie:
    """The path of a prefix trie to the signature that was asked for last; ``nodes`` counts layers computed so far."""

    def __init__(self) -> None:
        self.path, self.steps, self.base, self.at, self.nodes = [START], [None], array("q", [0]), "", 0
        self.answer = ("", 0)
        self._ended = False

    def solve(self, signature: str) -> tuple[str, int]:
        """(audit, cost). Signatures in sorted order share the layers of their common prefixes."""
        if self._ended and signature == self.at:
            return self.answer
        shared = next((i for i, (a, b) in enumerate(zip_longest(self.at, signature)) if a != b), len(signature))
        del self.path[shared + 1 :], self.steps[shared + 1 :], self.base[shared + 1 :]
        for mark in signature[shared:]:
            states, grown, edits = layer(self.path[-1], mark)
            self.path.append(states)
            self.steps.append(edits)
            self.base.append(self.base[-1] + grown)
            self.nodes += 1
        self.at, self._ended = signature, True
        inserts = {0: 0, 1: 2, 2: 1, 3: 0}
        cost, _, tail, s = min((h[0] + COST[INSERT] * inserts[s], h[1], INSERT * inserts[s], s) for s, h in enumerate(self.path[-1]) if h is not None)
        letters = [tail]
        for edits in reversed(self.steps[1:]):
            s, own = edits[s]
            letters.append(own)
        self.answer = ("".join(reversed(letters)), int(self.base[-1] + cost))
        return self.answer


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for b in batches:
        solved = [trie.solve(x) for x in b.column("signature").to_pylist()]
        yield b.append_column("audit", pa.array([a for a, _ in solved], pa.string())).append_column("cost", pa.array([c for _, c in solved], pa.int64()))


def audits(found: DataFrame) -> DataFrame:
    """``signatures`` with the cheapest edits' initials, audit, and their cost."""
    dealt = found.repartitionByRange("signature", "_k").sortWithinPartitions("signature")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return in_arrow(dealt, _walked, f"{schema}, audit string, cost long")


# ---- the edits


_ROLE = {2: "user", 3: "assistant"}


def _edit(audit: str, at: int, state: int, role: str, text: str) -> tuple[int, int, list[tuple[str, str]]]:
    """Edits up to and with the next turn: the next place in the audit, the state, and the turns that come out."""
    out = []
    while audit[at] == INSERT:
        state = _INSERTED[state]
        out.append((_ROLE[state], ""))
        at += 1
    if audit[at] == KEEP:
        state = _NEXT[state, role[:1]]
        out.append((role, text))
    elif audit[at] == REROLE:
        state = _INSERTED[state]
        out.append((_ROLE[state], text))
    return at + 1, state, out


def _inserted(audit: str, at: int, state: int) -> list[tuple[str, str]]:
    out = []
    for _ in audit[at:]:
        state = _INSERTED[state]
        out.append((_ROLE[state], ""))
    return out


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object]]:
    """Of a stream of heads and rows: (0, head), then (1, (role, text)) for each turn that comes out."""
    audit, at, state, begun = "", 0, 0, False
    for b in batches:
        heads = b.column("head").to_pylist()
        roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
        for head, role, text in zip(heads, roles, texts, strict=True):
            if head is not None:
                if begun:
                    yield from ((1, t) for t in _inserted(audit, at, state))
                yield 0, head
                audit, at, state, begun = head["audit"], 0, 0, True
                continue
            at, state, out = _edit(audit, at, state, role, text)
            yield from ((1, t) for t in out)
    if begun:
        yield from ((1, t) for t in _inserted(audit, at, state))


def _streams(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, role, text): each conversation's head, then its turns in order."""
    own = _named(rows.filter("NOT gone")).select("_k", F.lit(1).alias("_o"), "turn", "role", "_h", "text")
    head = F.struct(*[c for c in heads.columns if c != "_k"]).alias("head")
    both = own.unionByName(heads.select("_k", F.lit(0).alias("_o"), head), allowMissingColumns=True)
    return both.repartition("_k").sortWithinPartitions("_k", "_o", *_ORDER).select("head", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns of the repaired conversations of rows (conv_id, turn, role, text, gone)."""
    heads = audits(stored(signatures(rows), "conversation-signatures")).select("conv_id", "_k", "audit")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, n, typed = [], None, 0, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal typed
            for b in batches:
                typed = b.schema.field("head").type.field("conv_id").type
                yield b

        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], typed), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())], ["conv_id", "position", "role", "text"])
        size = 0
        for what, value in _turns(watched()):
            if what == 0:
                conv, n = value["conv_id"], 0
                continue
            out.append((conv, n, *value))
            n, size = n + 1, size + len(value[1])
            if size > 1 << 20 or len(out) >= 4096:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return in_arrow(_streams(rows, heads), run, f"conv_id {kind}, position long, role string, text string")


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged first."""
    rows = damaged(conversations)
    heads = audits(stored(signatures(rows), "conversation-signatures")).drop("signature")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typed, head, sha, empty = None, None, None, True
        out: list[dict] = []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal typed
            for b in batches:
                typed = b.schema.field("head").type
                yield b

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in out], typed.field(n).type) for n in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r["repaired_sha256"] for r in out], pa.string())], [*names, "repaired_sha256"])

        for what, value in _turns(watched()):
            if what == 0:
                if head is not None:
                    out.append(head | {"repaired_sha256": sha.hexdigest()})
                    if len(out) >= 4096:
                        yield batch()
                        out = []
                head, sha, empty = value, hashlib.sha256(), True
                continue
            sha.update((("" if empty else "\n") + value[0] + ":" + value[1]).encode())
            empty = False
        if head is not None:
            out.append(head | {"repaired_sha256": sha.hexdigest()})
        if out:
            yield batch()

    return in_arrow(_streams(rows, heads), run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


# ---- the same in SQL


def _moves() -> list[tuple]:
    """(state, mark, to, cost, letters, inserted turns, what becomes of the turn) of the grammar's moves for one turn."""
    out = []
    for s in range(4):
        for mark in "suaoSUAO" + MUST_GO:
            at, before = s, ""
            for n in range(3):
                late = TRUNCATED if mark.isupper() else 0
                out.append((s, mark, at, COST[INSERT] * n + COST[DELETE], INSERT * n + DELETE, before, ""))
                if mark != MUST_GO and (at, mark.lower()) in _NEXT:
                    out.append((s, mark, _NEXT[at, mark.lower()], COST[INSERT] * n + late, INSERT * n + KEEP, before, "own"))
                if mark != MUST_GO:
                    out.append((s, mark, _INSERTED[at], COST[INSERT] * n + COST[REROLE] + late, INSERT * n + REROLE, before, _ROLE[_INSERTED[at]]))
                at = _INSERTED[at]
                before += _ROLE[at] + ":|"
    return out


_ENDS = "(0, 0, '', ''), (1, 4, 'II', 'user:|assistant:|'), (2, 2, 'I', 'assistant:|'), (3, 0, '', '')"

#: DuckDB SQL for ``digest``.
SQL = rf"""
WITH RECURSIVE
b AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS kt FROM conversations),
c AS (SELECT conv_id, k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(kt, ''), lambda x: CAST(ord(x) AS BIGINT))),
          lambda h, o: list_reduce(list_concat([xor(h, o)], range(8)), lambda z, i: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295::BIGINT) % 20 AS kind FROM b),
d AS (SELECT conv_id, k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
        regexp_matches(text, '[^\x20\x09-\x0D]') AS said, right(regexp_replace(text, '[\x20\x09-\x0D]+\z', ''), 1) AS last, left(role, 1) AS x FROM d),
f AS (SELECT *, CASE WHEN NOT said THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
        coalesce(lag(x) OVER (PARTITION BY k ORDER BY i) || x NOT IN ('su', 'ua', 'au'), false) AS illegal FROM e),
r AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN '{MUST_GO}' WHEN fault = 't' THEN upper(CASE WHEN x IN ('s', 'u', 'a') THEN x ELSE 'o' END) WHEN x IN ('s', 'u', 'a') THEN x ELSE 'o' END AS mark FROM f),
n AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY k),
m AS (SELECT * FROM (VALUES {", ".join(map(str, _moves()))}) AS t(st, mark, too, cost, letters, before, own)),
l AS (SELECT k, CAST(0 AS BIGINT) AS i, 0 AS st, {{'c': 0, 'a': '', 't': ''}} AS v FROM (SELECT DISTINCT k FROM b)
      UNION ALL
      SELECT l.k, l.i + 1, too, min({{'c': l.v.c + cost, 'a': l.v.a || letters, 't': l.v.t || replace(before, '|', chr(10)) || CASE own WHEN '' THEN '' WHEN 'own' THEN role || ':' || text || chr(10) ELSE own || ':' || text || chr(10) END}})
      FROM l JOIN r ON r.k = l.k AND r.i = l.i + 1 JOIN m ON m.st = l.st AND m.mark = r.mark GROUP BY l.k, l.i + 1, too),
z AS (SELECT l.k, min({{'c': l.v.c + cost, 'a': l.v.a || letters, 't': l.v.t || replace(before, '|', chr(10))}}) AS v
      FROM l LEFT JOIN n ON n.k = l.k JOIN (VALUES {_ENDS}) AS e(st, cost, letters, before) ON e.st = l.st WHERE l.i = coalesce(n.n, 0) GROUP BY l.k)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(z.v.c AS BIGINT) AS cost, z.v.a AS audit, sha256(left(z.v.t, CAST(greatest(length(z.v.t) - 1, 0) AS BIGINT))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM b) q JOIN z USING (k) LEFT JOIN n USING (k)
"""
