"""Packing of tokenised documents into sequences of bounded length.

A document's token ids, with an end id, are cut only where they exceed the capacity. The histogram of piece lengths
(at most ``capacity`` numbers, whatever the corpus) goes to the driver, where a configuration linear program is
solved: the fewest patterns, each a multiset of lengths that fits the capacity, that cover the histogram. Each length has a
weight that is updated multiplicatively; a knapsack dynamic program over the weighted lengths prices patterns, and the
solution is the average over the rounds. Pattern counts are rounded as far as pieces are left, the program is solved
again for what is left, and the last few pieces are placed by best fit over the histogram. Pieces never pass through the
driver: a piece's rank among those of its length (counted by salted groups) picks its place in the plan, whose size
depends on the capacity alone.

Defined results: null and empty texts are one piece of the end id; rows with a null key and repeated rows are
packed like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.text import in_arrow, stored

CAPACITY = 2048
#: Rounds of the multiplicative weights, pricings in a round, step of the weights, and times the program is solved again.
ROUNDS = 32
TRIES = 4
STEP = 16.0
PASSES = 8

#: Pre-tokens whose ids a task keeps, twice, and characters of the longest: together about 60 MB.
KEPT, KEPT_LENGTH = 150_000, 32

_SCHEMA = "piece int, start long, length long, ids_crc32 long"


# Letters and numbers below U+0180 after lower-casing: the vocabulary's pre-tokens of such texts by the same pattern.
_LETTER, _NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")
_BEYOND = re.compile("[^\x00-ſ]")


class _Ids(dict):
    """Pre-tokens to the bytes of their little-endian 32-bit ids.

    Texts within U+017F are lower-cased and split here and each pre-token meets the model's merges once. White-space
    separated words with other characters, or with a special token's mark, go through the whole tokenizer instead.
    What the last ``KEPT`` new pre-tokens gave is kept, and what the ``KEPT`` before them gave.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, part: str) -> bytes:
        if part in self.before:
            out = self.before[part]
            self._keep(part, out)
            return out
        plain = part if part.isascii() and part.isprintable() else self.as_bytes(part)[0][0]
        out = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        self._keep(part, out)
        return out

    def _keep(self, part: str, out: bytes) -> None:
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.before = dict(self)
                self.clear()
            self[part] = out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if (text.isascii() or not _BEYOND.search(text)) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PRE.findall(text.lower())))
        out = []
        for word in text.encode().split():  # ASCII white space never joins a token
            w = word.decode()
            out.append(self._whole(w) if _BEYOND.search(w) or "<|" in w else b"".join(map(self.__getitem__, _PRE.findall(w.lower()))))
        return b"".join(out)


_LOADED: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _LOADED:
        _LOADED[path] = _Ids(path)
    return _LOADED[path]


def pieces(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every document's pieces of at most ``capacity`` tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = known.of(t or "") + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = data[4 * at : 4 * min(n, at + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        own.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(docs.select(F.col(key), F.col(text)), run, f"`{key}` {kind}, {_SCHEMA}" + ", ids array<int>" * ids)


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most total value within each capacity, and the piece that a pattern of it takes first (0: none): an unbounded knapsack.

    ``value[l]`` is the value of a piece of length l, 0 for lengths that may not be used.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[c:0:-1] + best[:c]
        i = int(total.argmax())  # of equal ones the largest piece: small ones fill gaps best
        if total[i] > best[c - 1]:
            best[c], last[c] = total[i], c - i
        else:
            best[c] = best[c - 1]
    return best, last


def priced(first: np.ndarray, last: np.ndarray, capacity: int) -> np.ndarray:
    """A row for each length in ``first``: the best pattern that holds it, descending, filled up with zeros."""
    used = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
    rest, rows = used[capacity - first], [first]
    while rest.any():
        rows.append(np.where(rest > 0, last[rest], 0))
        rest = used[rest - rows[-1]]
    return np.sort(np.stack(rows, 1), 1)[:, ::-1]


def fractional(count: np.ndarray, capacity: int, rounds: int, tries: int = TRIES) -> tuple[dict[tuple[int, ...], float], float]:
    """Patterns and how often each is used, from multiplicative weights, and a lower bound of the sequences needed.

    In each of ``rounds`` rounds every length may be used for an equal share of its pieces more, so that all lengths are
    covered at one pace and the average over the rounds is the solution. A length's price is its size times its weight; a
    dynamic program gives, for each length, the best pattern that holds it. Patterns of the best value, or full ones,
    are used until a length's share is gone, then lengths with a share left are priced again, ``tries`` times in all. After a
    round a length's weight grows exponentially with what is left of its share. Prices over the value of the best pattern
    are a solution of the dual program, hence the bound.
    """
    n, size = count.astype(float), np.arange(capacity + 1) / capacity
    weight, left, bound = np.ones(capacity + 1), np.zeros(capacity + 1), 0.0
    amount: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        left = left + n / rounds
        for i in range(tries):
            value = np.where(left > 1e-9, size * weight, 0.0)
            best, last = price(value, capacity)
            if best[capacity] <= 0:
                break
            if i == 0:  # all lengths have a share now
                top = best[capacity]
                bound = max(bound, float((n * size * weight).sum() / top))
            first = np.flatnonzero(left > 1e-9)
            worth = value[first] + best[capacity - first]
            order = np.argsort(-worth, kind="stable")
            for row, v in zip(priced(first[order], last, capacity).tolist(), worth[order].tolist(), strict=True):
                if v < top * (1 - 0.5 / capacity) and sum(row) < capacity:
                    continue
                p = tuple(x for x in row if x)
                step = min(left[x] / m for x, m in Counter(p).items())
                if step > 1e-9:
                    amount[p] = amount.get(p, 0.0) + step
                    for x in p:
                        left[x] -= step
        weight *= np.exp(STEP / capacity * np.where(n > 0, np.minimum(left * rounds / np.maximum(n, 1), 1), 0))
    return amount, bound


def rounded(count: np.ndarray, amount: dict[tuple[int, ...], float]) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns, most used first, each as often as its amount rounded up as far as pieces are left; and the pieces left."""
    left, plan = count.copy(), []
    for p, x in sorted(amount.items(), key=lambda e: (-e[1], e[0])):
        items = Counter(p)
        m = min(int(np.ceil(x - 1e-9)), *(int(left[c]) // k for c, k in items.items()))
        if m > 0:
            plan.append((p, m))
            for c, k in items.items():
                left[c] -= m * k
    return plan, left


@dataclass
class Solution:
    """Patterns and how often each is used; how many sequences come from the program; a lower bound of the sequences."""

    plan: list[tuple[tuple[int, ...], int]]
    from_program: int
    bound: int


def solution(count: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Solution:
    """The program solved and rounded, again for the pieces that rounding leaves, until it places hardly any; best fit for the rest.

    Best fit alone is kept where it needs fewer sequences; ``from_program`` is 0 then.
    """
    left = count.astype(np.int64).copy()
    full = int(left[capacity])
    left[capacity] = 0
    plan, bound, total = [], 0, int(left.sum())
    for i in range(PASSES):
        amount, least = fractional(left, capacity, rounds)
        bound = bound if i else int(np.ceil(least - 1e-6))
        more, rest = rounded(left, amount)
        placed = int((left - rest).sum())
        plan, left = plan + more, rest
        if 1000 * placed < total:
            break
    made = sum(m for _, m in plan)
    plan = plan + best_fit(left, capacity)
    left = count.astype(np.int64).copy()
    left[capacity] = 0
    plain = best_fit(left, capacity)
    if sum(m for _, m in plain) < sum(m for _, m in plan):  # a handful of pieces, where rounding costs a sequence
        plan, made = plain, 0
    return Solution(([((capacity,), full)] if full else []) + plan, made, bound + full)


def solve(count: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, together holding exactly count[l] pieces of each length l."""
    return solution(count, capacity, rounds).plan


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: sequences of equal content are handled together."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for c in range(capacity, 0, -1):
        k = int(count[c])
        for room in range(c, capacity):
            while k and by_room.get(room):
                p, m = by_room[room].pop()
                used = min(m, k)
                k -= used
                if m > used:
                    by_room[room].append((p, m - used))
                by_room.setdefault(room - c, []).append((p + (c,), used))
        each = capacity // c
        for n, m in ((each, k // each), (k % each, 1)):
            if n and m:
                by_room.setdefault(capacity - n * c, []).append(((c,) * n, m))
    return [x for room in sorted(by_room) for x in by_room[room]]


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: sorted by key = length * 2**48 + first rank."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for p, m in plan:
        at = 0
        for c in p:
            rows.append((c, rank[c], sequence, at))
            rank[c] += m
            at += c
        sequence += m
    c, first, seq, at = np.array(rows, np.int64).reshape(-1, 4).T
    order = np.argsort((c << 48) + first, kind="stable")
    return {"key": ((c << 48) + first)[order], "first": first[order], "sequence": seq[order], "offset": at[order]}


def pack(parts: DataFrame, *, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``parts`` (a stored table with a column length) with sequence_id and offset."""
    spark = parts.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = parts.columns
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    counts = salted.groupBy("_salt", "length").agg(F.count("*").alias("_n"))
    counts = stored(counts, "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(_slots(solve(histogram, capacity, rounds), capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_salt", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_salt", "length").orderBy(*names))
    # merged, not broadcast: its rows grow with the number of salts
    ranked = salted.withColumn("_rank", within).join(starts.hint("merge"), ["_salt", "length"]).select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (names.index("length"), len(names)))
            i = np.searchsorted(s["key"], (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s["sequence"][i] + rank - s["first"][i]), pa.array(s["offset"][i])], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*parts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return in_arrow(ranked, place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(docs, vocabulary, capacity=capacity), "pieces"), capacity=capacity)
