"""Ranked lexical search: postings in the order of their exact impact, score at a time, with a proof for the top k.

Queries are items of a bounded block (``ITEM_BYTES`` of text; more items make more blocks, each a search of its own). Their
terms go to all tasks. One pass over the texts keeps, for each document, its length and the query terms that it has; counts
for weights come from there by aggregation. Documents are then ranked in blocks of bounded size: a block's postings are
ordered by term and descending impact (the integer that a term adds to the score), and an item takes from its terms' lists
whatever reaches a falling level, so postings are taken in the order of impact and those of equal impact together. What is
left of the lists bounds what any document can still gain. Once that proves that only a few documents can be among the top k,
no more postings are taken and the scores of those few are completed from their own terms; without the proof lists are
taken to their end. The top k of all blocks meet in a window that passes k rows of an item from each task on.

Scores are exact: hashes find terms, their bytes decide; all of a score is 64-bit integer arithmetic but for the weight.

Defined results: rows are documents and items one by one, repeated rows too; null and empty texts have no term, are not
counted and are never found; an item without terms, or whose terms no document has, gives no row; equal scores go by
ascending doc_id, nulls last; empty tables give an empty result; other columns are not read. doc_id is a whole number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.text import _LOWER, ALNUM, chunks, in_arrow, stored, utf8, words

#: Bytes of item texts in a block of items.
ITEM_BYTES = 1 << 24
#: Postings of a block of documents, about.
BLOCK = 1 << 21
#: Each level of impact is this part of the one before.
FALL = 0.7
#: Candidates whose scores are completed, at most, unless lists are taken to their end.
CANDIDATES = 128


@dataclass
class Items:
    """A block of items: ids, the terms of all (hashes in order, bytes), and each item's terms with their number."""

    ids: list
    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def read_items(rows: list) -> Items:
    """Items of rows (id, text)."""
    data, offsets = utf8(pa.array([r[1] for r in rows], pa.string()))
    w = words(data, offsets, ALNUM)
    found, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], (w.end - w.start)[first]
    low = _LOWER[data]
    if len(found) and not _same(low, w.start, w.end - w.start, low, start[back], size[back]).all():
        raise ValueError("two terms of the items have one hash")  # 64 bits: not to be expected
    terms, times = [], []
    for i in range(len(rows)):
        t, c = np.unique(back[w.first[i] : w.first[i + 1]], return_counts=True)
        terms.append(t.astype(np.int64))
        times.append(c.astype(np.int64))
    return Items([r[0] for r in rows], found, low, start, size, terms, times)


def _same(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether each word of ``a`` has the bytes of the word of ``b`` beside it."""
    same = a_size == b_size
    at = np.flatnonzero(same)
    if not len(at):
        return same
    size = a_size[at]
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    differ = a[np.repeat(a_start[at], size) + place] != b[np.repeat(b_start[at], size) + place]
    same[at] = ~np.logical_or.reduceat(differ, begin)
    return same


def _forward(items: Items):
    """(doc_id, n, terms, tfs) of documents that have a term at all; terms are numbers of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, offsets in chunks(b.column(1)):
                w = words(data, offsets, ALNUM)
                n = np.diff(w.first)
                place = np.minimum(np.searchsorted(items.hash, w.hash), max(len(items.hash) - 1, 0))
                hit = np.flatnonzero(items.hash[place] == w.hash) if len(items.hash) else np.zeros(0, np.int64)
                term = place[hit]
                same = _same(_LOWER[data], w.start[hit], (w.end - w.start)[hit], items.data, items.start[term], items.size[term])
                doc = np.repeat(np.arange(len(n)), n)[hit[same]]
                pair, tf = np.unique(doc * max(len(items.hash), 1) + term[same], return_counts=True)
                own = np.searchsorted(pair, np.arange(len(n) + 1) * max(len(items.hash), 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(own), pa.array(v.astype(np.int32)))
                ids = b.column(0).slice(at, end - at)
                out = pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), lists(pair % max(len(items.hash), 1)), lists(tf)], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return run


def rank_block(n: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, order: np.ndarray, weights: np.ndarray, total: int, length: int, items: Items, k: int, candidates: int = CANDIDATES) -> tuple[list, list, list, int]:
    """(items' numbers, documents' places, scores) of each item's top k of a block, and how many postings were taken.

    ``first`` are offsets of each document's postings; ``order`` is each document's place among equal scores.
    """
    m = 25 + (75 * n * total) // length
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
    by_term = np.lexsort((-impact, terms))
    docs, down = doc[by_term], -impact[by_term]
    lists = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
    times = np.zeros(len(weights), np.int64)
    out_item, out_doc, out_score, taken = [], [], [], 0
    for i, (own, often) in enumerate(zip(items.terms, items.times, strict=True)):
        own = [(int(lists[t]), int(lists[t + 1]), int(c)) for t, c in zip(own, often, strict=True) if weights[t] and lists[t] < lists[t + 1]]
        if not own:
            continue
        score = np.zeros(len(n), np.int64)
        at = [lo for lo, _, _ in own]
        left = [-int(down[lo]) * c for lo, _, c in own]
        level, whole = max(left) * FALL, False
        few = None
        while True:
            for j, (_, hi, c) in enumerate(own):
                if left[j] < level or not left[j]:
                    continue
                to = at[j] + int(np.searchsorted(down[at[j] : hi], -math.ceil(level / c), "right"))
                score[docs[at[j] : to]] -= c * down[at[j] : to]  # a list has a document once
                taken += to - at[j]
                at[j] = to
                left[j] = -int(down[to]) * c if to < hi else 0
            rest = sum(left)
            if not rest:
                whole = True
                break
            kth = int(np.partition(score, len(n) - k)[len(n) - k]) if len(n) > k else 0
            if kth > rest:  # what has not been met yet cannot reach the top k
                few = np.flatnonzero(score >= kth - rest)
                if len(few) <= candidates:
                    break
            level = min(level, max(left)) * FALL
        if whole:
            few = np.flatnonzero(score)
            if len(few) > k:
                kth = int(np.partition(score[few], len(few) - k)[len(few) - k])
                few = few[score[few] >= kth]
            full = score[few]
        else:
            times[items.terms[i]] = often
            size = first[few + 1] - first[few]
            begin = np.cumsum(size) - size
            place = np.repeat(first[few] - begin, size) + np.arange(int(size.sum()))
            full = np.add.reduceat(times[terms[place]] * impact[place], begin)
            times[items.terms[i]] = 0
        best = np.lexsort((order[few], -full))[:k]
        best = best[full[best] > 0]
        out_item.append(np.full(len(best), i))
        out_doc.append(few[best])
        out_score.append(full[best])
    return out_item, out_doc, out_score, taken


def _ranked(items: Items, weights: np.ndarray, total: int, length: int, k: int, block: int):
    """(item, doc_id, score): each item's top k of each block of the documents that come."""

    def rank(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
        ids = t.column("doc_id").combine_chunks()
        n = t.column("n").to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(t.column("terms")).to_numpy())]).astype(np.int64)
        place = np.empty(len(n), np.int64)
        place[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(n))
        item, doc, score, _ = rank_block(n, first, flat("terms"), flat("tfs"), place, weights, total, length, items, k)
        if item:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item).astype(np.int32)), ids.take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(score))], ["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b) + len(b.column(2).flatten())
            if size >= block:
                yield from rank(held)
                held, size = [], 0
        if held:
            yield from rank(held)

    return run


def _search(docs: DataFrame, rows: list, k: int, block: int) -> DataFrame:
    """``search`` for the rows (id, text) of one block of items."""
    items = read_items(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = stored(in_arrow(docs.select("doc_id", "text"), _forward(items), f"doc_id {kind}, n long, terms array<int>, tfs array<int>"), "ranked-terms")
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    weights = np.zeros(len(items.hash), np.int64)
    for r in kept.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():  # a row for each term of the items
        weights[r["t"]] = math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * r["df"] + 1)))
    some = kept.filter(F.size("terms") > 0)
    return in_arrow(some, _ranked(items, weights, size["n"], max(size["l"], 1), k, block), f"item int, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, item_bytes: int = ITEM_BYTES, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    queries = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // item_bytes))
    spark, out = docs.sparkSession, None
    for p in range(parts):
        own = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = [tuple(r) for r in own.collect()]  # about half of item_bytes
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = _search(docs, rows, k, block).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL for ``search`` of ``benchmark`` in ``documents``.
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
d AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
i AS (SELECT q, item_id, x, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS x FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(w) AS x FROM t) WHERE x IN (SELECT x FROM i) GROUP BY ALL),
f AS (SELECT x, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY x, nn),
g AS (SELECT q, item_id, doc_id, p.r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
      FROM i JOIN f USING (x) JOIN p USING (x) JOIN d ON d.r = p.r, s GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
