"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Each of ``registers`` registers keeps an exponentially spaced,
truncated minimum over the set (base ``BASE``; the registers of a union are the maxima of the registers). Bands of
``rows`` registers give candidate buckets; a pair's Jaccard similarity is then estimated jointly with its set sizes
by maximum likelihood over the counts of larger, smaller and equal registers; pairs that the estimate cannot rule
out are confirmed on the full sets of 64-bit shingle hashes. Links are joined to components by rounds of
label spreading over the links alone.

No bucket is expanded to its pairs. Documents of equal sets are one class, its smallest key standing for it. A
document can have a link only if at most a share 1 - t of its shingles occurs in no other candidate (since
|A and B| >= t |A or B| >= t |A|); others leave. In each bucket all members are compared to one hub, the
member with the smallest share of such lone shingles. Members whose component differs from their hub's are
then compared exactly, in blocks, to all members of the buckets whose hubs lie in that component, so no link is lost;
a pair of blocks gives fewer links than it has rows.

With 32 bands of 4 registers a pair at similarity 0.85 shares no bucket with probability below 1e-10, and fewer than
``MIN_BANDS`` with probability below 1e-7.

Defined results: null and empty texts have empty sets and are linked with nothing; rows with a null key are
left out of links (component null, kept true); repeated rows of one key stand for the smallest of their texts and each
gets its result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import NOT_SPACE, chunks, in_arrow, mix, shingles, stored, words
from loomspark.sources.stored import drop

BASE = 1.001
RATE = 20.0
LIMIT = 65534
ROWS = 4
REGISTERS = 128
MIN_BANDS = 3
#: Rows and shingles of a block, on average, where the members of a large group are compared exactly.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(4141))
_TIMES = (_RNG.integers(1, 2**31, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_PLUS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    spaced = -np.log1p(-(least.astype(float) + 0.5) / 2**32) / RATE  # the least of exponential variables
    return np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def likelihood_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Jaccard similarity of each pair of register rows, the likeliest on a grid given both set sizes."""
    larger, smaller = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    equal = a.shape[1] - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u, v) / np.maximum(u, v)
    grid = np.linspace(0, 1, steps)[None, :] * most[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u[:, None] - v[:, None] * grid), 1e-12, 1), np.clip(p(v[:, None] - u[:, None] * grid), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    fit = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return grid[np.arange(len(grid)), fit.argmax(1)]


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """k, n (set size), s1 and s2 (together a 128-bit fingerprint of the set), r (registers, big-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                h, first = shingles(words(data, offsets, NOT_SPACE), size)
                n, s1, s2, r = [], [], [], []
                for i in range(b - a):
                    own = np.unique(h[first[i] : first[i + 1]])
                    n.append(len(own))
                    s1.append(mix(own).sum(dtype=np.uint64))
                    s2.append(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    r.append(registers(own).astype(">u2").tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2)), pa.array(r, pa.binary())], ["k", "n", "s1", "s2", "r"])

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, n long, s1 long, s2 long, r binary")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """k and h, the sorted distinct shingle hashes, of rows (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                h, first = shingles(words(data, offsets, NOT_SPACE), size)
                sets = [np.unique(h[first[i] : first[i + 1]]).view(np.int64) for i in range(b - a)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))], ["k", "h"])

    return in_arrow(docs, run, f"k {docs.schema['k'].dataType.simpleString()}, h array<long>")


@F.pandas_udf(T.DoubleType())
def _estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(ra):
        return pd.Series([], dtype=float)
    rows = [np.frombuffer(b"".join(x), ">u2").reshape(len(x), REGISTERS).astype(np.int32) for x in (ra, rb)]
    return pd.Series(likelihood_estimate(*rows, na.to_numpy(float), nb.to_numpy(float)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those with 100 * |intersection| >= percent * |union|."""
    a = sets.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = sets.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    t = percent / 100
    # sizes alone rule out most unequal pairs; 6 standard errors of the estimate lie between floor and t
    floor = max(0.0, t - 6 * (t * (1 - t) / REGISTERS) ** 0.5 - 0.02)
    near = (
        pairs.join(a, "a").join(b, "b")
        .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .withColumn("e", _estimate("ra", "rb", "na", "nb")).filter(F.col("e") >= floor).select("a", "b")
    )
    ha = sets.select(F.col("k").alias("a"), F.col("h").alias("ha"))
    hb = sets.select(F.col("k").alias("b"), F.col("h").alias("hb"))
    both = near.join(ha, "a").join(hb, "b").select("a", "b", (F.size("ha") + F.size("hb")).cast("long").alias("sum"), F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"))
    return both.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _exact_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """A boolean matrix: which of the sets a (sorted distinct hashes) are linked with which of the sets b."""
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, item, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = count[item] > 1
    rows, item = rows[shared], item[shared]
    _, item = np.unique(item, return_inverse=True)
    order = np.argsort(item, kind="stable")
    rows, item = rows[order], item[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        x, y = np.searchsorted(item, [at, at + 4096])
        has = np.zeros((len(a) + len(b), 4096), np.float32)
        has[rows[x:y], item[x:y] - at] = 1
        both += has[: len(a)] @ has[len(a) :].T
    size = np.array([len(x) for x in (*a, *b)])
    union = size[: len(a), None] + size[None, len(a) :] - both
    return 100 * both >= percent * union


def _within_families(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each family's outer members (c differs from f) with members of other components.

    Outer members and members are dealt to blocks of about ``BLOCK`` rows or ``BLOCK_SHINGLES``; each pair of blocks is one group, in which sets
    are compared exactly and links that join what earlier ones have joined are left out, so a group gives fewer links
    than it has rows.
    """
    outside = F.col("c") != F.col("f")
    counts = [F.count("*").alias("m"), F.sum("n").alias("mn"), F.count_if(outside).alias("o"), F.sum(F.when(outside, F.col("n"))).alias("on")]
    blocks = lambda rows, shingles: F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    size = family.groupBy("f").agg(*counts).filter("o > 0").select("f", blocks("m", "mn").alias("mb"), blocks("o", "on").alias("ob"))
    dealt = family.join(size, "f")
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "k"), F.col(n)).cast("int")
    outer = dealt.filter("c <> f").select("f", "k", "c", F.lit(True).alias("outer"), own(1, "ob").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"))
    inner = dealt.select("f", "k", "c", F.lit(False).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("i"), own(2, "mb").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf["outer"].to_numpy(bool)
        a, b = pdf[out], pdf[~out]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": pdf["k"].iloc[:0], "b": pdf["k"].iloc[:0]})
        linked = _exact_links(list(a["h"]), list(b["h"]), percent)
        part: dict = {}

        def root(x):
            while part.setdefault(x, x) != x:
                part[x] = x = part[part[x]]
            return x

        found = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = root(a["c"].iat[i]), root(b["c"].iat[j])
            if x != y:
                part[x] = y
                found.append((a["k"].iat[i], b["k"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    kind = family.schema["k"].dataType.simpleString()
    return outer.unionByName(inner).join(sets, "k").groupBy("f", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, c): the smallest key that each node reaches over links (a, b), itself included.

    Each round a node takes the smallest label among itself and its neighbours, then its label's label; rounds end
    when no label changes. Links and labels stay in tables of the shared folder.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    linked = edges.select(F.col("a").alias("k")).distinct()
    labels = stored(linked.select("k", F.col("k").alias("c")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("m"))
        step = labels.join(heard, "k").select("k", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("k").alias("c"), F.col("c").alias("j"))
        nxt = stored(step.join(jump, "c").select("k", "old", F.least("c", "j").alias("c")), "labels")
        drop(edges.sparkSession, *{str(f).rpartition("/")[0] for f in labels.inputFiles()})
        labels = nxt.select("k", "c")
        if nxt.filter("c < old").isEmpty():
            return nodes.join(labels, "k", "left").select("k", F.coalesce("c", "k").alias("c"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; kept marks the smallest key of each component."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    if not rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        one = rows.filter("k IS NOT NULL").groupBy("k").agg(F.min("t").alias("t"))
        found = near_duplicates(one.unionByName(rows.filter("k IS NULL")), key="k", text="t", size=size, percent=percent)
        again = rows.select("k").join(found.filter("k IS NOT NULL"), "k")
        return again.unionByName(found.filter("k IS NULL")).withColumnRenamed("k", key)
    seen = stored(sketches(docs, key, text, size), "sketches")
    sets = seen.filter("n > 0 AND k IS NOT NULL")
    classes = stored(sets.groupBy("s1", "s2").agg(F.min(F.struct("k", "n", "r")).alias("x")).select("s1", "s2", "x.*"), "classes")
    bands = [F.xxhash64(F.lit(i), F.substring("r", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(REGISTERS // ROWS)]
    banded = classes.select("k", F.explode(F.array(*bands)).alias("g"))
    shared = banded.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g")
    member = stored(banded.join(shared, "g"), "members")
    often = member.groupBy("k").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_BANDS).select("k")
    often = stored(often, "candidates")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(often, "k").dropDuplicates(["k"])
    sets = stored(full_sets(texts, size).join(classes.select("k", "n", "r"), "k"), "sets")
    # of each candidate's shingles, those that another candidate has
    item = sets.select("k", F.explode("h").alias("x"))
    common = item.groupBy("x").agg(F.count("*").alias("m")).filter("m > 1").select("x")
    known = item.join(common, "x").groupBy("k").agg(F.count("*").alias("known"))
    able = sets.select("k", "n").join(known, "k").filter(100 * F.col("known") >= percent * F.col("n")).select("k", "n", (1 - F.col("known") / F.col("n")).alias("lone"))
    able = stored(able, "linkable")
    member = stored(member.join(able, "k"), "linkable-members")
    hub = member.groupBy("g").agg(F.min(F.struct("lone", "k")).alias("hub"), F.count("*").alias("m")).filter("m > 1").select("g", F.col("hub.k").alias("hub"))
    hub = stored(hub, "hubs")
    first = member.join(hub, "g").filter("k <> hub").select(F.col("k").alias("a"), F.col("hub").alias("b")).distinct()
    links = stored(_confirmed(first, sets, percent), "links-hub")
    part = stored(components(links, able.select("k")), "parts")
    # members outside their hub's component, against all members of the buckets whose hubs are in that component
    placed = member.select("g", "k", "n").join(part, "k").join(hub.join(part.select(F.col("k").alias("hub"), F.col("c").alias("hc")), "hub"), "g")
    family = stored(placed.select(F.col("hc").alias("f"), "k", "c", "n").distinct(), "families")
    links = links.union(_within_families(family, sets.select("k", "h"), percent))
    found = stored(components(links, classes.select("k")), "components")
    of_class = classes.join(found, "k").select("s1", "s2", "c")
    out = seen.join(of_class, ["s1", "s2"], "left").withColumn("c", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("k")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("k").isNotNull(), F.col("c")).alias("component_id"), F.coalesce(F.col("k") == F.col("c"), F.lit(True)).alias("kept"))
