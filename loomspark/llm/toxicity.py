"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of a hashed character n-gram (of lower-cased text) is scaled by the n-gram's log-count ratio
between the classes; a logistic regression with an L2 penalty is fitted to the scaled features. n-grams
whose ratio is near 0 or that few texts have are left out, so a long text's score rests on telling n-grams.

Fitting takes at most ``max_rows`` labelled rows, those with the smallest hash of their key; class counts and
features of that sample pass through the driver and are bounded by it. Scoring is one pass without a shuffle.

Defined results: a null text counts as empty; an empty text's score is the intercept's; null labels and labels
other than 0 and 1 are left out of the fit; without both classes every score is the share of label 1 (0.0 without
labels); repeated rows are scored alike and count once in the fit, with the smallest of their texts; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.text import chunks, in_arrow, mix, stored

#: Characters whose n-grams are held at once.
RUN = 1 << 16
#: Bytes of text whose distinct n-grams are held at once while counting.
FIT_CHUNK = 1 << 18

_CODE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    min_rows: int = 6
    min_ratio: float = 1.0
    max_features: int = 50_000
    max_rows: int = 8_000
    penalty: float = 0.02
    rounds: int = 400


@dataclass
class Model:
    settings: Settings
    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def slots(self) -> np.ndarray:
        """For each hashed n-gram its feature's number plus 1, or 0."""
        out = np.zeros(1 << self.settings.bits, np.int32)
        out[self.feature] = np.arange(1, len(self.feature) + 1)
        return out


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk and the texts' offsets in them."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = data.tobytes().decode("utf-8")
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer keeps its own form
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), lead[offsets]


def _grams(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hashed n-gram) of every n-gram of each size, by runs of ``RUN`` characters."""
    codes, first = _codes(data, offsets)
    owners = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    for at in range(0, len(codes), RUN):
        wide, owner = codes[at : at + RUN + max(s.sizes) - 1].astype(np.uint64), owners[at : at + RUN + max(s.sizes) - 1]
        for n in s.sizes:
            size = min(RUN, len(wide) - n + 1)
            if size < 1:
                continue
            h = wide[:size] * _CODE[0]
            for k in range(1, n):
                h = h + wide[k : size + k] * _CODE[k]
            inside = owner[:size] == owner[n - 1 : size + n - 1]
            slot = (mix(h + np.uint64(n)) >> np.uint64(64 - s.bits)).astype(np.int32)
            yield owner[:size][inside], slot[inside]


def _found(data: np.ndarray, offsets: np.ndarray, s: Settings, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature number) pairs."""
    keys = [np.zeros(0, np.int64)]
    for owner, slot in _grams(data, offsets, s):
        f = slots[slot]
        hit = np.flatnonzero(f)
        keys.append((owner[hit].astype(np.int64) << 32) | (f[hit] - 1))
    k = np.unique(np.concatenate(keys))
    return k >> 32, k & 0xFFFFFFFF


def held_out(key: F.Column) -> F.Column:
    """Rows kept from the fit: crc32 of the key as text has remainder 2 by 4."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, s: Settings) -> DataFrame:
    """At most ``max_rows`` labelled texts outside the held-out part, those with the smallest hash of their key."""
    chosen = (
        labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_k")))
        .groupBy("_k").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64(F.lit("fit"), F.col("_k")), F.col("_k")).limit(s.max_rows)
    )
    # max_rows bounds what is broadcast; repeated rows of a key count once, with the smallest of their texts
    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").groupBy("_k").agg(F.min("_t").alias("_t"), F.min("_y").alias("_y"))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings | None = None) -> Model:
    """Fit on the labelled texts that are not held out."""
    s = settings or Settings()
    rows = stored(sample(docs, labels, key, text, label, s), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.zeros((2, 1 << s.bits), np.int64)
        size = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
            size += np.bincount(y, minlength=2)
            for a, b, data, offsets in chunks(batch.column(batch.schema.get_field_index("_t")), FIT_CHUNK):
                keys = [np.unique((o.astype(np.int64) << s.bits) | g) for o, g in _grams(data, offsets, s)]
                k = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
                for c in (0, 1):
                    by[c] += np.bincount((k & ((1 << s.bits) - 1))[y[a:b][k >> s.bits] == c], minlength=1 << s.bits)
        used = np.flatnonzero(by.sum(0))
        yield pa.RecordBatch.from_pydict({"f": np.append(used, -1), "neg": np.append(by[0][used], size[0]), "pos": np.append(by[1][used], size[1])})

    counts = in_arrow(rows.coalesce(8), count, "f long, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    got = counts.filter((F.col("neg") + F.col("pos") >= s.min_rows) | (F.col("f") < 0)).toArrow()  # at most 2**bits rows
    f, neg, pos = (got.column(c).to_numpy() for c in ("f", "neg", "pos"))
    total = f < 0
    n0, n1 = int(neg[total].sum()), int(pos[total].sum())
    if not n0 or not n1:
        p = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(s, np.zeros(0, np.int64), np.zeros(0), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    f, neg, pos = f[~total], neg[~total], pos[~total]
    ratio = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    strong = np.flatnonzero(np.abs(ratio) >= s.min_ratio)
    strong = strong[np.lexsort((f[strong], -np.abs(ratio[strong]) * np.sqrt((pos + neg)[strong])))][: s.max_features]
    strong = strong[np.argsort(f[strong])]
    model = Model(s, f[strong], ratio[strong], 0.0)
    slots = rows.sparkSession.sparkContext.broadcast(model.slots())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(batch.schema.get_field_index("_y")).to_numpy(zero_copy_only=False)
            k = batch.column(batch.schema.get_field_index("_k"))
            for a, b, data, offsets in chunks(batch.column(batch.schema.get_field_index("_t"))):
                owner, feature = _found(data, offsets, s, slots.value)
                at = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([k.slice(a, b - a), pa.array(y[a:b], pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))], ["_k", "y", "f"])

    kind = rows.schema["_k"].dataType
    schema = T.StructType([T.StructField("_k", kind), T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))])
    got = in_arrow(rows, encode, schema).orderBy("_k").toArrow()  # bounded by max_rows
    lists = got.column("f").combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    size = np.diff(lists.offsets.to_numpy())
    column, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), size)
    model.weight, model.intercept = _logistic(row, column, model.weight, y, s)
    keep = np.flatnonzero(np.abs(model.weight) > 1e-4)
    return Model(s, model.feature[keep], model.weight[keep], model.intercept)


def _logistic(row: np.ndarray, column: np.ndarray, ratio: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights (already times the ratio) and intercept, by accelerated gradient steps."""
    n, m = len(y), len(ratio)
    value = ratio[column]
    weight, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    # step sizes per feature from a bound of the curvature: rows' absolute sums
    reach = np.bincount(row, np.abs(value), minlength=n) + 1
    curve = np.bincount(column, np.abs(value) * reach[row], minlength=m) / (4 * n) + s.penalty / max(m, 1) + 1e-6
    bias_curve = reach.mean() / 4
    w0, b0, look, look_b = weight, bias, weight, bias
    for t in range(s.rounds):
        z = np.bincount(row, value * look[column], minlength=n) + look_b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        weight = look - (np.bincount(column, value * g[row], minlength=m) + s.penalty / 100 * look) / (curve + s.penalty / 100)
        bias = look_b - g.sum() / bias_curve
        pull = t / (t + 3)
        look, look_b = weight + pull * (weight - w0), bias + pull * (bias - b0)
        w0, b0 = weight, bias
    return weight * ratio, bias


def score(docs: DataFrame, model: Model, *, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a double column ``output``: the probability of label 1."""
    s = model.settings
    shared = docs.sparkSession.sparkContext.broadcast((model.slots(), model.weight, model.intercept))
    names = [c for c in docs.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weight, intercept = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, intercept)
            for a, b, data, offsets in chunks(batch.column(names.index(text))):
                owner, feature = _found(data, offsets, s, slots)
                out[a:b] += np.bincount(owner, weight[feature], minlength=b - a)
            p = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, output])

    own = docs.select(*[F.col(f"`{c}`") for c in names])
    return in_arrow(own, run, T.StructType([*own.schema, T.StructField(output, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, settings=settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
