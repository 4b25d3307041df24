"""Gram matrices of groups of rows: mergeable sums, from which scaling, components and least squares follow.

A task adds up, for each group that it meets, the count and for each feature i its sum and its products with the features from
i on, all about a common centre (any vector near the data serves, so that no digits are lost to large means). Partial sums
are rows (group, i, values) which Spark adds; a part of several groups is the sum of theirs, and a training part the total
less what is left out. Nothing is made for each cell, and one scan serves all groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of partial sums that a task holds before it passes them on.
HELD = 1 << 26
#: Rows that are multiplied at once.
STEP = 4096


def doubles(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.flatten()
    width = len(flat) // max(len(column), 1)
    if column.null_count or flat.null_count or (len(column) and len(flat) != width * len(column)):
        raise ValueError("features are arrays of one length without nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def centre(df: DataFrame, features: str) -> np.ndarray:
    """The mean of the features, in one pass."""
    vector = array_to_vector(F.transform(features, lambda v: v.cast("double")))
    mean = df.select(Summarizer.mean(vector).alias("m")).first()["m"]
    return np.zeros(0) if mean is None else mean.toArray()


def partial_sums(x: np.ndarray) -> list[np.ndarray]:
    """For each feature i: the count, its sum, its products with the features from i on."""
    s, g = x.sum(0), x.T @ x
    return [np.concatenate([[len(x), s[i]], g[i, i:]]) for i in range(x.shape[1])]


def grams(df: DataFrame, groups: list[str], features: str, about: np.ndarray) -> DataFrame:
    """(groups, i, v): for each group and feature i its sums (count, sum, products with features i, i + 1, ...) about ``about``.

    Groups are whole numbers, few in a task (``HELD`` bytes of sums are held, then passed on).
    """
    names = [f"_g{k}" for k in range(len(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, rows in held.items():
                head = [pa.array(np.full(len(rows), v, np.int64)) for v in g]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows, pa.list_(pa.float64()))], [*names, "i", "v"])
            held.clear()

        for b in batches:
            x = doubles(b.column(len(groups)))
            if not len(x):
                continue
            keys = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(groups))]) if groups else np.zeros((len(x), 0), np.int64)
            distinct, back = np.unique(keys, axis=0, return_inverse=True) if groups else (keys[:1], np.zeros(len(x), np.int64))
            for d, g in enumerate(distinct):
                own = x[back.ravel() == d]
                for at in range(0, len(own), STEP):
                    new, old = partial_sums(own[at : at + STEP] - about), held.get(tuple(g))
                    held[tuple(g)] = new if old is None else [a + c for a, c in zip(old, new, strict=True)]
            if len(held) * 4 * x.shape[1] ** 2 > HELD:
                yield from out()
        yield from out()

    rows = df.select(*[F.col(g).cast("long").alias(n) for g, n in zip(groups, names, strict=True)], F.transform(features, lambda v: v.cast("double")).alias("x"))
    schema = "".join(f"{n} long, " for n in names) + "i int, v array<double>"
    added = rows.mapInArrow(run, schema).groupBy(*names, "i").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    return added.select(*[F.col(n).alias(g) for n, g in zip(names, groups, strict=True)], "i", vector_to_array("v").alias("v"))


@dataclass
class Gram:
    """Count, sums and products of a part, about a centre."""

    n: float
    s: np.ndarray
    g: np.ndarray

    @classmethod
    def of(cls, i: np.ndarray, v: list[np.ndarray]) -> Gram:
        """From the rows (i, v) of one group."""
        width = len(i)
        s, g, n = np.zeros(width), np.zeros((width, width)), 0.0
        for k, row in zip(i, v, strict=True):
            n, s[k], g[k, k:] = row[0], row[1], row[2:]
        return cls(n, s, np.triu(g) + np.triu(g, 1).T)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.s + other.s, self.g + other.g)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.s - other.s, self.g - other.g)

    def mean(self) -> np.ndarray:
        """The mean, less the centre."""
        return self.s / self.n

    def covariance(self) -> np.ndarray:
        """The population covariance."""
        m = self.mean()
        return self.g / self.n - np.outer(m, m)


@dataclass
class Space:
    """An affine map of features: less a centre, then either some of the columns or a basis of components."""

    about: np.ndarray
    basis: np.ndarray
    #: Of components, the share of variance that those up to each one explain.
    shares: np.ndarray | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.about)[:, self.basis] if self.basis.ndim == 1 else (x - self.about) @ self.basis

    def width(self, share: float | None = None) -> int:
        """Columns of the space, or the fewest components that explain more than ``share``."""
        most = len(self.basis) if self.basis.ndim == 1 else self.basis.shape[1]
        if share is None or self.shares is None:
            return most
        return min(most, int(np.searchsorted(self.shares, share, "right")) + 1)

    def back(self, weights: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """Weights and intercept over the features as they are, for ones over the first columns of the space."""
        w = np.zeros(len(self.about))
        if self.basis.ndim == 1:
            w[self.basis[: len(weights)]] = weights
        else:
            w = self.basis[:, : len(weights)] @ weights
        return w, float(intercept - self.about @ w)


def spaces(g: Gram, about: np.ndarray) -> tuple[Space, Space]:
    """(varying features, whitened components) of a part: constants go; the second scales, rotates and scales again."""
    c = g.covariance()
    variance = np.diag(c)
    # a constant feature's variance is rounding only
    size = np.abs(about) + np.sqrt(np.abs(np.diag(g.g)) / max(g.n, 1))
    keep = np.flatnonzero(variance > 1e-14 * np.maximum(size, 1e-150) ** 2)
    mean = about + g.mean()
    plain = Space(mean, keep)
    if len(keep) < 2:
        return plain, plain
    deviation = np.sqrt(variance[keep])
    values, vectors = np.linalg.eigh(c[np.ix_(keep, keep)] / np.outer(deviation, deviation))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    rank = max(1, int((values > 1e-12 * values[0]).sum()))
    basis = np.zeros((len(mean), rank))
    basis[keep] = vectors[:, :rank] / deviation[:, None] / np.sqrt(values[:rank])
    return plain, Space(mean, basis, np.cumsum(values)[:rank] / values.sum())


def covariances(df: DataFrame, features: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, i, j, cov) for i <= j: population covariances within each group."""
    groups = groups or []
    rows = grams(df, groups, features, centre(df, features))
    sums = rows.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("i", F.get("v", F.lit(1)).alias("s")))).alias("s")).select(*groups, F.transform("s", lambda r: r["s"]).alias("s"))  # a number for each feature
    n = F.get("v", F.lit(0))
    cov = F.transform(F.slice("v", 3, F.size("v")), lambda g, d: F.struct((F.col("i") + d).alias("j"), (g / n - F.get("s", F.col("i")) / n * F.get("s", F.col("i") + d) / n).alias("cov")))
    met = rows.join(sums, groups) if groups else rows.crossJoin(F.broadcast(sums))  # one row
    return met.select(*groups, "i", F.inline(cov))
