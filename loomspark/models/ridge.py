"""Ridge regression whose penalty is chosen by the exact leave-one-out error, from one Gram matrix.

One scan adds up the products of features and target, one eigendecomposition of them gives the coefficients of every penalty,
and a second scan adds up the squared leave-one-out residuals, residual / (1 - leverage), of all penalties at once. There is
no split and no fit for each penalty, and nothing depends on the layout of rows but the last digits.

Minimised is the mean squared error plus the penalty times the squares of the coefficients of the scaled features; the
intercept is free.
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

from loomspark.operators.gram import STEP, Gram, centre, doubles, grams, spaces

GRID = [0.001, 0.01, 0.1, 1.0, 10.0]


@dataclass
class Ridge:
    """Coefficients over the features as they are, and what the fit recorded: penalty, leave-one-out mean squared errors."""

    weights: np.ndarray
    intercept: float
    recorded: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept


def fit_ridge(df: DataFrame, features: str, target: str, groups: str | None = None, *, share: float | None = None, grid: list[float] | None = None) -> dict[int, Ridge]:
    """A model for each group (a whole-number column; None: one, number 0) by the leave-one-out error of each penalty.

    With a ``share`` features are first reduced to the components that explain that share of their variance.
    """
    grid = grid or GRID
    group = F.lit(0) if groups is None else F.col(groups)
    rows = df.select(group.cast("int").alias("g"), F.concat(F.transform(features, lambda v: v.cast("double")), F.array(F.col(target).cast("double"))).alias("x"))
    about = centre(rows, "x")
    made: dict[int, tuple] = {}
    held: dict[int, tuple[list, list]] = {}
    for r in grams(rows, ["g"], "x", about).toLocalIterator():  # a matrix for each group
        i, v = held.setdefault(r["g"], ([], []))
        i.append(r["i"])
        v.append(r["v"])
    for g, (i, v) in held.items():
        whole = Gram.of(np.array(i), v)
        x = Gram(whole.n, whole.s[:-1], whole.g[:-1, :-1])
        plain, components = spaces(x, about[:-1])
        # components are scaled and uncorrelated: the space diagonalises the products, unless features are too few to rotate
        full = components if components.basis.ndim == 2 else None
        mean_y = about[-1] + whole.s[-1] / whole.n
        across = whole.g[:-1, -1] / whole.n - whole.s[:-1] / whole.n * whole.s[-1] / whole.n
        if full is None:
            scale = np.sqrt(np.diag(x.covariance())[plain.basis])
            basis = np.zeros((len(across), len(scale)))
            basis[plain.basis, np.arange(len(scale))] = 1 / scale
            values = np.ones(len(scale))
        else:
            k = full.width(share)
            basis, values = full.basis[:, :k], np.ones(k)
            if share is None:  # scaled features are penalised, not whitened components: these have the variances
                values = 1 / (basis**2 * np.diag(x.covariance())[:, None]).sum(0)
        d = basis.T @ across
        betas = np.array([d / (1 + a / values) for a in grid])
        made[g] = (plain.about, basis, values, betas, mean_y, whole.n)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            own, x = b.column(0).to_numpy(), doubles(b.column(1))
            for g in np.unique(own):
                mean, basis, values, betas, mean_y, n = made[int(g)]
                for at in range(0, int((own == g).sum()), STEP):
                    rows = x[own == g][at : at + STEP]
                    z, y = (rows[:, :-1] - mean) @ basis, rows[:, -1]
                    loo = []
                    for a, beta in zip(grid, betas, strict=True):
                        lever = 1 / n + (z**2 / (1 + a / values)).sum(1) / n
                        loo.append((((y - mean_y - z @ beta) / np.maximum(1 - lever, 1e-12)) ** 2).sum())
                    sums[int(g)] = sums.get(int(g), 0) + np.array(loo)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["g", "v"])

    total = rows.mapInArrow(errors, "g int, v array<double>").groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    out = {}
    for r in total.collect():  # a row for each group
        mean, basis, values, betas, mean_y, n = made[r["g"]]
        mse = np.array(r["v"]) / n
        best = int(mse.argmin())
        w = basis @ betas[best]
        out[r["g"]] = Ridge(w, float(mean_y - mean @ w), {"penalty": grid[best], "loo_mse": {str(a): float(e) for a, e in zip(grid, mse, strict=True)}})
    return out
