"""Balanced logistic regressions of many partitions, folds and penalties, fitted together by Newton steps.

A problem is a partition, a part of it that is left out, a penalty and a space (``operators.gram``). One job takes one step of
all problems that are still open: tasks add up loss, gradient and second derivatives of each problem over their rows, Spark adds
the sums, and steps are solved where the sums are. Steps and losses reach the driver, matrices do not. The number of jobs is
that of the slowest problem's steps, whatever the number of partitions, folds and penalties; sets of problems whose sums or
spaces would pass ``WAVE`` bytes are fitted one after another.

A step that does not lower the loss is halved. A refit starts from the fits of the folds. Results do not depend on the layout of
rows but for the last digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.folds import holdout, stratified_folds
from loomspark.operators.gram import STEP, Gram, Space, centre, doubles, grams, spaces
from loomspark.operators.metrics import auroc

#: Newton steps at most.
ROUNDS = 100
#: Bytes of sums, and of spaces, of the problems that are fitted side by side.
WAVE = 1 << 28
#: Rows of a partition that one task takes, about.
TASK_ROWS = 25_000
#: The split without folds.
ALL = -1


@dataclass(frozen=True)
class Problem:
    """``left``: the fold of split ``split`` that is not fitted on, ALL for none. ``width``: columns of the space that are used."""

    part: int
    split: int
    left: int
    c: float
    space: tuple
    width: int


@dataclass
class Pool:
    """Rows (partition_id, y, folds, x, h) of all partitions, and how many there are by partition, split, fold and label.

    ``h`` is the hash of a row's key.
    """

    rows: DataFrame
    splits: list[tuple]
    counts: dict[tuple[int, int, int, int], int]
    about: np.ndarray
    spaces: dict[tuple, Space] = field(default_factory=dict)
    scored: dict[Problem, float] = field(default_factory=dict)

    @property
    def parts(self) -> list[int]:
        return sorted({k[0] for k in self.counts})

    def size(self, part: int, split: int, left: int) -> tuple[int, int]:
        """(negatives, positives) of a training part."""
        own = lambda y: sum(n for (p, s, f, label), n in self.counts.items() if p == part and s == max(split, 0) and label == y and f != left)
        return own(0), own(1)


def pool(df: DataFrame, parts: DataFrame, key: str, label: str, features: str, splits: list[tuple]) -> Pool:
    """The rows of ``parts`` (partition_id, key, label) with their features and, for each split, their fold; persisted.

    A split is (k, seed), or (2, seed, share) for a hold-out part, which is fold 1.
    """
    placed = parts.select(F.col("partition_id").cast("int").alias("partition_id"), key, F.col(label).cast("int").alias("y")).withColumn("folds", F.array().cast("array<int>"))
    for k, seed, *share in splits:
        if share:
            placed = holdout(placed, key, "y", share[0], seed, ["partition_id"]).withColumn("fold", F.col("held_out").cast("int")).drop("held_out")
        else:
            placed = stratified_folds(placed, key, "y", k, seed, ["partition_id"])
        placed = placed.withColumn("folds", F.concat("folds", F.array("fold"))).drop("fold")
    x = F.transform(features, lambda v: v.cast("double")).alias("x")
    joined = placed.join(df.select(key, x), key)
    most = parts.groupBy("partition_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salt = F.pmod(F.xxhash64(key), F.lit(max(1, -(-most // TASK_ROWS))))
    rows = joined.withColumn("_s", salt).repartition("partition_id", "_s").select("partition_id", "y", "folds", "x", F.xxhash64(key).alias("h")).persist()
    each = rows.select("partition_id", "y", F.posexplode("folds").alias("split", "fold")).groupBy("partition_id", "split", "fold", "y").agg(F.count("*").alias("n"))
    counts = {(r["partition_id"], r["split"], r["fold"], r["y"]): r["n"] for r in each.collect()}  # two rows for each fold
    for p in sorted({k[0] for k in counts}):
        if len({k[3] for k in counts if k[0] == p}) < 2:
            rows.unpersist()
            raise ValueError("both classes are needed")
    return Pool(rows, splits, counts, centre(rows, "x"))


def find_spaces(p: Pool, parts: list[int], splits: list[int]) -> None:
    """Spaces of each part's training parts, by one scan: keys ("plain" or "components", part, split, left), left = ALL the whole."""
    own = p.rows.filter(F.col("partition_id").isin(parts)) if parts != p.parts else p.rows
    dealt = own.select("partition_id", "x", F.posexplode("folds").alias("split", "fold")).filter(F.col("split").isin(splits))
    sums = grams(dealt, ["partition_id", "split", "fold"], "x", p.about)
    about = p.about

    def decompose(t: pa.Table) -> pa.Table:
        by_fold = defaultdict(lambda: ([], []))
        for f, i, v in zip(t["fold"].to_pylist(), t["i"].to_pylist(), t["v"].to_pylist(), strict=True):
            by_fold[f][0].append(i)
            by_fold[f][1].append(v)
        made = {f: Gram.of(*rows) for f, rows in by_fold.items()}
        whole = None
        for f in sorted(made):
            whole = made[f] if whole is None else whole + made[f]
        out = {k: [] for k in ("partition_id", "split", "left", "kind", "about", "basis", "width", "shares")}
        for left in [ALL, *sorted(made)]:
            part = whole if left == ALL else whole - made[left]
            if part.n < 1:
                continue
            for kind, s in zip(("plain", "components"), spaces(part, about), strict=True):
                row = (t["partition_id"][0].as_py(), t["split"][0].as_py(), left, kind, s.about, s.basis.astype(float).ravel(), 0 if s.basis.ndim == 1 else s.basis.shape[1], np.zeros(0) if s.shares is None else s.shares)
                for c, v in zip(out.values(), row, strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.float64())]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    schema = "partition_id long, split long, left long, kind string, about array<double>, basis array<double>, width long, shares array<double>"
    for r in sums.groupBy("partition_id", "split").applyInArrow(decompose, schema).toLocalIterator():  # a matrix for each part and fold
        basis = np.array(r["basis"])
        basis = basis.astype(np.int64) if not r["width"] else basis.reshape(len(r["about"]), r["width"])
        p.spaces[r["kind"], r["partition_id"], r["split"], r["left"]] = Space(np.array(r["about"]), basis, np.array(r["shares"]) if r["shares"] else None)


def _softplus(m: np.ndarray) -> np.ndarray:
    return np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m)))


def _sigmoid(m: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(m))
    return np.where(m >= 0, 1, e) / (1 + e)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, y, folds, x) of a few thousand rows of one part each."""
    for b in batches:
        part, y = b.column(0).to_numpy(), b.column(1).to_numpy()
        folds, x = doubles(b.column(2)).astype(int), doubles(b.column(3))
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            for at in range(0, len(own), STEP):
                rows = own[at : at + STEP]
                yield int(p), y[rows], folds[rows], x[rows]


def _by_part(problems: list[Problem], open_: list[int]) -> dict[int, dict[tuple, list[int]]]:
    out: dict[int, dict[tuple, list[int]]] = {}
    for j in open_:
        out.setdefault(problems[j].part, {}).setdefault(problems[j].space, []).append(j)
    return out


def _step(p: Pool, problems: list[Problem], weights: np.ndarray, trial: dict[int, np.ndarray], known) -> dict[int, tuple[float, float, np.ndarray]]:
    """(loss, decrement, direction) of each open problem at its trial coefficients, intercept first; one job."""
    wanted = _by_part(problems, list(trial))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part, y, folds, x in _batches(batches):
            for space, own in wanted.get(part, {}).items():
                z = known.value[space].apply(x)
                for j in own:
                    q = problems[j]
                    a = np.column_stack([np.ones(len(z)), z[:, : q.width]])
                    w = weights[j][y]
                    if q.left != ALL:
                        w = w * (folds[:, q.split] != q.left)
                    m = a @ trial[j]
                    at = _sigmoid(m)
                    h = (a * (w * at * (1 - at))[:, None]).T @ a
                    new = np.concatenate([[(w * (_softplus(m) - y * m)).sum()], a.T @ (w * (at - y)), h[np.triu_indices(len(h))]])
                    held[j] = new if j not in held else held[j] + new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["j", "v"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for j, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, beta, weight = np.array(v), trial[j], 1 / problems[j].c
                k = len(beta)
                loss, g, h = v[0] + weight * (beta[1:] @ beta[1:]) / 2, v[1 : k + 1].copy(), np.zeros((k, k))
                h[np.triu_indices(k)] = v[k + 1 :]
                h = h + np.triu(h, 1).T
                g[1:] += weight * beta[1:]
                h[np.arange(1, k), np.arange(1, k)] += weight
                h[np.arange(k), np.arange(k)] += 1e-13 * np.trace(h) / k
                d = -np.linalg.solve(h, g)
                rows.append((j, loss, float(-(g @ d)), d))
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["j", "loss", "decrement", "d"])

    parts = list(wanted)
    rows = p.rows if parts == p.parts else p.rows.filter(F.col("partition_id").isin(parts))
    added = rows.mapInArrow(sums, "j int, v array<double>").groupBy("j").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    got = added.mapInArrow(solved, "j int, loss double, decrement double, d array<double>").collect()  # a row for each problem
    return {r["j"]: (r["loss"], r["decrement"], np.array(r["d"])) for r in got}


def _waves(p: Pool, problems: list[Problem]) -> list[list[int]]:
    """Numbers of the problems that are fitted side by side."""
    out, size, seen = [[]], 0, set()
    for j, q in enumerate(problems):
        more = 4 * (q.width + 2) ** 2 + (0 if q.space in seen else p.spaces[q.space].basis.nbytes)
        if out[-1] and size + more > WAVE:
            out.append([])
            size, seen = 0, set()
            more = 4 * (q.width + 2) ** 2 + p.spaces[q.space].basis.nbytes
        out[-1].append(j)
        seen.add(q.space)
        size += more
    return out


def solve(p: Pool, problems: list[Problem], start: list[np.ndarray] | None = None, *, balanced: bool = True, tolerance: float = 1e-13) -> list[np.ndarray]:
    """Each problem's coefficients, intercept first: the least sum of weighted losses plus half their squares over c."""
    beta = [np.zeros(q.width + 1) if start is None else start[j] for j, q in enumerate(problems)]
    weights = np.ones((len(problems), 2))
    for j, q in enumerate(problems):
        neg, pos = p.size(q.part, q.split, q.left)
        if not neg or not pos:
            raise ValueError("both classes are needed")
        if balanced:
            weights[j] = (neg + pos) / (2 * neg), (neg + pos) / (2 * pos)
    for wave in _waves(p, problems):
        known = p.rows.sparkSession.sparkContext.broadcast({problems[j].space: p.spaces[problems[j].space] for j in wave})  # WAVE bytes at most, or one space
        trial = {j: beta[j] for j in wave}
        best: dict[int, tuple[float, np.ndarray, float]] = {}
        for _ in range(ROUNDS):
            for j, (loss, decrement, d) in _step(p, problems, weights, trial, known).items():
                if j in best and not loss <= best[j][0] + 1e-12 * (1 + abs(best[j][0])):
                    lowest, d, t = best[j]
                    best[j] = (lowest, d, t / 2)
                    trial[j] = beta[j] + t / 2 * d
                    if t < 1e-8:
                        del trial[j]
                    continue
                beta[j] = trial[j]
                if decrement <= tolerance * (1 + loss):
                    beta[j] = trial.pop(j) + d
                    continue
                best[j] = (loss, d, 1.0)
                trial[j] = beta[j] + d
            if not trial:
                break
        known.unpersist()
    return beta


def held_scores(p: Pool, problems: list[Problem], beta: list[np.ndarray]) -> DataFrame:
    """(j, y, p1): each problem's probabilities for the rows of the fold that it left out."""
    wanted, known = _by_part(problems, list(range(len(problems)))), p.rows.sparkSession.sparkContext.broadcast({q.space: p.spaces[q.space] for q in problems})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y, folds, x in _batches(batches):
            for space, own in wanted.get(part, {}).items():
                z = known.value[space].apply(x)
                for j in own:
                    q = problems[j]
                    at = folds[:, q.split] == q.left
                    if not at.any():
                        continue
                    p1 = np.round(_sigmoid(beta[j][0] + z[at][:, : q.width] @ beta[j][1:]), 12)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p1), j, np.int32)), pa.array(y[at].astype(np.int32)), pa.array(p1)], ["j", "y", "p1"])

    return p.rows.filter(F.col("partition_id").isin(list(wanted))).mapInArrow(run, "j int, y int, p1 double")


def fold_aurocs(p: Pool, problems: list[Problem], beta: list[np.ndarray]) -> np.ndarray:
    """The AUROC of each problem on the fold that it left out; nan where that has one class."""
    out = np.full(len(problems), np.nan)
    for wave in _waves(p, problems):
        some = [problems[j] for j in wave]
        for r in auroc(held_scores(p, some, [beta[j] for j in wave]), "p1", "y", ["j"]).collect():  # a row for each problem
            out[wave[r["j"]]] = np.nan if r["auroc"] is None else r["auroc"]
    return out


def calibrations(scores: DataFrame, grid: list[float], k: int = 4) -> dict[int, tuple[float, float, float]]:
    """(slope, intercept, c) by group of scores (j, y, p1): one-feature logistic regressions from raw to calibrated probability.

    Of several penalties the one with the least log-loss is taken: each row is scored by a fit on the other folds of the
    pooled scores. Rows of equal score and label are in one fold.
    """
    fold = F.pmod(F.xxhash64("p1", "y"), F.lit(k)).cast("int")
    rows = scores.select(F.col("j").cast("int").alias("partition_id"), F.col("y").cast("int").alias("y"), F.array(fold).alias("folds"), F.array("p1").alias("x")).persist()
    try:
        each = rows.groupBy("partition_id", F.get("folds", F.lit(0)).alias("fold"), "y").agg(F.count("*").alias("n")).collect()
        p = Pool(rows, [(k, 0)], {(r["partition_id"], 0, r["fold"], r["y"]): r["n"] for r in each}, np.zeros(1))
        p.spaces = {("p1", part): Space(np.zeros(1), np.array([0])) for part in p.parts}
        best = dict.fromkeys(p.parts, grid[0])
        if len(grid) > 1:
            made = [Problem(part, 0, f, c, ("p1", part), 1) for part in p.parts for f in range(k) for c in grid if min(p.size(part, 0, f)) > 0]
            beta = solve(p, made, balanced=False)
            own = F.when(F.col("y") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
            losses = held_scores(p, made, beta).groupBy("j").agg(F.sum(-F.log(F.greatest(own, F.lit(1e-15)))).alias("l")).collect()  # a row for each problem
            total: dict[tuple[int, float], float] = defaultdict(float)
            for r in losses:
                total[made[r["j"]].part, made[r["j"]].c] += r["l"]
            for part in p.parts:
                best[part] = min(grid, key=lambda c, part=part: (round(total[part, c], 9), c)) if any((part, c) in total for c in grid) else grid[0]
        final = [Problem(part, ALL, ALL, best[part], ("p1", part), 1) for part in p.parts]
        return {q.part: (float(b[1]), float(b[0]), q.c) for q, b in zip(final, solve(p, final, balanced=False), strict=True)}
    finally:
        rows.unpersist()


def _mean(values: np.ndarray) -> float:
    return float(np.nanmean(values)) if np.isfinite(values).any() else float("nan")


def reduction_helps(p: Pool, parts: list[int], split: int = 0, share: float = 0.9, slack: float = 0.02) -> dict[int, bool]:
    """For each partition whether mean AUROC over the folds with components is above that without, or within ``slack`` of it."""
    find_spaces(p, parts, [split])
    folds = range(p.splits[split][0])
    made = []
    for part in parts:
        for f in folds:
            plain, components = ("plain", part, split, f), ("components", part, split, f)
            made.append(Problem(part, split, f, 1.0, plain, p.spaces[plain].width()))
            made.append(Problem(part, split, f, 1.0, components, p.spaces[components].width(share)))
    scores = fold_aurocs(p, made, solve(p, made)).reshape(len(parts), len(folds), 2)
    return {part: _mean(scores[i, :, 1]) >= _mean(scores[i, :, 0]) - slack for i, part in enumerate(parts)}


def share_scores(p: Pool, shares: dict[int, float], splits: list[int]) -> dict[int, float]:
    """For each partition the mean AUROC of its share of variance over the folds of all splits.

    Spaces are found once, by one scan for all shares and splits; equal numbers of components are fitted once.
    """
    missing = sorted({part for part in shares for s in splits if ("components", part, s, 0) not in p.spaces})
    if missing:
        find_spaces(p, missing, splits)
    made = []
    for part, share in shares.items():
        for split in splits:
            for f in range(p.splits[split][0]):
                key = ("components", part, split, f)
                made.append(Problem(part, split, f, 1.0, key, p.spaces[key].width(share)))
    fresh = [q for q in made if q not in p.scored]
    p.scored |= zip(fresh, fold_aurocs(p, fresh, solve(p, fresh)), strict=True) if fresh else {}
    return {part: _mean(np.array([p.scored[q] for q in made if q.part == part])) for part in shares}


@dataclass
class Linear:
    """A fitted logistic regression over the features as they are, and what its fit recorded."""

    weights: np.ndarray
    intercept: float
    recorded: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ self.weights + self.intercept)


def fit_all(p: Pool, shares: dict[int, float | None], grid: list[float], split: int = 0) -> dict[int, Linear]:
    """A model for each partition: C by mean AUROC over the folds, in the partition's own space, then a refit on all its rows."""
    parts, k = sorted(shares), p.splits[split][0]
    missing = [part for part in parts if ("plain", part, split, ALL) not in p.spaces]
    if missing:
        find_spaces(p, missing, [split])
    key = lambda part: ("plain" if shares[part] is None else "components", part, split, ALL)
    width = lambda part: p.spaces[key(part)].width(shares[part])
    made = [Problem(part, split, f, c, key(part), width(part)) for part in parts for f in range(k) for c in grid]
    beta = solve(p, made)
    table = fold_aurocs(p, made, beta).reshape(len(parts), k, len(grid))
    best, start = [], []
    for i in range(len(parts)):
        means = [_mean(table[i, :, c]) for c in range(len(grid))]
        best.append(int(np.nanargmax(means)) if np.isfinite(means).any() else 0)
        start.append(np.mean([beta[(i * k + f) * len(grid) + best[i]] for f in range(k)], axis=0))
    final = [Problem(part, ALL, ALL, grid[b], key(part), width(part)) for part, b in zip(parts, best, strict=True)]
    out = {}
    for i, (q, b) in enumerate(zip(final, solve(p, final, start), strict=True)):
        over = np.array([_mean(table[i, f]) for f in range(k)])
        recorded = {"best_c_score": _mean(table[i, :, best[i]]), "mean_score_all_c": _mean(over), "std_score_all_c": float(np.nanstd(over)) if np.isfinite(over).any() else float("nan"), "c": q.c, "pca": shares[q.part]}
        w, intercept = p.spaces[q.space].back(b[1:], float(b[0]))
        out[q.part] = Linear(w, intercept, recorded)
    return out
