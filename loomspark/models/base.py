"""Decisions, searches and fits of all partitions of a pool: reduction, logistic regressions, calibrated forests."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.models import forest as T
from loomspark.models.linear import ALL, Linear, Pool, calibrations, find_spaces, fit_all, reduction_helps, share_scores
from loomspark.models.search import Range, Search
from loomspark.operators.features import vectors
from loomspark.operators.gram import Space
from loomspark.operators.metrics import auroc

#: Inverse strengths of the L2 penalty that are tried: ten even steps of the logarithm from 1e-4 to 1e4.
C_GRID = [10 ** (-4 + 8 * i / 9) for i in range(10)]
#: The share of variance without a search.
PCA_SHARE = 0.9
#: Shares of variance that a search looks at.
PCA_SHARES = Range(0.8, 0.99)
#: Sets of folds over which a share is judged.
REPEATS = 3


@dataclass(frozen=True)
class Options:
    """A fit's options; ``pca`` is True, False, or None to decide, ``leaves`` None for no bound."""

    num_trials: int = 5
    num_splits: int = 3
    test_size: float = 0.25
    pca: bool | None = None
    seed: int = 42
    trees: int = 100
    max_features: float | None = None
    leaves: int | None = None
    max_depth: int = T.DEEPEST
    shape: str = "logistic_regression"


def weighted(df: DataFrame, label: str) -> DataFrame:
    """``df`` with a column weight that balances the classes."""
    r = df.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    n, p = r["n"], r["p"] or 0
    if not p or p == n:
        raise ValueError("both classes are needed")
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))


def logistic(df: DataFrame, vector: str, label: str, c: float):
    """One balanced L2 logistic regression by Spark's own optimiser, with the penalty of strength 1 / (c n)."""
    n = df.count()
    return LogisticRegression(featuresCol=vector, labelCol=label, weightCol="weight", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9, probabilityCol="probability").fit(weighted(df, label))


def positive(model, df: DataFrame, name: str = "p1") -> DataFrame:
    """``df`` with the probability of label 1."""
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c not in df.columns]
    return model.transform(df).withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop(*drop)


def with_vector(df: DataFrame, features: str) -> DataFrame:
    return vectors(df, features, "x")


# ---- decisions


def splits(o: Options) -> list[tuple]:
    """Splits of a fit's pool: for the decision and the search over C; repeats for the search over shares; hold-out parts."""
    shares = [(3, o.seed + r) for r in range(REPEATS if o.pca is not False and o.num_trials else 0)]
    held = [(2, o.seed + r, o.test_size) for r in range(o.num_splits if o.shape == "random_forest" else 0)]
    return [(max(3, int(1 / o.test_size)), o.seed), *shares, *held]


def _numbers(p: Pool, held: bool) -> list[int]:
    """Numbers of the pool's splits for hold-out parts, or for shares."""
    return [i for i, s in enumerate(p.splits) if i and (len(s) == 3) == held]


def decide(p: Pool, o: Options, votes: int = 4) -> dict[int, float | None]:
    """For each partition the share of variance that its reduction keeps, or None for no reduction.

    The first ``votes`` partitions decide for themselves, their majority for all others (a tie: no reduction). Shares are
    searched over whole hundredths, partitions side by side.
    """
    parts = p.parts
    if o.pca is None:
        own = reduction_helps(p, parts[:votes])
        most = 2 * sum(own.values()) > len(own)
        use = {part: own.get(part, most) for part in parts}
    else:
        use = dict.fromkeys(parts, bool(o.pca))
    out: dict[int, float | None] = {part: PCA_SHARE if use[part] else None for part in parts}
    searches = {part: Search({"share": PCA_SHARES}, {"share": 0.99}, o.num_trials, o.seed) for part in parts if use[part] and o.num_trials}
    while open_ := {part: s for part, s in searches.items() if not s.over}:
        asked = {part: round(s.ask()["share"], 2) for part, s in open_.items()}
        scores = share_scores(p, asked, _numbers(p, False))
        for part, s in open_.items():
            s.tell({"share": asked[part]}, scores[part])
    return out | {part: s.best["share"] for part, s in searches.items()}


def forest_space(o: Options, width: int, rows: int) -> tuple[dict[str, Range], dict]:
    """(ranges, first trial): trees within 100 of the default and 10 to 1000, features within 0.2 of it and 0.05 to 1, leaves
    from an octave below it (16 at least) to an octave above it or as many as the training rows. What has no number by default
    (leaves without a bound, the square root of the features) is not searched.
    """
    first = {"trees": o.trees, "max_features": o.max_features, "leaves": o.leaves}
    space = {"trees": Range(max(10, o.trees - 100), min(1000, o.trees + 100), whole=True)}
    if o.max_features is not None:
        space["max_features"] = Range(max(0.05, o.max_features - 0.2), min(1.0, o.max_features + 0.2))
    if o.leaves is not None:
        train = int(rows * (1 - o.test_size))
        octave = math.log2(max(o.leaves, 1))
        low, high = min(round(2 ** max(4, octave - 1)), train), max(round(2 ** min(10, octave + 1)), train, o.leaves)
        space["leaves"] = Range(max(2, min(low, high)), max(2, high), whole=True, log=True)
    return space, first


# ---- fits


def fit_linear(p: Pool, o: Options, votes: int = 4) -> dict[int, Linear]:
    """A logistic regression for each partition."""
    return fit_all(p, decide(p, o, votes), C_GRID)


def forest_rows(p: Pool, shares: dict[int, float | None]) -> T.Binned:
    """The pool's rows in the spaces of the reductions, cut into bins."""
    find_spaces(p, p.parts, [0])
    spaces = {part: p.spaces["plain" if shares[part] is None else "components", part, 0, ALL] for part in p.parts}
    widths = {part: s.width(shares[part]) for part, s in spaces.items()}
    # features as they are need no centre
    spaces = {part: Space(np.zeros_like(s.about), s.basis) if s.basis.ndim == 1 else s for part, s in spaces.items()}
    return T.binned(p, spaces, widths)


def fit_forests(p: Pool, o: Options, votes: int = 4) -> dict[int, T.Forest]:
    """A calibrated forest for each partition.

    Trials are judged on one hold-out part, ``num_splits`` times with other seeds, without class weights. The calibrator is
    fitted to the pooled scores of the chosen forest's hold-out parts, one for each seed: with a reduction at C = 1, without
    one at the C of least log-loss. Without hold-out parts it is fitted to scores of the training rows at C = 1e-6.
    """
    held = _numbers(p, True)
    if o.num_trials and not held:
        raise ValueError("a search needs one split or more")
    shares = decide(p, o, votes)
    d = forest_rows(p, shares)
    try:
        made = lambda part, settings, **more: T.Grow(part, **({"depth": o.max_depth, "seed": o.seed} | settings | more))
        rows = {part: sum(p.size(part, 0, ALL)) for part in p.parts}
        searches = {part: Search(*forest_space(o, d.width[part], rows[part]), o.num_trials, o.seed) for part in p.parts}
        while o.num_trials and (open_ := {part: s for part, s in searches.items() if not s.over}):
            asked = {part: s.ask() for part, s in open_.items()}
            problems = [made(part, settings, split=held[0], left=1, balanced=False, seed=o.seed + r) for part, settings in asked.items() for r in range(len(held))]
            scores = dict(_aurocs(d, problems, T.grow(d, problems)))
            for i, (part, s) in enumerate(open_.items()):
                s.tell(asked[part], float(np.mean([scores.get(i * len(held) + r, math.nan) for r in range(len(held))])))
        chosen = {part: s.best for part, s in searches.items()}
        final = [made(part, chosen[part], split=ALL, left=ALL) for part in p.parts]
        grown = T.grow(d, final)
        judged: dict[int, list[float]] = {}
        if held:
            parts = [made(part, chosen[part], split=s, left=1) for part in p.parts for s in held]
            trees = T.grow(d, parts)
            for j, a in _aurocs(d, parts, trees):
                judged.setdefault(parts[j].part, []).append(a)
            of_part = F.element_at(F.array(*[F.lit(q.part) for q in parts]), F.col("j") + 1)
            scores = T.held_scores(d, parts, trees).withColumn("j", of_part)
            reduced = [part for part in p.parts if shares[part] is not None]
            plain = [part for part in p.parts if shares[part] is None]
            found = (calibrations(scores.filter(F.col("j").isin(reduced)), [1.0]) if reduced else {}) | (calibrations(scores.filter(F.col("j").isin(plain)), C_GRID) if plain else {})
        else:
            of_part = F.element_at(F.array(*[F.lit(q.part) for q in final]), F.col("j") + 1)
            found = calibrations(T.held_scores(d, final, grown).withColumn("j", of_part), [1e-6])
        out = {}
        for q, trees in zip(final, grown, strict=True):
            slope, intercept, c = found[q.part]
            recorded = chosen[q.part] | {"pca": shares[q.part], "held_out": judged.get(q.part, []), "c": c, "trials": len(searches[q.part].seen)}
            out[q.part] = T.Forest(d.space[q.part], d.width[q.part], d.edges[q.part], trees, slope, intercept, recorded)
        return out
    finally:
        d.rows.unpersist()


def _aurocs(d: T.Binned, problems: list[T.Grow], grown: list[T.Flat]) -> list[tuple[int, float]]:
    rows = auroc(T.held_scores(d, problems, grown), "p1", "y", ["j"]).collect()  # a row for each problem
    return sorted((r["j"], math.nan if r["auroc"] is None else r["auroc"]) for r in rows)
