"""Quick score: cross-validated AUROC of naive Bayes, for one table or for many groups of rows at once.

One scan gives sums of the feature vectors by group, fold and label; the sums of a training part are those of the other
folds. A model is one row for each group and fold; rows meet their model and are scored row by row, without a row for each
cell. Features are taken about their overall mean, so that large means cost no digits. Scores are rounded to 8 places before
ranking so that the order of summation cannot break a tie; a row that gets no score (a null or not finite feature) raises.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.features import is_integer_matrix
from loomspark.operators.folds import stratified_folds
from loomspark.operators.gram import centre
from loomspark.operators.metrics import auroc


def _pairwise(f, *columns: Column) -> Column:
    """``f`` over the places of arrays of one length."""
    return F.transform(F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(columns)]), lambda z: f(*[z[f"c{i}"] for i in range(len(columns))]))


def _training(rows: DataFrame, label: str, groups: list[str]) -> DataFrame:
    """(groups, fold, label, n, s, q): rows, sums and sums of squares of the rows outside each fold, arrays by feature."""
    square = array_to_vector(F.transform("_x", lambda v: v * v))
    own = rows.groupBy(*groups, "fold", label).agg(F.count("*").alias("n"), Summarizer.sum(array_to_vector("_x")).alias("s"), Summarizer.sum(square).alias("q"))
    each = rows.select(*groups, "fold").distinct()
    other = own.withColumnRenamed("fold", "_other")
    met = each.join(other, groups).filter("fold <> _other") if groups else each.crossJoin(other).filter("fold <> _other")  # k rows by 2 k
    total = met.groupBy(*groups, "fold", label).agg(F.sum("n").alias("n"), Summarizer.sum(F.col("s")).alias("s"), Summarizer.sum(F.col("q")).alias("q"))
    return total.select(*groups, "fold", label, "n", vector_to_array("s").alias("s"), vector_to_array("q").alias("q"))


def fold_scores(df: DataFrame, key: str, label: str, features: str, *, kind: str = "gaussian", k: int = 5, seed: int | str = 42, alpha: float = 1.0, groups: list[str] | None = None, about: list[float] | None = None) -> DataFrame:
    """(groups, key, fold, label, score): difference of the classes' log-likelihoods by the model of the other folds.

    ``about``: any vector near the features, their mean by default.
    """
    groups = groups or []
    if kind == "auto":
        kind = "bernoulli" if is_integer_matrix(df, key, features).first()["integral"] else "gaussian"
    if kind == "bernoulli":
        x = F.transform(features, lambda v: (v > 0).cast("double"))
    else:
        about = centre(df, features).tolist() if about is None else about
        x = F.zip_with(features, F.lit(about), lambda v, c: v.cast("double") - c)
    placed = stratified_folds(df.select(*groups, key, label, features), key, label, k, seed, groups).withColumn("_x", x).drop(features)
    t = _training(placed, label, groups)
    of = lambda c: F.max(F.when(F.col(label) == c, F.struct("n", "s", "q")))
    wide = t.groupBy(*groups, "fold").agg(of(0).alias("a"), of(1).alias("b"))
    if kind == "gaussian":
        n = F.col("a.n") + F.col("b.n")
        spread = lambda s, q, n: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
        whole = _pairwise(lambda s0, s1, q0, q1: spread(s0 + s1, q0 + q1, n), F.col("a.s"), F.col("b.s"), F.col("a.q"), F.col("b.q"))
        wide = wide.withColumn("_eps", F.greatest(1e-9 * F.array_max(whole), F.lit(1e-300)))  # where all features are constant
        fit = lambda c: _pairwise(lambda s, q: F.struct((s / F.col(f"{c}.n")).alias("m"), (spread(s, q, F.col(f"{c}.n")) + F.col("_eps")).alias("w")), F.col(f"{c}.s"), F.col(f"{c}.q"))
        term = lambda v, p: -0.5 * F.log(2 * F.lit(3.141592653589793) * p["w"]) - (v - p["m"]) * (v - p["m"]) / (2 * p["w"])
    else:
        fit = lambda c: F.transform(F.col(f"{c}.s"), lambda s: F.struct(((s + alpha) / (F.col(f"{c}.n") + 2 * alpha)).alias("m")))
        term = lambda v, p: F.when(v > 0, F.log(p["m"])).otherwise(F.log(1 - p["m"]))
    model = wide.select(*groups, "fold", fit("a").alias("_a"), fit("b").alias("_b"), F.log(F.col("b.n") / F.col("a.n")).alias("_prior"))
    joined = placed.join(model, [*groups, "fold"])  # a row for each group and fold
    terms = _pairwise(lambda v, a, b: term(v, b) - term(v, a), F.col("_x"), F.col("_a"), F.col("_b"))
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    score = F.round(total + F.col("_prior"), 8)
    sound = score.isNotNull() & ~F.isnan(score)
    return joined.select(*groups, key, "fold", label, F.when(sound, score).otherwise(F.raise_error(F.lit("a row has no score: are its features null or not finite?"))).alias("score"))


def quick_auroc(df: DataFrame, key: str, label: str, features: str, *, groups: list[str] | None = None, **options) -> DataFrame:
    """(groups, fold, auroc) of each fold."""
    return auroc(fold_scores(df, key, label, features, groups=groups, **options), "score", label, [*(groups or []), "fold"])


def quick_score(df: DataFrame, key: str, label: str, features: str, *, kind: str = "auto", **options) -> float:
    """Mean AUROC over folds, of Bernoulli models where features are whole numbers; raises ValueError without positives."""
    if df.filter(F.col(label) == 1).isEmpty():
        raise ValueError("No positive samples")
    return float(quick_auroc(df, key, label, features, kind=kind, **options).agg(F.avg("auroc")).first()[0])


def candidate_scores(candidates: DataFrame, df: DataFrame, key: str, label: str, features: str, **options) -> DataFrame:
    """(partition_id, auroc): the mean quick AUROC of each candidate (partition_id, key, label), all in one job.

    A candidate without both classes in every fold has 0.5.
    """
    rows = candidates.join(df.select(key, features), key)
    if options.get("kind", "gaussian") != "bernoulli":
        options["about"] = centre(df, features).tolist()  # of the table, not of all candidates' rows
    scored = quick_auroc(rows, key, label, features, groups=["partition_id"], **options).groupBy("partition_id").agg(F.avg("auroc").alias("auroc"))
    return candidates.select("partition_id").distinct().join(scored, "partition_id", "left").select("partition_id", F.coalesce("auroc", F.lit(0.5)).alias("auroc"))
