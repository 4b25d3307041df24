"""Exact ranking and regression metrics, for each group of rows, ties included.

Rows are summed by score first; running sums over scores come from ``ranks.running``. A group without both classes has
a null AUROC, one without positives a null average precision. Rows with a null score or label are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.scalars import seeded
from loomspark.operators.ranks import number_bin, running


def by_score(df: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    """(groups, s, tp, fp): positives and negatives at each score."""
    y = F.col(label).cast("int")
    rows = df.filter(F.col(score).isNotNull() & y.isin(0, 1)).select(*groups, F.col(score).cast("double").alias("s"), y.alias("_y"))
    return rows.groupBy(*groups, "s").agg(F.sum("_y").cast("long").alias("tp"), F.sum(1 - F.col("_y")).cast("long").alias("fp")).withColumn("_bin", number_bin(F.col("s")))


def auroc(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, auroc): the share of pairs of a positive and a negative in order, ties half."""
    groups = groups or []
    below = running(by_score(df, score, label, groups), groups, ["_bin"], [F.col("s")], {"below": "fp"})
    pairs = F.sum("tp").cast("double") * F.sum("fp")
    won = F.sum(F.col("tp") * (F.col("below") + F.col("fp") / 2))
    return below.groupBy(*groups).agg(F.when(pairs > 0, won / pairs).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, ap): precision at each score weighted by the recall gained there, without interpolation."""
    groups = groups or []
    rows = by_score(df, score, label, groups).withColumns({"n": F.col("tp") + F.col("fp"), "_down": -F.col("_bin")})
    above = running(rows, groups, ["_down"], [F.col("s").desc()], {"tp_above": "tp", "n_above": "n"})
    total = F.sum("tp").cast("double")
    gained = F.sum(F.col("tp") * ((F.col("tp_above") + F.col("tp")) / (F.col("n_above") + F.col("n"))))
    return above.groupBy(*groups).agg(F.when(total > 0, gained / total).alias("ap"))


def roc_points(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, threshold, fpr, tpr) at each score taken as threshold, itself included."""
    groups = groups or []
    rows = by_score(df, score, label, groups).withColumn("_down", -F.col("_bin"))
    above = running(rows, groups, ["_down"], [F.col("s").desc()], {"tp_above": "tp", "fp_above": "fp"})
    totals = rows.groupBy(*groups).agg(F.sum("tp").alias("p"), F.sum("fp").alias("n"))
    joined = above.join(totals, groups) if groups else above.crossJoin(F.broadcast(totals))  # totals: one row
    return joined.select(*groups, F.col("s").alias("threshold"), ((F.col("fp_above") + F.col("fp")) / F.col("n")).alias("fpr"), ((F.col("tp_above") + F.col("tp")) / F.col("p")).alias("tpr"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of ``column``, ties sharing their mean rank."""
    counts = df.groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bin", number_bin(F.col("_v")))
    ranks = running(counts, [], ["_bin"], [F.col("_v")], {"_below": "_n"}).select("_v", (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[column].cast("double") == ranks["_v"]).drop("_v")


def regression(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(r2, mae, spearman) of one table."""
    rows = df.select(F.col(truth).cast("double").alias("t"), F.col(guess).cast("double").alias("g")).filter("t IS NOT NULL AND g IS NOT NULL")
    ranked = average_ranks(average_ranks(rows, "t", "rt"), "g", "rg")
    return ranked.agg((1 - F.sum((F.col("t") - F.col("g")) ** 2) / (F.var_pop("t") * F.count("*"))).alias("r2"), F.avg(F.abs(F.col("t") - F.col("g"))).alias("mae"), F.corr("rt", "rg").alias("spearman"))


def threshold(df: DataFrame, p: str = "p1", t: float = 0.5, name: str = "prediction") -> DataFrame:
    """``df`` with 1 where p >= t, else 0."""
    return df.withColumn(name, (F.col(p) >= t).cast("int"))


def complement(df: DataFrame, p: str = "p1", name: str = "p0") -> DataFrame:
    return df.withColumn(name, 1 - F.col(p))


def ensemble_mean(df: DataFrame, key: str, p: str = "p1") -> DataFrame:
    """Mean probability of each row over the models that scored it."""
    return df.groupBy(key).agg(F.avg(p).alias(p), F.count("*").alias("n_models"))


def majority_vote(df: DataFrame, key: str, p: str = "p1", t: float = 0.5) -> DataFrame:
    """(key, vote): whether more than half of the models that scored a row reach ``t``."""
    return df.groupBy(key).agg((2 * F.count_if(F.col(p) >= t) > F.count(p)).alias("vote"))


def jittered(df: DataFrame, key: str, seed: int | str = 42, width: float = 0.4) -> DataFrame:
    """``df`` with a column jitter in [-width / 2, width / 2), fixed by key and seed: the data of a plot of scores."""
    share = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / 2**32
    return df.withColumn("jitter", (share - 0.5) * width)


def chunk_ids(df: DataFrame, groups: list[str], order: str, size: int) -> DataFrame:
    """``df`` with its chunk number in key order; ``order`` is a numeric key."""
    binned = df.withColumns({"_bin": number_bin(F.col(order).cast("double")), "_one": F.lit(1).cast("long")})
    out = running(binned, groups, ["_bin"], [F.col(order)], {"_rank": "_one"})
    return out.withColumn("chunk", F.floor(F.col("_rank") / size).cast("long")).drop("_bin", "_one", "_rank")


def best(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row of the greatest value, among equal ones the first by ``order``; nulls are never it."""
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), order).limit(1)
