"""Folds and hold-out parts in seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.ranks import seeded_rank


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int | str = 42, groups: list[str] | None = None) -> DataFrame:
    """``df`` with a fold 0 to k - 1; each label's counts (within ``groups``) differ by 1 at most between folds."""
    return seeded_rank(df, [*(groups or []), label], key, seed, name="_rn").withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_rn")


def folds(df: DataFrame, key: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    """``df`` with a fold 0 to k - 1 of equal sizes but for 1."""
    return seeded_rank(df, [], key, seed, name="_rn").withColumn("fold", (F.col("_rn") % k).cast("int")).drop("_rn")


def holdout(df: DataFrame, key: str, label: str, share: float = 0.25, seed: int | str = 42, groups: list[str] | None = None) -> DataFrame:
    """``df`` with held_out: of each label (within ``groups``, which are few) ``share`` of the rows, rounded half to even."""
    by = [*(groups or []), label]
    sizes = df.groupBy(*by).agg(F.bround(F.count("*") * F.lit(share), 0).alias("_size"))
    ranked = seeded_rank(df, by, key, seed, name="_rn")
    return ranked.join(F.broadcast(sizes), by).withColumn("held_out", F.col("_rn") < F.col("_size")).select(*df.columns, "held_out")


def oversampled(df: DataFrame, key: str, label: str, share: float = 0.25, most: float = 0.5, seed: int | str = 42, n_splits: int = 5) -> DataFrame:
    """(fold, part, key, label, mult): train and test rows of each emitted fold, negatives repeated where positives pass ``most``.

    k is max(3, int(1 / share)) and n_splits - 1 folds at most are emitted. A train part of n rows whose positive share
    passes ``most`` gets int(n * (1 - most) - negatives) more negatives, drawn with replacement in seeded order.
    """
    k = max(3, int(1 / share))
    placed = stratified_folds(df.select(key, label), key, label, k, seed)
    every = df.sparkSession.range(min(k, n_splits - 1)).select(F.col("id").cast("int").alias("_f"))
    split = placed.crossJoin(F.broadcast(every)).select(F.col("_f").alias("fold"), F.when(F.col("fold") == F.col("_f"), "test").otherwise("train").alias("part"), key, label)  # k rows at most
    train = split.filter("part = 'train'")
    counts = train.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    more = counts.select("fold", "neg", F.when((F.col("n") - F.col("neg")) / F.col("n") > most, F.greatest(F.floor(F.col("n") * (1 - most) - F.col("neg")), F.lit(0))).otherwise(0).cast("long").alias("more"))
    ranked = seeded_rank(train, ["fold", label], key, f"{seed}:more", name="_rn").join(F.broadcast(more), "fold")
    extra = F.floor(F.col("more") / F.col("neg")) + (F.col("_rn") < F.col("more") % F.col("neg")).cast("long")
    mult = F.when((F.col(label) == 0) & (F.col("more") > 0), 1 + extra).otherwise(1).cast("long")
    return ranked.select("fold", "part", key, label, mult.alias("mult")).unionByName(split.filter("part = 'test'").withColumn("mult", F.lit(1).cast("long")))
