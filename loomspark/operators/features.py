"""Per-feature statistics of array columns, scaling, and counts of slots. Components are in ``operators.gram``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, key: str, features: str) -> DataFrame:
    """(j, n, mean, variance) with the population variance; one row of sums, then a row for each feature."""
    made = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    row = df.agg(made.alias("s")).select(F.col("s.count").alias("n"), vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v"))
    each = row.select("n", F.posexplode(F.arrays_zip("m", "v")).alias("j", "e"))
    return each.select("j", "n", F.col("e.m").alias("mean"), (F.col("e.v") * (F.col("n") - 1) / F.col("n")).alias("variance"))


def varying(df: DataFrame, key: str, features: str, least: float = 0.0) -> DataFrame:
    """(j): features whose variance passes ``least``."""
    return moments(df, key, features).filter(F.col("variance") > least).select("j")


def standardised(df: DataFrame, key: str, features: str) -> DataFrame:
    """(key, j, z): cells less their mean, over the population deviation; constant features give 0."""
    each = F.sort_array(F.collect_list(F.struct("j", "mean", F.sqrt("variance").alias("sd"))))
    m = F.broadcast(moments(df, key, features).agg(each.alias("_m")))  # one row
    z = F.zip_with(features, F.col("_m"), lambda v, p: F.when(p["sd"] > 0, (v.cast("double") - p["mean"]) / p["sd"]).otherwise(F.lit(0.0)))
    return df.crossJoin(m).select(key, F.posexplode(z).alias("j", "z"))


def is_integer_matrix(df: DataFrame, key: str, features: str, rows: int = 10) -> DataFrame:
    """(integral): whether the first ``rows`` rows by key hold whole numbers only."""
    first = df.orderBy(key).limit(rows)
    return first.agg(F.coalesce(F.min(F.forall(features, lambda v: v == F.floor(v))), F.lit(True)).alias("integral"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_rows / (2 * n of the label)."""
    counts = df.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"))
    total = df.filter(F.col(label).isin(0, 1)).agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_all") / (2 * F.col("n"))).alias("weight"))  # one row of two


def slot_counts(df: DataFrame, items: Column, slot: Callable[[Column], Column], keep: list[str], most: int = 255) -> DataFrame:
    """(keep, j, v): for each row the slot numbers of its items and how often each occurs, ``most`` at most.

    Items are exploded so that slots are computed by compiled code; a row's counts are added up where the row is before the shuffle.
    """
    each = df.select(F.monotonically_increasing_id().alias("_row"), *keep, items.alias("_items")).select("_row", *keep, F.explode("_items").alias("_item"))
    counted = each.select("_row", *keep, slot(F.col("_item")).alias("j")).groupBy("_row", *keep, "j").agg(F.count("*").alias("v"))
    return counted.select(*keep, "j", F.least("v", F.lit(most)).cast("int").alias("v"))


def vectors(df: DataFrame, features: str, name: str = "x") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.transform(features, lambda v: v.cast("double"))))


def dense_counts(df: DataFrame, items: Column, slot: Callable[[Column], Column], key: str, width: int, most: int = 255, name: str = "counts") -> DataFrame:
    """(key, counts): how often each slot 0 to ``width`` - 1 occurs in a row, ``most`` at most; keys are unique."""
    held = slot_counts(df, items, slot, [key], most).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_m"))  # ``width`` entries at most
    full = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)))
    return df.select(key).join(held, key, "left").select(key, full.alias(name))
