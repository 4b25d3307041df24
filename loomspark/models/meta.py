"""First parameters of a forest from what a table looks like: meta-features and the nearest entry of a stored portfolio.

The meta-features are one row of aggregates over one scan. A portfolio is a Parquet table of (meta-features, parameters) to
which searches add what they have found; the parameters of the nearest entry, in logarithms of sizes and in shares, are the
next search's first trial. An empty portfolio gives nothing, and the defaults hold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.tables import exists

SCHEMA = "n_rows long, n_features int, positive_share double, zero_share double, mean_spread double, parameters string"
FEATURES = ["n_rows", "n_features", "positive_share", "zero_share", "mean_spread"]


def meta_features(df: DataFrame, label: str, features: str) -> DataFrame:
    """One row: rows, features, share of label 1, share of cells that are 0, mean over rows of the deviation within a row."""
    x = F.transform(features, lambda v: v.cast("double"))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    n = F.size(features)
    spread = F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))
    zeros = F.size(F.filter(x, lambda v: v == 0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.max(n), F.lit(0)).alias("n_features"),
        F.avg(F.col(label).cast("double")).alias("positive_share"),
        (F.sum(zeros) / F.sum(n)).alias("zero_share"),
        F.avg(spread).alias("mean_spread"),
    )


def remember(spark: SparkSession, path: str, found: DataFrame, parameters: dict) -> None:
    """Add meta-features (a row) and the parameters that did best there to a portfolio."""
    row = found.select(*FEATURES, F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"))
    row.coalesce(1).write.mode("append").parquet(path)


def _log(c: Column) -> Column:
    return F.log10(F.greatest(c.cast("double"), F.lit(1.0)))


def nearest(spark: SparkSession, path: str, found: DataFrame) -> dict | None:
    """The parameters of the portfolio's nearest entry; ties go to the first by parameters. None without a portfolio."""
    if not exists(spark, path):
        return None
    past, now = spark.read.schema(SCHEMA).parquet(path), found.select(*[F.col(c).alias(f"_{c}") for c in FEATURES])
    gap = lambda c, of=lambda x: x: F.pow(of(F.col(c)) - of(F.col(f"_{c}")), 2)
    distance = gap("n_rows", _log) + gap("n_features", _log) + 4 * gap("positive_share") + gap("zero_share") + F.pow(F.log1p("mean_spread") - F.log1p("_mean_spread"), 2)
    best = past.crossJoin(F.broadcast(now)).orderBy(distance, "parameters").limit(1).collect()  # one row
    return json.loads(best[0]["parameters"]) if best else None
