"""Tables, CSV with a fixed schema, feature matrices, JSON, and checks of what a fit is given."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a labelled text file, and of one with predictions.
LABELLED = T.StructType([T.StructField("Drug", T.StringType()), T.StructField("Y", T.DoubleType())])
PREDICTED = T.StructType([*LABELLED, T.StructField("pred", T.DoubleType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_csv(spark: SparkSession, path: str, *, predicted: bool = False) -> DataFrame:
    """(row_id, drug, y[, pred]) of a CSV file; row_id follows the file's order where it is read as one part."""
    read = spark.read.schema(PREDICTED if predicted else LABELLED).option("header", True).option("escape", '"').csv(path)
    columns = [F.col("Drug").alias("drug"), F.col("Y").alias("y"), *([F.col("pred")] if predicted else [])]
    if not predicted:
        columns[1] = F.col("Y").cast("int").alias("y")
    return read.select(F.monotonically_increasing_id().alias("row_id"), *columns)


def write_predictions(df: DataFrame, path: str) -> None:
    """Drug, Y, pred as CSV."""
    df.select(F.col("drug").alias("Drug"), F.col("y").alias("Y"), F.col("pred")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, features) of a Parquet matrix whose values are named features, values or Values."""
    df = spark.read.parquet(path)
    for name in ("features", "values", "Values"):
        if name in df.columns:
            return df.select("row_id", F.col(name).alias("features"))
    raise ValueError("the matrix has no column features, values or Values")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds nothing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist."""
    return [p for p in paths if exists(spark, p)]


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object, small enough for the driver."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def check_input(df: DataFrame | None, *, path: str | None = None, label: str | None = None, key: str = "row_id", fit: bool = True) -> None:
    """Raise ValueError unless exactly one of a table and a path is given, with a unique key and, for a fit, labels 0 and 1."""
    if (df is None) == (path is None):
        raise ValueError("give a table or a path, and not both")
    if path is not None and PurePosixPath(path).suffix not in (".parquet", ".csv", ""):
        raise ValueError(f"not a Parquet or CSV path: {path}")
    if df is None:
        return
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    if fit and (label is None or label not in df.columns):
        raise ValueError("labels are needed for a fit")
    if fit:
        wrong = df.filter(F.col(label).isNull() | ~F.col(label).isin(0, 1)).limit(1).count()
        if wrong:
            raise ValueError("labels are 0 or 1")
    if not df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null or not unique")
