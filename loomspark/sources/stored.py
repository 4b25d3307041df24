"""Tables of a running job, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or str(spark.sparkContext.getCheckpointDir() or "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; ``clear`` deletes it."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors.

    With ``free`` the files of the shuffles that lead to it are deleted once it is written (Spark 4.1 on).
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, True)
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has stored: for the end of a job, when no result is read any more."""
    drop(spark, _tables(spark))
