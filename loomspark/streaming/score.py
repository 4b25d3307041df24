"""Scoring of streams by a fitted ensemble: no state, since every model's probability is averaged within its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomspark.models.ensemble import BinaryClassifier


def score_stream(model: BinaryClassifier, source: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """``source`` with p0, p1 and prediction."""
    return model.predict(source, threshold)


def score_folder(spark: SparkSession, model: BinaryClassifier, folder: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Score Parquet files as they arrive in a folder; restarts go on where the checkpoint ends."""
    source = spark.readStream.schema(schema).parquet(folder)
    return score_stream(model, source).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
