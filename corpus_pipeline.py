"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, and so on to packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages run one after another, each over all that the
one before kept, written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.decontaminate import decontaminate
from loomspark.llm.neardup import near_duplicates
from loomspark.llm.packing import pack_documents
from loomspark.llm.pii import mask
from loomspark.llm.queries import vocabulary
from loomspark.llm.text import stored, table
from loomspark.llm.toxicity import fit, score

#: SQL cannot express the classifier or the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.3 or more leave; null texts are scored as empty ones, and repeated rows alike."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, output="_score").filter(F.col("_score") < 0.3).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays, one row of it: the one whose text, then other columns, come first.

    Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, size=5, percent=80).filter("kept").select("doc_id").distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(found, "doc_id", "left_semi")
    if not kept.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        order = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
        kept = kept.groupBy("doc_id").agg(F.min(order).alias("r")).select("doc_id", "r.*")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows leave; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text, the other columns stay; null texts stay null."""
    masked = mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens; null texts are packed as empty ones."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
