"""Exact deduplication as a stream: keyed state on disk, without expiry, and a check of all bytes where digests meet.

Files are read once, as a stream. Its state, in RocksDB and kept for good, has a row for each digest of a normalised text
(A-Z lower-cased, nothing else changed): how many rows had it, and of the row that stays its key and its locator (file, row
within the file). The checkpoint in the shared folder holds the state, so a run that is cut off goes on where it was, and
files that arrive later are judged against all that came before.

A digest that several rows have is only a hit. A bitmap of those digests, of bounded size, is sent to all tasks; rows that it
lets through are compared byte by byte: the least and the greatest text of a digest are the same exactly if all its texts
are. They are partial aggregates, so of a digest that a third of all rows have a task passes on two texts. Digests with
different texts are split by their text.

Rows meet their group by a join on the digest; the few groups that hold many rows are broadcast, so no task gets the rows of
one of those. Only built-in functions are used: there is no Python in any task.

Defined results: a null text counts as empty; of equal texts the row with the largest key stays, among equal keys the one
with the last locator, rows without a key only where no other has one; repeated rows are rows like others, one of them stays;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.stored import shared_folder, stored

#: Bytes of input that one batch of the stream takes.
BATCH_BYTES = 1 << 38
#: A group of more than this part of all rows is sent to all tasks: fewer than HOT groups.
HOT = 10_000
#: Bits of the bitmap of hits, by the number of groups: 2**20 to 2**28 (32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # files of many small stores take what they hold
}


def normalised(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pattern(path: str) -> str:
    """``path`` as a pattern that matches only itself: a stream takes a single file only so."""
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


class ExactDedup:
    """Duplicates among the Parquet files of ``source``, file by file as they come; ``folder`` keeps the state."""

    def __init__(self, spark: SparkSession, source: str, folder: str, *, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES) -> None:
        self.spark, self.source, self.folder = spark, source.rstrip("/"), folder.rstrip("/")
        self.key, self.text, self.digest, self.batch_bytes = key, text, digest, batch_bytes

    def _rows(self, df: DataFrame) -> DataFrame:
        body = normalised(F.col(f"`{self.text}`"))
        return df.select(F.col(f"`{self.key}`").alias("id"), body.alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).withColumn("digest", self.digest(F.col("body")))

    def advance(self) -> ExactDedup:
        """Take in all files that are there and have not been read yet."""
        schema = self.spark.read.parquet(self.source).select(f"`{self.key}`", f"`{self.text}`").schema
        files = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", self.batch_bytes).option("maxFileAge", "36500d").parquet(_pattern(self.source))
        groups = self._rows(files).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
        before = {k: self.spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            self.spark.conf.set(k, v)
        try:
            running = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        running.awaitTermination()
        return self

    def state(self) -> DataFrame:
        """(digest, n, keep: id, file, row): what the stream's state holds."""
        held = self.spark.read.format("statestore").load(f"{self.folder}/state")
        n, keep = held.schema["value"].dataType.names
        return held.select("key.digest", F.col(f"value.`{n}`").alias("n"), F.col(f"value.`{keep}`").alias("keep"))

    def _split(self, rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
        """(digest): those that stand for more than one text."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n_groups).bit_length()))
        slot = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
        at = {"bucket": F.bitmap_bucket_number(slot), "bit": F.bitmap_bit_position(slot)}
        bitmap = groups.filter("n > 1").withColumns(at).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.expr("shiftleft(1, cast(bit % 8 as int))").bitwiseAND(byte) != 0
        hits = rows.select("digest", "body").withColumns(at).join(F.broadcast(bitmap), "bucket").filter(is_set)  # bits / 8 bytes at most
        return hits.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter("least <> most").select("digest")

    def verdicts(self) -> DataFrame:
        """(id, file, row, digest, keep_id, group_size, kept) of every row that the stream has read; no file may arrive meanwhile."""
        groups = stored(self.state(), "exact-groups")
        total = groups.agg(F.count("*").alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        rows = self._rows(self.spark.read.parquet(self.source))
        split = stored(self._split(rows, groups, total["g"]), "exact-split")
        name = F.col("digest")
        if not split.isEmpty():  # not with a sound digest: the texts of these digests are told apart by themselves
            texts = rows.join(split, "digest").groupBy("digest", "body").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("keep"))
            texts = stored(texts, "exact-texts")
            own = F.concat(F.col("digest"), F.encode("body", "utf-8"))
            groups = groups.join(split, "digest", "left_anti").unionByName(texts.select(own.alias("digest"), "n", "keep"))
            rows = rows.join(split.withColumn("_many", F.lit(True)), "digest", "left")
            name = F.when(F.col("_many"), own).otherwise(F.col("digest"))
        rows = rows.select("id", "file", "row", "digest", name.alias("name"))
        large = F.col("n") > total["n"] / HOT
        of = lambda df, mark: df.select(F.col("digest").alias("name"), F.struct("n", "keep").alias(mark))
        hot = of(groups.filter(large & (F.col("n") > 1)), "hot")  # fewer than HOT
        cold = of(groups.filter(~large | (F.col("n") == 1)), "cold").withColumnRenamed("name", "at")
        met = rows.join(F.broadcast(hot), "name", "left")
        # rows that have their group go anywhere: their join key is their own place, which no digest equals
        elsewhere = F.encode(F.concat_ws(":", "file", "row"), "utf-8")
        met = met.withColumn("at", F.when(F.col("hot").isNull(), F.col("name")).otherwise(elsewhere)).join(cold, "at", "left")
        g = F.coalesce("hot", "cold")
        kept = (g["keep"]["file"] == F.col("file")) & (g["keep"]["row"] == F.col("row"))
        return met.select("id", "file", "row", "digest", g["keep"]["id"].alias("keep_id"), g["n"].alias("group_size"), kept.alias("kept"))

    def deduplicated(self) -> DataFrame:
        """The rows of the source that stay, with all their columns."""
        stay = self.verdicts().filter("kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
        docs = self.spark.read.parquet(self.source)
        at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return at.join(stay, ["_file", "_row"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spark: SparkSession, source: str, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of the documents in ``source``; without a ``folder`` state begins anew."""
    import uuid

    folder = folder or f"{shared_folder(spark)}/exact/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    found = ExactDedup(spark, source, folder).advance().verdicts()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB SQL for ``digest``.
SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY b) AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       row_number() OVER (PARTITION BY b ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(b) AS text_sha256
FROM t
"""
