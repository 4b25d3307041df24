"""Shared helpers: Arrow text columns as byte arrays, word hashes, bounded Arrow batches.

Everything here works on bounded chunks of a record batch. A chunk holds whole texts and about
``CHUNK`` bytes, so a task's memory follows its longest text and not its number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sources.stored import shared_folder, stored  # noqa: F401  used by the operators

#: Bytes of text handled at once.
CHUNK = 1 << 20
#: Bytes of an Arrow batch, where the session allows more.
BATCH = 1 << 22
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the words of a shingle.
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes: anything but ASCII white space.
NOT_SPACE = ~_SPACE
#: Word bytes: a-z, 0-9 and everything beyond ASCII (A-Z counts after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = utf8(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, rows, at + 4096)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of a chunk: 64-bit hashes of their lower-cased bytes, byte spans, first word of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of ``kind`` bytes within each text, hashed after A-Z are lower-cased."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = kind[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, first)
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    power = np.cumprod(np.full(int(size.max()), _STEP, np.uint64))
    value = _BYTE[_LOWER[data[inside]]] * power[place]
    return Words(mix(np.add.reduceat(value, at)), start, end, first)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes; texts' borders are the caller's concern."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _PLACE[k % 64] * np.uint64(2 * (k // 64) + 1)
    return mix(total + np.uint64(n))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and len + 1 offsets; a shorter text that has words gives one."""
    count = np.diff(w.first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(int(offsets[-1]), np.uint64)
    whole = runs(w.hash, n)
    long = np.flatnonzero(count >= n)
    if len(long):
        size = made[long]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(offsets[long], size) + step] = whole[np.repeat(w.first[long], size) + step]
    for d in np.flatnonzero((count > 0) & (count < n)):
        out[offsets[d]] = runs(w.hash[w.first[d] : w.first[d + 1]], int(count[d]))[0]
    return out, offsets


def groups_for(docs: DataFrame, text: str, per: int = 1 << 25) -> int:
    """How many groups of documents to make: by bytes of text, ``per`` for each, and one for each shuffle partition at least.

    Groups that are held whole then do not grow with the input, whatever the number of partitions is set to.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // per))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow``, with the session's Arrow batches held to ``BATCH`` bytes: a task's memory then follows bytes, not rows."""
    spark = df.sparkSession
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(_BATCH_BYTES))) > BATCH:
        spark.conf.set(_BATCH_BYTES, BATCH)  # read when the plan runs, so it stays
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
