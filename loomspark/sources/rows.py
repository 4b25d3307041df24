"""Matrices in row ranges: ``.npy`` files (and HDF5, where its package is there) read by the ranges that are asked for.

``format("matrix_rows")`` is a Python data source. A path is a file or a folder of ``.npy`` parts; rows are numbered from 0
through the parts in the order of their names. Partitions are planned from row ranges, of ``rows`` rows at most; filters on
``row_id`` (=, IN, <, <=, >, >=) become ranges before anything is read, so a gather of a few rows reads those rows' bytes and
nothing else. Only the parts' headers are read to plan. The writer makes a part of each task, named so that their order is
that of the partitions.

Paths are local or what pyarrow's file systems open.
"""

from __future__ import annotations

import io
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a partition.
ROWS = 65_536
#: Ranges of fewer missing rows than this are read as one.
GAP = 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part:
    """One file: where its rows begin in the whole and in the file, their number, width and type."""

    path: str
    first: int
    rows: int
    width: int
    offset: int
    kind: str


def _npy(system: fs.FileSystem, path: str, first: int) -> Part:
    with system.open_input_file(path) as f:
        head = f.read(12)
        long = head[6] > 1
        size = struct.unpack("<I", head[8:12])[0] if long else struct.unpack("<H", head[8:10])[0]
        offset = (12 if long else 10) + size
        f.seek(0)
        buffer = io.BytesIO(f.read(offset))
        version = np.lib.format.read_magic(buffer)
        shape, fortran, kind = np.lib.format.read_array_header_2_0(buffer) if version >= (2, 0) else np.lib.format.read_array_header_1_0(buffer)
    if len(shape) != 2 or fortran or kind.hasobject:
        raise ValueError(f"{path} is not a matrix in row order")
    return Part(path, first, shape[0], shape[1], offset, kind.str)


def _hdf5(path: str) -> Part:
    try:
        import h5py
    except ImportError as e:
        raise ValueError("HDF5 needs the package h5py") from e
    with h5py.File(path) as f:
        name = next((n for n in ("values", "Values") if n in f), None)
        if name is None:
            raise ValueError("HDF5 does not contain a values key")
        return Part(path, 0, f[name].shape[0], f[name].shape[1], 0, f"h5:{name}")


def parts_of(path: str) -> list[Part]:
    """The parts of a file or folder, in order."""
    if path.endswith((".h5", ".hdf5")):
        return [_hdf5(path)]
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"nothing at {path}")
    names = [at] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npy"))
    out, first = [], 0
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    for name in names:
        p = _npy(system, name, first)
        p.path = prefix + name
        out.append(p)
        first += p.rows
    return out


@dataclass
class Rows(InputPartition):
    """Rows of one part: (from, to) in the whole, ends exclusive."""

    part: Part
    ranges: list[tuple[int, int]]


def ranges_of(filters: list[Filter], total: int) -> tuple[list[tuple[int, int]], list[Filter]]:
    """(row ranges, ends exclusive, that the filters on row_id leave; filters that are not understood)."""
    low, high, some, rest = 0, total, None, []
    for f in filters:
        if getattr(f, "attribute", None) != ("row_id",) or (isinstance(f, In) and any(v is None for v in f.value)):
            rest.append(f)
            continue
        if isinstance(f, EqualTo | In):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            some = own if some is None else some & own
        elif isinstance(f, GreaterThan):
            low = max(low, math.floor(f.value) + 1)
        elif isinstance(f, GreaterThanOrEqual):
            low = max(low, math.ceil(f.value))
        elif isinstance(f, LessThan):
            high = min(high, math.ceil(f.value))
        elif isinstance(f, LessThanOrEqual):
            high = min(high, math.floor(f.value) + 1)
        else:
            rest.append(f)
    if some is None:
        return ([(low, high)] if low < high else []), rest
    return [(i, i + 1) for i in sorted(some) if low <= i < high], rest


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.parts = parts_of(options["path"])
        self.rows = int(options.get("rows", ROWS))
        self.total = sum(p.rows for p in self.parts)
        self.ranges = [(0, self.total)] if self.total else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.ranges, rest = ranges_of(filters, self.total)
        yield from rest

    def partitions(self) -> list[Rows]:
        out = []
        for p in self.parts:
            held, n = [], 0
            for low, high in self.ranges:
                low, high = max(low, p.first), min(high, p.first + p.rows)
                while low < high:
                    end = min(high, low + self.rows - n)
                    held.append((low, end))
                    n += end - low
                    low = end
                    if n == self.rows:
                        out.append(Rows(p, held))
                        held, n = [], 0
            if held:
                out.append(Rows(p, held))
        return out or [Rows(Part("", 0, 0, 0, 0, ""), [])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition.part
        if not partition.ranges:
            return
        if p.kind.startswith("h5:"):
            import h5py

            with h5py.File(p.path) as f:
                for low, high in partition.ranges:
                    yield _batch(low, np.asarray(f[p.kind[3:]][low - p.first : high - p.first]))
            return
        system, at = _open(p.path)
        kind = np.dtype(p.kind)
        wide = kind.itemsize * p.width
        with system.open_input_file(at) as f:
            for low, high in partition.ranges:
                for a in range(low, high, 4096):
                    b = min(high, a + 4096)
                    f.seek(p.offset + (a - p.first) * wide)
                    yield _batch(a, np.frombuffer(f.read((b - a) * wide), kind).reshape(b - a, p.width))


def _batch(first: int, x: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(x, np.float64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x), dtype=np.int64)), lists], ["row_id", "features"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class MatrixWriter(DataSourceArrowWriter):
    """Rows (row_id, features) of each task as one part, by row_id; the rows of a part are held while it is written."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        batches = [b for b in iterator if len(b)]
        if not batches:
            return Written("")
        t = pa.Table.from_batches(batches)
        t = t.sort_by("row_id")
        lists = t.column("features").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.run}.npy"
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/.{name}") as f:
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(x))
            f.write(np.ascontiguousarray(x).tobytes())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.path.endswith(".npy") and self.run not in f.path:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{at}/.{m.name}", f"{at}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _open(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{at}/.{m.name}")


class MatrixRows(DataSource):
    """(row_id, features) of a matrix."""

    @classmethod
    def name(cls) -> str:
        return "matrix_rows"

    def schema(self) -> str:
        return "row_id long, features array<double>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def matrix_rows(spark: SparkSession, path: str, *, rows: int = ROWS) -> DataFrame:
    """(row_id, features) of a matrix; filters on row_id reach the reader."""
    spark.dataSource.register(MatrixRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("matrix_rows").option("rows", rows).load(path)


def write_matrix(df: DataFrame, path: str, *, key: str = "row_id", features: str = "features", rows: int = ROWS) -> None:
    """The rows of ``df`` as ``.npy`` parts in the order of their key, of about ``rows`` rows: row i is the i-th by key."""
    spark = df.sparkSession
    spark.dataSource.register(MatrixRows)
    n = df.count()
    ready = df.select(F.col(key).cast("long").alias("row_id"), F.transform(features, lambda v: v.cast("double")).alias("features"))
    ready.repartitionByRange(max(1, -(-n // rows)), "row_id").write.format("matrix_rows").mode("overwrite").save(path)


def gather_rows(spark: SparkSession, path: str, wanted: DataFrame, *, most: int = 100_000) -> DataFrame:
    """(pos, row_id, features) of ``wanted`` (pos, row_id). Up to ``most`` different rows are read by their ranges; of more
    numbers the range from the least to the greatest is read and joined."""
    ids = wanted.select("row_id").distinct()
    n = ids.limit(most + 1).count()
    if n <= most:
        source = matrix_rows(spark, path).filter(F.col("row_id").isin([r["row_id"] for r in ids.collect()]))  # ``most`` numbers
    else:
        ends = ids.agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
        source = matrix_rows(spark, path).filter(F.col("row_id").between(ends["a"], ends["b"]))
    return wanted.join(source, "row_id").select("pos", "row_id", "features")
