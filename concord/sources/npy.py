"""Matrices in numpy's own file form, read and written by many tasks at once.

Reading plans byte ranges of rows from the header alone; each task reads its range.  Writing lays every row where its
number says: the header's length, the number of rows and the dimension give the offset, so tasks write into one file side
by side, nothing is joined afterwards, and a task that runs twice writes the same bytes twice.  The commit step checks that
the tasks' rows tile 0..N-1 and only then gives the file its name.  Paths are those of a file system that all executors
mount (the file form allows nothing else: an object store has no writes in place)."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that a task reads, and rows of a batch.
RANGE, BATCH = 32 << 20, 1024
KINDS = {"<f4": "float", "<f8": "double"}


class NpyError(ValueError):
    """A file that is not the matrix it should be; ``what`` is shape, dtype, order, size, rows or path."""

    def __init__(self, what: str, said: str):
        super().__init__(f"npy {what}: {said}")
        self.what = what


@dataclass(frozen=True)
class Header:
    kind: str
    rows: int
    dim: int
    begins: int


def local(path: str) -> str:
    if path.startswith("file:"):
        return path[5:] if not path.startswith("file://") else path[7:]
    if "://" in path:
        raise NpyError("path", f"{path} is not on a mounted file system")
    return path


def header(path: str) -> Header:
    """What the file says of itself, checked against its size."""
    with open(path, "rb") as f:
        try:
            version = np.lib.format.read_magic(f)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        except ValueError as e:
            raise NpyError("header", f"{path}: {e}") from e
        begins = f.tell()
    if len(shape) != 2 or (shape[1] == 0 and shape[0]):
        raise NpyError("shape", f"{path} is {shape}, not a matrix")
    if dtype.str not in KINDS:
        raise NpyError("dtype", f"{path} is {dtype.str}, not one of {', '.join(KINDS)}")
    if fortran and min(shape) > 1:
        raise NpyError("order", f"{path} is laid out by columns")
    want = begins + shape[0] * shape[1] * dtype.itemsize
    if (size := os.path.getsize(path)) != want:
        raise NpyError("size", f"{path} has {size} bytes, its header asks for {want}")
    return Header(dtype.str, *shape, begins)


@dataclass
class Rows(InputPartition):
    first: int
    last: int  # exclusive


class NpyReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.header = path, size, header(path)

    def partitions(self) -> list[Rows]:
        h = self.header
        step = max(1, self.size // (h.dim * np.dtype(h.kind).itemsize or 1))
        return [Rows(a, min(a + step, h.rows)) for a in range(0, h.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h, width = self.header, self.header.dim * np.dtype(self.header.kind).itemsize
        with open(self.path, "rb") as f:
            f.seek(h.begins + partition.first * width)
            for a in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - a)
                flat = pa.array(np.frombuffer(f.read(n * width), h.kind))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.dim), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), lists], names=["row_id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    first: int
    last: int  # exclusive; equal to first if the task had no row


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, dim: int):
        self.path, self.rows, self.dim = path, rows, dim
        top = io.BytesIO()
        np.lib.format.write_array_header_1_0(top, {"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
        self.top, self.part = top.getvalue(), f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(self.part, "wb") as f:
            f.write(self.top)
            f.truncate(len(self.top) + rows * dim * 4)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        first = last = None
        with open(self.part, "r+b") as f:
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(), batch.column(1)
                if not len(ids):
                    continue
                first = int(ids[0]) if first is None else first
                want = np.arange(len(ids)) + (int(ids[0]) if last is None else last)
                if (ids != want).any() or want[0] < 0 or want[-1] >= self.rows:
                    raise NpyError("rows", f"row_id {ids[np.argmax(ids != want)]} where {want[np.argmax(ids != want)]} should be, of {self.rows}")
                last = int(want[-1]) + 1
                out = np.full((len(ids), self.dim), np.nan, "<f4")
                some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                lengths = lists.value_lengths().drop_null().to_numpy()
                if (lengths != self.dim).any():
                    raise NpyError("shape", f"a row of {lengths[lengths != self.dim][0]} components among rows of {self.dim}")
                out[some] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim) if len(some) else 0
                f.seek(len(self.top) + want[0] * self.dim * 4)
                f.write(out.tobytes())
        return Written(first or 0, last or 0)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m.first, m.last) for m in messages if m is not None and m.last > m.first)
        at = 0
        for first, last in done:
            if first != at:
                self.abort(messages)
                raise NpyError("rows", f"rows {min(at, first)} to {max(at, first) - 1} are {'missing' if first > at else 'there twice'}")
            at = last
        if at != self.rows:
            self.abort(messages)
            raise NpyError("rows", f"{at} of {self.rows} rows were written")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class Npy(DataSource):
    """Format ``npy``: row_id, vec.  Writing takes the options ``rows`` and ``dim``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row_id bigint, vec array<{KINDS[header(local(self.options['path'])).kind]}>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(local(self.options["path"]), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        path = local(self.options["path"])
        if os.path.exists(path) and not overwrite:
            raise NpyError("path", f"{path} exists")
        return NpyWriter(path, int(self.options["rows"]), int(self.options["dim"]))


def read_matrix(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """row_id, vec of a matrix; a task reads about ``size`` bytes."""
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("range", size).load(path)


def write_matrix(deltas: DataFrame, path: str, row_id: str = "row_id", vec: str = "delta") -> None:
    """float32[N, D]: row number ``row_id`` has ``vec``, or NaN throughout where it is null.  ``deltas`` is read twice."""
    deltas.sparkSession.dataSource.register(Npy)
    rows = deltas.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(vec).cast("array<float>").alias("vec"))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    laid = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    laid.write.format("npy").mode("overwrite").options(rows=n, dim=max(dim, 0)).save(path)


def read_cells(spark: SparkSession, path: str, meta: DataFrame, pos: str = "pos") -> DataFrame:
    """Metadata rows with their vectors: ``pos`` must be exactly the matrix's row numbers, or the error says what is not."""
    h = header(local(path))
    got = meta.agg(F.count("*").alias("n"), F.count_distinct(pos).alias("d"), F.min(pos).alias("lo"), F.max(pos).alias("hi")).first()
    if got["n"] != h.rows or got["d"] != h.rows or (h.rows and (got["lo"], got["hi"]) != (0, h.rows - 1)):
        raise NpyError("rows", f"{path} has {h.rows} rows, the metadata {got['n']} with {got['d']} positions from {got['lo']} to {got['hi']}")
    matrix = read_matrix(spark, path).withColumnRenamed("row_id", "__row")
    return meta.join(matrix, F.col(pos) == F.col("__row")).drop("__row")
