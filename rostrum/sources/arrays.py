"""Two-dimensional arrays in NumPy's format, as tables of vectors.

A matrix is one ``.npy`` file, or a folder of parts with a table that names
them in order. Reading deals out ranges of rows: each task opens a file at its
own rows, so a file of any size is read by many. Writing gives a part for each
partition; parts of lost or doubled attempts are not named and don't count.
"""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x93NUMPY"
VECTORS = "row long, vector array<double>"


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


@dataclass(frozen=True)
class Header:
    """Where the rows of a file begin, how many there are, and what is in them."""

    offset: int
    rows: int
    columns: int
    kind: str


def header(path: str) -> Header:
    """The header of a file; other than two-dimensional numbers row by row are refused."""
    with _open(path) as f:
        if f.read(6) != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        major, _ = f.read(2)
        n = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
        told = ast.literal_eval(f.read(n).decode("latin1" if major < 3 else "utf-8"))
        kind, shape = np.dtype(told["descr"]), told["shape"]
        if kind.kind not in "fiu" or told["fortran_order"] or len(shape) != 2:
            raise ValueError(f"{path} has {kind} of shape {shape}: rows of numbers are asked for")
        return Header(f.tell(), shape[0], shape[1], kind.str)


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` of a file, the file's own first one being row ``base`` of all."""

    path: str
    head: Header
    base: int
    first: int
    last: int


class NpyReader(DataSourceReader):
    def __init__(self, files: list[str], most_rows: int):
        self.files, self.most_rows = files, most_rows

    def partitions(self):
        out, base = [], 0
        for path in self.files:
            head = header(path)
            out += [Rows(path, head, base, a, min(a + self.most_rows, head.rows)) for a in range(0, head.rows, self.most_rows)]
            base += head.rows
        return out or [Rows("", Header(0, 0, 0, "<f8"), 0, 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("vector", pa.list_(pa.float64()))])
        if part.last == part.first:
            return
        width, step = np.dtype(part.head.kind).itemsize * part.head.columns, max(1, (1 << 22) // max(1, part.head.columns))
        with _open(part.path) as f:
            for a in range(part.first, part.last, step):
                b = min(a + step, part.last)
                data = f.read_at((b - a) * width, part.head.offset + a * width)
                if len(data) < (b - a) * width:
                    raise ValueError(f"{part.path} ends before its row {b}")
                flat = np.frombuffer(data, part.head.kind).astype(np.float64)
                ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * part.head.columns)
                vectors = pa.ListArray.from_arrays(ends, pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + part.base), vectors], schema=schema)


class NpySource(DataSource):
    """``spark.read.format("npy")`` over files named, one a line, in the option ``files``."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return VECTORS

    def reader(self, schema):
        return NpyReader([f for f in self.options["files"].split("\n") if f], int(self.options.get("mostrows", 1 << 16)))


def vectors(spark: SparkSession, path: str, most_rows: int = 1 << 16) -> DataFrame:
    """(row, vector) of the ``.npy`` file at ``path``, or of the parts that a folder by ``save_vectors`` names, in their order."""
    files = [path]
    if not path.endswith(".npy"):
        named = spark.read.parquet(f"{path}/parts").orderBy("first").collect()  # one row a part
        files = [f"{path}/{r['name']}" for r in named if r["rows"]]
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("files", "\n".join(files)).option("mostrows", most_rows).load()


def save_vectors(rows: DataFrame, path: str, vector: str = "vector", order: str | None = None, kind: str = "<f4") -> None:
    """Writes vectors of one length as ``.npy`` parts below ``path``, in the order of ``order`` if given, and the table that names them.

    Vectors of unlike lengths, or null ones, fail. A row's place is its number when it is read.
    """
    given = rows.select(F.col(vector).cast("array<double>").alias("v"), *([F.col(order).alias("o")] if order else []))
    if order:
        given = given.repartitionByRange("o").sortWithinPartitions("o")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held, task = [], TaskContext.get()
        for batch in batches:
            column = batch.column(0)
            if column.null_count or len(set(column.value_lengths().to_pylist())) > 1:
                raise ValueError("vectors of one length are asked for")
            if len(column):
                held.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind))
        if len({h.shape[1] for h in held}) > 1:
            raise ValueError("vectors of one length are asked for")
        n = sum(len(h) for h in held)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.npy"
        if n:
            store, inner = fs.FileSystem.from_uri(path)
            store.create_dir(inner, recursive=True)
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": (n, held[0].shape[1])})
            with store.open_output_stream(f"{inner}/{name}", compression=None) as out:
                out.write(head.getvalue())
                for h in held:
                    out.write(np.ascontiguousarray(h).tobytes())
        yield pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([task.partitionId()], pa.int64()), "rows": pa.array([n], pa.int64())})

    given.mapInArrow(write, "name string, first long, rows long").write.mode("overwrite").parquet(f"{path}/parts")
