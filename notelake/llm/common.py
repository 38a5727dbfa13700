"""Shared plumbing: durable folders, batches of bounded size and block layout."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names. Only a local master may do without."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            named = got.get()
        elif sc.master.startswith("local"):
            named = "file://" + tempfile.mkdtemp(prefix="notelake-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that is no longer read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting for the actions inside; the session's own comes back at the end."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def tidy(spark: SparkSession):
    """Actions inside leave no shuffle files behind."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1500):
    """Actions inside send texts to Python in batches of few rows."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def store(folder: str):
    """(file system, path) of a folder on any file system that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file by way of a temporary name, so a task that runs twice leaves the same whole file."""
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    temporary = f"{root}/_{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(data)
    files.move(temporary, f"{root}/{name}")


def fetch(folder: str, name: str) -> bytes:
    files, root = store(folder)
    with files.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows and of at most ``size`` bytes, or of one row: texts may be long."""
    for b in batches:
        todo = [b.slice(at, rows) for at in range(0, b.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    col = batch.column(name)
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    return [t or b"" for t in col.to_pylist()]


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype, width: int = 0):
        self.a = np.empty((1024, width) if width else 1024, dtype)
        self.n = 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            b = np.empty((max(2 * len(self.a), self.n + len(x)), *self.a.shape[1:]), self.a.dtype)
            b[: self.n] = self.a[: self.n]
            self.a = b
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def ranges(lens: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens)


def with_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, block): blocks are ranges of ids in ascending order, each of about ``block_bytes`` of text.

    A block is a unit of bounded size; ids of equal value, and null ids (block 0), share one.
    The bounds are quantiles of the id column; their number follows the input.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * min(partitions(spark), 256), -(-int(total) // block_bytes))
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    at = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known.to_numpy()] = np.searchsorted(at, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    return d.withColumn("block", block("doc_id")), len(at) + 1
