"""What the operators of this subpackage share: tables, shared storage, arrow columns."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch, whatever the length of texts: what a task's two processes hold of its rows at once.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bounded(spark: SparkSession) -> None:
    """Has Spark send batches of BATCH_BYTES to Python, unless the cluster's configuration says otherwise."""
    if spark.sparkContext.getConf().get(BATCH_KEY) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    In local mode, where there are no other machines, a temporary folder is set if there is none.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/folia/{name}-{uuid.uuid4().hex}"


#: Makes Spark drop a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors.

    The shuffle files of the work that is written are of no more use, and are dropped at once.
    """
    spark = df.sparkSession
    bounded(spark)
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for the tables, once nothing that isn't written itself reads them."""
    for df in tables:
        if path := getattr(df, "_stored", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: str = "text"):
    """The column's UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def struct_type(**fields: T.DataType) -> T.StructType:
    """Needs no session, unlike a type written as a string."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def struct_array(names: list[str], columns: list[list], types: list[pa.DataType]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


#: Seconds between two such returns of a worker.
TRIM_S = 2.0


def lists(values: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """A list column of the rows of ``values`` where ``some`` is set, and of empty lists elsewhere."""
    ends = np.concatenate([[0], np.cumsum(some * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def slices(values: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 4096):
    """Pieces of an Arrow binary column as lists of bytes, of about ``most_bytes`` each (a longer text stands alone).

    Arrow batches hold up to 10,000 rows; Python objects are made only for one piece at a time.
    """
    n, start = len(values), 0
    while start < n:
        stop, size = start, 0
        while stop < n and stop - start < most_rows and (stop == start or size < most_bytes):
            size += len(values[stop].as_buffer() or b"")
            stop += 1
        yield values.slice(start, stop - start).to_pylist()
        start = stop
    trimmed()


_last_trim = 0.0


def trimmed() -> None:
    """Gives a worker's freed memory back to the machine, at most once in a few seconds: workers live on between stages."""
    global _last_trim
    if (now := time.monotonic()) - _last_trim < TRIM_S:
        return
    _last_trim = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
