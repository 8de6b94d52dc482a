"""Reading print streams into tables of structured fields.

``read_files`` lists files as rows of bytes; ``frame`` makes fields and errors of them. A
file is one row and is framed by one task, as its records can only be found one after another;
files are many, and each is worked on by itself, so there is no shuffle. ``AfpSource`` is the
same as a data source, ``spark.read.format("afp").load(path)``, with one partition for each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folia.functions import scans

#: Files beyond this size are not read, and are told as errors.
MOST_BYTES = 64 << 20
TOO_LARGE = "file has over %d bytes"

FIELDS = "path string, field_seq int, offset long, sf_id int, flags int, sequence int, data binary, error string"


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*.afp", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, content, refused) of files; the bytes of those beyond ``most_bytes`` are not read, and refused says why."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    read = files.filter(F.col("length") <= most_bytes).select("path", "content", F.lit(None).cast("string").alias("refused"))
    refused = files.filter(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE % most_bytes).alias("refused"))
    return read.unionByName(refused)


def _rows(path: str, content: bytes | None):
    try:
        return [(path, k, *field, None) for k, field in enumerate(scans.fields(content or b""))]
    except scans.FramingError as e:
        return [(path, None, e.offset, None, None, None, None, str(e))]


_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in FIELDS.split(", ")]


def _batches(rows: list[tuple], most: int = 8192):
    for k in range(0, len(rows), most):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + most]), _KINDS)], names=_NAMES)


def _framed(batches, most: int = 8192):
    """Batches of rows of as many files as fill one."""
    rows = []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows += _rows(path.as_py(), content.as_py())
            if len(rows) >= most:
                yield from _batches(rows)
                rows = []
    yield from _batches(rows)


def frame(files: DataFrame) -> DataFrame:
    """Fields of (path, content); a stream with a wrong record, or a refused one, is one row with an error and no field."""
    if "refused" not in files.columns:
        return files.select("path", "content").mapInArrow(_framed, FIELDS)
    known = files.filter(F.col("refused").isNull()).select("path", "content").mapInArrow(_framed, FIELDS)
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in FIELDS.split(", ")} | {"path": F.col("path"), "offset": F.lit(0).cast("long"), "error": F.col("refused")}
    return known.unionByName(files.filter(F.col("refused").isNotNull()).select(*[v.alias(k) for k, v in none.items()]))


def fields_of(framed: DataFrame) -> DataFrame:
    return framed.filter(F.col("error").isNull()).drop("error")


def errors_of(framed: DataFrame) -> DataFrame:
    return framed.filter(F.col("error").isNotNull()).select("path", "offset", F.col("error").alias("message"))


class _File(InputPartition):
    def __init__(self, path: str, refused: str | None):
        self.path, self.refused = path, refused


class _Reader(DataSourceReader):
    def __init__(self, paths: list[tuple[str, str | None]]):
        self.paths = paths

    def partitions(self):
        return [_File(p, refused) for p, refused in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition.refused:
            yield from _batches([(partition.path, None, 0, None, None, None, None, partition.refused)])
            return
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as f:
            yield from _batches(_rows(partition.path, f.read()))


class AfpSource(DataSource):
    """``format("afp")``: fields of all files below a path, of any store that pyarrow opens by address."""

    @classmethod
    def name(cls) -> str:
        return "afp"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        from pathlib import PurePosixPath

        from pyarrow import fs

        path = self.options["path"]
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        found = store.get_file_info(root)
        some = [found] if found.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        most = int(self.options.get("maxFileBytes", MOST_BYTES))
        glob = self.options.get("pathGlobFilter", "*.afp")
        scheme = path.split("://")[0] if "://" in path else "file"
        files = [(f"{scheme}://{i.path}", TOO_LARGE % most if i.size > most else None) for i in some if i.is_file and PurePosixPath(i.path).match(glob)]
        return _Reader(sorted(files))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AfpSource)
