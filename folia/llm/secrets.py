"""Secret scans with an incremental ledger of blobs.

Every text, of any version of any path, is addressed by the SHA-256 of its UTF-8 bytes. The
ledger keeps one row for each blob and version of the rules that was scanned, findings or none.
A run scans only the pairs that the ledger lacks, each blob once however many rows hold it,
appends them, and joins the ledger's findings back to all rows.

A null text is the empty blob. Texts are scanned whole, however long. Repeated rows share a blob and
all get its findings; an empty table gives an empty table. Of each blob a task sends one copy at
most, so a text that a third of all rows have is no hot task; its findings are joined back to rows
by hash without their texts. One writer at a time may append to a ledger; an append is a
committed write, so a lost executor or a failed run leaves no part of it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import bounded, scratch, slices, stored, table, unused, utf8

#: Raised whenever a rule changes: blobs scanned under another version are scanned anew.
RULES_VERSION = 1

# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Texts without these can't match ASSIGN, nor be searched for it.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Kinds beyond the base: a mark that must be in the text, then the pattern.
MORE = {
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")),
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}
KINDS = ["assign", "access", "hex", *MORE]

SCANNED = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret by start, then kind as listed; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    for kind, (mark, pattern) in MORE.items():
        if mark in text:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def _packed(batches):
    """Blobs of a task's rows, each once in a task, compressed for the shuffle."""
    packer = zstandard.ZstdCompressor(level=3)
    met: set[bytes] = set()
    for batch in batches:
        blobs, packs = [], []
        for part in slices(batch.column(0)):
            for b in part:
                if (blob := hashlib.sha256(b).digest()) not in met:
                    if len(met) >= 1 << 20:  # copies beyond are dropped after the shuffle
                        met.clear()
                    met.add(blob)
                    blobs.append(blob)
                    packs.append(packer.compress(b))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(packs, pa.binary())], names=["blob", "pack"])


def _scanned(batches):
    """Findings of each blob of the task; all rows of a blob are in one task and at most one a task that met it."""
    unpacker = zstandard.ZstdDecompressor()
    met: set[bytes] = set()
    for batch in batches:
        rows = []
        for blob, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if blob in met:
                continue
            met.add(blob)
            found = find(unpacker.decompress(pack).decode("utf-8", "replace"))
            base = [x for x in found if x[2] not in MORE]
            n = [sum(x[2] == k for x in base) for k in KINDS[:3]]
            rows.append((blob, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def update_ledger(docs: DataFrame, ledger: str, version: int = RULES_VERSION) -> DataFrame:
    """Scans what the ledger at path ``ledger`` lacks of the rows' blobs, appends it, and returns the ledger's rows of this version."""
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select(utf8().alias("b"))
    if _exists(spark, ledger):
        # Hashes alone find what is new; where that is little, texts that were seen before don't move at all.
        texts = texts.withColumn("blob", F.unhex(F.sha2("b", 256)))
        seen = spark.read.parquet(ledger).filter(F.col("rules") == version).select("blob")
        unseen = stored(texts.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
        texts = texts.join(unseen, "blob", "left_semi").select("b")
    packs = texts.mapInArrow(_packed, "blob binary, pack binary")
    packs.repartition(F.col("blob")).mapInArrow(_scanned, SCANNED).withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger).filter(F.col("rules") == version).drop("rules")


def scan(docs: DataFrame, ledger: str | None = None, version: int = RULES_VERSION, out: str = "secrets") -> DataFrame:
    """The rows with a column ``out``: n_assign, n_access, n_hex, base_sha256, spans of their text.

    ledger: a path in storage that all executors share, or a fresh one for this run alone.
    A column named ``out`` in the rows is replaced; all others stay.
    """
    found = update_ledger(docs, ledger or scratch(docs.sparkSession, "ledger"), version)
    blob = unused("_blob", docs.columns)
    found = found.select(F.col("blob").alias(blob), F.struct("n_assign", "n_access", "n_hex", "base_sha256", "spans").alias(out))
    rows = docs.drop(out).withColumn(blob, F.unhex(F.sha2(utf8(), 256)))
    return rows.join(found, blob, "left").drop(blob)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows, all of them, with their own columns; secrets are replaced by a mark in the text, and n_chars follows."""
    name = unused("secrets", docs.columns)
    found = scan(docs, out=name)
    some = F.coalesce(F.col(name)["spans"] != "", F.lit(False))
    text = unused("_clean", found.columns)
    found = found.withColumn(text, F.when(some, redacted(F.col("text"), F.when(some, F.col(name)["spans"]))).otherwise(F.col("text")))
    n_chars = F.when(some, F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return found.select(*[{"text": F.col(text), "n_chars": n_chars}.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


MARK = "[secret]"


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts with each run of overlapping spans replaced by ``MARK``."""
    out = []
    for text, joined in ((texts[k].as_py(), spans[k].as_py()) for k in range(len(texts))):
        if text is not None and joined:
            parts, end = [], 0
            for _, a, b in (s.split(":") for s in joined.split(",")):
                a, b = int(a), int(b)
                if a >= end:
                    parts += [text[end:a], MARK]
                end = max(end, b)
            text = "".join([*parts, text[end:]])
        out.append(text)
    return pa.array(out, pa.string())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


QUERIES = {"op7_secrets": op7_secrets}
SQL: dict[str, str] = {}
