"""Sharding by jump consistent hashing, with DataFrame functions only.

Law ``key``: the key and the number of shards decide a row's shard; no table of a ring is
kept, and appending shards moves only the rows that go into the new ones. Rows of equal text
stay together only if the text (or its hash) is the key; under the key ``doc_id`` they need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.llm.common import stored, table

# The multiplier of the jump generator's linear congruence, as two 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 0x27BB2EE6, 0x87B0B0FD

LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF
#: Rows are numbered in independent pieces of each shard: at least so many, of about so many rows each.
PIECES_PER_SHARD, PIECE_ROWS = 64, 1 << 20


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on 32-bit halves: never overflows, so ANSI mode may be on."""
    c = F.lit(MULTIPLIER_LOW).cast("long")
    a = low.bitwiseAND(LOW16) * c
    b = F.shiftrightunsigned(low, 16) * c
    bottom = a + F.shiftleft(b.bitwiseAND(LOW16), 16) + 1
    carry = F.shiftrightunsigned(bottom, 32) + F.shiftrightunsigned(b, 16)
    cross = (low * F.lit(MULTIPLIER_HIGH).cast("long")).bitwiseAND(LOW32)
    d = high.bitwiseAND(LOW16) * c
    e = F.shiftleft((F.shiftrightunsigned(high, 16) * c).bitwiseAND(LOW16), 16)
    return (carry + cross + (d + e).bitwiseAND(LOW32)).bitwiseAND(LOW32), bottom.bitwiseAND(LOW32)


def jump_shards(key: Column, counts: list[int]) -> Column:
    """Array of the shards of a 64-bit ``key`` for each number of shards in ``counts``.

    The jumps of a key rise, and its shard among n is the last jump below n; so one fold over
    at most max(counts) jumps gives every count. A null key counts as 0.
    """
    most = max(counts)
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW32).cast("long")).alias("low"), zero.alias("jump"),
        *[zero.alias(f"s{n}") for n in counts],
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        reach = F.floor((s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double"))).cast("long")
        on = s["jump"] < most
        held = [F.when(s["jump"] < n, s["jump"]).otherwise(s[f"s{n}"]).alias(f"s{n}") for n in counts]
        return F.struct(
            F.when(on, high).otherwise(s["high"]).alias("high"), F.when(on, low).otherwise(s["low"]).alias("low"),
            F.when(on, reach).otherwise(s["jump"]).alias("jump"), *held,
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(most)), start, step, lambda s: F.array(*[s[f"s{n}"].cast("int") for n in counts]))


def shard(docs: DataFrame, shards: int, key: Column | None = None, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    key: what decides the shard; the first 64 bits of the MD5 of doc_id by default, of which null is a value like any other.
    size: UTF-8 bytes plus 8; a null text has none and crc32 0. slot: gapless from 0 within a shard, in
    order of (piece, doc_id, size, crc); rows alike in these may swap. Repeated rows get a slot each. Texts
    are taken whole; an empty table gives an empty one. Columns of other names, and names this function
    uses within, are not carried over.

    Slots take no pass through one task a shard: rows are numbered within pieces (hashes of doc_id;
    null ids, of which there may be many, are dealt by row) and the pieces' counts are summed up.
    Pieces grow in number with the rows, not in size.
    """
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.conv(F.substring(name, 1, 16), 16, -10).cast("long") if key is None else key
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"), jump_shards(key, [shards, shards + 1]).alias("jumps"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.conv(F.substring(name, 17, 8), 16, 10).cast("long")).alias("dealt"),
    )
    rows = stored(rows.select("doc_id", "size", "text_crc32", "dealt", F.col("jumps")[0].alias("shard"), F.col("jumps")[1].alias("grown_shard")), "shard")
    pieces = max(PIECES_PER_SHARD, rows.count() // (shards * PIECE_ROWS))
    rows = rows.withColumn("piece", F.pmod("dealt", F.lit(pieces)))
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = counts.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")) - 1
    numbered = rows.withColumn("within", within)
    # The second side has a row of 20 bytes for each PIECE_ROWS rows, or shards * PIECES_PER_SHARD.
    return numbered.join(F.broadcast(before), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).alias("slot"), "grown_shard"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)


QUERIES = {"op10_sharding": op10_sharding}
SQL: dict[str, str] = {}
