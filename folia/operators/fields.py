"""Tables over structured fields: names, nesting, pages, descriptions, counts, resources.

Inputs are tables of (path, field_seq, offset, sf_id, flags, sequence, data). Order matters within
a file only, so each window is partitioned by path, and all windows share one shuffle. Data
columns stay out of aggregates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.functions import describe, scans, tables
from folia.functions.text import codec_of_name, ebcdic

BPG, EPG, BMO, EMO, BDT, PTX, PGD = 0xD3A8AF, 0xD3A9AF, 0xD3A8DF, 0xD3A9DF, 0xD3A8A8, 0xD3EE9B, 0xD3A6AF
BFN, FNC, EFN, BCP, BCF = 0xD3A889, 0xD3A789, 0xD3A989, 0xD3A887, 0xD3A88A
MCF2, MCF1, MDR, MPO, IPO = 0xD3AB8A, 0xD3B18A, 0xD3ABC3, 0xD3ABD8, 0xD3AFD8
BEGIN, END = 0xA8, 0xA9


def labels(key: Column, names: dict[int, str]) -> Column:
    """Names of codes; null for others."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


@F.arrow_udf(T.StringType())
def ebcdic_text(data: pa.Array) -> pa.Array:
    return pa.array([None if b is None else ebcdic(b) for b in data.to_pylist()], pa.string())


def in_file(*more: str) -> Window:
    return Window.partitionBy("path", *more).orderBy("field_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def joined(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the files. Neither side is broadcast: estimates are of the tables that streams are made of, or of packed Parquet, and far too small."""
    return left.join(right.hint("merge"), on, how)


def named(fields: DataFrame) -> DataFrame:
    """Adds type_code, category_code, type_name, name and token_name."""
    kind = F.shiftright("sf_id", 8).bitwiseAND(0xFF)
    name = F.coalesce(labels(F.col("sf_id"), tables.FIELDS), F.format_string("Unknown (0x%06X)", F.col("sf_id")))
    token = F.when(kind.isin(BEGIN, END) & (F.octet_length("data") >= 8), F.substring("data", 1, 8))
    return fields.withColumns({
        "type_code": kind, "category_code": F.col("sf_id").bitwiseAND(0xFF), "type_name": labels(kind, tables.TYPES), "name": name, "token_name": ebcdic_text(token),
    })


def nested(fields: DataFrame) -> DataFrame:
    """Adds depth (that of End fields is their Begin's, never below 0) and page (of the bracket that a field stands in, or null)."""
    kind = F.shiftright("sf_id", 8).bitwiseAND(0xFF)
    w = in_file()
    step = F.when(kind == BEGIN, 1).when(kind == END, -1).otherwise(0)
    rows = fields.withColumn("_sum", F.sum(step).over(w))
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w)))
    depth = (F.col("_sum") - F.col("_low") - F.when(kind == BEGIN, 1).otherwise(0)).cast("int")
    begun = F.sum(F.when(F.col("sf_id") == BPG, 1).otherwise(0)).over(w) - 1
    # A page's End is still its own; what follows isn't.
    before = F.last(F.when(F.col("sf_id").isin(BPG, EPG), F.col("sf_id") == BPG), ignorenulls=True).over(
        Window.partitionBy("path").orderBy("field_seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    within = (F.col("sf_id") == BPG) | F.coalesce(before, F.lit(False))
    return rows.withColumns({"depth": depth, "page": F.when(within, begun).cast("int")}).drop("_sum", "_low")


TRIPLET = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "detail", "hex")] + [T.StructField("group", T.IntegerType())])
_TRIPLET = pa.struct([(n, pa.string()) for n in ("id", "name", "detail", "hex")] + [("group", pa.int32())])


@F.arrow_udf(T.ArrayType(TRIPLET))
def triplet_rows(sf_id: pa.Array, data: pa.Array) -> pa.Array:
    names = TRIPLET.fieldNames()
    rows = [[dict(zip(names, r)) for r in describe.triplet_rows(i, d)] for i, d in zip(sf_id.to_pylist(), data.to_pylist())]
    return pa.array(rows, pa.list_(_TRIPLET))


@F.arrow_udf(T.StringType())
def search_text(sf_id: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([describe.search_text(i, d) for i, d in zip(sf_id.to_pylist(), data.to_pylist())], pa.string())


@F.arrow_udf(T.StringType())
def summary(sf_id: pa.Array, data: pa.Array, font_control: pa.Array) -> pa.Array:
    return pa.array([describe.summary(*row) for row in zip(sf_id.to_pylist(), data.to_pylist(), font_control.to_pylist())], pa.string())


def triplets(fields: DataFrame) -> DataFrame:
    """(path, field_seq, triplet_seq, id, name, detail, hex, group) of every triplet."""
    rows = fields.filter(~F.col("sf_id").isin(PTX, 0xD3EEFB, 0xD3EE92)).select("path", "field_seq", F.posexplode(triplet_rows("sf_id", "data")).alias("triplet_seq", "t"))
    return rows.select("path", "field_seq", "triplet_seq", "t.*")


def field_rows(fields: DataFrame) -> DataFrame:
    """What an inspector shows of each field."""
    rows = nested(named(fields))
    sf = F.col("sf_id")
    control = F.when(sf == FNC, F.col("data")).when(sf.isin(BFN, EFN), F.lit(b""))
    rows = rows.withColumn("_fnc", F.when(sf == 0xD38C89, F.last(control, ignorenulls=True).over(in_file())))
    preview = F.trim(F.regexp_replace(F.lower(F.hex(F.substring("data", 1, 16))), "(..)", "$1 "))
    return rows.select(
        "path", "field_seq", "offset", F.format_string("0x%06X", sf).alias("sf_id"), "name", F.coalesce("token_name", F.lit("")).alias("token"),
        (F.octet_length("data") + 9).alias("size"), F.octet_length("data").alias("data_len"), "depth", preview.alias("preview"), "page",
        triplet_rows(sf, F.col("data")).alias("triplets"), search_text(sf, F.col("data")).alias("search_text"), summary(sf, F.col("data"), F.col("_fnc")).alias("data"),
    )


def with_loose_pages(rows: DataFrame, *items: DataFrame) -> DataFrame:
    """Field rows whose text fields outside pages get the first page that something of theirs stands on.

    items: tables of (path, page_idx, src), such as runs and rules; src is the offset of the field.
    """
    first = None
    for own in items:
        own = own.select("path", "page_idx", F.col("src").alias("offset"))
        first = own if first is None else first.unionByName(own)
    first = first.groupBy("path", "offset").agg(F.min("page_idx").alias("_first"))
    loose = F.col("page").isNull() & (F.col("sf_id") == f"0x{PTX:06X}")
    return rows.join(first, ["path", "offset"], "left").withColumn("page", F.when(loose, F.col("_first")).otherwise(F.col("page"))).select(rows.columns)


def histogram(fields: DataFrame) -> DataFrame:
    """(path, name, n, rank): how often each kind of field occurs; of equals the first seen comes first."""
    counts = named(fields.select("path", "field_seq", "sf_id", F.lit(b"").alias("data"))).groupBy("path", "name").agg(F.count("*").alias("n"), F.min("field_seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "first"))
    return counts.select("path", "name", "n", rank.alias("rank"))


def page_counts(fields: DataFrame) -> DataFrame:
    """(path, fields, bracketed pages, resource_kind); the kind is empty for streams with pages."""
    first = F.min(labels(F.col("sf_id"), {k: i for i, k in enumerate(tables.RESOURCE_KINDS)}))
    kinds = F.array(*[F.lit(v) for v in tables.RESOURCE_KINDS.values()])
    rows = fields.groupBy("path").agg(F.count("*").alias("n_fields"), F.sum((F.col("sf_id") == BPG).cast("long")).alias("bracketed_pages"), first.alias("kind"))
    kind = F.when(F.col("bracketed_pages") > 0, F.lit("")).otherwise(F.coalesce(F.get(kinds, F.col("kind")), F.lit("")))
    return rows.select("path", "n_fields", "bracketed_pages", kind.alias("resource_kind"))


RESOURCE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())]))


@F.arrow_udf(RESOURCE)
def _resources(sf_id: pa.Array, data: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "name": ebcdic(n)} for k, n in scans.resource_names(i, d)] for i, d in zip(sf_id.to_pylist(), data.to_pylist())]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string())])))


@F.arrow_udf(T.StringType())
def codec_by_name(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else codec_of_name(n) for n in names.to_pylist()], pa.string())


KIND_ORDER = {"coded font": 0, "code page": 1, "character set": 2}


def missing_resources(fields: DataFrame) -> DataFrame:
    """(path, kind, name, codec, rank) of font resources that a file's maps name and the file doesn't embed."""
    maps = fields.filter(F.col("sf_id").isin(MCF1, MCF2))
    named_ = maps.select("path", F.explode(_resources("sf_id", "data")).alias("r")).select("path", "r.*").filter("name != ''").distinct()
    begins = fields.filter(F.col("sf_id").isin(BCP, BFN, BCF) & (F.octet_length("data") >= 8))
    kind = labels(F.col("sf_id"), {BCP: "code page", BFN: "character set", BCF: "coded font"})
    embedded = begins.select("path", kind.alias("kind"), ebcdic_text(F.substring("data", 1, 8)).alias("name")).distinct()
    rows = named_.join(embedded, ["path", "kind", "name"], "left_anti").withColumn("codec", F.when(F.col("kind") == "code page", codec_by_name("name")))
    order = labels(F.col("kind"), KIND_ORDER)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(order, "name")))


MAPPED = T.ArrayType(T.StructType([T.StructField("local_id", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("label", "codec", "code_page", "character_set")]]))


@F.arrow_udf(MAPPED)
def font_mappings(sf_id: pa.Array, data: pa.Array) -> pa.Array:
    """What a coded-font map says of each local id."""
    out = []
    for i, d in zip(sf_id.to_pylist(), data.to_pylist()):
        pages, names = describe.code_pages(i, d), describe.font_resources(i, d)
        rows = []
        for local in {**pages, **names}:
            label, codec = pages.get(local, (None, None))
            page, chars = names.get(local, (None, None))
            rows.append({"local_id": local, "label": label, "codec": codec, "code_page": page, "character_set": chars})
        out.append(rows)
    kind = pa.list_(pa.struct([("local_id", pa.int32()), *[(n, pa.string()) for n in ("label", "codec", "code_page", "character_set")]]))
    return pa.array(out, kind)


def coded_fonts(fields: DataFrame) -> DataFrame:
    """(path, field_seq, pos, local_id, label, codec, code_page, character_set) of each mapping."""
    maps = fields.filter(F.col("sf_id").isin(MCF1, MCF2))
    return maps.select("path", "field_seq", F.posexplode(font_mappings("sf_id", "data")).alias("pos", "m")).select("path", "field_seq", "pos", "m.*")


def code_page_note(fields: DataFrame) -> DataFrame:
    """(path, note): distinct code pages that a file's maps name, in order, joined by commas."""
    label = F.concat_ws(" → ", "label", "codec")
    firsts = coded_fonts(fields).filter(F.col("label").isNotNull()).groupBy("path", label.alias("label")).agg(F.min(F.struct("field_seq", "pos")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "label")))
    return firsts.groupBy("path").agg(F.array_join(F.transform(listed, lambda x: x["label"]), ", ").alias("note"))
