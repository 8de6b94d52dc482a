"""Queries over print streams that are made of the rows of tables.

Each builds streams of its table's rows inside Spark, reads them with the engine, and returns
what it read; the SQL beside it gives the same answer from the rows themselves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.operators import fields as ops
from folia.operators import layout
from folia.sources import afp
from folia.sources import writer as w


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def building(build):
    """A column of streams, each of one row of the columns given."""

    @F.arrow_udf(T.BinaryType())
    def built(*columns: pa.Array) -> pa.Array:
        return pa.array([build(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.binary())

    return built


def read(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return afp.fields_of(afp.frame(rows.select(path.cast("string").alias("path"), content.alias("content"))))


def _text_document(text: str) -> bytes:
    runs = w.runs(text or "")
    return w.document(w.page(*[w.text_field(*runs[k : k + 100]) for k in range(0, len(runs), 100)]))


def ptx_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text, written as transparent data and read from the text controls."""
    rows = table(spark, sf_dir, "documents")
    found = read(rows, F.col("doc_id"), building(_text_document)("text"))
    runs = layout.controls(found).filter(F.col("cs_type") == layout.TRN)
    runs = runs.select("path", "field_seq", "cs_seq", layout.decoded("params", F.lit("cp500"))["text"].alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("field_seq", "cs_seq", "part")))
    texts = runs.groupBy("path").agg(F.array_join(F.transform(listed, lambda r: r["part"]), "").alias("text")).select(F.col("path").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _tags(segments: list[str]) -> bytes:
    name = w.triplet(0x02, b"\x0b\x00" + "Segment".encode("cp500"))
    return w.document(*[w.record(0xD3A090, name + w.triplet(0x36, b"\0\0" + s.encode("cp500"))) for s in segments])


#: Customers of a stream, at most.
STREAM_ROWS = 1000


def by_nation(spark: SparkSession, sf_dir: str, item: Column) -> DataFrame:
    """(c_nationkey, part, items): a nation's customers in parts of bounded size, whatever their number."""
    part = F.floor(F.col("c_custkey") / STREAM_ROWS)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", part.alias("part")).agg(F.collect_list(item).alias("items"))


def document_name() -> Column:
    return F.concat_ws("-", "c_nationkey", "part")


def tle_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation by segment, counted from index tags."""
    rows = by_nation(spark, sf_dir, F.col("c_mktsegment"))
    found = ops.triplets(read(rows, document_name(), building(_tags)("items"))).filter("id = '0x36'")
    value = F.regexp_extract("detail", '^"(.*)"$', 1).alias("segment")
    return found.groupBy(F.substring_index("path", "-", 1).cast("int").alias("nation"), value).agg(F.count("*").alias("n"))


def _order(lines: list[int]) -> bytes:
    return w.document(w.page(*[w.text_field(*w.runs(f"line {n}")) for n in lines]))


def field_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of field occurs in the stream of an order: a page, with a text field for each line."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("l"))
    found = ops.histogram(read(rows, F.col("l_orderkey"), building(_order)("l")))
    return found.select(F.col("path").cast("long").alias("l_orderkey"), "name", "n", "rank")


def _turns(texts: list[dict]) -> bytes:
    pages = []
    for turn in sorted(texts, key=lambda t: t["turn"]):
        moves = []
        for k, line in enumerate(turn["text"].split("\n")):
            for i, word in enumerate(line.split()):
                moves += [(0xC6, w.s16(min(100 + 200 * i, 30000))), (0xD2, w.s16(100 * (k + 1))), *w.runs(word)]
        pages.append(w.page(*[w.text_field(*moves[k : k + 90]) for k in range(0, len(moves), 90)]))
    return w.document(*pages)


def conversation_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, words as placed runs, read back in reading order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("t"))
    _, texts, _ = layout.layout(read(rows, F.col("conv_id"), building(_turns)("t")))
    return layout.page_text(texts).select(F.col("path").cast("long").alias("conv_id"), "page_idx", "text")


def _maps(sizes: list[int]) -> bytes:
    groups = [w.font_map(k % 255 + 1, f"T1V1{n:04d}", f"C0H2{n:02d}B0") for k, n in enumerate(sizes)]
    embedded = [w.record(0xD3A887, w.name8(f"T1V1{n:04d}")) + w.record(0xD3A987, w.name8(f"T1V1{n:04d}")) for n in sizes if n % 2 == 0]
    return w.document(*[w.record(0xD3AB8A, b"".join(groups[k : k + 100])) for k in range(0, len(groups), 100)], *embedded)


def missing_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code pages and character sets that the streams of brands name for their sizes and don't embed; even sizes' code pages are embedded."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("s"))
    found = ops.missing_resources(read(rows, F.col("p_brand"), building(_maps)("s")))
    return found.select(F.col("path").alias("p_brand"), "kind", "name", "rank")


def _rules(lengths: list[int]) -> bytes:
    rules = [(0xE4, w.s16(n)) for n in lengths]
    # Of each page only the first layout.MOST_RUNS rules are read.
    pages = [rules[k : k + layout.MOST_RUNS] for k in range(0, len(rules), layout.MOST_RUNS)]
    return w.document(*[w.page(w.page_descriptor(12240, 15840), *[w.text_field(*page[k : k + 100]) for k in range(0, len(page), 100)]) for page in pages])


def rules_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as long as the quantities of an order's lines: their number and total length by order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity") * 10).cast("int")).alias("q"))
    _, _, rules = layout.layout(read(rows, F.col("l_orderkey"), building(_rules)("q")))
    return rules.groupBy(F.col("path").cast("long").alias("l_orderkey")).agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("total"))


#: Places go round here, as 24 bits hold no more.
PLACES = 1 << 22


def _letters(nation: str, customers: list[int]) -> bytes:
    form = w.record(0xD3A8DF, w.name8("FORM")) + w.text_field((0xC6, w.s16(10)), (0xD2, w.s16(20)), *w.runs(nation)) + w.record(0xD3A9DF, w.name8("FORM"))
    pages = [w.page(w.record(0xD3AFD8, w.name8("FORM") + w.s24(k) + w.s24(0))) for k in customers]
    return w.document(form, *pages)


def overlay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letterhead overlay for each nation, placed on a page for each customer: pages and the sum of places by nation."""
    rows = by_nation(spark, sf_dir, F.col("c_custkey") % PLACES).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    _, texts, _ = layout.layout(read(rows, document_name(), building(_letters)("n_name", "items")))
    return texts.groupBy(F.col("text").alias("n_name")).agg(F.count("*").alias("pages"), F.sum("x").cast("long").alias("places"))


def _area(key: int, size: int) -> bytes:
    return w.document(w.record(0xD3A66B, w.triplet(0x4C, b"\0" + (size * 100).to_bytes(3, "big") + (key % (1 << 24)).to_bytes(3, "big"))))


def triplet_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object areas as wide as parts are large, as their triplets tell."""
    rows = table(spark, sf_dir, "part")
    found = ops.triplets(read(rows, F.col("p_partkey"), building(_area)("p_partkey", "p_size"))).filter("id = '0x4C'")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "detail")


def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and page of the text fields of orders' streams."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("l"))
    found = ops.nested(read(rows, F.col("l_orderkey"), building(_order)("l"))).filter(F.col("sf_id") == ops.PTX)
    return found.groupBy(F.col("path").cast("long").alias("l_orderkey"), "depth", "page").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        ptx_text_roundtrip, tle_index, field_histogram, nesting_depth, conversation_reading_order, missing_resources, rules_extent, overlay_join, triplet_measurements,
    )
}

SQL = {
    "ptx_text_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "tle_index": "SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL",
    "field_histogram": """
        SELECT l_orderkey, name, n, rank::INT AS rank FROM (SELECT l_orderkey, count(*) AS lines, (count(*) > 1)::INT AS much FROM lineitem GROUP BY 1), LATERAL (VALUES
            ('BDT (Begin Document)', 1::BIGINT, 1 + much), ('BPG (Begin Page)', 1, 2 + much), ('PTX (Presentation Text Data)', lines, 3 - 2 * much), ('EPG (End Page)', 1, 4), ('EDT (End Document)', 1, 5)) AS v(name, n, rank)""",
    "nesting_depth": "SELECT l_orderkey, 2::INT AS depth, 0::INT AS page, count(*) AS n FROM lineitem GROUP BY 1",
    "conversation_reading_order": r"""
        SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS page_idx,
            array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text
        FROM conversations""",
    "missing_resources": """
        SELECT p_brand, kind, name, row_number() OVER (PARTITION BY p_brand ORDER BY kind = 'character set', name)::INT AS rank FROM (
            SELECT DISTINCT p_brand, 'code page' AS kind, 'T1V1' || lpad(p_size::VARCHAR, 4, '0') AS name FROM part WHERE p_size % 2 = 1
            UNION SELECT p_brand, 'character set', 'C0H2' || lpad(p_size::VARCHAR, 2, '0') || 'B0' FROM part)""",
    "rules_extent": "SELECT l_orderkey, count(*) AS n, sum((l_quantity * 10)::INT)::BIGINT AS total FROM lineitem GROUP BY 1",
    "overlay_join": "SELECT n_name, count(*) AS pages, sum(c_custkey % 4194304 + 10)::BIGINT AS places FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "triplet_measurements": "SELECT p_partkey, (p_size * 100)::VARCHAR || ' × ' || p_partkey::VARCHAR AS detail FROM part",
}
