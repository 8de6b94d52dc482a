"""Queries that hold the readers against streams of literal bytes made of tables' rows.

Unlike the round trips, streams here are put together from the format's byte layouts, with EBCDIC
text, and the SQL beside each says what the format means by them.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.operators import fields as ops
from folia.operators import glyphs, layout, objects, render, specimens
from folia.plans.queries import building, read, table
from folia.sources import afp
from folia.sources.samples import samples
from folia.sources.shared import written


def _sf(code: str, data: bytes = b"") -> bytes:
    return b"\x5a" + struct.pack(">H", len(data) + 8) + bytes.fromhex(code) + bytes(3) + data


def _t(code: int, data: bytes) -> bytes:
    return bytes([len(data) + 2, code]) + data


def _e(text: str, codec: str = "cp500") -> bytes:
    return text.encode(codec)


def _ptx(*controls: str | bytes) -> bytes:
    """Controls without chaining, each with its own escape."""
    return _sf("D3EE9B", b"".join(b"\x2b\xd3" + (bytes([len(c) + 1]) + c if isinstance(c, bytes) else bytes.fromhex(c)) for c in controls))


def _h(v: int) -> bytes:
    return struct.pack(">h", v)


def _doc(*body: bytes) -> bytes:
    return _sf("D3A8A8", _e("DOC00001")) + b"".join(body) + _sf("D3A9A8", _e("DOC00001"))


def _page(*body: bytes) -> bytes:
    return _sf("D3A8AF", _e("PAGE    ")) + b"".join(body) + _sf("D3A9AF", _e("PAGE    "))


def _triplets(key: int, size: int, brand: str, kind: str) -> bytes:
    return _doc(_sf("D3A66B", b"".join((
        _t(0x26, (bytes.fromhex("0000"), bytes.fromhex("2D00"), bytes.fromhex("5A00"), bytes.fromhex("8700"))[size % 4]), _t(0x8B, bytes(2) + struct.pack(">H", size * 20)),
        _t(0x01, struct.pack(">HH", 697, 37) if size % 2 else struct.pack(">HH", 0, 500)), _t(0x4B, struct.pack(">BBHH", size % 2, 0, size * 10, size)), _t(0x24, bytes([5, size])), _t(0x25, bytes([size])),
        _t(0x02, b"\x0b\x00" + _e(brand)), _t(0x36, b"\0\0" + _e(kind)), _t(0x57, struct.pack(">I", key)), _t(0x62, b"\x00" + _e(f"099{size:03d}12345600")),
        _t(0x65, b"made in " + str(size).encode()), _t(0x65, _e("gemacht")), _t(0x68, bytes([size % 6])), _t(0x50, struct.pack(">H", size)), _t(0x10, b"\x40"), _t(0xF0, b"\x01"),
    ))))


def triplet_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every described kind of triplet, of a part's values: identifier, name and detail in order."""
    found = ops.triplets(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_triplets)("p_partkey", "p_size", "p_brand", "p_type")))
    return found.filter("field_seq = 1").select(F.col("path").cast("long").alias("p_partkey"), "triplet_seq", "id", "name", "detail")


def _inspected(key: int, name: str, segment: str, nation: int) -> bytes:
    return _doc(
        _sf("D3EEEE", _e(name)), _sf("D3A090", _t(0x02, b"\x0b\x00" + _e("Segment")) + _t(0x36, b"\0\0" + _e(segment))),
        _sf("D3AB8A", b"\x00\x1e" + _t(0x02, b"\x85\x00" + _e("T1V10500")) + _t(0x02, b"\x86\x00" + _e("C0H200B0")) + _t(0x24, b"\x05\x01")),
        _page(_sf("D3A6AF", struct.pack(">BBHHBHBHB", 0, 0, 14400, 14400, 0, 1000 + nation, 0, 2000, 0) + bytes(2)), _ptx(b"\xda" + _e(f"Key {key}")), _sf("D3AFD8", _e("FORM    ") + bytes([0, 0, nation, 0, 0, 5]))),
        _sf("D3A6FB", struct.pack(">BHHHH", 0, 3000, 3000, 8 * (nation + 1), nation + 1)), _sf("D3ABD8", b"\x00\x12" + _t(0x02, b"\x84\x00" + _e("OVERLAY1")) + _t(0x24, bytes([2, nation + 1]))),
    )


def field_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inspector shows of each field of a customer's stream: names, sizes, places, depth, page, preview, text to search, summary."""
    found = read(table(spark, sf_dir, "customer"), F.col("c_custkey"), building(_inspected)("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    return ops.field_rows(found).select(F.col("path").cast("long").alias("c_custkey"), "field_seq", "sf_id", "name", "token", "size", "depth", F.coalesce("page", F.lit(-1)).alias("page"), F.col("data").alias("summary"), "search_text")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, pages, code pages named, and the most frequent kind of field, of the same streams."""
    found = read(table(spark, sf_dir, "customer"), F.col("c_custkey"), building(_inspected)("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))
    first = ops.histogram(found).filter("rank = 1").select("path", F.col("name").alias("most"), F.col("n").alias("times"))
    rows = ops.page_counts(found).join(ops.code_page_note(found), "path").join(first, "path")
    return rows.select(F.col("path").cast("long").alias("c_custkey"), "n_fields", "bracketed_pages", "resource_kind", "note", "most", "times")


def _damaged(key: int) -> bytes:
    good = _doc(_page())
    return (good, b"\n<html>", good[:-4], good[:17] + b"\x5a\x00\x03" + good[17:], b"", good + b"x")[key % 6]


def framing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams damaged in several ways, by supplier's key: the offset and the message of the error, or the number of fields."""
    rows = table(spark, sf_dir, "supplier")
    framed = afp.frame(rows.select(F.col("s_suppkey").cast("string").alias("path"), building(_damaged)("s_suppkey").alias("content")))
    bad = afp.errors_of(framed).select("path", "offset", "message")
    n = afp.fields_of(framed).groupBy("path").agg(F.count("*").alias("n_fields"))
    return rows.select("s_suppkey", F.col("s_suppkey").cast("string").alias("path")).join(bad, "path", "left").join(n, "path", "left").select("s_suppkey", F.coalesce("offset", F.lit(-1)).cast("long").alias("position"), F.coalesce("message", F.lit("")).alias("message"), F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


CODECS = (("T1V10500", "cp500"), ("T1001140", "cp1140"), ("T1V10037", "cp037"))


def _letter(key: int, name: str, nation: int) -> bytes:
    code_page, codec = CODECS[key % 3]
    text = f"[Mr!] {name}"
    angle = 11520 * (key % 4)
    return _doc(
        _sf("D3AB8A", b"\x00\x1e" + _t(0x02, b"\x85\x00" + _e(code_page)) + _t(0x02, b"\x86\x00" + _e("C0H200B0")) + _t(0x24, b"\x05\x07")),
        _page(
            _ptx(b"\xf0\x07", b"\x74" + (b"\x00\x02" if nation % 2 else b"\x00\x04"), b"\xc0" + struct.pack(">H", 100 + nation), b"\xd0" + _h(240), b"\xd8\x00", b"\xda" + _e(text, codec), b"\xc8" + _h(50), b"\xd4" + _h(-10), b"\xda" + _e("x", codec)),
            _ptx(b"\x80" + bytes.fromhex("00010000000008080800") + bytes([nation, 128, 255]), b"\xc4" + struct.pack(">H", 77), b"\xf6" + struct.pack(">HH", angle, (angle + 11520) % 46080), b"\xc6" + _h(1000), b"\xd2" + _h(2000 + nation), b"\xda" + _e("a b", codec)),
        ),
    )


def text_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in three code pages with fonts, colours, margins, lines, relative moves, word spaces and four orientations, by customer."""
    _, texts, _ = layout.layout(read(table(spark, sf_dir, "customer"), F.col("c_custkey"), building(_letter)("c_custkey", "c_name", "c_nationkey")))
    return texts.select(F.col("path").cast("long").alias("c_custkey"), "page_idx", "item_seq", "x", "y", "text", "color", "font_id", "font_size", "font_family", "font_weight", "orientation", F.coalesce("space_width", F.lit(-1)).alias("space_width"))


def _forms(key: int, nation: int) -> bytes:
    """An overlay of half the units an inch, placed by name and by local id; then loose text."""
    half = struct.pack(">BBHHBHBHB", 0, 0, 7200, 7200, 0, 6120, 0, 7920, 0) + bytes(2)
    form = _sf("D3A8DF", _e("FORM0001")) + _sf("D3A6AF", half) + _ptx(b"\xc6" + _h(30), b"\xd2" + _h(key % 1000), b"\xda" + _e("form"), b"\xe4" + _h(100) + _h(10)) + _sf("D3A9DF", _e("FORM0001"))
    names = _sf("D3ABD8", b"\x00\x12" + _t(0x02, b"\x84\x00" + _e("FORM0001")) + _t(0x24, bytes([2, 9])))
    page = _page(_sf("D3AFD8", _e("FORM0001") + bytes([0, 0, 100, 0, 0, nation])), _sf("D3AFD8", bytes([0] * 7 + [9]) + bytes([0, 3, 0, 0, 4, 0])), _sf("D3AFD8", _e("UNKNOWN ") + bytes(6)))
    loose = _ptx(b"\xc6" + _h(500), b"\xd2" + _h(700), b"\xda" + _e("one"), b"\xd2" + _h(15520 + 60 + nation), b"\xc6" + _h(510), b"\xda" + _e("two"))
    return _doc(form, names, page, loose)


def overlays_and_loose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and rules of overlays of another scale on pages, and of text outside pages cut into pages, by supplier."""
    rows = table(spark, sf_dir, "supplier")
    _, texts, rules = layout.layout(read(rows, F.col("s_suppkey"), building(_forms)("s_suppkey", "s_nationkey")))
    key, none = F.col("path").cast("long").alias("s_suppkey"), F.lit(-1)
    texts = texts.select(key, "page_idx", "text", "x", "y", none.alias("length"), none.alias("thickness"))
    return texts.unionByName(rules.select(key, "page_idx", F.lit("rule").alias("text"), "x", "y", "length", "thickness"))


def pages_of_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that an inspector names for each text field, those of overlays and outside pages among them."""
    found = written(read(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), building(_forms)("s_suppkey", "s_nationkey")), "forms")
    _, texts, rules = layout.layout(found)
    rows = ops.with_loose_pages(ops.field_rows(found), texts, rules).filter("sf_id = '0xD3EE9B'")
    return rows.select(F.col("path").cast("long").alias("s_suppkey"), "field_seq", F.coalesce("page", F.lit(-1)).alias("page"))


def _bare(key: int, nation: int) -> bytes:
    """Overlays without a document: two of one name, of which the last counts, an empty one, and another."""
    form = lambda name, text: _sf("D3A8DF", _e(name)) + _sf("D3A6AF", struct.pack(">BBHHBHBHB", 0, 0, 14400, 14400, 0, 3000 + nation, 0, 2000, 0) + bytes(2)) + (_ptx(b"\xc6" + _h(40), b"\xd2" + _h(key % 1000), b"\xda" + _e(text)) if text else b"") + _sf("D3A9DF", _e(name))
    return form("FIRST   ", "old") + form("OTHER   ", f"other {key}") + form("EMPTY   ", "") + form("FIRST   ", f"first {key}")


def bare_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of files that hold nothing else, shown as pages."""
    pages, texts, _ = layout.layout(read(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), building(_bare)("s_suppkey", "s_nationkey")))
    rows = texts.join(pages.withColumnRenamed("kind", "page_kind"), ["path", "page_idx"])
    return rows.select(F.col("path").cast("long").alias("s_suppkey"), "page_idx", "text", "x", "y", "width", "height", "page_kind")


def _window(width: int, height: int) -> bytes:
    return b"\xf6\x12" + struct.pack(">3xBHH2xhhhh", 0, 1000, 1000, 0, width, 0, height)


def _segment(orders: bytes) -> bytes:
    return b"\x70\x0c" + bytes(4) + b"\0\0" + struct.pack(">H", len(orders)) + bytes(4) + orders


def _drawing(key: int, size: int) -> bytes:
    x, y = size, 100 + key % 700
    orders = bytes([0x0A, size % 6 + 1, 0x19, size % 5 + 1]) + b"\xc0\x0a" + struct.pack(">hhhhh", 0, x, 100, x + 200, y)  # a box
    orders += b"\x21\x04" + struct.pack(">hh", x, 100) + b"\x81\x08" + struct.pack(">hhhh", x + 50, y, x + 100, 100) + b"\xa1\x04" + bytes([10, 246, 5, 7])  # lines
    orders += b"\xb2\x09" + bytes.fromhex("000108080800") + bytes([255, size, 0]) + b"\x68\x40\x21\x04" + struct.pack(">hh", 0, 0) + b"\x81\x08" + struct.pack(">hhhh", x, 0, x, x) + b"\x60\x00"  # an area
    orders += bytes([0x18, 2]) + b"\xc7\x06" + struct.pack(">hh", 500, 300) + bytes([size, 0])  # a circle
    orders += b"\x22\x08" + struct.pack(">hhhh", 2, 1, 0, 0) + b"\xe3\x12" + struct.pack(">hhhhBBII", 500, 500, 500, 500, size, 0, 0, 90 << 16)  # a quarter of an ellipse
    orders += b"\x18\x08" + b"\xe5\x10" + struct.pack(">8h", 0, 0, x, 0, x, x, 0, x)  # a curve that isn't seen
    split = len(orders) // 2
    whole = _segment(orders)
    units = struct.pack(">BBHH", 0, 0, 7200, 7200)
    area, place = _sf("D3A66B", _t(0x4B, units) + _t(0x4C, bytes([0, 0, 2, size, 0, 1, size]))), _sf("D3AC6B", bytes([1, 23]) + bytes([0, 0, size, 0, 1, 0]) + bytes(15))
    hidden = b"\x70\x0c" + bytes(4) + b"\0\x80" + struct.pack(">H", 4) + bytes(4) + b"\x0a\x02\x0a\x02"  # an unchained segment
    return _doc(_page(_sf("D3A8BB", bytes(8)), area, place, _sf("D3A6BB", _window(999, 899)), _sf("D3EEBB", hidden + whole[:split]), _sf("D3EEBB", whole[split:]), _sf("D3A9BB", bytes(8))))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, lines, areas, arcs and curves of a part's values as SVG, and where they stand on the page."""
    found = objects.graphics(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_drawing)("p_partkey", "p_size")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "page_idx", "x", "y", "width", "height", "window_width", "window_height", "shapes", "svg")


def _picture(key: int, size: int) -> bytes:
    segment = b"\x94\x09\x00" + struct.pack(">HHHH", 3000, 3000, 8, size) + b"\x95\x02\x03\x01" + b"\xfe\x92" + struct.pack(">H", size) + bytes([key % 256] * size)
    segment = b"\x70\x00\x91\x01\xff" + segment + b"\x93\x00\x71\x00"
    area = _sf("D3A66B", _t(0x4B, struct.pack(">BBHH", 0, 0, 2400, 2400)) + _t(0x4C, bytes([0, 0, 0, 48, 0, 0, size])))

    bar = struct.pack(">BBHH", 0, 0, 14400, 14400) + bytes(6) + bytes([0x20, 2]) + bytes(3) + bytes([21])
    symbol = b"\x00" + struct.pack(">HH", size, key % 1000) + bytes([0, 0, size % 41, size % 4, 0, 0, 0, 0, 0]) + f"part {key}".encode()
    hidden = b"\x04" + symbol[1:]
    return _doc(_page(
        _sf("D3A8FB", _e("IMAGE001")), area, _sf("D3AC6B", bytes([1, 23, 0, 0, size, 255, 255, 255]) + bytes(15)), _sf("D3EEFB", segment[:20]), _sf("D3EEFB", segment[20:]), _sf("D3A9FB", _e("IMAGE001")),
        _sf("D3A8EB", bytes(8)), _sf("D3A6EB", bar), _sf("D3EEEB", symbol), _sf("D3EEEB", hidden), _sf("D3A9EB", bytes(8)),
    ))


def images_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bilevel images of a part's size on a page: place and extent in page units, and the bytes of the image field that spans two fields."""
    found = read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_picture)("p_partkey", "p_size"))
    data = objects.image_fields(found).filter(F.col("code") == 0xFE92).select("path", F.lower(F.hex("operand")).alias("bits"))
    rows = objects.images(found).join(data, "path")
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "page_idx", "x", "y", "width", "height", "mime", "bits")


def bar_code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar-code symbols of parts; suppressed ones are left out."""
    found = objects.bar_codes(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_picture)("p_partkey", "p_size")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "type", "modifier", "upi", "module_mils", "version", "ec_level", "x", "y", "data")


def _font(key: int, size: int) -> bytes:
    letters = [chr(65 + (size + k) % 26) for k in range(3)]
    pages = b"".join(_e(f"L{c}020000") + bytes([0, 0xC1 + k]) for k, c in enumerate(letters)) + _e("1A000000") + bytes([0, 1])
    control = bytes([1, 5, 0, 0, 0, 0]) + bytes(9) + bytes([28, 0]) + bytes(13)
    index = b"".join(_e(f"L{c}020000") + struct.pack(">HHhHH", size + k, 0, size - 30 - k, 0, k) + bytes(10) for k, c in enumerate(letters))
    boxes = b"".join(struct.pack(">HHI", 7, size % 8 + k, 0) for k in range(3))
    return _doc(
        _sf("D3A887", _e("T1OWN001")), _sf("D38C87", pages), _sf("D3A987", _e("T1OWN001")),
        _sf("D3A889", _e("C0OWN001")), _sf("D3A789", control), _sf("D3A689", _e("OWN FACE".ljust(32)) + bytes(10)), _sf("D38C89", index), _sf("D3A289", boxes), _sf("D3EE89", bytes(range(16))), _sf("D3A989", _e("C0OWN001")),
        _sf("D3AB8A", b"\x00\x1e" + _t(0x02, b"\x85\x00" + _e("T1OWN001")) + _t(0x02, b"\x86\x00" + _e("C0ELSE01")) + _t(0x24, b"\x05\x07")),
    )


def embedded_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of embedded code pages; records whose name isn't a letter's are left out."""
    found = objects.code_pages(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_font)("p_partkey", "p_size")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "name", "code_point", "gcgid")


def embedded_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster glyphs of embedded fonts: boxes joined with the font's index, and their bits."""
    found = objects.fonts(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_font)("p_partkey", "p_size")))
    glyphs = objects.font_glyphs(found).join(found.select("path", "object", "name", "typeface"), ["path", "object"])
    return glyphs.select(F.col("path").cast("long").alias("p_partkey"), "name", "typeface", "pattern", "gcgid", "width", "height", "char_increment", "baseline_offset", F.hex("bits").alias("bits"))


def resources_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of font resource that streams name and don't embed, in order."""
    found = ops.missing_resources(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_font)("p_partkey", "p_size")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "kind", "name", "codec", "rank")


def _bridge(key: int, size: int) -> bytes:
    """An embedded font of some letters in two orientations, named, with an external code page; a run in it."""
    letters = "abcdefghij"[: size % 10 + 1]
    index = b"".join(_e(f"L{c.upper()}010000") + struct.pack(">H", 500 + k + 100 * turn) for turn in range(2) for k, c in enumerate(letters))
    pool = 2 + 12 * len(letters)
    names = bytes(2) + b"".join(_e(f"L{c.upper()}010000") + struct.pack(">I", pool + 8 * k) for k, c in enumerate(letters)) + b"".join(bytes([8]) + f"letter{c}".encode() for c in letters)
    code_page = ("T1V10037", "T1001140")[key % 2]
    return _doc(
        _sf("D3A889", _e("C0OWN002")), _sf("D3A789", bytes([1, 0x1E]) + bytes(13) + bytes([10]) + bytes(12)), _sf("D3A689", _e("LETTERS".ljust(32)) + bytes(4)), _sf("D38C89", index), _sf("D3AB89", names), _sf("D3A989", _e("C0OWN002")),
        _sf("D3AB8A", b"\x00\x1e" + _t(0x02, b"\x85\x00" + _e(code_page)) + _t(0x02, b"\x86\x00" + _e("C0OWN002")) + _t(0x24, b"\x05\x07")), _page(_ptx(b"\xf0\x07", b"\xda" + _e("abcdefghij"))),
    )


def bridged_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of external code pages that embedded fonts can draw, by the identity of characters."""
    found = glyphs.drawable_points(written(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_bridge)("p_partkey", "p_size")), "bridge"))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "local_id", "code_page", "character_set", "bridged", "code_point", "gcgid")


def named_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of outline fonts with their names, of indexes that list them for two orientations."""
    found = glyphs.outline_characters(objects.fonts(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_bridge)("p_partkey", "p_size"))))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "rec_seq", "gcgid", "char_increment", "orientations", "name")


def glyph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an embedded font has glyphs for enough bytes of a run."""
    found = written(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_bridge)("p_partkey", "p_size")), "bridge")
    runs = layout.controls(found).filter(F.col("cs_type") == layout.TRN).select("path", F.col("field_seq").alias("item"), F.lit(7).alias("local_id"), "params")
    return glyphs.coverage(runs, glyphs.drawable_points(found)).select(F.col("path").cast("long").alias("p_partkey"), F.round("share", 6).alias("share"), "covered")


def tallest_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height of the tallest glyph of embedded raster fonts."""
    found = objects.fonts(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_font)("p_partkey", "p_size")))
    return glyphs.tallest(found).select(F.col("path").cast("long").alias("p_partkey"), "height")


def specimen_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of the glyphs of raster fonts, of files without pages: titles, labels and pictures at their places."""
    pages, texts, images = specimens.specimens(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_font)("p_partkey", "p_size")))
    key = F.col("path").cast("long").alias("p_partkey")
    images = images.select(key, "page_idx", F.concat("mime", F.lit(" "), F.hex(F.substring("data", 2, 3))).alias("what"), "x", "y", "width", "height")
    none = F.lit(-1)
    texts = texts.select(key, "page_idx", F.col("text").alias("what"), "x", "y", F.col("font_size").alias("width"), none.alias("height"))
    return images.unionByName(texts).unionByName(pages.select(key, "page_idx", F.lit("page").alias("what"), none.alias("x"), none.alias("y"), "width", "height"))


def sample_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sample stream holds: fields, pages and objects of each kind."""
    found = afp.fields_of(afp.frame(samples(spark)))
    counts = ops.page_counts(found)
    for name, rows in (("images", objects.images(found)), ("drawings", objects.graphics(found)), ("symbols", objects.bar_codes(found)), ("glyphs", objects.font_glyphs(objects.fonts(found)))):
        counts = counts.join(rows.groupBy("path").agg(F.count("*").alias(name)), "path", "left").fillna(0, [name])
    return counts.withColumnRenamed("path", "sample")


def _lettering(key: int, size: int) -> bytes:
    """An embedded raster font of three letters at 24 points, with its code page; a run in it, a turned one, one that it doesn't cover."""
    index = b"".join(_e(f"L{c}020000") + struct.pack(">HHhHH", 500 + 100 * k, 0, 125 * k, 0, k) + bytes(10) for k, c in enumerate("ABC"))
    boxes = b"".join(struct.pack(">HHI", 7, 3 + k, 0) for k in range(3))
    control = bytes([1, 5]) + bytes(13) + bytes([28]) + bytes(8) + struct.pack(">H", 3000) + bytes(2)
    face = _e("LETTERS".ljust(32)) + bytes(2) + struct.pack(">H", 240) + bytes(4)
    return _doc(
        _sf("D3A887", _e("T1OWN003")), _sf("D38C87", b"".join(_e(f"L{c}020000") + bytes([0, 0xC1 + k]) for k, c in enumerate("ABC"))), _sf("D3A987", _e("T1OWN003")),
        _sf("D3A889", _e("C0OWN003")), _sf("D3A789", control), _sf("D3A689", face), _sf("D38C89", index), _sf("D3A289", boxes), _sf("D3EE89", bytes(range(16))), _sf("D3A989", _e("C0OWN003")),
        _sf("D3AB8A", b"\x00\x1e" + _t(0x02, b"\x85\x00" + _e("T1OWN003")) + _t(0x02, b"\x86\x00" + _e("C0OWN003")) + _t(0x24, b"\x05\x07")),
        _page(_ptx(b"\xf0\x07", b"\xc6" + _h(size), b"\xd2" + _h(key % 1000), b"\xda" + _e("ABzA"), b"\xda" + _e("xyzA"), b"\xf6" + struct.pack(">HH", 11520, 23040), b"\xc6" + _h(300), b"\xd2" + _h(400), b"\x74\x00\x02", b"\xda" + _e("C"))),
    )


def glyph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text drawn in a file's own raster glyphs: the glyph of each byte, its place and extent, and the turn of its run."""
    found = written(read(table(spark, sf_dir, "part"), F.col("p_partkey"), building(_lettering)("p_partkey", "p_size")), "lettering")
    drawn, runs, _ = layout.drawn_text(found, lambda rows: glyphs.drawn_bytes(rows, found))
    rows = glyphs.glyph_pictures(drawn, runs)
    nothing = F.lit(-1)
    return rows.select(F.col("path").cast("long").alias("p_partkey"), "cs_seq", "pos", "x", "y", "width", "height", F.coalesce("recolor", F.lit("")).alias("recolor"), F.coalesce("rotate.angle", nothing).alias("angle"), F.hex("bits").alias("bits"))


def _card(key: int, name: str) -> bytes:
    text = f'<{name}> & "co"'
    return _doc(_sf("D3A6AF", struct.pack(">BBHHBHBHB", 0, 0, 14400, 14400, 0, 4000, 0, 3000, 0) + bytes(2)), _page(_ptx(b"\xc6" + _h(key % 2000), b"\xd2" + _h(400), b"\xda" + _e(text), b"\xe4" + _h(-300) + _h(20), b"\xe6" + _h(500) + _h(3))))


def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a run and two rules as SVG, by supplier."""
    pages, texts, rules = layout.layout(read(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), building(_card)("s_suppkey", "s_name")))
    return render.svg(pages, texts.withColumn("notes", F.array().cast(texts.schema["notes"].dataType)), rules).select(F.col("path").cast("long").alias("s_suppkey"), "page_idx", "svg")


QUERIES = {
    f.__name__: f
    for f in (
        triplet_details, field_inspection, stream_counts, framing_errors, text_state, overlays_and_loose_text, drawings, images_placed, bar_code_symbols, embedded_code_pages, embedded_glyphs,
        resources_missing, specimen_sheets, sample_streams, glyph_texts, page_pictures, bare_overlays, pages_of_text_fields, bridged_code_points, named_characters, glyph_coverage, tallest_glyphs,
    )
}

_STROKE = """stroke="' || c || '" stroke-width="' || w || '" stroke-linecap="round" stroke-linejoin="round\""""

SQL = {
    "triplet_details": """
        SELECT p_partkey, triplet_seq::INT AS triplet_seq, id, name, detail FROM part, LATERAL (VALUES
            (0, '0x26', 'Character Rotation', ['0°', '90°', '180°', '270°'][p_size % 4 + 1]), (1, '0x8B', 'Data Object Font Descriptor', p_size || ' pt'),
            (2, '0x01', 'Coded Graphic Character Set Global Identifier', CASE WHEN p_size % 2 = 1 THEN 'GCSGID 697, CPGID 37 → cp037' ELSE 'CCSID 500 → cp500' END),
            (3, '0x4B', 'Measurement Units', (p_size * 10) || ' × ' || p_size || ' units per 10 ' || ['in', 'cm'][p_size % 2 + 1]), (4, '0x24', 'Resource Local Identifier', 'coded font, local id ' || p_size),
            (5, '0x25', 'Resource Section Number', 'section ' || p_size), (6, '0x02', 'Fully Qualified Name', 'Attribute GID: ' || p_brand), (7, '0x36', 'Attribute Value', '"' || p_type || '"'),
            (8, '0x57', 'Object Byte Extent', p_partkey || ' bytes'), (9, '0x62', 'Local Date and Time Stamp', 'created 1999 day ' || lpad(p_size::VARCHAR, 3, '0') || ', 12:34:56'),
            (10, '0x65', 'Comment', '"made in ' || p_size || '" (ASCII)'), (11, '0x65', 'Comment', '"gemacht" (EBCDIC)'),
            (12, '0x68', 'Medium Orientation', ['portrait', 'landscape', 'reverse portrait', 'reverse landscape', 'portrait 90°', 'landscape 90°'][p_size % 6 + 1]),
            (13, '0x50', 'Encoding Scheme ID', 'scheme X''' || printf('%04X', p_size) || ''''), (14, '0x10', 'Object Classification', 'secondary resource'), (15, '0xF0', 'Unknown (0xF0)', '')) AS v(triplet_seq, id, name, detail)""",
    "field_inspection": """
        SELECT c_custkey, v.field_seq::INT AS field_seq, v.sf_id, v.name, token, size::INT AS size, depth::INT AS depth, coalesce(page, -1)::INT AS page, summary, search_text FROM customer, LATERAL (VALUES
            (0, '0xD3A8A8', 'BDT (Begin Document)', 'DOC00001', 17, 0, NULL, '', ''), (1, '0xD3EEEE', 'NOP (No Operation)', '', 9 + length(c_name), 1, NULL, c_name, c_name),
            (2, '0xD3A090', 'TLE (Tag Logical Element)', '', 24 + length(c_mktsegment), 1, NULL, 'Segment ' || c_mktsegment, 'Segment ' || c_mktsegment),
            (3, '0xD3AB8A', 'MCF (Map Coded Font, format 2)', '', 39, 1, NULL, '1:(CP=T1V10500 CS=C0H200B0)', ''), (4, '0xD3A8AF', 'BPG (Begin Page)', 'PAGE', 17, 1, 0, '', ''),
            (5, '0xD3A6AF', 'PGD (Page Descriptor)', '', 24, 2, 0, 'page ' || (1000 + c_nationkey) || '×2000 L-units · 1440 units/inch', ''),
            (6, '0xD3EE9B', 'PTX (Presentation Text Data)', '', 13 + length('Key ' || c_custkey), 2, 0, 'Key ' || c_custkey, 'Key ' || c_custkey),
            (7, '0xD3AFD8', 'IPO (Include Page Overlay)', '', 23, 2, 0, 'overlay ''FORM'' @ offset ' || c_nationkey || ',5', ''), (8, '0xD3A9AF', 'EPG (End Page)', 'PAGE', 17, 1, 0, '', ''),
            (9, '0xD3A6FB', 'IDD (Image Data Descriptor)', '', 18, 1, NULL, 'image ' || (8 * (c_nationkey + 1)) || '×' || (c_nationkey + 1) || ' pels · 300×300 DPI', ''),
            (10, '0xD3ABD8', 'MPO (Map Page Overlay)', '', 27, 1, NULL, 'id ' || (c_nationkey + 1) || ' → OVERLAY1', ''), (11, '0xD3A9A8', 'EDT (End Document)', 'DOC00001', 17, 0, NULL, '', '')
        ) AS v(field_seq, sf_id, name, token, size, depth, page, summary, search_text)""",
    "stream_counts": "SELECT c_custkey, 12::BIGINT AS n_fields, 1::BIGINT AS bracketed_pages, '' AS resource_kind, 'T1V10500 → cp500' AS note, 'BDT (Begin Document)' AS most, 1::BIGINT AS times FROM customer",
    "framing_errors": """
        SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 0 WHEN 2 THEN 51 WHEN 3 THEN 17 WHEN 5 THEN 68 ELSE -1 END::BIGINT AS position,
            CASE s_suppkey % 6 WHEN 1 THEN 'expected carriage control X''5A'', found X''0A'' at offset 0' WHEN 2 THEN 'bad structured field length 16 at offset 51'
                WHEN 3 THEN 'bad structured field length 3 at offset 17' WHEN 5 THEN 'expected carriage control X''5A'', found X''78'' at offset 68' ELSE '' END AS message,
            CASE s_suppkey % 6 WHEN 0 THEN 4 ELSE 0 END::BIGINT AS n_fields FROM supplier""",
    "text_state": """
        SELECT c_custkey, 0::INT AS page_idx, v.item_seq::INT AS item_seq, v.x::INT AS x, v.y::INT AS y, v.text, v.color, 7::INT AS font_id, 240::INT AS font_size, 'Arial, sans-serif' AS font_family, 'normal' AS font_weight,
            v.orientation::INT AS orientation, v.space_width::INT AS space_width FROM customer, LATERAL (VALUES
            (1, 100 + c_nationkey, 240, '[Mr!] ' || c_name, CASE WHEN c_nationkey % 2 = 1 THEN '#ff0000' ELSE '#00ff00' END, 0, -1),
            (2, 150 + c_nationkey + 132 * (6 + length(c_name)), 230, 'x', CASE WHEN c_nationkey % 2 = 1 THEN '#ff0000' ELSE '#00ff00' END, 0, -1),
            (3, CASE WHEN c_custkey % 2 = 1 THEN 2000 + c_nationkey ELSE 1000 END, CASE WHEN c_custkey % 2 = 1 THEN 1000 ELSE 2000 + c_nationkey END, 'a b', '#' || printf('%02x', c_nationkey) || '80ff', 90 * (c_custkey % 4), 77)
        ) AS v(item_seq, x, y, text, color, orientation, space_width)""",
    "overlays_and_loose_text": """
        SELECT s_suppkey, v.page_idx::INT AS page_idx, v.text, v.x::INT AS x, v.y::INT AS y, v.length::INT AS length, v.thickness::INT AS thickness FROM supplier, LATERAL (VALUES
            (0, 'form', 160, s_nationkey + 2 * (s_suppkey % 1000), -1, -1), (0, 'form', 828, 1024 + 2 * (s_suppkey % 1000), -1, -1), (1, 'one', 500, 700, -1, -1), (2, 'two', 510, 60 + s_nationkey, -1, -1),
            (0, 'rule', 688, s_nationkey + 2 * (s_suppkey % 1000), 200, 20), (0, 'rule', 1356, 1024 + 2 * (s_suppkey % 1000), 200, 20)) AS v(page_idx, text, x, y, length, thickness)""",
    "drawings": f"""
        SELECT p_partkey, 0::INT AS page_idx, s::INT AS x, 256::INT AS y, (2 * (512 + s))::INT AS width, (2 * (256 + s))::INT AS height, 999::INT AS window_width, 899::INT AS window_height, 7::INT AS shapes,
            '<rect x="' || s || '" y="' || (799 - h) || '" width="200" height="' || h || '" fill="' || c || '" {_STROKE}/><polyline points="' || s || ',799 ' || (s + 50) || ',' || (799 - h) || ' ' || (s + 100) || ',799" fill="none" {_STROKE}/>'
            || '<polyline points="' || (s + 100) || ',799 ' || (s + 110) || ',809 ' || (s + 115) || ',802" fill="none" {_STROKE}/>' || replace(
                '<path d="M 0,899 L ' || s || ',899 L ' || s || ',' || (899 - s) || ' Z" fill="' || c || '" {_STROKE}/><circle cx="500" cy="599" r="' || s || '" fill="' || c || '" {_STROKE} stroke-dasharray="' || (6 * w) || '.0 ' || (3 * w) || '.0"/>'
                || '<path d="M 500,399 L ' || (500 + 2 * s) || ',399 A ' || (2 * s) || ',' || s || ' 0 0 0 500,' || (399 - s) || '" fill="none" {_STROKE} stroke-dasharray="' || (6 * w) || '.0 ' || (3 * w) || '.0"/>', c, '#ff' || printf('%02x', s) || '00')
            || '<path d="M 0,899 C ' || s || ',899 ' || s || ',' || (899 - s) || ' 0,' || (899 - s) || '" fill="none" stroke="none"/>' AS svg
        FROM (SELECT p_partkey, p_size AS s, p_partkey % 700 AS h, p_size % 5 + 1 AS w, ['#0000ff', '#ff0000', '#ff00ff', '#00ff00', '#00ffff', '#ffff00'][p_size % 6 + 1] AS c FROM part)""",
    "images_placed": """
        SELECT p_partkey, 0::INT AS page_idx, p_size::INT AS x, -1::INT AS y, 288::INT AS width, (6 * p_size)::INT AS height, 'image/png' AS mime, repeat(printf('%02x', p_partkey % 256), p_size) AS bits FROM part""",
    "bar_code_symbols": """
        SELECT p_partkey, 32::INT AS type, 2::INT AS modifier, 1440::INT AS upi, 21::INT AS module_mils, (p_size % 41)::INT AS version, (p_size % 4)::INT AS ec_level, p_size::INT AS x, (p_partkey % 1000)::INT AS y,
            'part ' || p_partkey AS data FROM part""",
    "embedded_code_pages": "SELECT p_partkey, 'T1OWN001' AS name, (193 + k)::INT AS code_point, 'L' || chr((65 + (p_size + k) % 26)::INT) || '020000' AS gcgid FROM part, range(3) r(k)",
    "embedded_glyphs": """
        SELECT p_partkey, 'C0OWN001' AS name, 'OWN FACE' AS typeface, k::INT AS pattern, 'L' || chr((65 + (p_size + k) % 26)::INT) || '020000' AS gcgid, 8::INT AS width, (p_size % 8 + k + 1)::INT AS height,
            (p_size + k)::INT AS char_increment, (p_size - 30 - k)::INT AS baseline_offset, substr('000102030405060708090A0B0C0D0E0F', 1, (2 * (p_size % 8 + k + 1))::INT) AS bits FROM part, range(3) r(k)""",
    "resources_missing": "SELECT p_partkey, 'character set' AS kind, 'C0ELSE01' AS name, NULL::VARCHAR AS codec, 1::INT AS rank FROM part",
    "specimen_sheets": """
        WITH shown AS (
            SELECT p_partkey, p_size, k, h, row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS i, round_even(5600.0 / h, 0)::INT AS wide
            FROM (SELECT p_partkey, p_size, k, p_size % 8 + k + 1 AS h FROM part, range(3) r(k)) WHERE h >= 3),
        sized AS (SELECT *, least(wide, 1500) AS w, CASE WHEN wide > 1500 THEN round_even(1050000.0 / wide, 0)::INT ELSE 700 END AS hh FROM shown)
        SELECT p_partkey, 0::INT AS page_idx, 'image/png 504E47' AS what, (600 + 1700 * i + (1700 - w) // 2)::INT AS x, (980 + 700 - hh)::INT AS y, w::INT AS width, hh::INT AS height FROM sized
        UNION ALL SELECT p_partkey, 0, 'L' || chr((65 + (p_size + k) % 26)::INT) || '020000', (640 + 1700 * i)::INT, 1910, 170, -1 FROM shown
        UNION ALL SELECT p_partkey, 0, 'Embedded raster font: OWN FACE — ' || count(*) || ' glyphs', 600, 600, 440, -1 FROM shown GROUP BY 1
        UNION ALL SELECT DISTINCT p_partkey, 0, 'page', -1, -1, 12240, 2880 FROM shown""",
    "glyph_texts": """
        SELECT p_partkey, v.cs_seq::INT AS cs_seq, v.pos::INT AS pos, v.x::INT AS x, v.y::INT AS y, 38::INT AS width, v.height::INT AS height, v.recolor, v.angle::INT AS angle, v.bits FROM part, LATERAL (VALUES
            (3, 0, p_size, p_partkey % 1000 - 19, 19, '', -1, '00010203'), (3, 1, p_size + 240, p_partkey % 1000 - 24 + 60, 24, '', -1, '0001020304'), (3, 3, p_size + 240 + 288 + 240, p_partkey % 1000 - 19, 19, '', -1, '00010203'),
            (9, 0, 400, 300 - 29 + 120, 29, '#ff0000', 90, '000102030405')) AS v(cs_seq, pos, x, y, height, recolor, angle, bits)""",
    "sample_streams": """
        SELECT * FROM (VALUES ('text.afp', 6::BIGINT, 1::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT), ('overlay.afp', 13, 2, '', 0, 0, 0, 0), ('drawing.afp', 11, 1, '', 0, 1, 0, 0),
            ('image.afp', 10, 1, '', 1, 0, 0, 0), ('bar-code.afp', 9, 1, '', 0, 0, 1, 0), ('font.afp', 7, 0, 'font character set', 0, 0, 0, 2)) AS v(sample, n_fields, bracketed_pages, resource_kind, images, drawings, symbols, glyphs)""",
    "bare_overlays": """
        SELECT s_suppkey, v.page_idx::INT AS page_idx, v.text, 40::INT AS x, (s_suppkey % 1000)::INT AS y, (3000 + s_nationkey)::INT AS width, 2000::INT AS height, 'overlay' AS page_kind
        FROM supplier, LATERAL (VALUES (0, 'first ' || s_suppkey), (1, 'other ' || s_suppkey)) AS v(page_idx, text)""",
    "pages_of_text_fields": "SELECT s_suppkey, v.field_seq::INT AS field_seq, v.page::INT AS page FROM supplier, LATERAL (VALUES (3, 0), (11, 1)) AS v(field_seq, page)",
    "bridged_code_points": """
        SELECT p_partkey, 7::INT AS local_id, ['T1V10037', 'T1001140'][(p_partkey % 2 + 1)::INT] AS code_page, 'C0OWN002' AS character_set, true AS bridged, (CASE WHEN k < 9 THEN 129 + k ELSE 145 END)::INT AS code_point,
            'L' || chr((65 + k)::INT) || '010000' AS gcgid FROM part, range(10) r(k) WHERE k <= p_size % 10""",
    "named_characters": """
        SELECT p_partkey, k::INT AS rec_seq, 'L' || chr((65 + k)::INT) || '010000' AS gcgid, (500 + k)::INT AS char_increment, 2::INT AS orientations, 'letter' || chr((97 + k)::INT) AS name
        FROM part, range(10) r(k) WHERE k <= p_size % 10""",
    "glyph_coverage": "SELECT p_partkey, (p_size % 10 + 1) / 10.0::DOUBLE AS share, p_size % 10 + 1 >= 7 AS covered FROM part",
    "tallest_glyphs": "SELECT p_partkey, (p_size % 8 + 3)::INT AS height FROM part",
    "page_pictures": """
        SELECT s_suppkey, 0::INT AS page_idx, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 4000 3000" data-upi="1440" font-family="Arial, Helvetica, sans-serif"><rect width="4000" height="3000" fill="#ffffff"/>'
            || '<rect x="' || (x + 132 * (9 + n) - 300) || '" y="400" width="300" height="20" data-src="58" fill="#000000"/><rect x="' || (x + 132 * (9 + n)) || '" y="400" width="10" height="500" data-src="58" fill="#000000"/>'
            || '<text x="' || x || '" y="400" font-size="240" data-src="58" fill="#000000">&lt;' || s_name || '&gt; &amp; "co"</text></svg>' AS svg
        FROM (SELECT s_suppkey, s_name, length(s_name) AS n, s_suppkey % 2000 AS x FROM supplier)""",
}
