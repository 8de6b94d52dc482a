import math
import struct
import zlib

from folia.functions import drawing
from folia.functions import images as kernel
from folia.operators import fields as ops
from folia.operators import objects, render
from folia.plans.report import document_report
from folia.sources import afp
from folia.sources import writer as w


def pixels(png):
    at = png.index(b"IDAT")
    return zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")])


def sdf(code, data):
    return bytes([code, len(data)]) + data


def image(width, height, bits, data, compression=3):
    size = sdf(0x94, b"\0" + (2400).to_bytes(2, "big") * 2 + width.to_bytes(2, "big") + height.to_bytes(2, "big"))
    return size + sdf(0x95, bytes([compression, 1])) + sdf(0x96, bytes([bits])) + b"\xfe\x92" + len(data).to_bytes(2, "big") + data


def test_images():
    shown = lambda b: kernel.displayable(kernel.segment(b))
    assert pixels(shown(image(8, 2, 1, b"\xff\xff"))[1]) == bytes(4)
    assert pixels(shown(image(2, 2, 8, bytes([0, 85, 170, 255])))[1]) == bytes([0, 0, 85, 0, 170, 255])
    assert shown(image(2, 2, 8, b"\0")) is None and shown(image(2, 2, 8, bytes(4), 0x82)) is None and kernel.segment(b"") is None
    assert shown(image(2, 2, 8, b"xx\xff\xd8jpeg", 0x83)) == ("image/jpeg", b"\xff\xd8jpeg")


def test_bar_code():
    descriptor = b"\x01\0" + (3937).to_bytes(2, "big") * 2 + bytes(6) + bytes([0x1C, 0, 0, 0, 0, 16])
    code = kernel.bar_code(descriptor, b"\0\0\1\0\1" + bytes(10) + b"12345")
    assert (code["type"], code["upi"], code["module_mils"], code["x"], code["y"], code["data"]) == (0x1C, 1000, 16, 1, 1, "12345")
    assert kernel.bar_code(descriptor, b"\4\0\1\0\1" + bytes(15)) is None


def test_tables(spark):
    obd = w.record(0xD3A66B, w.triplet(0x4B, b"\0\0" + (14400).to_bytes(2, "big") * 2) + w.triplet(0x4C, b"\0" + (100).to_bytes(3, "big") + (50).to_bytes(3, "big")))
    data = image(8, 2, 1, b"\xff\xff")
    picture = lambda name: w.record(0xD3A8FB, w.name8(name)) + obd + w.record(0xD3AC6B, b"\1\0" + w.s24(7) + w.s24(9)) + w.record(0xD3EEFB, data[:9]) + w.record(0xD3EEFB, data[9:]) + w.record(0xD3A9FB, w.name8(name))
    include = w.record(0xD3AFC3, w.name8("RES") + bytes(2) + w.s24(1000) + w.s24(2000) + bytes(11))
    page = w.page(w.page_descriptor(5000, 6000), picture("IN"), include, w.text_field((0xC6, w.s16(10)), (0xD2, w.s16(20)), (0xDA, "a<b & c".encode("cp500"))))
    pageset = w.record(0xD3A887, w.name8("CP1")) + w.record(0xD38C87, w.name8("LA010000") + b"\0\x81" + w.name8("LB010000") + b"\0\x82") + w.record(0xD3A987, w.name8("CP1"))
    control = bytes([0, 5]) + bytes(13) + bytes([18, 1])
    index = b"".join(w.name8(n) + (600).to_bytes(2, "big") + bytes(2) + w.s16(-5) + bytes(2) + k.to_bytes(2, "big") for k, n in enumerate(("LA010000", "LB010000")))
    boxes = b"".join((7).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2 * k).to_bytes(4, "big") for k in range(2))
    font = w.record(0xD3A889, w.name8("C0TEST")) + w.record(0xD3A789, control) + w.record(0xD3A689, "COURIER".ljust(32).encode("cp500")) + w.record(0xD38C89, index) + w.record(0xD3A289, boxes) + w.record(0xD3EE89, b"\1\2\3\4") + w.record(0xD3A989, w.name8("C0TEST"))
    order = b"\x70\x0c" + bytes(8) + bytes(4)
    order = order[:8] + (2).to_bytes(2, "big") + order[10:] + b"\x0a\x02"
    drawing = w.record(0xD3A8BB, w.name8("G")) + w.record(0xD3EEBB, order) + w.record(0xD3A9BB, w.name8("G"))
    stream = w.document(picture("RES"), pageset, font, drawing, page)
    files = spark.createDataFrame([("a", bytearray(stream)), ("bad", b"\n")], "path string, content binary")
    fields = afp.fields_of(afp.frame(files)).cache()
    found = [(r.page_idx, r.x, r.y, r.width, r.height, r.mime) for r in objects.images(fields).orderBy("item_seq").collect()]
    assert found == [(0, 7, 9, 100, 50, "image/png"), (0, 1000, 2000, 100, 50, "image/png")]
    assert {(r.code_point, r.gcgid) for r in objects.code_pages(fields).collect()} == {(0x81, "LA010000"), (0x82, "LB010000")}
    glyphs = {(r.gcgid, r.width, r.height, r.char_increment, r.baseline_offset, bytes(r.bits)) for r in objects.font_glyphs(objects.fonts(fields)).collect()}
    assert glyphs == {("LA010000", 8, 2, 600, -5, b"\1\2"), ("LB010000", 8, 2, 600, -5, b"\3\4")}
    assert [(r.code, bytes(r.operand)) for r in objects.drawing_orders(fields).collect()] == [(0x0A, b"\2")]
    assert [r.typeface for r in objects.typefaces(fields).collect()] == ["COURIER"]
    assert ops.field_rows(fields).filter("name like 'CPI%'").first().data.startswith("2 code points: 0x81→LA010000")


def test_svg(spark):
    pages = spark.createDataFrame([("a", 0, 5000, 6000, 1440, True, "bracketed")], "path string, page_idx int, width int, height int, units_per_inch int, truncated boolean, kind string")
    columns = "path string, page_idx int, item_seq int, x int, y int, text string, color string, font_id int, font_size int, font_family string, font_weight string, orientation int, src long, space_width int"
    row = ("a", 0, 1, 10, 20, "a<b & c", "#000000", None, 240, "Arial", "bold", 90, 30, None, [("font", 'say "x"')])
    texts = spark.createDataFrame([row], columns + ", notes array<struct<cat string, msg string>>")
    rules = spark.createDataFrame([("a", 0, 1, 10, 20, -100, 3, "I", "#000000", 5)], "path string, page_idx int, item_seq int, x int, y int, length int, thickness int, axis string, color string, src long")
    svg = render.svg(pages, texts, rules).first().svg
    assert '<rect x="-90" y="20" width="100" height="3" data-src="5" fill="#000000"/>' in svg
    assert 'font-weight="bold" data-src="30" transform="rotate(90,10,20)" data-fidelity=' in svg and "a&lt;b &amp; c</text>" in svg
    assert svg.endswith("exceeds 5000 runs]</text></svg>") and "word-spacing" not in svg


def test_stream(spark, tmp_path):
    from folia.streaming.files import stream_fields

    (tmp_path / "x.afp").write_bytes(w.document())
    query = stream_fields(spark, str(tmp_path)).writeStream.format("memory").queryName("afp_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("afp_stream").count() == 2


def test_sql_functions(spark):
    from folia.functions import sql

    sql.register(spark)
    spark.createDataFrame([(bytearray(w.document(w.text_field((0xDA, b"\xc1\xc2")))),)], "content binary").createOrReplaceTempView("print_files")
    rows = spark.sql("SELECT f.sf_id, trn_text(c.params, 'cp500').text AS t FROM print_files, LATERAL afp_fields(content) f, LATERAL ptoca_sequences(f.data) c").collect()
    assert [r.t for r in rows] == ["AB"]


def _drawing(orders):
    window = b"\xf6\x12" + struct.pack(">3xBHH2xhhhh", 0, 1000, 1000, 0, 1000, 0, 800)
    return drawing.drawn(window, b"\x70\x0c" + bytes(6) + struct.pack(">H", len(orders)) + bytes(4) + orders)


def test_drawing_orders():
    at = lambda x, y: b"\x21\x04" + struct.pack(">hh", x, y)
    assert 'points="100,200 400,500"' in _drawing(at(100, 600) + b"\x81\x04" + struct.pack(">hh", 400, 300))["svg"]
    assert _drawing(b"\xc0\x0a" + struct.pack(">hhhhh", 0, 100, 600, 900, 200))["svg"].startswith('<rect x="100" y="200" width="800" height="400"')
    line = at(0, 400) + b"\x81\x04" + struct.pack(">hh", 500, 400)
    assert 'stroke="#ff0000"' in _drawing(b"\x0a\x02" + line)["svg"] and 'stroke="#ff8000"' in _drawing(b"\xb2\x09" + bytes.fromhex("000108080800ff8000") + line)["svg"]
    assert 'stroke="#7f0000"' in _drawing(b"\xb2\x0a" + bytes.fromhex("00040808080800ffff80")[:6] + bytes([0, 255, 255, 128]) + line)["svg"]
    assert _drawing(b"") is None and drawing.drawn(b"", b"") is None
    area = b"\x68\x00" + at(100, 700) + b"\x81\x0c" + struct.pack(">hhhhhh", 900, 700, 900, 100, 100, 100) + b"\x60\x00"
    assert _drawing(area)["svg"] == '<path d="M 100,100 L 900,100 L 900,700 L 100,700 Z" fill="#000000" stroke="none"/>'
    assert 'stroke-dasharray="6.0 3.0 1.0 3.0"' in _drawing(b"\x18\x03" + line)["svg"] and 'stroke="none"' in _drawing(b"\x18\x08" + line)["svg"]


def test_partial_arcs_run_counterclockwise():
    for first, sweep, large in ((0, 90, 0), (0, 180, 0), (0, 270, 1), (90, 90, 0), (270, 90, 0), (45, 90, 0)):
        svg = _drawing(b"\xe3\x12" + struct.pack(">hhhhBBII", 500, 400, 500, 400, 100, 0, first << 16, sweep << 16))["svg"]
        start, end = (tuple(map(float, svg.split(mark)[1].split('"')[0].split()[0].split(","))) for mark in (" L ", f" 0 {large} 0 "))
        for (x, y), angle in ((start, first), (end, first + sweep)):
            assert abs(x - 500 - 100 * math.cos(math.radians(angle))) < 1 and abs(y - 400 + 100 * math.sin(math.radians(angle))) < 1


def test_document_report(spark):
    page = w.page(w.text_field((0xC6, w.s16(100)), (0xD2, w.s16(300)), *w.runs("Hello"), (0xE4, w.s16(50))))
    files = spark.createDataFrame([("good", w.document(page)), ("bad", b"<html>"), ("empty", b"")], "path string, content binary")
    rows = {r.path: r for r in document_report(files).collect()}
    assert set(rows) == {"good", "bad", "empty"} and rows["bad"].error and not rows["empty"].error
    assert (rows["good"].n_fields, rows["good"].page_total, rows["empty"].n_fields, rows["bad"].page_total) == (5, 1, 0, 0)
    assert rows["good"].pages[0].text == "Hello" and "<text" in rows["good"].pages[0].svg and [x.n for x in rows["good"].summary] == [1] * 5


def test_large_files_are_errors(spark, tmp_path):
    (tmp_path / "a.afp").write_bytes(w.document())
    (tmp_path / "b.afp").write_bytes(w.document(*[w.page()] * 40))
    framed = afp.frame(afp.read_files(spark, str(tmp_path), most_bytes=200))
    assert afp.fields_of(framed).count() == 2
    assert [(r.path[-5:], r.message) for r in afp.errors_of(framed).collect()] == [("b.afp", "file has over 200 bytes")]
