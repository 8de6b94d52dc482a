import random

import pytest

from folia.operators import fields as ops
from folia.operators import layout
from folia.plans import queries
from folia.sources import afp
from folia.sources import writer as w

E = lambda s: s.encode("cp500")


@pytest.fixture(scope="module")
def framed(spark):
    form = w.record(0xD3A8DF, w.name8("OVL1")) + w.text_field((0xC6, w.s16(700)), (0xD2, w.s16(800)), (0xDA, E("Form"))) + w.record(0xD3A9DF, w.name8("OVL1"))
    page = w.page(
        w.page_descriptor(12240, 15840), w.record(0xD3AFD8, w.name8("OVL1") + w.s24(100) + w.s24(200)),
        w.text_field(
            (0xF0, b"\1"), (0xC6, w.s16(2000)), (0xD2, w.s16(3000)), (0xDA, E("Hello World")), (0xE4, w.s16(500) + w.s16(3)), (0xF6, b"\x2d\0\x2d\0"), (0xC6, w.s16(100)), (0xD2, w.s16(200)), (0xDA, E("R")),
        ),
    )
    bracketed = w.document(w.record(0xD3AB8A, w.font_map(1, "T1V10273", "C0H200B0")), form, page)
    loose = w.document(w.page_descriptor(4000, 2000), w.text_field(*[(0xDA, E(f"word{k} ") * 4) for k in range(40)]))
    resource = w.record(0xD3A887, w.name8("T1V10500")) + w.record(0xD3A987, w.name8("T1V10500"))
    rows = [("a", bracketed), ("b", loose), ("c", resource), ("bad", b"\n<html>")]
    return afp.frame(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).cache()


def test_errors(framed):
    assert [(r.path, r.offset) for r in afp.errors_of(framed).collect()] == [("bad", 0)]


def test_field_rows(framed):
    rows = {(r.path, r.field_seq): r for r in ops.field_rows(afp.fields_of(framed)).collect()}
    assert [rows["a", k].depth for k in range(11)] == [0, 1, 1, 2, 1, 1, 2, 2, 2, 1, 0]
    assert [rows["a", k].page for k in range(11)] == [None] * 5 + [0] * 5 + [None]
    assert rows["a", 8].data == "Hello World R" and rows["a", 1].data == "1:(CP=T1V10273 CS=C0H200B0)" and rows["a", 0].token == "DOC"


def test_counts_and_resources(framed):
    fields = afp.fields_of(framed)
    counts = {r.path: r for r in ops.page_counts(fields).collect()}
    assert (counts["a"].bracketed_pages, counts["a"].resource_kind, counts["c"].resource_kind) == (1, "", "code page")
    assert [(r.kind, r.name, r.codec) for r in ops.missing_resources(fields).orderBy("rank").collect()] == [("code page", "T1V10273", "cp273"), ("character set", "C0H200B0", None)]
    assert [r.note for r in ops.code_page_note(fields).collect()] == ["T1V10273 → cp273"]
    assert [r.name for r in ops.histogram(fields).filter("path = 'a'").orderBy("rank").collect()][:2] == ["PTX (Presentation Text Data)", "BDT (Begin Document)"]


def test_layout(framed):
    pages, texts, rules = layout.layout(afp.fields_of(framed))
    texts = texts.cache()
    a = [(r.text, r.x, r.y, r.orientation) for r in texts.filter("path = 'a'").orderBy("item_seq").collect()]
    assert a == [("Form", 800, 1000, 0), ("Hello World", 2000, 3000, 0), ("R", 200, 100, 90)]
    assert [(r.x, r.y, r.length, r.thickness, r.axis) for r in rules.collect()] == [(2000 + 11 * 132, 3000, 500, 10, "I")]
    text = {(r.path, r.page_idx): r.text for r in layout.page_text(texts).collect()}
    assert text["a", 0] == "R\nForm\nHello World" and text["b", 0].count("\n") == 4 and len(text) == 9
    assert {(r.path, r.width, r.kind) for r in pages.collect()} == {("a", 12240, "bracketed"), ("b", 4000, "implicit")}


def test_depth_equals_a_loop(spark):
    rng = random.Random(3)
    kinds = [0xD3A8A8, 0xD3A9A8, 0xD3A8AF, 0xD3A9AF, 0xD3EEEE]
    stream = [rng.choice(kinds) for _ in range(300)]
    depth, page, current, want = 0, -1, None, []
    for k in stream:
        depth -= k >> 8 & 0xFF == 0xA9 and depth > 0
        if k == 0xD3A8AF:
            page += 1
            current = page
        want.append((depth, current))
        if k == 0xD3A9AF:
            current = None
        depth += k >> 8 & 0xFF == 0xA8
    fields = spark.createDataFrame([("p", i, k, bytearray()) for i, k in enumerate(stream)], "path string, field_seq int, sf_id int, data binary")
    assert [(r.depth, r.page) for r in ops.nested(fields).orderBy("field_seq").collect()] == want


def test_data_source(spark, tmp_path):
    (tmp_path / "x.afp").write_bytes(w.document())
    (tmp_path / "y.afp").write_bytes(b"\n")
    afp.register(spark)
    rows = spark.read.format("afp").load(str(tmp_path)).collect()
    assert len(rows) == 3 and sum(r.error is not None for r in rows) == 1
    assert afp.frame(afp.read_files(spark, str(tmp_path))).count() == 3


def test_rules_extent_of_a_hot_order(spark, tmp_path):
    lines = [(1, float(k % 50 + 1)) for k in range(5003)] + [(2, 7.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in queries.rules_extent(spark, str(tmp_path)).collect()}
    assert got == {(1, 5003, sum(int(q * 10) for _, q in lines[:-1])), (2, 1, 70)}
