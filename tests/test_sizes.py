"""Joins of tables that grow with the files aren't broadcast, as the driver would hold them whole."""

import pytest

from folia.operators import glyphs, layout
from folia.plans import conformance, queries


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS int) AS p_size").write.parquet(f"{folder}/part.parquet")
    return folder


def test_bridged_code_points(spark, parts):
    found = conformance.bridged_code_points(spark, parts)
    assert "SortMergeJoin" in planned(found) and "Broadcast" not in planned(found)
    assert found.count() == sum((k % 50 + 1) % 10 + 1 for k in range(40))


def test_points_of_glyphs(spark):
    rows = spark.createDataFrame([("cp500", "LA010000"), ("cp500", "LA990000"), ("none", "LA010000"), (None, "LA010000"), ("cp500", None)], "codec string, gcgid string")
    found = [r.p or [] for r in rows.select(glyphs.points_of_glyph("codec", "gcgid").alias("p")).collect()]
    assert found == [[0x81], [], [], [], []]


def test_glyph_coverage(spark, parts):
    found = conformance.glyph_coverage(spark, parts)
    assert "SortMergeJoin" in planned(found) and "Broadcast" not in planned(found)
    want = {(k, ((k % 50 + 1) % 10 + 1) / 10) for k in range(40)}
    assert {(r.p_partkey, r.share) for r in found.collect()} == want and found.filter("covered != (share >= 0.7)").isEmpty()


def test_drawings(spark, parts):
    found = conformance.drawings(spark, parts)
    assert "SortMergeJoin" in planned(found) and "Broadcast" not in planned(found)
    assert sorted(r.p_partkey for r in found.collect()) == list(range(40))


def test_rules_extent(spark, tmp_path, monkeypatch):
    plans, written = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df, name: plans.append(planned(df)) or written(df, name))
    spark.range(60).selectExpr("id % 20 AS l_orderkey", "CAST(id % 50 + 1 AS double) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = queries.rules_extent(spark, str(tmp_path))
    plans.append(planned(found))
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)
    assert {tuple(r) for r in found.collect()} == {(k, 3, sum(10 * ((k + j) % 50 + 1) for j in (0, 20, 40))) for k in range(20)}
