"""Glyphs of embedded fonts: names of characters, bridged code pages, which code points a font can draw.

All are equi-joins on (path, name) of small tables that a file's own resources give; only the map of
a codec's 256 bytes to identifiers is a kernel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.functions import glyph_ids
from folia.operators.fields import coded_fonts, joined
from folia.operators.objects import code_pages, font_characters, font_glyphs, fonts, glyph_name
from folia.sources.shared import written

#: Least share of a run's bytes that must have a glyph.
COVERED = 0.7


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def points_of_glyph(codecs: pa.Array, gcgids: pa.Array) -> pa.Array:
    """The code points that a codec has for a glyph."""
    known: dict[str | None, dict[str, list[int]]] = {None: {}}
    for c in set(codecs.to_pylist()) - {None}:
        own = known[c] = {}
        for k, name in glyph_ids.of_codec(c):
            own.setdefault(name, []).append(k)
    return pa.array([known[c].get(g) for c, g in zip(codecs.to_pylist(), gcgids.to_pylist())], pa.list_(pa.int32()))


def character_names(found: DataFrame) -> DataFrame:
    """(path, object, gcgid, name) of the name maps of fonts: records of 12 bytes up to the pool of names, which they point into."""
    count = F.floor((F.octet_length("fnn") - 2) / 12).cast("int")
    rows = found.filter(count > 0).select("path", "object", "fnn", F.posexplode(F.sequence(F.lit(0), count - 1)).alias("rec_seq", "_k"))
    at = F.col("rec_seq") * 12 + 3
    rows = rows.select("path", "object", "fnn", "rec_seq", glyph_name(F.substring("fnn", at, F.lit(8))).alias("gcgid"), F.conv(F.hex(F.substring("fnn", at + 8, F.lit(4))), 16, 10).cast("long").alias("offset"))
    pool = rows.filter(~F.col("gcgid").rlike(r"^\p{L}")).groupBy("path", "object").agg(F.min("rec_seq").alias("pool"))
    rows = rows.join(pool, ["path", "object"], "left").filter(F.col("pool").isNull() | (F.col("rec_seq") < F.col("pool")))
    size = F.conv(F.hex(F.substring("fnn", (F.col("offset") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.filter(F.col("offset") < F.octet_length("fnn")).withColumn("n", size).filter("n >= 2")
    raw = F.substring("fnn", (F.col("offset") + 2).cast("int"), F.col("n") - 1)
    rows = rows.withColumn("raw", raw).filter(~F.hex("raw").rlike("^(..)*[89A-F]"))
    return rows.groupBy("path", "object", "gcgid").agg(F.max_by(F.decode("raw", "US-ASCII"), "rec_seq").alias("name"))


def outline_characters(found: DataFrame) -> DataFrame:
    """(path, object, gcgid, char_increment, orientations, name) of outline fonts: the first record of each character, which are listed once for each orientation."""
    rows = font_characters(found.filter("technology <> 5 OR technology IS NULL"))
    firsts = rows.groupBy("path", "object", "gcgid").agg(F.min_by("char_increment", "rec_seq").alias("char_increment"), F.min("rec_seq").alias("rec_seq"))
    turns = rows.groupBy("path", "object").agg(F.greatest(F.lit(1), F.floor(F.count("*") / F.count_distinct("gcgid"))).cast("int").alias("orientations"))
    return firsts.join(turns, ["path", "object"]).join(character_names(found), ["path", "object", "gcgid"], "left").select("path", "object", "rec_seq", "gcgid", "char_increment", "orientations", F.coalesce("name", F.lit("")).alias("name"))


def tallest(found: DataFrame) -> DataFrame:
    """(path, object, height): of the tallest raster glyph of each font."""
    return font_glyphs(found).groupBy("path", "object").agg(F.max("height").alias("height"))


def drawable_points(fields: DataFrame) -> DataFrame:
    """(path, field_seq, local_id, code_page, character_set, bridged, code_point, gcgid): what a mapped font can draw with the file's own glyphs.

    A code page that the file embeds says itself which character a code point is; one that it doesn't
    is bridged: its codec gives the character, and the character its identifier. Only identifiers that
    the embedded character set has are kept.
    """
    maps = coded_fonts(fields).filter("code_page IS NOT NULL AND character_set IS NOT NULL").select("path", "field_seq", "local_id", "code_page", "character_set", "codec")
    own = code_pages(fields).select("path", F.col("name").alias("code_page"), "code_point", "gcgid")
    embedded = joined(maps, own, ["path", "code_page"]).withColumn("bridged", F.lit(False))
    outside = joined(maps, own.select("path", "code_page").distinct(), ["path", "code_page"], "left_anti")
    glyphs = font_characters(fonts(fields), "name").select("path", F.col("name").alias("character_set"), "gcgid").distinct()
    embedded = joined(embedded, glyphs, ["path", "character_set", "gcgid"], "left_semi")
    # From the glyphs to their code points: a font has fewer than a codec has points.
    outside = joined(outside, glyphs, ["path", "character_set"]).withColumn("code_point", F.explode(points_of_glyph("codec", "gcgid"))).withColumn("bridged", F.lit(True))
    both = embedded.unionByName(outside)
    return both.select("path", "field_seq", "local_id", "code_page", "character_set", "bridged", "code_point", "gcgid")


def coverage(runs: DataFrame, points: DataFrame) -> DataFrame:
    """(path, item, share, covered) of runs (path, item, local_id, params): the share of bytes that their font can draw, and whether it is enough. Empty runs are covered."""
    codes = F.transform(F.sequence(F.lit(0), F.octet_length("params") - 1), lambda k: F.conv(F.hex(F.substring("params", k + 1, F.lit(1))), 16, 10).cast("int"))
    each = runs.withColumn("code_point", F.explode_outer(F.when(F.octet_length("params") > 0, codes)))
    known = points.select("path", "local_id", "code_point", F.lit(1.0).alias("hit")).distinct()
    share = F.when(F.count("code_point") == 0, F.lit(1.0)).otherwise(F.coalesce(F.sum("hit"), F.lit(0.0)) / F.count("code_point"))
    rows = joined(each, known, ["path", "local_id", "code_point"], "left").groupBy("path", "item").agg(share.alias("share"))
    return rows.withColumn("covered", F.col("share") >= COVERED)


#: Points from which raster glyphs are drawn, as smaller ones look rough.
LEAST_POINTS = 20


def rasters(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glyphs by path, character_set and gcgid; metrics by path and character_set) of raster fonts; of sets of one name the last counts."""
    found = fonts(fields).filter("technology = 5 AND name <> ''")
    shapes = font_glyphs(found).join(found.select("path", "object", F.col("name").alias("character_set"), "resolution", "point_size"), ["path", "object"])
    last = shapes.groupBy("path", "character_set").agg(F.max("object").alias("object"))
    shapes = shapes.join(last, ["path", "character_set", "object"])
    metrics = shapes.groupBy("path", "character_set").agg(F.max("height").alias("tallest"), F.first("resolution").alias("resolution"), F.first("point_size").alias("point_size"))
    glyph = F.max_by(F.struct("width", "height", "char_increment", "baseline_offset", "bits"), "pattern").alias("glyph")
    return shapes.groupBy("path", "character_set", "gcgid").agg(glyph), metrics


def drawn_bytes(runs: DataFrame, fields: DataFrame, small: bool = False) -> DataFrame:
    """Each byte of the runs that are drawn in the file's own raster glyphs: its glyph, or none, and its place along the line.

    runs: (path, field_seq, cs_seq, font_id, params, size, upi). A run is drawn so if the last map of
    its local id with glyphs has enough of them, and the font is of LEAST_POINTS or ``small`` is set.
    Adds pos, glyph, em, pel, step (the advance) and along (the advances before).
    """
    shapes, metrics = (written(x, "glyphs") for x in rasters(fields))
    points = drawable_points(fields).join(metrics.select("path", "character_set"), ["path", "character_set"], "left_semi")
    points = points.select("path", F.col("field_seq").alias("map_seq"), F.col("local_id").alias("font_id"), "character_set", "code_point", "gcgid").distinct()
    points = written(points, "points")
    maps = points.select("path", "map_seq", "font_id", "character_set").distinct()
    key = ["path", "field_seq", "cs_seq"]
    runs = runs.select(*key, "font_id", "params", "size", "upi").filter(F.octet_length("params") > 0)
    force = runs.select(*key, "font_id").join(maps, ["path", "font_id"]).filter(F.col("map_seq") < F.col("field_seq")).groupBy(*key).agg(F.max_by(F.struct("map_seq", "character_set"), "map_seq").alias("m"))
    runs = runs.join(force, key).select(*runs.columns, "m.*").join(metrics, ["path", "character_set"])
    runs = runs.filter((F.col("point_size") >= LEAST_POINTS) | F.lit(small))
    codes = F.transform(F.sequence(F.lit(0), F.octet_length("params") - 1), lambda k: F.conv(F.hex(F.substring("params", k + 1, F.lit(1))), 16, 10).cast("int"))
    rows = runs.select("*", F.posexplode(codes).alias("pos", "code_point")).drop("params")
    rows = rows.join(points, ["path", "map_seq", "font_id", "character_set", "code_point"], "left").join(shapes, ["path", "character_set", "gcgid"], "left")
    whole = Window.partitionBy(*key)
    rows = rows.withColumn("share", F.avg(F.col("glyph").isNotNull().cast("double")).over(whole)).filter(F.col("share") >= COVERED)
    em = F.when(F.col("point_size") > 0, F.bround(F.col("point_size") / 72 * F.col("upi")).cast("int")).otherwise(F.col("size"))
    pel = F.when(F.col("resolution") > 0, F.col("upi") / F.col("resolution")).otherwise(F.col("size") / F.col("tallest"))
    rows = rows.withColumns({"em": em, "pel": pel})
    usual = F.greatest(F.lit(1), F.bround(F.lit(0.5) * F.col("em")).cast("int"))
    stated = F.when(F.col("glyph.char_increment") > 0, F.greatest(F.bround(F.col("glyph.char_increment") / 1000 * F.col("em")).cast("int"), F.lit(1)))
    rows = rows.withColumn("step", F.coalesce(stated, usual))
    before = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*key, "pos", "glyph", "em", "pel", "step", F.coalesce(F.sum("step").over(before), F.lit(0)).cast("int").alias("along"))


def glyph_pictures(drawn: DataFrame, runs: DataFrame) -> DataFrame:
    """Pictures of drawn bytes; runs: (path, owner, field_seq, cs_seq, x, y, orientation, color) of the same runs.

    A glyph stands on the baseline, or below by its offset; turned runs turn about their start.
    """
    g = F.col("glyph")
    extent = lambda c: F.greatest(F.lit(1), F.bround(g[c] * F.col("pel")).cast("int"))
    drop = F.bround(g["baseline_offset"] / 1000 * F.col("em")).cast("int")
    rows = drawn.filter(g.isNotNull()).join(runs, ["path", "field_seq", "cs_seq"])
    turn = F.when(F.col("orientation") != 0, F.struct(F.col("orientation").alias("angle"), F.col("x").alias("cx"), F.col("y").alias("cy")))
    return rows.select(
        "path", "owner", "field_seq", "cs_seq", "pos", (F.col("x") + F.col("along")).alias("x"), (F.col("y") - extent("height") + drop).alias("y"), extent("width").alias("width"), extent("height").alias("height"),
        F.when(F.col("color") != "#000000", F.col("color")).alias("recolor"), turn.alias("rotate"), g["width"].alias("pels"), g["height"].alias("lines"), g["bits"].alias("bits"),
    )
