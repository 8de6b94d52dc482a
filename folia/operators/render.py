"""Page pictures: SVG markup as string expressions, joined in drawing order.

Marks are columns of their item's table; a page's picture is one ordered aggregation over its marks.
A run's fit to the next one is a lead over the page, the budget of pages and elements a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_PAGES, MOST_ELEMENTS, MOST_RUNS = 500, 50_000, 5000

#: Channels that an ink leaves out of white.
INKS = {"c": (-1, 0, 0), "m": (0, -1, 0), "y": (0, 0, -1), "k": (-1, -1, -1)}


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def quoted(c: Column) -> Column:
    """A value as a quoted attribute; in single quotes if only it holds double ones."""
    c = escaped(c)
    for a, b in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    double, single = c.contains('"'), c.contains("'")
    plain = F.concat(F.lit('"'), F.when(double & single, F.replace(c, F.lit('"'), F.lit("&quot;"))).otherwise(c), F.lit('"'))
    return F.when(double & ~single, F.concat(F.lit("'"), c, F.lit("'"))).otherwise(plain)


def _attr(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))


def _one(c: Column) -> Column:
    return F.format_string("%.1f", c)


def ink_filters() -> str:
    """Filters that turn an ink's plane into its colour."""
    out = []
    for ink, channels in INKS.items():
        rows = []
        for k, v in enumerate(channels):
            row = ["0"] * 4
            row[k] = str(v)
            rows.append(" ".join([*row, "1"]))
        out.append(f'<filter id="ink-{ink}" color-interpolation-filters="sRGB"><feColorMatrix values="{"  ".join([*rows, "0 0 0 1 0"])}"/></filter>')
    return "<defs>" + "".join(out) + "</defs>"


def fidelity(notes: Column) -> Column:
    return F.when(F.size(notes) > 0, F.concat(F.lit(" data-fidelity="), quoted(F.to_json(notes)))).otherwise(F.lit(""))


def text_marks(texts: DataFrame) -> DataFrame:
    w = Window.partitionBy("path", "page_idx").orderBy("item_seq")
    size = F.col("font_size")
    default = size * 0.278
    spacing = F.when(F.col("space_width").isNotNull(), F.greatest(F.col("space_width") - default, size * -0.12))
    room = F.lead("x").over(w) - F.col("x") - (size * 0.3).cast("int")
    guess = F.length("text") * 0.52 * size
    fits = (F.lead("y").over(w) == F.col("y")) & (F.lead("x").over(w) > F.col("x")) & (F.col("orientation") == 0) & (F.length(F.trim("text")) >= 4) & (guess > 0) & (room / guess).between(0.7, 1.4)
    width = F.when(spacing.isNotNull(), _attr("word-spacing", _one(spacing))).when(fits, F.concat(_attr("textLength", room), F.lit(' lengthAdjust="spacingAndGlyphs"'))).otherwise(F.lit(""))
    turn = F.when(F.col("orientation") != 0, F.format_string(' transform="rotate(%d,%d,%d)"', "orientation", "x", "y")).otherwise(F.lit(""))
    family = F.when(F.col("font_family") != "Arial", F.concat(F.lit(" font-family="), quoted(F.col("font_family")))).otherwise(F.lit(""))
    bold = F.when(F.col("font_weight") == "bold", F.lit(' font-weight="bold"')).otherwise(F.lit(""))
    head = F.format_string('<text x="%d" y="%d" font-size="%d"', "x", "y", "font_size")
    mark = F.concat(head, family, bold, _attr("data-src", F.col("src")), turn, width, fidelity(F.col("notes")), F.lit(' fill="'), "color", F.lit('">'), escaped(F.col("text")), F.lit("</text>"))
    return texts.select("path", "page_idx", F.lit(5).alias("layer"), F.col("item_seq").cast("long").alias("seq"), mark.alias("mark"))


def rule_marks(rules: DataFrame) -> DataFrame:
    inline = F.col("axis") == "I"
    w, h = F.when(inline, F.col("length")).otherwise(F.col("thickness")), F.when(inline, F.col("thickness")).otherwise(F.col("length"))
    head = F.format_string('<rect x="%d" y="%d" width="%d" height="%d"', F.col("x") + F.least(w, F.lit(0)), F.col("y") + F.least(h, F.lit(0)), F.abs(w), F.abs(h))
    return rules.select("path", "page_idx", F.lit(2).alias("layer"), F.col("item_seq").cast("long").alias("seq"), F.concat(head, _attr("data-src", F.col("src")), F.lit(' fill="'), "color", F.lit('"/>')).alias("mark"))


def image_marks(images: DataFrame) -> DataFrame:
    """Needs ``spark.sql.chunkBase64String.enabled`` off, or line breaks are taken out here."""
    flat = lambda c: F.regexp_replace(F.base64(c), r"\s", "")
    box = F.format_string('x="%d" y="%d" width="%d" height="%d" preserveAspectRatio="xMidYMid meet"', "x", "y", "width", "height")
    plain = F.concat(F.lit("<image "), box, F.lit(' href="data:'), "mime", F.lit(";base64,"), flat(F.col("data")), F.lit('"/>'))
    planes = F.lit('<g style="isolation:isolate">')
    for k, ink in enumerate(INKS):
        blend = "" if k == 0 else ' style="mix-blend-mode:multiply"'
        planes = F.concat(planes, F.lit("<image "), box, F.lit(f' filter="url(#ink-{ink})"{blend} href="data:image/jpeg;base64,'), flat(F.get(F.col("bands"), F.lit(k))), F.lit('"/>'))
    mark = F.when(F.col("bands").isNull(), plain).otherwise(F.concat(planes, F.lit("</g>")))
    return images.select("path", "page_idx", F.lit(3).alias("layer"), F.col("item_seq").cast("long").alias("seq"), mark.alias("mark"))


def graphic_marks(graphics: DataFrame) -> DataFrame:
    frame = F.format_string('<svg x="%d" y="%d" width="%d" height="%d" viewBox="0 0 %d %d" overflow="hidden">', "x", "y", "width", "height", "window_width", "window_height")
    return graphics.select("path", "page_idx", F.lit(4).alias("layer"), F.col("item_seq").cast("long").alias("seq"), F.concat(frame, "svg", F.lit("</svg>")).alias("mark"))


def within_budget(pages: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages up to the one at which the elements so far pass the budget, and to the most pages."""
    counts = texts.select("path", "page_idx").unionByName(rules.select("path", "page_idx")).groupBy("path", "page_idx").agg(F.count("*").alias("elements"))
    before = F.coalesce(F.sum("elements").over(Window.partitionBy("path").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.join(counts, ["path", "page_idx"], "left").fillna(0, ["elements"]).withColumn("before", before)
    return rows.filter((F.col("before") <= MOST_ELEMENTS) & (F.col("page_idx") < MOST_PAGES)).drop("before", "elements")


def svg(pages: DataFrame, texts: DataFrame, rules: DataFrame, images: DataFrame | None = None, graphics: DataFrame | None = None) -> DataFrame:
    """(path, page_idx, svg) of the pages within the budget."""
    pages = within_budget(pages, texts, rules)
    head = F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d" data-upi="%d" font-family="Arial, Helvetica, sans-serif"><rect width="%d" height="%d" fill="#ffffff"/>', "width", "height", "units_per_inch", "width", "height"
    )
    cut = F.format_string('<text x="60" y="%d" font-size="200" fill="#9aa0b8">[render truncated: page content exceeds %d runs]</text>', F.col("height") - 80, F.lit(MOST_RUNS))
    at = lambda layer, mark: pages.select("path", "page_idx", F.lit(layer).alias("layer"), F.lit(0).cast("long").alias("seq"), mark.alias("mark"))
    marks = at(0, head).unionByName(at(9, F.concat(F.when(F.col("truncated"), cut).otherwise(F.lit("")), F.lit("</svg>")))).unionByName(text_marks(texts)).unionByName(rule_marks(rules))
    if images is not None:
        inks = images.filter("bands is not null").select("path", "page_idx").distinct()
        marks = marks.unionByName(image_marks(images)).unionByName(inks.select("path", "page_idx", F.lit(1).alias("layer"), F.lit(0).cast("long").alias("seq"), F.lit(ink_filters()).alias("mark")))
    if graphics is not None:
        marks = marks.unionByName(graphic_marks(graphics))
    marks = marks.join(pages.select("path", "page_idx"), ["path", "page_idx"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("layer", "seq", "mark")))
    return marks.groupBy("path", "page_idx").agg(F.array_join(F.transform(listed, lambda m: m["mark"]), "").alias("svg"))
