"""Specimen pages of font files: each raster font's glyphs on a grid, with their identifiers.

A file without pages of its own shows its embedded fonts. Places on the grid are expressions of a
glyph's number among those shown.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.functions import images as kernel
from folia.operators.fields import BPG
from folia.operators.objects import font_glyphs, fonts

# The sheet's measures in units of 1440 an inch, and the least pels of a glyph that is shown.
WIDTH, MARGIN, TITLE, LABEL, GLYPH, CELL_WIDTH, CELL_HEIGHT, TOP, LEAST = 12240, 600, 440, 170, 700, 1700, 1300, 980, 3
COLUMNS = max(1, (WIDTH - 2 * MARGIN) // CELL_WIDTH)


@F.arrow_udf(T.BinaryType())
def glyph_png(bits: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """One bit a pel, set bits dark; patterns that are cut short end in white."""
    out = []
    for b, w, h in zip(bits.to_pylist(), width.to_pylist(), height.to_pylist()):
        row = (w + 7) // 8
        out.append(kernel.png(w, h, 1, 0, row, (b or b"").ljust(row * h, b"\0").translate(bytes(255 - k for k in range(256)))))
    return pa.array(out, pa.binary())


def fitted(width: Column, height: Column) -> tuple[Column, Column]:
    """A glyph's extent on the sheet: of the sheet's height, or as wide as a cell allows."""
    wide = F.bround(F.lit(GLYPH) * width / height).cast("int")
    most = CELL_WIDTH - 200
    return F.least(wide, F.lit(most)), F.when(wide > most, F.bround(F.lit(GLYPH) * most / wide).cast("int")).otherwise(F.lit(GLYPH))


def specimens(fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, texts, images) of the files without pages that embed raster fonts; a page for each font, in order."""
    paged = fields.filter(F.col("sf_id") == BPG).select("path").distinct()
    found = fonts(fields.join(paged, "path", "left_anti"))
    shown = font_glyphs(found).filter((F.col("width") >= LEAST) & (F.col("height") >= LEAST))
    shown = shown.withColumn("k", F.row_number().over(Window.partitionBy("path", "object").orderBy("pattern")) - 1)
    sheets = shown.groupBy("path", "object").agg(F.count("*").alias("n")).join(found.select("path", "object", "name", "typeface"), ["path", "object"])
    sheets = sheets.withColumn("page_idx", F.row_number().over(Window.partitionBy("path").orderBy("object")) - 1)
    rows = F.ceil(F.col("n") / COLUMNS).cast("int")
    pages = sheets.select("path", "page_idx", F.lit(WIDTH).alias("width"), (TOP + rows * CELL_HEIGHT + MARGIN).alias("height"), F.lit(1440).alias("units_per_inch"), F.lit(False).alias("truncated"), F.lit("specimen").alias("kind"))
    label = F.coalesce(F.nullif("typeface", F.lit("")), F.nullif("name", F.lit("")), F.lit("embedded font"))
    titles = sheets.select(
        "path", "page_idx", F.lit(0).alias("item_seq"), F.lit(MARGIN).alias("x"), F.lit(MARGIN).alias("y"), F.format_string("Embedded raster font: %s — %d glyphs", label, "n").alias("text"),
        F.lit("#000000").alias("color"), F.lit(TITLE).alias("font_size"), F.lit("Arial").alias("font_family"), F.lit("bold").alias("font_weight"),
    )
    wide, high = fitted(F.col("width"), F.col("height"))
    cell_x, cell_y = MARGIN + F.col("k") % COLUMNS * CELL_WIDTH, TOP + F.floor(F.col("k") / COLUMNS).cast("int") * CELL_HEIGHT
    cells = shown.join(sheets.select("path", "object", "page_idx"), ["path", "object"]).withColumns({"cx": cell_x, "cy": cell_y, "w": wide, "h": high})
    texts = cells.select(
        "path", "page_idx", (F.col("k") + 1).alias("item_seq"), (F.col("cx") + 40).alias("x"), (F.col("cy") + GLYPH + LABEL + 60).alias("y"), F.coalesce(F.nullif("gcgid", F.lit("")), F.lit("?")).alias("text"),
        F.lit("#666666").alias("color"), F.lit(LABEL).alias("font_size"), F.lit("Consolas").alias("font_family"), F.lit("normal").alias("font_weight"),
    )
    images = cells.select(
        "path", "page_idx", F.col("k").alias("item_seq"), (F.col("cx") + F.floor((CELL_WIDTH - F.col("w")) / 2).cast("int")).alias("x"), (F.col("cy") + GLYPH - F.col("h")).alias("y"),
        F.col("w").alias("width"), F.col("h").alias("height"), F.lit("image/png").alias("mime"), glyph_png("bits", "width", "height").alias("data"),
    )
    return pages, titles.unionByName(texts), images
