"""A report on each file, as an inspector gives it: fields, counts, pages, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.functions.text import DEFAULT_CODEC
from folia.operators import fields as ops
from folia.operators import layout, objects, render
from folia.sources import afp
from folia.sources.shared import written

# Code pages that may be chosen; others count as the first. Python has no codec of two of them, whose text falls back to it.
CODE_PAGES = ("cp500", "cp037", "cp273", "cp1047", "cp1140", "cp1141")


def document_report(files: DataFrame, code_page: str = DEFAULT_CODEC) -> DataFrame:
    """(path, error, n_fields, summary, page_total, resource_kind, mcf_note, missing_resources, pages) of (path, content).

    One row for each file, whether it has fields or not. Fields, texts, rules, images and drawings are
    written to shared storage first, so each part is planned and aggregated by itself.
    """
    code_page = code_page if code_page in CODE_PAGES else DEFAULT_CODEC
    framed = written(afp.frame(files), "framed")
    fields = afp.fields_of(framed)
    pages, texts, rules = (written(x, "laid-out") for x in layout.layout(fields, code_page, written(objects.typefaces(fields), "typefaces")))
    images, graphics = written(objects.images(fields), "images"), written(objects.graphics(fields), "graphics")
    pictures = written(render.svg(pages, texts, rules, images, graphics), "pictures").join(layout.page_text(texts), ["path", "page_idx"], "left")
    listed = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    pictures = pictures.groupBy("path").agg(listed("page_idx", "svg", "text").alias("pages"))
    totals = pages.groupBy("path").agg(F.count("*").alias("page_total"))
    summary = ops.histogram(fields).groupBy("path").agg(listed("rank", "name", "n").alias("summary"))
    missing = ops.missing_resources(fields).groupBy("path").agg(listed("rank", "kind", "name", "codec").alias("missing_resources"))
    out = files.select("path").distinct().join(afp.errors_of(framed).select("path", F.col("message").alias("error")), "path", "left")
    for part in (ops.page_counts(fields), summary, totals, ops.code_page_note(fields).withColumnRenamed("note", "mcf_note"), missing, pictures):
        out = out.join(part, "path", "left")
    return out.fillna(0, ["n_fields", "page_total"])
