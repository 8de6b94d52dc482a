"""Page layout: text runs and rules at their places, overlays, sizes, reading order.

The fields that layout reads are written once with their owners, and so are the controls with
their state, so each result is planned from a table by itself and no stream is framed again.
Text controls become rows; what an interpreter would keep as state is a window over them.
A pen coordinate is a segmented running sum (a control that sets it starts a segment), colour,
margins, increments, orientation and font are last values, and the font and code page in force
for a local id are an as-of lookup in the file's mappings. Windows are partitioned by
(path, page) where the state ends with the page. Only text outside all pages, where a line
wraps by what came before, is folded in sequence, a file at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.functions import describe, scans
from folia.functions.text import LABELS, coded_points, coded_typeface, run_text, substitute
from folia.operators.fields import BDT, BMO, BPG, EMO, EPG, IPO, MCF1, MCF2, MDR, MPO, PGD, PTX, coded_fonts, ebcdic_text, in_file, joined, labels
from folia.sources.shared import written

WIDTH, HEIGHT, UPI = 12240, 15840, 1440
MOST_RUNS, ADVANCE = 5000, 0.55

# Standard text colours.
COLORS = {
    0x0001: "#0000ff", 0x0002: "#ff0000", 0x0003: "#ff00ff", 0x0004: "#00ff00", 0x0005: "#00ffff", 0x0006: "#ffff00", 0x0008: "#000000", 0x0010: "#a52a2a", 0xFF07: "#000000",
}

AMI, AMB, RMI, RMB, SIM, SVI, SBI, BLN, SCFL, STC, SEC, STO, TRN, DIR, DBR = (
    0xC6, 0xD2, 0xC8, 0xD4, 0xC0, 0xC4, 0xD0, 0xD8, 0xF0, 0x74, 0x80, 0xF6, 0xDA, 0xE4, 0xE6,
)

CONTROL = T.ArrayType(T.StructType([T.StructField("cs_type", T.IntegerType()), T.StructField("params", T.BinaryType())]))


@F.arrow_udf(CONTROL)
def control_sequences(data: pa.Array) -> pa.Array:
    rows = [[{"cs_type": k, "params": p} for k, p in scans.control_sequences(d)] for d in data.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("cs_type", pa.int32()), ("params", pa.binary())])))


def unsigned(data: Column, at: int, size: int) -> Column:
    """Big-endian unsigned bytes from 0-based ``at``; null where the bytes are too few."""
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("int"))


def signed(data: Column, at: int, size: int) -> Column:
    v = unsigned(data, at, size)
    return F.when(v >= 1 << (8 * size - 1), v - (1 << 8 * size)).otherwise(v)


def floor_scale(v: Column, of: Column, to: Column) -> Column:
    return F.floor(v.cast("long") * to / of).cast("int")


def with_owner(fields: DataFrame) -> DataFrame:
    """Adds owner: the field_seq of the page or overlay that a field stands in, or null; kept where it is known."""
    if "owner" in fields.columns:
        return fields
    event = F.when(F.col("sf_id").isin(BPG, BMO), F.col("field_seq")).when(F.col("sf_id").isin(EPG, EMO), F.lit(-1))
    last = F.last(event, ignorenulls=True)
    before = last.over(Window.partitionBy("path").orderBy("field_seq").rowsBetween(Window.unboundedPreceding, -1))
    own = F.when(F.col("sf_id").isin(BPG, BMO), F.col("field_seq")).otherwise(before)
    return fields.withColumn("owner", F.when(own >= 0, own))


def objects(fields: DataFrame) -> DataFrame:
    """Pages and overlays: (path, owner, kind, name, closed, page_idx, width, height, upi); closed by EPG or EMO, overlays without a page_idx."""
    rows = with_owner(fields.filter(F.col("sf_id").isin(BPG, EPG, BMO, EMO, PGD)))
    size = F.when((F.col("sf_id") == PGD) & (F.octet_length("data") >= 12), F.struct(
        unsigned(F.col("data"), 6, 3).alias("width"), unsigned(F.col("data"), 9, 3).alias("height"),
        F.when(unsigned(F.col("data"), 2, 2) >= 10, F.floor(unsigned(F.col("data"), 2, 2) / 10)).otherwise(UPI).cast("int").alias("upi"),
    ))
    rows = rows.withColumn("size", size)
    rows = rows.withColumn("default", F.last(F.when(F.col("owner").isNull(), F.col("size")), ignorenulls=True).over(in_file()))
    begins = F.col("sf_id").isin(BPG, BMO)
    end = F.when(F.col("sf_id").isin(EPG, EMO), F.struct("field_seq", "sf_id"))
    grouped = rows.filter(F.col("owner").isNotNull()).groupBy("path", "owner").agg(
        F.max(F.when(begins, F.col("sf_id"))).alias("begin"), F.max(F.when(begins, F.substring("data", 1, 8))).alias("token"), F.min(end).alias("end"),
        F.max(F.when(begins, F.col("default"))).alias("default"), F.max(F.when(F.col("size").isNotNull(), F.struct("field_seq", "size"))).alias("own"),
    )
    size = F.coalesce(F.col("own.size"), F.col("default"), F.struct(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(UPI).alias("upi")))
    kind = F.when(F.col("end.sf_id") == EPG, "page").when((F.col("end.sf_id") == EMO) & (F.col("begin") == BMO), "overlay")
    rows = grouped.withColumn("size", size).select("path", "owner", kind.alias("kind"), ebcdic_text("token").alias("name"), F.col("end.field_seq").alias("closed"), "size.*")
    idx = F.row_number().over(Window.partitionBy("path", "kind").orderBy("closed")) - 1
    return rows.filter(F.col("kind").isNotNull()).withColumn("page_idx", F.when(F.col("kind") == "page", idx))


FONT = T.ArrayType(T.StructType([T.StructField("local_id", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("weight", T.StringType()), T.StructField("size", T.IntegerType())]))


@F.arrow_udf(FONT)
def resource_fonts(data: pa.Array) -> pa.Array:
    """Fonts by local id of a data-resource map: full name, 20ths of a point."""
    out = []
    for d in data.to_pylist():
        rows: dict[int, dict] = {}
        for body in scans.groups(d)[0]:
            local, name, size = None, None, None
            for tid, t in scans.triplets(body):
                if tid == 0x02 and len(t) >= 3 and t[0] == 0xDE:
                    name = run_text(t[2:])[0].strip()
                elif tid == 0x02 and len(t) >= 3 and t[0] == 0xBE:
                    local = t[-1]
                elif tid == 0x8B and len(t) >= 4:
                    size = scans.u16(t, 2)
            if local is not None:
                family = name or "Arial"
                plain = family.replace(" Bold", "").replace(" bold", "")
                rows[local] = {"local_id": local, "family": plain, "weight": "normal" if plain == family else "bold", "size": size}
        out.append(list(rows.values()))
    return pa.array(out, pa.list_(pa.struct([("local_id", pa.int32()), ("family", pa.string()), ("weight", pa.string()), ("size", pa.int32())])))


SUBSTITUTE = T.StructType([T.StructField("family", T.StringType()), T.StructField("weight", T.StringType()), T.StructField("points", T.DoubleType()), T.StructField("note", T.StringType())])


@F.arrow_udf(SUBSTITUTE)
def substitutes(chars: pa.Array, typeface: pa.Array, embedded: pa.Array) -> pa.Array:
    """The font that stands for a character set: by its embedded typeface, else by its name."""
    rows = []
    for name, face, own in zip(chars.to_pylist(), typeface.to_pylist(), embedded.to_pylist()):
        name = name or ""
        found = substitute(face or "") or substitute(coded_typeface(name))
        family, weight = found or ("Arial", "normal")
        label = (face or "").title().replace("-", " ") or coded_typeface(name).title()
        shown = LABELS.get(family, family)
        if own:
            note = f"Drawn in substitute font {shown}" + (f" for {label}" if label else "") + " — the embedded glyphs aren't used at this size."
        else:
            who = f"{label} (“{name.strip() or '?'}”)" if label else f"“{name.strip() or '?'}”"
            note = f"{who} is referenced but not embedded in this file — rendered with the system {shown}; glyph widths are approximated."
        rows.append({"family": family, "weight": weight, "points": coded_points(name), "note": note})
    return pa.array(rows, pa.struct([("family", pa.string()), ("weight", pa.string()), ("points", pa.float64()), ("note", pa.string())]))


def font_events(fields: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """(path, field_seq, local_id, info, mapped, codec, note): what each map says of each local id; info of MDRs, mapped of coded-font maps.

    faces: (path, name, typeface) of embedded character sets.
    """
    mdr = fields.filter(F.col("sf_id") == MDR).select("path", "field_seq", F.explode(resource_fonts("data")).alias("f"))
    info = F.struct(F.col("f.family").alias("family"), F.col("f.weight").alias("weight"), F.col("f.size").alias("size"), F.lit(None).cast("double").alias("points"))
    none = F.lit(None)
    mdr = mdr.select("path", "field_seq", F.col("f.local_id").alias("local_id"), info.alias("info"), none.cast(info_type()).alias("mapped"), none.cast("string").alias("codec"), none.cast("string").alias("note"))
    maps = coded_fonts(fields)
    if faces is None:
        maps = maps.withColumn("typeface", F.lit(None).cast("string"))
    else:
        maps = maps.join(faces.select("path", F.col("name").alias("character_set"), "typeface"), ["path", "character_set"], "left")
    maps = maps.withColumn("s", substitutes("character_set", "typeface", F.col("typeface").isNotNull()))
    mapped = F.struct(F.col("s.family").alias("family"), F.col("s.weight").alias("weight"), F.lit(None).cast("int").alias("size"), F.col("s.points").alias("points"))
    named = F.col("code_page").isNotNull() | F.col("character_set").isNotNull() | F.col("label").isNotNull()
    maps = maps.filter(named).select("path", "field_seq", "local_id", none.cast(info_type()).alias("info"), mapped.alias("mapped"), "codec", F.col("s.note").alias("note"))
    return mdr.unionByName(maps)


def info_type() -> T.StructType:
    return T.StructType([T.StructField("family", T.StringType()), T.StructField("weight", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("points", T.DoubleType())])


#: Fields that text layout reads.
READ = (BDT, BPG, EPG, BMO, EMO, PGD, PTX, MDR, MCF1, MCF2, MPO, IPO)


def controls(fields: DataFrame) -> DataFrame:
    """(path, owner, field_seq, offset, cs_seq, cs_type, params) of all text controls."""
    rows = with_owner(fields.filter(F.col("sf_id").isin(BPG, EPG, BMO, EMO, PTX))).filter(F.col("sf_id") == PTX)
    rows = rows.select("path", "owner", "field_seq", "offset", F.posexplode(control_sequences("data")).alias("cs_seq", "c"))
    return rows.select("path", "owner", "field_seq", "offset", "cs_seq", "c.*")


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("left_out", T.IntegerType()), T.StructField("codec", T.StringType()), T.StructField("substitutes", T.IntegerType()), T.StructField("blank", T.BooleanType())])


@F.arrow_udf(DECODED)
def decoded(params: pa.Array, codec: pa.Array) -> pa.Array:
    rows = []
    for p, c in zip(params.to_pylist(), codec.to_pylist()):
        if p is None:
            rows.append(None)
        else:
            text, left_out, used, subs = run_text(p, c)
            rows.append({"text": text, "left_out": left_out, "codec": used, "substitutes": subs, "blank": not text.strip()})
    kind = pa.struct([("text", pa.string()), ("left_out", pa.int32()), ("codec", pa.string()), ("substitutes", pa.int32()), ("blank", pa.bool_())])
    return pa.array(rows, kind)


FONT_NAMES = ("info", "mapped", "codec", "note")


def fonts_in_force(rows: DataFrame, sizes: DataFrame, fields: DataFrame, faces: DataFrame | None) -> DataFrame:
    """(path, field_seq, cs_seq, font, font_codec, font_notes, declared) of the runs that name a local id.

    declared: whether the font known when the page ends states a size. An as-of lookup: mappings,
    runs and ends of pages of a local id are one sequence.
    """
    used = rows.filter((F.col("cs_type") == TRN) & F.col("font_id").isNotNull()).select("path", "owner", "field_seq", "cs_seq", F.col("font_id").alias("local_id"))
    events = font_events(fields, faces)
    none = {c: F.lit(None).cast(events.schema[c].dataType) for c in FONT_NAMES}
    ends = used.select("path", "owner", "local_id").distinct().join(sizes.select("path", "owner", "closed"), ["path", "owner"], "left")
    ends = ends.select("path", "owner", F.coalesce("closed", F.lit((1 << 31) - 1)).alias("field_seq"), F.lit(-2).alias("cs_seq"), "local_id").withColumns(none)
    both = events.withColumns({"owner": F.lit(None).cast("int"), "cs_seq": F.lit(-1)}).unionByName(used.withColumns(none)).unionByName(ends)
    e = Window.partitionBy("path", "local_id").orderBy("field_seq", "cs_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({
        "own": F.last("info", ignorenulls=True).over(e), "since": F.coalesce(F.last(F.when(F.col("info").isNotNull(), F.col("field_seq")), ignorenulls=True).over(e), F.lit(-1)),
        "first": F.first("mapped", ignorenulls=True).over(e), "page": F.last("codec", ignorenulls=True).over(e),
    }).withColumn("font", F.coalesce("own", "first"))
    # Distinct notes of a local id since its last map, each with where it was first told: carried once, not by every run.
    told = both.filter(F.col("note").isNotNull()).groupBy("path", "local_id", "since", "note").agg(F.min("field_seq").alias("at"))
    told = told.groupBy("path", "local_id", "since").agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("told"))
    stated = F.coalesce(F.col("font.size") > 0, F.lit(False)) | F.coalesce(F.col("font.points") > 0, F.lit(False))
    closing = both.filter(F.col("cs_seq") == -2).select(F.col("path").alias("p"), F.col("owner").alias("o"), F.col("local_id").alias("l"), stated.alias("declared"))
    runs = both.filter(F.col("cs_seq") >= 0).join(told, ["path", "local_id", "since"], "left")
    runs = runs.join(closing, (F.col("path") == F.col("p")) & F.col("owner").eqNullSafe(F.col("o")) & (F.col("local_id") == F.col("l")), "left")
    notes = F.transform(F.filter("told", lambda x: x["at"] < F.col("field_seq")), lambda x: x["note"])
    return runs.select("path", "field_seq", "cs_seq", "font", F.col("page").alias("font_codec"), notes.alias("font_notes"), "declared")


def with_state(fields: DataFrame, codec: str = "cp500", faces: DataFrame | None = None, drawn: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(controls with the last values in force at them, and with text, font and size at runs; what ``drawn`` makes of the runs).

    drawn: which runs are drawn byte by byte, with the step of each; the pen follows their steps.
    """
    t, p = F.col("cs_type"), F.col("params")
    rows = controls(fields)
    w = Window.partitionBy("path", "owner").orderBy("field_seq", "cs_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(kind: int, value: Column) -> Column:
        return F.last(F.when(t == kind, value), ignorenulls=True).over(w)

    rgb = F.concat(F.lit("#"), F.lower(F.hex(F.substring(p, 11, 3))))
    is_rgb = (F.octet_length(p) >= 13) & (F.substring(p, 2, 1) == F.lit(b"\x01")) & (F.substring(p, 7, 3) == F.lit(b"\x08\x08\x08"))
    color = F.when((t == STC) & (F.octet_length(p) >= 2), F.coalesce(labels(unsigned(p, 0, 2), COLORS), F.lit("#000000"))).when((t == SEC) & is_rgb, rgb)
    rows = rows.withColumns({
        "margin": F.coalesce(last(SIM, unsigned(p, 0, 2)), F.lit(0)), "increment": F.coalesce(last(SBI, signed(p, 0, 2)), F.lit(0)), "space": last(SVI, unsigned(p, 0, 2)),
        "font_id": last(SCFL, unsigned(p, 0, 1)), "color": F.coalesce(F.last(color, ignorenulls=True).over(w), F.lit("#000000")),
        "orientation": F.coalesce(last(STO, F.pmod(F.floor(unsigned(p, 0, 2) / 128), F.lit(360)).cast("int")), F.lit(0)),
    })
    sizes = objects(fields)
    upi = F.coalesce("upi", F.lit(UPI))
    rows = joined(rows, sizes.select("path", "owner", "upi"), ["path", "owner"], "left").withColumn("upi", upi)
    if fields.filter(F.col("sf_id").isin(MDR, MCF1, MCF2)).isEmpty():  # no file maps a font
        force = {"font": info_type(), "font_codec": T.StringType(), "font_notes": T.ArrayType(T.StringType()), "declared": T.BooleanType()}
        rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in force.items()})
    else:
        rows = rows.join(fonts_in_force(rows, sizes, fields, faces), ["path", "field_seq", "cs_seq"], "left")
    text = decoded(F.when(t == TRN, p), F.coalesce("font_codec", F.lit(codec)))
    points = F.bround(F.col("font.points") * upi / 72).cast("int")
    size = F.coalesce(F.nullif(F.col("font.size"), F.lit(0)), F.nullif(points, F.lit(0)), F.greatest(F.floor(upi / 6), F.lit(8)).cast("int"))
    rows = rows.withColumns({"run": text, "size": size, "sized": F.coalesce("declared", F.lit(False))})
    spaces = F.length("run.text") - F.length(F.replace(F.col("run.text"), F.lit(" "), F.lit("")))
    advance = (F.length("run.text") - spaces) * F.col("size") * ADVANCE + spaces * F.coalesce(F.col("space").cast("double"), F.col("size") * ADVANCE)
    rows = rows.withColumns({"spaces": spaces, "advance": advance.cast("int")})
    if drawn is None:
        return rows.withColumn("by_glyphs", F.lit(False)), None
    own = written(drawn(rows.filter((t == TRN) & F.col("font_id").isNotNull())), "drawn-bytes")
    steps = own.groupBy("path", "field_seq", "cs_seq").agg(F.sum("step").cast("int").alias("steps"))
    rows = rows.join(steps, ["path", "field_seq", "cs_seq"], "left")
    return rows.withColumns({"advance": F.coalesce("steps", "advance"), "by_glyphs": F.col("steps").isNotNull()}).drop("steps"), own


def with_pen(rows: DataFrame) -> DataFrame:
    """Adds i and b, the pen before each control, on pages and overlays."""
    t, p = F.col("cs_type"), F.col("params")
    v, enough = signed(p, 0, 2), F.octet_length(p) >= 2
    turns = (t == STO) & enough
    rows = rows.withColumns({
        "set_i": F.when(((t == AMI) & enough) | (t == BLN) | turns, 1).otherwise(0),
        "step_i": F.when((t == AMI) | (t == RMI), v).when(t == BLN, F.col("margin")).when(t == TRN, F.col("advance")).otherwise(0),
        "set_b": F.when(((t == AMB) & enough) | turns, 1).otherwise(0),
        "step_b": F.when((t == AMB) | (t == RMB), v).when(t == BLN, F.col("increment")).otherwise(0),
    }).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("step_i", "step_b")})
    w = Window.partitionBy("path", "owner").orderBy("field_seq", "cs_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"seg_i": F.sum("set_i").over(w), "seg_b": F.sum("set_b").over(w)})
    for axis in "ib":
        s = Window.partitionBy("path", "owner", f"seg_{axis}").orderBy("field_seq", "cs_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(axis, (F.sum(f"step_{axis}").over(s) - F.when(t == TRN, F.col(f"step_{axis}")).otherwise(0)).cast("int"))
    return rows.drop("set_i", "set_b", "step_i", "step_b", "seg_i", "seg_b")


# What the notes on runs say.
LEFT_OUT = "%d character(s) omitted — code point(s) the %s codec can't map (usually a producer-specific symbol)."
SUBSTITUTED = "%d glyph(s) the producer couldn't encode in the AFP code page (wrote substitute X'3F') — the original glyphs (e.g. symbol/dingbat font) are absent from this AFP, not just unrendered here."
NO_CODE_PAGE = "No code page declared for this font — text decoded with the fallback %s."
ESTIMATED = "Point size not declared — estimated ≈%dpt from the producer's line spacing."
NOT_INFERABLE = "Point size not declared and not inferable (single line) — using a default of ≈%dpt."


def _note(cat: str, message: Column) -> Column:
    return F.struct(F.lit(cat).alias("cat"), message.alias("msg"))


def _texts(rows: DataFrame) -> DataFrame:
    """Runs of text with their notes, of controls with i and b."""
    swap = F.col("orientation").isin(90, 270)
    run, text = F.col("run"), F.col("run.text")
    solid = F.length(text) - F.col("spaces")
    notes = [
        F.when(run["left_out"] > 0, _note("glyph", F.format_string(LEFT_OUT, run["left_out"], run["codec"]))),
        F.when((run["substitutes"] >= 3) & (solid > 0) & (run["substitutes"] / solid > 0.5), _note("glyph", F.format_string(SUBSTITUTED, run["substitutes"]))),
        F.when((run["codec"] != "utf-16-be") & F.col("font_codec").isNull(), _note("codepage", F.format_string(NO_CODE_PAGE, run["codec"]))),
    ]
    told = F.transform(F.coalesce("font_notes", F.array().cast("array<string>")), lambda m: _note("font", m))
    return rows.filter((F.col("cs_type") == TRN) & ~run["blank"] & ~F.col("by_glyphs")).select(
        "path", "owner", F.struct("field_seq", "cs_seq", F.lit(-1).alias("of_seq"), F.lit(-1).alias("of_cs")).alias("item"),
        F.when(swap, F.col("b")).otherwise(F.col("i")).alias("x"), F.when(swap, F.col("i")).otherwise(F.col("b")).alias("y"),
        text.alias("text"), "color", "font_id", F.col("size").alias("font_size"), F.coalesce("font.family", F.lit("Arial")).alias("font_family"),
        F.coalesce("font.weight", F.lit("normal")).alias("font_weight"), "orientation", F.col("offset").alias("src"), F.when(F.col("spaces") > 0, F.col("space")).alias("space_width"),
        F.filter(F.concat(told, F.array(*notes)), lambda x: x.isNotNull()).alias("notes"), "sized", "upi",
    )


def _rules(rows: DataFrame) -> DataFrame:
    p = F.col("params")
    least = F.greatest(F.lit(1), F.bround(F.col("upi") / 144)).cast("int")
    thick = F.coalesce(signed(p, 2, 2), F.lit(20))
    thick = F.when((thick != 0) & (F.abs(thick) < least), F.signum(thick).cast("int") * least).otherwise(thick)
    return rows.filter(F.col("cs_type").isin(DIR, DBR) & (F.octet_length(p) >= 2)).select(
        "path", "owner", F.struct("field_seq", "cs_seq", F.lit(-1).alias("of_seq"), F.lit(-1).alias("of_cs")).alias("item"), F.col("i").alias("x"), F.col("b").alias("y"),
        signed(p, 0, 2).alias("length"), thick.alias("thickness"), F.when(F.col("cs_type") == DIR, "I").otherwise("B").alias("axis"), "color", F.col("offset").alias("src"),
    )


def estimated(texts: DataFrame) -> DataFrame:
    """Sizes of runs whose font declares none: by the pitch of baselines, else by the width of characters, else as they are."""
    upi = F.col("upi")
    low, high = F.greatest(F.floor(upi / 18), F.lit(4)), F.floor(upi * 5 / 6)
    open_ = texts.filter(~F.col("sized"))
    by_y = Window.partitionBy("path", "owner", "font_id").orderBy("y")
    middle = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))  # noqa: E731  the upper one of two
    pitches = open_.select("path", "owner", "font_id", "upi", "y").distinct().withColumn("d", F.col("y") - F.lag("y").over(by_y))
    pitches = pitches.filter((F.col("d") > 0) & (F.col("d") <= F.floor(upi / 2))).groupBy("path", "owner", "font_id").agg(middle("d").alias("pitch"))
    order = Window.partitionBy("path", "owner").orderBy("item")
    next_ = texts.withColumns({"nx": F.lead("x").over(order), "ny": F.lead("y").over(order)})
    each = (F.col("nx") - F.col("x")) / (F.length("text") + 1)
    widths = next_.filter(~F.col("sized") & (F.col("ny") == F.col("y")) & (F.col("nx") > F.col("x")) & (each >= upi / 30) & (each <= upi / 4))
    widths = widths.select("path", "owner", "font_id", each.alias("w")).groupBy("path", "owner", "font_id").agg(middle("w").alias("char"))
    rows = texts
    for found in (pitches, widths):  # text outside pages has no owner, and runs may have no font: nulls are equal here
        found = found.withColumnsRenamed({"path": "_path", "owner": "_owner", "font_id": "_font"})
        on = (F.col("path") == F.col("_path")) & F.col("owner").eqNullSafe(F.col("_owner")) & F.col("font_id").eqNullSafe(F.col("_font"))
        rows = rows.join(found, on, "left").drop("_path", "_owner", "_font")
    guess = F.coalesce((F.col("pitch") / 1.2).cast("int"), (F.col("char") / 0.52).cast("int"))
    clamped = F.greatest(low, F.least(high, guess)).cast("int")
    size = F.when(F.col("sized") | guess.isNull(), F.col("font_size")).otherwise(clamped)
    points = F.bround(size / upi * 72).cast("int")
    message = F.when(guess.isNotNull(), F.format_string(ESTIMATED, points)).otherwise(
        F.format_string(NOT_INFERABLE, points)
    )
    notes = F.when(F.col("sized"), F.col("notes")).otherwise(F.array_union("notes", F.array(_note("font", message))))
    return rows.withColumns({"notes": notes, "font_size": size}).drop("pitch", "char")


OVERLAYS = T.ArrayType(T.StructType([T.StructField("local_id", T.IntegerType()), T.StructField("name", T.StringType())]))


@F.arrow_udf(OVERLAYS)
def overlay_ids(data: pa.Array) -> pa.Array:
    rows = [[{"local_id": i, "name": n} for i, n in describe.overlay_ids(d).items()] for d in data.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("local_id", pa.int32()), ("name", pa.string())])))


def inclusions(fields: DataFrame, found: DataFrame) -> DataFrame:
    """(path, owner, at, overlay, ox, oy, upi, from_upi): overlays placed on pages, by name or else by local id, if closed before."""
    rows = with_owner(fields.filter(F.col("sf_id").isin(BPG, EPG, BMO, EMO, IPO))).filter((F.col("sf_id") == IPO) & F.col("owner").isNotNull())
    data = F.col("data")
    ref = F.substring(data, 1, 8)
    marks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substr(F.hex(ref), k * 2 + 1, F.lit(2))), lambda x: ~x.isin("00", "40", ""))
    single = F.when(F.size(marks) == 1, F.conv(marks[0], 16, 10).cast("int"))
    rows = rows.select(
        "path", "owner", F.col("field_seq").alias("at"), ebcdic_text(ref).alias("name"), single.alias("local_id"),
        F.coalesce(signed(data, 8, 3), F.lit(0)).alias("ox"), F.coalesce(signed(data, 11, 3), F.lit(0)).alias("oy"),
    )
    maps = fields.filter(F.col("sf_id") == MPO).select("path", "field_seq", F.explode(overlay_ids("data")).alias("m")).select("path", "field_seq", "m.*")
    by_id = rows.join(maps.withColumnRenamed("name", "mapped"), ["path", "local_id"], "left").filter(F.col("field_seq").isNull() | (F.col("field_seq") < F.col("at")))
    by_id = by_id.groupBy("path", "at").agg(F.max(F.struct("field_seq", "mapped")).alias("m")).select("path", "at", F.col("m.mapped").alias("mapped"))
    rows = rows.join(by_id, ["path", "at"], "left")
    over = found.filter(F.col("kind") == "overlay").select("path", F.col("owner").alias("overlay"), F.col("name").alias("own_name"), "closed", F.col("upi").alias("from_upi"))
    upis = found.select("path", "owner", "upi")
    met = rows.join(over, "path").filter((F.col("closed") < F.col("at")) & (F.col("own_name") != "") & ((F.col("own_name") == F.col("name")) | (F.col("own_name") == F.col("mapped"))))
    best = Window.partitionBy("path", "at").orderBy(F.desc(F.col("own_name") == F.col("name")), F.desc("closed"))
    met = met.withColumn("k", F.row_number().over(best)).filter("k = 1")
    return met.join(upis, ["path", "owner"]).select("path", "owner", "at", "overlay", "ox", "oy", "upi", "from_upi")


def included(items: DataFrame, placed: DataFrame, scaled: tuple[str, ...]) -> DataFrame:
    """The items of the overlays of each inclusion, moved to the page that includes them."""
    own = items.drop("upi").withColumnRenamed("owner", "overlay").join(placed, ["path", "overlay"])
    to = lambda c: floor_scale(F.col(c), F.col("from_upi"), F.col("upi"))
    order = F.struct(F.col("at").alias("field_seq"), F.lit(-1).alias("cs_seq"), F.col("item.field_seq").alias("of_seq"), F.col("item.cs_seq").alias("of_cs"))
    moved = own.withColumns({"x": F.col("ox") + to("x"), "y": F.col("oy") + to("y"), **{c: to(c) for c in scaled}, "item": order})
    return moved.select([c for c in items.columns])


def bare_overlays(fields: DataFrame, found: DataFrame, state: DataFrame) -> DataFrame:
    """Overlays of files with neither a document nor pages nor text outside them: the last of each name, with the place of the first."""
    used = fields.filter(F.col("sf_id") == BDT).select("path").unionByName(found.filter("kind = 'page'").select("path"))
    used = used.unionByName(state.filter(F.col("owner").isNull() & F.col("cs_type").isin(TRN, DIR, DBR)).select("path")).distinct()
    own = joined(found.filter("kind = 'overlay' AND name <> ''"), used, "path", "left_anti")
    first = own.groupBy("path", "name").agg(F.min("closed").alias("first"), F.max("closed").alias("closed"))
    return joined(own.drop("page_idx"), first, ["path", "name", "closed"])


def _capped(items: DataFrame) -> DataFrame:
    """The first items of each page, and whether there are more of them."""
    w = Window.partitionBy("path", "owner").orderBy("item")
    rows = items.withColumn("item_seq", F.row_number().over(w))
    return rows.withColumn("more", F.max("item_seq").over(Window.partitionBy("path", "owner")) > MOST_RUNS).filter(F.col("item_seq") <= MOST_RUNS)


FLOW = "path string, field_seq int, cs_seq int, i int, b int"


def _flowed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pens before each control of a file's text outside all pages, where runs wrap at the width."""
    rows = rows.sort_values(["field_seq", "cs_seq"])
    i, b, out = 240, 320, []
    wrap = int(rows["width"].iloc[0]) - 480
    for kind, value, margin, step, size, length, advance in zip(rows["cs_type"], rows["v"], rows["margin"], rows["increment"], rows["size"], rows["length"], rows["advance"]):
        if kind == TRN and i > 0 and i + length * size * ADVANCE > wrap:
            i, b = 240, b + int(size * 1.4)
        out.append((i, b))
        given = value == value
        if kind == AMI and given:
            i = int(value)
        elif kind == RMI and given:
            i += int(value)
        elif kind == AMB and given:
            b = int(value)
        elif kind == RMB and given:
            b += int(value)
        elif kind == BLN:
            i, b = margin, b + step
        elif kind == STO and given:
            i = b = 0
        elif kind == TRN:
            i += int(advance)
    pens = pd.DataFrame(out, columns=["i", "b"], index=rows.index)
    return pd.DataFrame({"path": key[0], "field_seq": rows["field_seq"], "cs_seq": rows["cs_seq"], "i": pens["i"], "b": pens["b"]})


def implicit_pens(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds i and b to controls outside all pages. Each file's are folded in one task, as each line's place hangs on those before."""
    first = rows.groupBy("path").agg(F.min("field_seq").alias("from"))
    size = with_owner(fields.filter(F.col("sf_id").isin(BPG, EPG, BMO, EMO, PGD))).filter((F.col("sf_id") == PGD) & F.col("owner").isNull() & (F.octet_length("data") >= 12))
    sizes = size.join(first, "path").filter(F.col("field_seq") < F.col("from")).groupBy("path").agg(F.max(F.struct("field_seq", unsigned(F.col("data"), 6, 3).alias("w"))).alias("s"))
    slim = rows.join(sizes, "path", "left").select(
        "path", "field_seq", "cs_seq", "cs_type", signed(F.col("params"), 0, 2).cast("double").alias("v"), "margin", "increment", "size", F.coalesce(F.length("run.text"), F.lit(0)).alias("length"),
        F.coalesce("advance", F.lit(0)).alias("advance"), F.coalesce("s.w", F.lit(WIDTH)).alias("width"),
    )
    return rows.join(slim.groupBy("path").applyInPandas(_flowed, FLOW), ["path", "field_seq", "cs_seq"])


def layout(fields: DataFrame, codec: str = "cp500", faces: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, text runs, rules) of all files; runs and rules by (path, page_idx, item_seq), bracketed pages first."""
    fields = written(with_owner(fields.filter(F.col("sf_id").isin(*READ))), "fields")
    found = written(objects(fields), "objects")
    state = written(with_state(fields, codec, faces)[0], "controls")  # both kinds of text, and rules, are drawn from it
    placed_rows = with_pen(state.filter(F.col("owner").isNotNull()))
    texts, rules = placed_texts, placed_rules = _texts(placed_rows), _rules(placed_rows)
    kinds = found.select("path", "owner", "kind")
    of = lambda items, kind: joined(items, kinds.filter(F.col("kind") == kind), ["path", "owner"], "left_semi")
    on_pages, rules_on_pages = of(texts, "page"), of(rules, "page")
    if not fields.filter(F.col("sf_id") == IPO).isEmpty():
        on = written(inclusions(fields, found), "inclusions")
        of_overlays = estimated(_capped(of(texts, "overlay"))).drop("item_seq", "more")
        upi = on.select("path", "owner", "upi").distinct()
        on_pages = on_pages.unionByName(included(of_overlays.drop("upi"), on, ("font_size",)).join(upi, ["path", "owner"]))
        rules_on_pages = rules_on_pages.unionByName(included(of(rules, "overlay"), on, ("length", "thickness")))
    capped, rules = _capped(on_pages), _capped(rules_on_pages)
    texts = estimated(capped)  # of the runs that are left
    pages = found.filter("kind = 'page'")
    cut = capped.select("path", "owner", "more").unionByName(rules.select("path", "owner", "more")).groupBy("path", "owner").agg(F.max("more").alias("truncated"))
    index = pages.select("path", "owner", "page_idx")
    drop = ("owner", "item", "more", "sized", "upi")
    texts, rules = (joined(x, index, ["path", "owner"]).drop(*drop) for x in (texts, rules))
    counts = pages.groupBy("path").agg(F.count("*").alias("bracketed"))
    pages = pages.join(cut, ["path", "owner"], "left").select("path", "page_idx", "width", "height", F.col("upi").alias("units_per_inch"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.lit("bracketed").alias("kind"))
    alone = bare_overlays(fields, found, state)
    if not alone.isEmpty():
        own, own_rules = _capped(estimated(of(placed_texts, "overlay"))), _capped(of(placed_rules, "overlay"))
        told = own.select("path", "owner", "more").unionByName(own_rules.select("path", "owner", "more")).groupBy("path", "owner").agg(F.max("more").alias("truncated"))
        alone = alone.join(told, ["path", "owner"])  # those with something on them
        alone = written(alone.withColumn("page_idx", F.row_number().over(Window.partitionBy("path").orderBy("first")) - 1), "bare-overlays")
        index = alone.select("path", "owner", "page_idx")
        pages = pages.unionByName(alone.select("path", "page_idx", "width", "height", F.col("upi").alias("units_per_inch"), "truncated", F.lit("overlay").alias("kind")))
        texts, rules = (x.unionByName(y.join(index, ["path", "owner"]).drop(*drop)) for x, y in ((texts, own), (rules, own_rules)))
    outside = state.filter(F.col("owner").isNull())
    if outside.isEmpty():
        return pages, texts, rules
    loose = written(implicit_pens(outside, fields), "loose")
    flow = _paginated(estimated(_capped(_texts(loose))), _capped(_rules(loose)), fields, counts)
    return pages.unionByName(flow[0]), texts.unionByName(flow[1].drop(*drop)), rules.unionByName(flow[2].drop(*drop))


def drawn_text(fields: DataFrame, drawn: Callable[[DataFrame], DataFrame], codec: str = "cp500") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drawn bytes, their runs with places, the text they stand for) of bracketed pages, where ``drawn`` tells which runs are drawn byte by byte."""
    fields = written(with_owner(fields.filter(F.col("sf_id").isin(*READ))), "fields")
    pages = written(objects(fields), "objects").filter("kind = 'page'").select("path", "owner", "page_idx")
    state, own = with_state(fields, codec, drawn=drawn)
    swap = F.col("orientation").isin(90, 270)
    rows = with_pen(written(state.filter(F.col("owner").isNotNull()), "controls")).filter("by_glyphs").join(pages, ["path", "owner"])
    rows = rows.withColumns({"x": F.when(swap, F.col("b")).otherwise(F.col("i")), "y": F.when(swap, F.col("i")).otherwise(F.col("b"))})
    text = rows.filter("font_codec IS NOT NULL AND NOT run.blank").select("path", "page_idx", "field_seq", "cs_seq", "x", "y", F.col("run.text").alias("text"), "font_id", F.col("offset").alias("src"))
    return own, rows.select("path", "owner", "page_idx", "field_seq", "cs_seq", "x", "y", "orientation", "color"), text


def _paginated(texts: DataFrame, rules: DataFrame, fields: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text outside all pages cut into pages of the default height, after a file's bracketed pages."""
    sized = objects_default(fields)
    both = texts.select("path", "x", "y", "more").unionByName(rules.select("path", "x", "y", "more"))
    reach = both.groupBy("path").agg(F.max("x").alias("reach"), F.max("more").alias("truncated"))
    size = reach.join(sized, "path", "left").select(
        "path", F.greatest(F.coalesce("width", F.lit(WIDTH)), F.col("reach") + 6 * 240).alias("width"), F.coalesce("height", F.lit(HEIGHT)).alias("height"), F.coalesce("upi", F.lit(UPI)).alias("units_per_inch"), "truncated",
    )
    usable = F.greatest(F.lit(1), F.col("height") - 320)
    chunk = F.floor(F.col("y") / usable).cast("int")
    cut = lambda items: items.join(size.select("path", "height"), "path").withColumn("chunk", chunk).withColumn("y", F.col("y") - F.col("chunk") * usable).drop("height")
    texts, rules = cut(texts), cut(rules)
    chunks = texts.select("path", "chunk").unionByName(rules.select("path", "chunk")).distinct()
    order = Window.partitionBy("path").orderBy("chunk")
    chunks = chunks.join(counts, "path", "left").withColumn("page_idx", (F.coalesce("bracketed", F.lit(0)) + F.row_number().over(order) - 1).cast("int"))
    last = F.col("page_idx") == F.max("page_idx").over(Window.partitionBy("path"))
    pages = chunks.join(size, "path").select("path", "page_idx", "width", "height", "units_per_inch", (last & F.col("truncated")).alias("truncated"), F.lit("implicit").alias("kind"))
    index = chunks.select("path", "chunk", "page_idx")
    return pages, texts.join(index, ["path", "chunk"]).drop("chunk"), rules.join(index, ["path", "chunk"]).drop("chunk")


def objects_default(fields: DataFrame) -> DataFrame:
    """(path, width, height, upi): the page size that a file states outside pages."""
    rows = with_owner(fields.filter(F.col("sf_id").isin(BPG, EPG, BMO, EMO, PGD))).filter((F.col("sf_id") == PGD) & F.col("owner").isNull() & (F.octet_length("data") >= 12))
    d = F.col("data")
    upi = F.when(unsigned(d, 2, 2) >= 10, F.floor(unsigned(d, 2, 2) / 10)).otherwise(UPI).cast("int")
    return rows.groupBy("path").agg(F.max(F.struct("field_seq", unsigned(d, 6, 3).alias("width"), unsigned(d, 9, 3).alias("height"), upi.alias("upi"))).alias("s")).select("path", "s.width", "s.height", "s.upi")


def page_text(texts: DataFrame) -> DataFrame:
    """(path, page_idx, text): runs from top to bottom, a new line where y moves on by over 40, else a space between."""
    order = Window.partitionBy("path", "page_idx").orderBy("y", "x", "item_seq")
    before = F.lag("y").over(order)
    sep = F.when(before.isNull(), "").when(F.abs(F.col("y") - before) > 40, "\n").otherwise(" ")
    rows = texts.select("path", "page_idx", "y", "x", "item_seq", F.concat(sep, F.col("text")).alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("y", "x", "item_seq", "part")))
    return rows.groupBy("path", "page_idx").agg(F.array_join(F.transform(listed, lambda r: r["part"]), "").alias("text"))
