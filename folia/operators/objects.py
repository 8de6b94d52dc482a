"""Objects of pages and resources: images, bar codes, drawing orders, code pages, fonts.

An object's fields are those between its Begin and its End. Brackets are last values over a
file's fields, payloads that span fields are joined in order by object, and what one object
says of another is a join by name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.functions import drawing, scans
from folia.functions import images as kernel
from folia.functions.text import font_name
from folia.operators.fields import BPG, ebcdic_text, in_file, joined
from folia.operators.layout import UPI, floor_scale, objects, signed, unsigned, with_owner

BIM, EIM, IPD, BBC, EBC, BDD, BDA, BGR, EGR, GAD, GDD = 0xD3A8FB, 0xD3A9FB, 0xD3EEFB, 0xD3A8EB, 0xD3A9EB, 0xD3A6EB, 0xD3EEEB, 0xD3A8BB, 0xD3A9BB, 0xD3EEBB, 0xD3A6BB
BOC, EOC, OCD, OBD, OBP, IOB, BRS, ERS, BPS, EPS = 0xD3A892, 0xD3A992, 0xD3EE92, 0xD3A66B, 0xD3AC6B, 0xD3AFC3, 0xD3A8CE, 0xD3A9CE, 0xD3A85F, 0xD3A95F
BCP, CPI, ECP, BFN, EFN, FNC, FND, FNI, FNM, FNG, FNN = 0xD3A887, 0xD38C87, 0xD3A987, 0xD3A889, 0xD3A989, 0xD3A789, 0xD3A689, 0xD38C89, 0xD3A289, 0xD3EE89, 0xD3AB89


def bracketed(fields: DataFrame, begin: int, end: int) -> DataFrame:
    """Fields between Begin and End, with object: the field_seq of the Begin, and the token of it."""
    event = F.when(F.col("sf_id") == begin, F.col("field_seq")).when(F.col("sf_id") == end, F.lit(-1))
    before = F.last(event, ignorenulls=True).over(Window.partitionBy("path").orderBy("field_seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = fields.withColumn("object", F.when(F.col("sf_id") == begin, F.col("field_seq")).otherwise(before))
    token = F.last(F.when(F.col("sf_id") == begin, F.substring("data", 1, 8)), ignorenulls=True).over(in_file())
    return rows.withColumn("token", token).filter(F.col("object") >= 0)


def payload(kind: int):
    """The data of an object's fields of a kind, joined in order."""
    listed = F.array_sort(F.collect_list(F.when(F.col("sf_id") == kind, F.struct("field_seq", "data"))))
    return F.aggregate(listed, F.lit(b""), lambda whole, x: F.concat(whole, x["data"]))


IMAGE = T.StructType([T.StructField(n, t) for n, t in (("mime", T.StringType()), ("data", T.BinaryType()), ("bands", T.ArrayType(T.BinaryType())), ("width", T.IntegerType()), ("height", T.IntegerType()), ("hres", T.IntegerType()))])


@F.arrow_udf(IMAGE)
def decoded_image(data: pa.Array) -> pa.Array:
    rows = []
    for d in data.to_pylist():
        found = kernel.segment(d)
        shown = kernel.displayable(found) if found else None
        planes = kernel.ink_planes(found) if found and shown is None else None
        if shown is None and planes is None:
            rows.append(None)
        else:
            mime, blob = shown or ("image/jpeg", b"")
            rows.append({"mime": mime, "data": blob, "bands": planes, "width": found["width"], "height": found["height"], "hres": found["hres"]})
    kind = pa.struct([("mime", pa.string()), ("data", pa.binary()), ("bands", pa.list_(pa.binary())), ("width", pa.int32()), ("height", pa.int32()), ("hres", pa.int32())])
    return pa.array(rows, kind)


AREA = T.StructType([T.StructField(n, T.IntegerType()) for n in ("upi", "width", "height")])


@F.arrow_udf(AREA)
def object_area(data: pa.Array) -> pa.Array:
    """Units per inch and size that a run of triplets states."""
    rows = []
    for d in data.to_pylist():
        upi, width, height = None, 0, 0
        for tid, t in scans.triplets(d or b""):
            if tid == 0x4B and len(t) >= 4:
                upi = scans.u16(t, 2) // 10 or None
            elif tid == 0x4C and len(t) >= 7:
                width, height = scans.u24(t, 1), scans.u24(t, 4)
        rows.append({"upi": upi, "width": width, "height": height})
    return pa.array(rows, pa.struct([("upi", pa.int32()), ("width", pa.int32()), ("height", pa.int32())]))


def image_objects(fields: DataFrame) -> DataFrame:
    """(path, object, closed, owner, name, resource, mime, data, bands, upi, width, height, x, y) of the image objects that can be shown."""
    kinds = (BIM, EIM, IPD, OBD, OBP, BRS, ERS, BPS, EPS, BPG, 0xD3A9AF, 0xD3A8DF, 0xD3A9DF)
    rows = with_owner(fields.filter(F.col("sf_id").isin(*kinds)))
    event = F.when(F.col("sf_id").isin(BRS, BPS), F.substring("data", 1, 8)).when(F.col("sf_id").isin(ERS, EPS), F.lit(b""))
    rows = rows.withColumn("resource", F.nullif(F.last(event, ignorenulls=True).over(in_file()), F.lit(b"")))
    last = lambda kind: F.max(F.when(F.col("sf_id") == kind, F.struct("field_seq", "data")))["data"]
    closed = F.max(F.when(F.col("sf_id") == EIM, F.struct("field_seq", "owner", "resource")))
    found = bracketed(rows, BIM, EIM).groupBy("path", "object").agg(
        F.first("token").alias("token"), closed.alias("end"), payload(IPD).alias("ipd"), last(OBD).alias("obd"), last(OBP).alias("obp"),
    ).filter(F.col("end").isNotNull())
    found = found.withColumns({"image": decoded_image("ipd"), "area": object_area("obd")}).filter(F.col("image").isNotNull())
    own = (F.col("area.width") > 0) & (F.col("area.height") > 0)
    res = F.floor(F.col("image.hres") / 10).cast("int")
    return found.select(
        "path", "object", F.col("end.field_seq").alias("closed"), F.col("end.owner").alias("owner"), ebcdic_text("token").alias("name"), ebcdic_text("end.resource").alias("resource"),
        "image.mime", "image.data", "image.bands", F.coalesce(F.nullif(F.when(own, F.col("area.upi")).otherwise(res), F.lit(0)), F.lit(UPI)).alias("upi"),
        F.when(own, F.col("area.width")).otherwise(F.col("image.width")).alias("width"), F.when(own, F.col("area.height")).otherwise(F.col("image.height")).alias("height"),
        F.coalesce(F.when(F.octet_length("obp") >= 8, signed(F.col("obp"), 2, 3)), F.lit(0)).alias("x"), F.coalesce(F.when(F.octet_length("obp") >= 8, signed(F.col("obp"), 5, 3)), F.lit(0)).alias("y"),
    ).filter((F.col("width") > 0) & (F.col("height") > 0))


@F.arrow_udf(T.StringType())
def mime_of(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else kernel.sniffed(d) for d in data.to_pylist()], pa.string())


def images(fields: DataFrame) -> DataFrame:
    """(path, page_idx, item_seq, x, y, width, height, mime, data, bands): images on pages, inline and included by name.

    An inclusion takes the object container of its name, of what has been read of it, or else the
    first image object of that name before it.
    """
    pages = objects(fields).filter("kind = 'page'").select("path", "owner", "page_idx", F.col("upi").alias("page_upi"))
    made = image_objects(fields)
    inline = made.filter(F.col("owner").isNotNull()).join(pages, ["path", "owner"])
    to = lambda c: floor_scale(F.col(c), F.col("upi"), F.col("page_upi"))
    inline = inline.select("path", "page_idx", F.col("closed").alias("item_seq"), "x", "y", to("width").alias("width"), to("height").alias("height"), "mime", "data", "bands")
    rows = with_owner(fields.filter(F.col("sf_id").isin(IOB, BPG, 0xD3A9AF, 0xD3A8DF, 0xD3A9DF)))
    d = F.col("data")
    includes = rows.filter((F.col("sf_id") == IOB) & F.col("owner").isNotNull() & (F.octet_length("data") >= 27)).join(pages, ["path", "owner"]).select(
        "path", "page_idx", "page_upi", F.col("field_seq").alias("at"), ebcdic_text(F.substring(d, 1, 8)).alias("name"), signed(d, 10, 3).alias("x"), signed(d, 13, 3).alias("y"),
        object_area(F.expr("substring(data, 28)")).alias("area"),
    )
    containers = bracketed(fields.filter(F.col("sf_id").isin(BOC, EOC, OCD)), BOC, EOC).filter(F.col("sf_id") == OCD)
    containers = containers.select("path", ebcdic_text("token").alias("name"), "field_seq", F.col("data").alias("part"))
    blobs = includes.join(containers, ["path", "name"]).filter(F.col("field_seq") < F.col("at"))
    blobs = blobs.groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("field_seq", "part"))).alias("p")).select("path", "at", F.aggregate("p", F.lit(b""), lambda w, x: F.concat(w, x["part"])).alias("blob"))
    named = made.filter(F.col("owner").isNull()).select(F.explode(F.array_distinct(F.array_compact(F.array("name", "resource")))).alias("name"), "path", "closed", F.struct("mime", "data", "bands", "upi", "width", "height").alias("own"))
    firsts = includes.select("path", "at", "name").join(named, ["path", "name"]).filter(F.col("closed") < F.col("at")).groupBy("path", "at").agg(F.min_by("own", "closed").alias("own"))
    met = includes.join(blobs, ["path", "at"], "left").join(firsts, ["path", "at"], "left").withColumn("kind", mime_of("blob"))
    stated = (F.col("area.width") > 0) & (F.col("area.height") > 0)
    take = lambda c: F.when(stated, F.col(f"area.{c}")).when(F.col("blob").isNull(), F.col(f"own.{c}"))
    met = met.withColumns({"upi": F.coalesce(take("upi"), F.col("page_upi")), "width": take("width"), "height": take("height")})
    met = met.filter(F.when(F.col("blob").isNotNull(), F.col("kind").isNotNull()).otherwise(F.col("own").isNotNull()) & (F.col("width") > 0) & (F.col("height") > 0))
    own = F.col("blob").isNull()
    met = met.select(
        "path", "page_idx", F.col("at").alias("item_seq"), "x", "y", to("width").alias("width"), to("height").alias("height"),
        F.when(own, F.col("own.mime")).otherwise(F.col("kind")).alias("mime"), F.when(own, F.col("own.data")).otherwise(F.col("blob")).alias("data"), F.when(own, F.col("own.bands")).alias("bands"),
    )
    return inline.unionByName(met)


BAR = T.StructType([T.StructField(n, T.StringType() if n == "data" else T.IntegerType()) for n in ("type", "modifier", "upi", "module_mils", "version", "ec_level", "x", "y", "data")])


@F.arrow_udf(BAR)
def bar_code(descriptor: pa.Array, data: pa.Array) -> pa.Array:
    kind = pa.struct([(n, pa.string() if n == "data" else pa.int32()) for n in BAR.fieldNames()])
    return pa.array([kernel.bar_code(a or b"", b) for a, b in zip(descriptor.to_pylist(), data.to_pylist())], kind)


def bar_codes(fields: DataFrame) -> DataFrame:
    """(path, field_seq, type, modifier, upi, module_mils, version, ec_level, x, y, data) of the symbols of bar-code objects."""
    rows = bracketed(fields.filter(F.col("sf_id").isin(BBC, EBC, BDD, BDA)), BBC, EBC)
    w = Window.partitionBy("path", "object").orderBy("field_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("bdd", F.last(F.when(F.col("sf_id") == BDD, F.col("data")), ignorenulls=True).over(w)).filter(F.col("sf_id") == BDA)
    return rows.select("path", "field_seq", bar_code("bdd", "data").alias("b")).filter("b is not null").select("path", "field_seq", "b.*")


ORDERS = T.ArrayType(T.StructType([T.StructField("code", T.IntegerType()), T.StructField("operand", T.BinaryType())]))


def _coded(scan):
    @F.arrow_udf(ORDERS)
    def rows(data: pa.Array) -> pa.Array:
        return pa.array([[{"code": c, "operand": p} for c, p in scan(d)] for d in data.to_pylist()], pa.list_(pa.struct([("code", pa.int32()), ("operand", pa.binary())])))

    return rows


def drawing_orders(fields: DataFrame) -> DataFrame:
    """(path, object, order_seq, code, operand) of graphics objects."""
    whole = bracketed(fields.filter(F.col("sf_id").isin(BGR, EGR, GAD)), BGR, EGR).groupBy("path", "object").agg(payload(GAD).alias("d"))
    return whole.select("path", "object", F.posexplode(_coded(scans.orders)("d")).alias("order_seq", "o")).select("path", "object", "order_seq", "o.*")


DRAWN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "shapes")] + [T.StructField("svg", T.StringType())])


@F.arrow_udf(DRAWN)
def drawn(descriptor: pa.Array, orders: pa.Array) -> pa.Array:
    rows = [None if d is None else drawing.drawn(d, o or b"") for d, o in zip(descriptor.to_pylist(), orders.to_pylist())]
    return pa.array(rows, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("shapes", pa.int32()), ("svg", pa.string())]))


def graphics(fields: DataFrame) -> DataFrame:
    """(path, page_idx, item_seq, x, y, width, height, window_width, window_height, shapes, svg): drawings on pages, in the page's units."""
    pages = objects(fields).filter("kind = 'page'").select("path", "owner", "page_idx", F.col("upi").alias("page_upi"))
    rows = with_owner(fields.filter(F.col("sf_id").isin(BGR, EGR, GAD, GDD, OBD, OBP, BPG, 0xD3A9AF, 0xD3A8DF, 0xD3A9DF)))
    last = lambda kind: F.max(F.when(F.col("sf_id") == kind, F.struct("field_seq", "data")))["data"]
    closed = F.max(F.when(F.col("sf_id") == EGR, F.struct("field_seq", "owner")))
    found = bracketed(rows, BGR, EGR).groupBy("path", "object").agg(closed.alias("end"), payload(GAD).alias("gad"), last(GDD).alias("gdd"), last(OBD).alias("obd"), last(OBP).alias("obp"))
    found = joined(found.filter(F.col("end.owner").isNotNull()).withColumn("owner", F.col("end.owner")), pages, ["path", "owner"])
    found = found.withColumns({"d": drawn("gdd", "gad"), "area": object_area("obd")}).filter(F.col("d").isNotNull())
    upi = F.coalesce("area.upi", "page_upi")
    place = lambda at: F.coalesce(F.when(F.octet_length("obp") >= 8, signed(F.col("obp"), at, 3)), F.lit(0))
    return found.select(
        "path", "page_idx", F.col("end.field_seq").alias("item_seq"), place(2).alias("x"), place(5).alias("y"),
        floor_scale(F.col("area.width"), upi, F.col("page_upi")).alias("width"), floor_scale(F.col("area.height"), upi, F.col("page_upi")).alias("height"),
        F.col("d.width").alias("window_width"), F.col("d.height").alias("window_height"), "d.shapes", "d.svg",
    )


def image_fields(fields: DataFrame) -> DataFrame:
    """(path, object, sdf_seq, code, operand) of image objects."""
    whole = bracketed(fields.filter(F.col("sf_id").isin(BIM, EIM, IPD)), BIM, EIM).groupBy("path", "object").agg(payload(IPD).alias("d"))
    return whole.select("path", "object", F.posexplode(_coded(scans.image_fields)("d")).alias("sdf_seq", "o")).select("path", "object", "sdf_seq", "o.*")


@F.arrow_udf(T.StringType())
def glyph_name(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else font_name(d) for d in data.to_pylist()], pa.string())


def _records(rows: DataFrame, data: str, size) -> DataFrame:
    """Adds rec_seq and rec: the records of ``size`` bytes that a column holds whole."""
    count = F.floor(F.octet_length(data) / size).cast("int")
    rows = rows.filter(count > 0).withColumn("rec_seq", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("rec", F.substring(F.col(data), F.col("rec_seq") * size + 1, size if not isinstance(size, int) else F.lit(size)))


def code_pages(fields: DataFrame) -> DataFrame:
    """(path, name, code_point, gcgid) of embedded code pages; of pages of one name the last, of a code point the last record."""
    whole = bracketed(fields.filter(F.col("sf_id").isin(BCP, ECP, CPI)), BCP, ECP).groupBy("path", "object").agg(F.first("token").alias("token"), payload(CPI).alias("d"))
    whole = whole.withColumn("name", ebcdic_text("token")).filter((F.col("name") != "") & (F.octet_length("d") > 0))
    whole = whole.withColumn("k", F.row_number().over(Window.partitionBy("path", "name").orderBy(F.desc("object")))).filter("k = 1")
    rows = _records(whole, "d", 10).select("path", "name", "rec_seq", unsigned(F.col("rec"), 9, 1).alias("code_point"), glyph_name(F.substring("rec", 1, 8)).alias("gcgid"))
    rows = rows.filter(F.col("gcgid").rlike(r"^\p{L}"))
    return rows.groupBy("path", "name", "code_point").agg(F.max_by("gcgid", "rec_seq").alias("gcgid"))


def fonts(fields: DataFrame) -> DataFrame:
    """(path, object, name, typeface, technology, record_size, alignment, resolution, point_size, fni, fnm, fng, fnn) of embedded character sets."""
    rows = bracketed(fields.filter(F.col("sf_id").isin(BFN, EFN, FNC, FND, FNI, FNM, FNG, FNN)), BFN, EFN)
    last = lambda kind: F.max(F.when(F.col("sf_id") == kind, F.struct("field_seq", "data")))["data"]
    found = rows.groupBy("path", "object").agg(F.first("token").alias("token"), last(FNC).alias("fnc"), last(FND).alias("fnd"), *[payload(k).alias(n) for k, n in ((FNI, "fni"), (FNM, "fnm"), (FNG, "fng"), (FNN, "fnn"))])
    return found.select(
        "path", "object", ebcdic_text("token").alias("name"), F.trim(F.substring_index(glyph_name(F.when(F.octet_length("fnd") >= 32, F.substring("fnd", 1, 32))), "@", 1)).alias("typeface"), unsigned(F.col("fnc"), 1, 1).alias("technology"),
        F.coalesce(unsigned(F.col("fnc"), 15, 1), F.lit(28)).alias("record_size"), unsigned(F.col("fnc"), 16, 1).alias("alignment"),
        F.coalesce(F.floor(unsigned(F.col("fnc"), 24, 2) / 10).cast("int"), F.lit(0)).alias("resolution"), F.coalesce(unsigned(F.col("fnd"), 34, 2) / 10, F.lit(0.0)).alias("point_size"), "fni", "fnm", "fng", "fnn",
    )


def font_characters(found: DataFrame, *more: str) -> DataFrame:
    """(path, object, rec_seq, gcgid, char_increment, baseline_offset, pattern) of a font's index, after those columns that the font has ``more``."""
    rows = _records(found.filter("record_size >= 10"), "fni", F.col("record_size"))
    r = F.col("rec")
    return rows.select(*more, "path", "object", "rec_seq", glyph_name(F.substring("rec", 1, 8)).alias("gcgid"), unsigned(r, 8, 2).alias("char_increment"), signed(r, 12, 2).alias("baseline_offset"), unsigned(r, 16, 2).alias("pattern"))


#: Bytes of a pattern, and patterns of a font, at most.
MOST_PATTERN, MOST_GLYPHS = 1 << 20, 1024


def font_glyphs(found: DataFrame) -> DataFrame:
    """(path, object, pattern, gcgid, width, height, char_increment, baseline_offset, bits) of raster fonts: patterns joined with the first index record of each."""
    boxes = _records(found.filter("technology = 5"), "fnm", 8)
    r = F.col("rec")
    unit = F.when(F.col("alignment") == 2, 4).when(F.col("alignment") == 3, 8).otherwise(1)
    width, height = unsigned(r, 0, 2) + 1, unsigned(r, 2, 2) + 1
    row = F.floor((width + 7) / 8).cast("int")
    start = F.conv(F.hex(F.substring("rec", 5, 4)), 16, 10).cast("long") * unit
    boxes = boxes.select("path", "object", F.col("rec_seq").alias("pattern"), width.alias("width"), height.alias("height"), F.substring(F.col("fng"), (start + 1).cast("int"), row * height).alias("bits"), (row * height).alias("need"))
    boxes = boxes.filter((F.col("need") <= MOST_PATTERN) & (F.col("pattern") < MOST_GLYPHS)).drop("need")  # patterns may be cut short
    firsts = font_characters(found).filter("pattern is not null").groupBy("path", "object", "pattern").agg(F.min_by(F.struct("gcgid", "char_increment", "baseline_offset"), "rec_seq").alias("c"))
    return boxes.join(firsts, ["path", "object", "pattern"], "left").select("path", "object", "pattern", F.coalesce("c.gcgid", F.lit("")).alias("gcgid"), "width", "height", F.coalesce("c.char_increment", F.lit(0)).alias("char_increment"), F.coalesce("c.baseline_offset", F.lit(0)).alias("baseline_offset"), "bits")


def typefaces(fields: DataFrame) -> DataFrame:
    """(path, name, typeface) of embedded character sets, for the layout's substitutes."""
    return fonts(fields).filter("name != '' AND typeface != ''").select("path", "name", "typeface").dropDuplicates(["path", "name"])
