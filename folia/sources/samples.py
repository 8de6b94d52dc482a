"""Sample streams, one for each kind of content, made when they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.sources import writer as w


def _text() -> bytes:
    lines = [(0xC6, w.s16(720)), (0xD2, w.s16(720)), *w.runs("A sample page"), (0xD4, w.s16(300)), (0xC6, w.s16(720)), *w.runs("with two lines and a rule"), (0xE4, w.s16(1440) + w.s16(20))]
    return w.document(w.page(w.page_descriptor(12240, 15840), w.text_field(*lines)))


def _overlay() -> bytes:
    form = w.record(0xD3A8DF, w.name8("FORM")) + w.text_field((0xC6, w.s16(100)), (0xD2, w.s16(200)), *w.runs("Letterhead")) + w.record(0xD3A9DF, w.name8("FORM"))
    return w.document(form, *[w.page(w.record(0xD3AFD8, w.name8("FORM") + w.s24(0) + w.s24(0)), w.text_field((0xC6, w.s16(100)), (0xD2, w.s16(900)), *w.runs(f"Page {k}"))) for k in (1, 2)])


def _drawing() -> bytes:
    orders = b"\x0a\x02\xc0\x0a" + bytes(2) + w.s16(100) + w.s16(100) + w.s16(900) + w.s16(700) + b"\xc7\x06" + w.s16(500) + w.s16(400) + b"\x64\0"
    return w.document(w.page(w.page_descriptor(12240, 15840), w.graphics(1000, 800, orders, (720, 720, 1440, 1152))))


def _image() -> bytes:
    return w.document(w.page(w.page_descriptor(12240, 15840), w.bilevel_image(16, 8, b"\xaa\x55" * 8, (720, 720, 1440, 720))))


def _bar_code() -> bytes:
    return w.document(w.page(w.page_descriptor(12240, 15840), w.qr_code("SAMPLE 12345", 720, 720)))


def _font() -> bytes:
    return w.raster_font("C0SAMPLE", "SAMPLE", [("LA020000", 8, 8, b"\x18\x24\x42\x42\x7e\x42\x42\x42"), ("LB020000", 8, 8, b"\x7c\x42\x42\x7c\x42\x42\x42\x7c")])


SAMPLES = {"text.afp": _text, "overlay.afp": _overlay, "drawing.afp": _drawing, "image.afp": _image, "bar-code.afp": _bar_code, "font.afp": _font}


def samples(spark: SparkSession, *names: str) -> DataFrame:
    """(path, content) of the samples named, or of all; an unknown name is an error."""
    if unknown := set(names) - set(SAMPLES):
        raise ValueError(f"no such sample: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([(n, SAMPLES[n]()) for n in names or SAMPLES], "path string, content binary")
