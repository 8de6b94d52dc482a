"""Functions for SQL: scalar ones by name, and table functions for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folia.functions import scans
from folia.operators import fields as ops
from folia.operators import layout, objects


class _Fields:
    def eval(self, content: bytes):
        try:
            yield from ((k, offset, sf_id, flags, sequence, data) for k, (offset, sf_id, flags, sequence, data) in enumerate(scans.fields(content or b"")))
        except scans.FramingError:
            return


class _Triplets:
    def eval(self, sf_id: int, data: bytes):
        yield from scans.field_triplets(sf_id, data or b"")


class _Controls:
    def eval(self, data: bytes):
        yield from scans.control_sequences(data or b"")


class _Orders:
    def eval(self, data: bytes):
        yield from scans.orders(data or b"")


class _ImageFields:
    def eval(self, data: bytes):
        yield from scans.image_fields(data or b"")


def register(spark: SparkSession) -> None:
    pair = "code int, operand binary"
    for name, handler, kind in (
        ("afp_fields", _Fields, "field_seq int, offset long, sf_id int, flags int, sequence int, data binary"), ("afp_triplets", _Triplets, "group_idx int, tid int, tdata binary"),
        ("ptoca_sequences", _Controls, "cs_type int, params binary"), ("goca_orders", _Orders, pair), ("ioca_sdfs", _ImageFields, pair),
    ):
        spark.udtf.register(name, udtf(handler, returnType=kind))
    for name, function in (("ebcdic", ops.ebcdic_text), ("trn_text", layout.decoded), ("afp_search_text", ops.search_text), ("codec_by_name", ops.codec_by_name), ("image_blob", objects.decoded_image)):
        spark.udf.register(name, function)
