"""Writing print streams: bytes of records from their values, for tests and for exports of tables."""

from __future__ import annotations


def record(sf_id: int, data: bytes = b"", flags: int = 0, sequence: int = 0) -> bytes:
    return b"\x5a" + (8 + len(data)).to_bytes(2, "big") + sf_id.to_bytes(3, "big") + bytes([flags]) + sequence.to_bytes(2, "big") + data


def name8(name: str) -> bytes:
    return name.ljust(8)[:8].encode("cp500")


def triplet(tid: int, data: bytes) -> bytes:
    return bytes([len(data) + 2, tid]) + data


def group(*triplets: bytes) -> bytes:
    body = b"".join(triplets)
    return (len(body) + 2).to_bytes(2, "big") + body


def s16(v: int) -> bytes:
    return v.to_bytes(2, "big", signed=True)


def s24(v: int) -> bytes:
    return v.to_bytes(3, "big", signed=True)


def controls(*sequences: tuple[int, bytes]) -> bytes:
    """Text controls as one chain."""
    out, last = b"\x2b\xd3", len(sequences) - 1
    for k, (kind, params) in enumerate(sequences):
        out += bytes([len(params) + 2, kind | (k < last)]) + params
    return out


def page_descriptor(width: int, height: int, units: int = 14400) -> bytes:
    return record(0xD3A6AF, bytes(2) + units.to_bytes(2, "big") * 2 + width.to_bytes(3, "big") + height.to_bytes(3, "big") + bytes(3))


def page(*body: bytes, name: str = "PAGE") -> bytes:
    return record(0xD3A8AF, name8(name)) + b"".join(body) + record(0xD3A9AF, name8(name))


def document(*body: bytes, name: str = "DOC") -> bytes:
    return record(0xD3A8A8, name8(name)) + b"".join(body) + record(0xD3A9A8, name8(name))


def text_field(*sequences: tuple[int, bytes]) -> bytes:
    return record(0xD3EE9B, controls(*sequences))


def runs(text: str) -> list[tuple[int, bytes]]:
    """A text as transparent-data controls in UTF-16BE, 126 characters each, none cut within a pair of surrogates."""
    raw = text.encode("utf-16-be")
    out, at = [], 0
    while at < len(raw):
        end = min(at + 252, len(raw))
        if end < len(raw) and 0xD8 <= raw[end - 2] <= 0xDB:
            end -= 2
        out.append((0xDA, raw[at:end]))
        at = end
    return out


def font_map(local: int, code_page: str, chars: str) -> bytes:
    """A group of a coded-font map, format 2."""
    return group(
        triplet(0x02, b"\x85\x00" + name8(code_page)), triplet(0x02, b"\x86\x00" + name8(chars)), triplet(0x24, bytes([5, local])),
    )


def object_area(width: int, height: int, units: int = 14400) -> bytes:
    return record(0xD3A66B, triplet(0x4B, bytes(2) + units.to_bytes(2, "big") * 2) + triplet(0x4C, b"\0" + width.to_bytes(3, "big") + height.to_bytes(3, "big")))


def object_position(x: int, y: int) -> bytes:
    return record(0xD3AC6B, b"\x01\x17" + s24(x) + s24(y) + bytes(15))


def graphics(width: int, height: int, orders: bytes, place: tuple[int, int, int, int]) -> bytes:
    """A graphics object of one segment; place: x, y and extent on the page."""
    window = bytes(4) + (1000).to_bytes(2, "big") * 2 + bytes(2) + s16(0) + s16(width) + s16(0) + s16(height)
    segment = b"\x70\x0c" + bytes(6) + len(orders).to_bytes(2, "big") + bytes(4) + orders
    body = object_area(*place[2:]) + object_position(*place[:2]) + record(0xD3A6BB, bytes([0xF6, len(window)]) + window) + record(0xD3EEBB, segment)
    return record(0xD3A8BB, bytes(8)) + body + record(0xD3A9BB, bytes(8))


def bilevel_image(width: int, height: int, bits: bytes, place: tuple[int, int, int, int], name: str = "IMAGE") -> bytes:
    """An image object of one bit a pel."""
    size = b"\x94\x09\0" + (3000).to_bytes(2, "big") * 2 + width.to_bytes(2, "big") + height.to_bytes(2, "big")
    segment = b"\x70\0\x91\x01\xff" + size + b"\x95\x02\x03\x01\xfe\x92" + len(bits).to_bytes(2, "big") + bits + b"\x93\0\x71\0"
    return record(0xD3A8FB, name8(name)) + object_area(*place[2:]) + object_position(*place[:2]) + record(0xD3EEFB, segment) + record(0xD3A9FB, name8(name))


def qr_code(text: str, x: int, y: int, module_mils: int = 20) -> bytes:
    """A bar-code object with one QR symbol of ASCII text."""
    descriptor = bytes(2) + (14400).to_bytes(2, "big") * 2 + bytes(6) + b"\x20\x02" + bytes(3) + bytes([module_mils])
    data = b"\0" + x.to_bytes(2, "big") + y.to_bytes(2, "big") + bytes(9) + text.encode("ascii")
    return record(0xD3A8EB, bytes(8)) + record(0xD3A6EB, descriptor) + record(0xD3EEEB, data) + record(0xD3A9EB, bytes(8))


def raster_font(name: str, typeface: str, glyphs: list[tuple[str, int, int, bytes]]) -> bytes:
    """A character set of (identifier, width, height, bits) with increments as wide as the glyphs."""
    index, boxes, patterns = b"", b"", b""
    for k, (gcgid, width, height, bits) in enumerate(glyphs):
        index += name8(gcgid) + width.to_bytes(2, "big") + bytes(6) + k.to_bytes(2, "big") + bytes(10)
        boxes += (width - 1).to_bytes(2, "big") + (height - 1).to_bytes(2, "big") + len(patterns).to_bytes(4, "big")
        patterns += bits
    control = b"\x01\x05" + bytes(13) + b"\x1c" + bytes(12)
    body = ((0xD3A789, control), (0xD3A689, typeface.ljust(32).encode("cp500") + bytes(10)), (0xD38C89, index), (0xD3A289, boxes), (0xD3EE89, patterns))
    return record(0xD3A889, name8(name)) + b"".join(record(kind, data) for kind, data in body) + record(0xD3A989, name8(name))
