"""Images: segments of image fields, PNG, bar codes."""

from __future__ import annotations

import struct
import zlib

from folia.functions import scans
from folia.functions.scans import u16

JPEG, PLAIN = 0x83, 0x03
START_OF_JPEG = b"\xff\xd8"


def segment(data: bytes) -> dict | None:
    """Size, resolution, coding, bits and bytes of an image segment; None if it holds no image field."""
    out = {"width": 0, "height": 0, "hres": 0, "vres": 0, "compression": PLAIN, "bits": 1, "data": b"", "bands": {}}
    known = False
    for code, p in scans.image_fields(data):
        if code == 0x94 and len(p) >= 9:
            out |= {"hres": u16(p, 1), "vres": u16(p, 3), "width": u16(p, 5), "height": u16(p, 7)}
        elif code == 0x95 and p:
            out["compression"] = p[0]
        elif code == 0x96 and p:
            out["bits"] = p[0]
            continue
        elif code == 0xFE92:
            out["data"] += p
        elif code == 0xFE9C and len(p) >= 3:
            out["bands"][p[0]] = out["bands"].get(p[0], b"") + p[3:]
        else:
            continue
        known = True
    if not known:
        return None
    if not out["data"] and len(out["bands"]) == 1:
        out["data"] = next(iter(out["bands"].values()))
    return out


def png(width: int, height: int, depth: int, color: int, row_bytes: int, pixels: bytes) -> bytes:
    """Scan lines as a PNG without filters; color 0 is gray, 2 is RGB."""
    lines = b"".join(b"\0" + pixels[k * row_bytes : (k + 1) * row_bytes] for k in range(height))
    out = b"\x89PNG\r\n\x1a\n"
    for tag, body in ((b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return out


def displayable(image: dict) -> tuple[str, bytes] | None:
    """(mime, bytes) of an image that browsers show, or None for other codings and for too few bytes."""
    data, width, height, bits = image["data"], image["width"], image["height"], image["bits"]
    if image["compression"] == JPEG:
        at = data.find(START_OF_JPEG)
        return ("image/jpeg", data[at:]) if at >= 0 else None
    if image["compression"] != PLAIN or bits not in (1, 8, 24) or width <= 0 or height <= 0:
        return None
    row = (width * bits + 7) // 8
    if not data or len(data) < row * height:
        return None
    if bits == 1:  # a set bit is a mark here, and white there
        data = data.translate(bytes(255 - k for k in range(256)))
    return "image/png", png(width, height, min(bits, 8), 2 if bits == 24 else 0, row, data)


def ink_planes(image: dict) -> list[bytes] | None:
    """JPEGs of the four inks, if the image is just that."""
    bands = image["bands"]
    if image["compression"] != JPEG or sorted(bands) != [1, 2, 3, 4] or not all(b.startswith(START_OF_JPEG) for b in bands.values()):
        return None
    return [bands[k] for k in (1, 2, 3, 4)]


def sniffed(data: bytes) -> str | None:
    for magic, mime in ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG", "image/png"), (b"GIF8", "image/gif")):
        if data.startswith(magic):
            return mime
    return None


def bar_code(descriptor: bytes, data: bytes) -> dict | None:
    """Kind, place and content of a bar-code symbol; None if suppressed or cut short."""
    if len(descriptor) < 18 or len(data) < 5 or data[0] & 0x04:
        return None
    units = u16(descriptor, 2)
    upi = round(units * 2.54 / 10) if descriptor[0] == 1 else units // 10
    module = descriptor[17]
    kind, payload, codec, version, level = descriptor[12], data[5:], "ascii", 0, 0
    # Two-dimensional kinds put their own parameters before the data.
    start = {0x20: 14, 0x1C: 15}.get(kind, 5)
    if start > 5 and len(data) >= start:
        payload, codec = data[start:], "cp500" if data[5] & 0x80 else "ascii"
        if kind == 0x20:
            version, level = data[7] if data[7] <= 40 else 0, data[8] if data[8] <= 3 else 0
    try:
        text = payload.decode(codec)
    except UnicodeDecodeError:
        text = payload.decode("latin-1")
    return {
        "type": kind, "modifier": descriptor[13], "upi": upi or 1440, "module_mils": 13 if module in (0, 255) else module, "version": version, "ec_level": level,
        "x": u16(data, 1), "y": u16(data, 3), "data": text,
    }
