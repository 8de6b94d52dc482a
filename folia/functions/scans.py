"""Scans of the byte grammars: records, triplets, control sequences, drawing orders, image fields.

Each scan walks bytes that state their own lengths, so it can't be cut into pieces or put as
column expressions; all of them are plain functions of bytes, run in Arrow batches.
"""

from __future__ import annotations

from folia.functions import tables

Field = tuple[int, int, int, int, bytes]  # offset, id, flags, sequence, data


class FramingError(ValueError):
    """A stream that isn't framed as structured fields, with the offset where that shows."""

    def __init__(self, offset: int, message: str):
        super().__init__(f"{message} at offset {offset}")
        self.offset = offset


def u16(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def u24(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 3], "big")


def s16(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 2], "big", signed=True)


def s24(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 3], "big", signed=True)


def fields(stream: bytes) -> list[Field]:
    """All structured fields of a stream; one wrong record fails it as a whole."""
    out, at, end = [], 0, len(stream)
    while at < end:
        if stream[at] != 0x5A:
            raise FramingError(at, f"expected carriage control X'5A', found X'{stream[at]:02X}'")
        if end - at < 9:
            raise FramingError(at, "truncated structured field")
        size = u16(stream, at + 1)
        if size < 8 or at + 1 + size > end:
            raise FramingError(at, f"bad structured field length {size}")
        out.append((at, u24(stream, at + 3), stream[at + 6], u16(stream, at + 7), stream[at + 9 : at + 1 + size]))
        at += 1 + size
    return out


def triplets(data: bytes) -> list[tuple[int, bytes]]:
    """(id, data) of a run of triplets up to the first bad one."""
    out, at = [], 0
    while at + 2 <= len(data):
        size = data[at]
        if size < 2 or at + size > len(data):
            break
        out.append((data[at + 1], data[at + 2 : at + size]))
        at += size
    return out


def tiling_triplets(data: bytes) -> list[tuple[int, bytes]] | None:
    """Triplets that fill the bytes to the last one, or None."""
    out = triplets(data)
    return out if out and sum(len(t) + 2 for _, t in out) == len(data) else None


def groups(data: bytes) -> tuple[list[bytes], bool]:
    """Bodies of repeating groups that state their own length, and whether they fill the bytes."""
    out, at = [], 0
    while at + 2 <= len(data):
        size = u16(data, at)
        if size < 2 or at + size > len(data):
            return out, False
        out.append(data[at + 2 : at + size])
        at += size
    return out, at == len(data)


# Fields of repeating groups, and offsets of the triplets of fields with a fixed prefix, in order of trial.
GROUPED = frozenset((0xD3AB8A, 0xD3ABC3, 0xD3ABAF, 0xD3ABD8, 0xD3ABEB))
PREFIXES = {
    0xD3A090: (0,), 0xD3A66B: (0,), 0xD3ABCC: (8,), 0xD3AFC3: (27,), 0xD3AF5F: (14,), 0xD3AFD8: (14,), 0xD3A6AF: (15, 14), 0xD3A688: (13,), 0xD3B19B: (14, 12),
}


def field_triplets(sf_id: int, data: bytes) -> list[tuple[int | None, int, bytes]]:
    """(group or None, id, data) of a field's triplets; none if they don't fit its bytes."""
    if sf_id in GROUPED:
        bodies, whole = groups(data)
        runs = [tiling_triplets(body) for body in bodies]
        if not whole or any(run is None for run in runs):
            return []
        return [(k, *t) for k, run in enumerate(runs) for t in run]
    offsets = PREFIXES.get(sf_id)
    if offsets is None:
        if sf_id >> 8 & 0xFF not in (0xA8, 0xA9):
            return []
        offsets = (8, 10, 2) if data[:2] == b"\xff\xff" else (8, 10)
    for at in offsets:
        if run := tiling_triplets(data[at:]):
            return [(None, *t) for t in run]
    return []


def font_maps(data: bytes) -> list[tuple[int, bytes | None, bytes | None, bytes | None, bytes]]:
    """(local id, coded font, code page, character set, bytes) of the fixed groups of a coded-font map, format 1; absent names are None."""
    if len(data) < 4 or data[0] < 28 or (len(data) - 4) % data[0]:
        return []
    out = []
    for at in range(4, len(data), data[0]):
        body = data[at : at + data[0]]
        names = [None if (x := body[k : k + 8]) == b"\xff" * 8 else x for k in (4, 12, 20)]
        out.append((body[0], *names, body))
    return out


def control_sequences(data: bytes) -> list[tuple[int, bytes]]:
    """(even type, parameters) of a field's text controls, up to the first bad length."""
    out, at, chained = [], 0, False
    while at < len(data):
        if not chained:
            at = data.find(b"\x2b\xd3", at) + 2
            if at < 2:
                break
        if at + 2 > len(data) or data[at] < 2 or at + data[at] > len(data):
            break
        kind = data[at + 1]
        out.append((kind & 0xFE, data[at + 2 : at + data[at]]))
        at += data[at]
        chained = bool(kind & 1)
    return out


def image_fields(data: bytes) -> list[tuple[int, bytes]]:
    """(code, data) of the self-defining fields of an image segment; extended codes as X'FEcc'."""
    out, at = [], 0
    while at + 2 <= len(data):
        code = data[at]
        if code == 0xFE:
            if at + 4 > len(data):
                break
            code, size, at = 0xFE00 | data[at + 1], u16(data, at + 2), at + 4
            if size == 0 and code in (0xFE92, 0xFE9C):
                size = len(data) - at
        else:
            size, at = data[at + 1], at + 2
        if at + size > len(data):
            break
        out.append((code, data[at : at + size]))
        at += size
    return out


def orders(data: bytes) -> list[tuple[int, bytes]]:
    """(code, operand) of the drawing orders of the chained segments of a graphics object."""
    out, at = [], 0
    while at < len(data):
        if data[at] != 0x70:
            at += 1
            continue
        if at + 14 > len(data):
            break
        chained, size = not data[at + 7] & 0x80, u16(data, at + 8)
        at += 14
        body = data[at : at + size]
        at += size
        if chained:
            out += segment_orders(body)
    return out


def segment_orders(body: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(body):
        code = body[at]
        if code == 0xFE:  # extended: code of two bytes, length of two
            if at + 4 > len(body):
                break
            code, head, size = 0xFE00 | body[at + 1], 4, u16(body, at + 2)
        elif code == 0x00:
            head, size = 1, 0
        elif code == 0x71 or code & 0x88 == 0x08:  # one operand byte
            head, size = 1, 1
        else:
            if at + 2 > len(body):
                break
            head, size = 2, body[at + 1]
        if at + head + size > len(body):
            break
        out.append((code, body[at + head : at + head + size]))
        at += head + size
    return out


def resource_names(sf_id: int, data: bytes) -> list[tuple[str, bytes]]:
    """(kind, name bytes) that a coded-font map refers to, kinds being coded font, code page and character set."""
    if sf_id == 0xD3B18A:
        return [(kind, name) for _, *names, _ in font_maps(data) for kind, name in zip(("coded font", "code page", "character set"), names) if name is not None]
    kinds = {0x85: "code page", 0x86: "character set", 0x8E: "coded font"}
    return [(kinds[t[0]], t[2:]) for body in groups(data)[0] for tid, t in triplets(body) if tid == 2 and len(t) >= 3 and t[0] in kinds]


def type_name(sf_id: int) -> str:
    return tables.FIELDS.get(sf_id) or f"Unknown (0x{sf_id:06X})"
