"""Text of print streams: codecs, names and runs."""

from __future__ import annotations

import codecs
import re
from functools import cache

from folia.functions import tables

DEFAULT_CODEC = "cp500"


@cache
def codec_of_page(number: int) -> str | None:
    """Python's codec of a code page or CCSID, if it has one."""
    if number <= 0:
        return None
    for name in (tables.CODEC_NAMES.get(number), f"cp{number}", f"cp{number:03d}"):
        try:
            if name and codecs.lookup(name):
                return name
        except LookupError:
            continue
    return None


@cache
def codec_of_name(name: str) -> str | None:
    """The codec of a code page by the digits that its name ends in, five or else four of them."""
    for n in (5, 4):
        tail = name[-n:]
        if len(tail) == n and tail.isdigit() and (codec := codec_of_page(int(tail))):
            return codec
    return None


def ebcdic(b: bytes) -> str:
    return b.decode(DEFAULT_CODEC, "replace").strip()


def wide(b: bytes) -> str | None:
    """The bytes as UTF-16BE, if at least four fifths of the high bytes are zero."""
    if len(b) < 2 or len(b) % 2 or b[::2].count(0) < len(b) // 2 * 0.8:
        return None
    try:
        return b.decode("utf-16-be")
    except UnicodeDecodeError:
        return None


def name_of(b: bytes) -> str:
    found = wide(b)
    return ebcdic(b) if found is None else found.strip()


def fixed_name(b: bytes | None) -> str | None:
    """An EBCDIC name of a fixed slot; blank and absent ones are None."""
    return None if b is None else b.decode(DEFAULT_CODEC, "replace").strip() or None


def font_name(b: bytes) -> str:
    """An EBCDIC name up to its first character that can't be printed."""
    text = b.decode(DEFAULT_CODEC, "replace")
    end = next((i for i, c in enumerate(text) if not c.isprintable()), len(text))
    return text[:end].strip()


_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def run_text(b: bytes, codec: str = DEFAULT_CODEC) -> tuple[str, int, str, int]:
    """Text of a run, characters left out of it, the codec used, and substitute characters (shown as bullets)."""
    found = wide(b)
    if found is not None:
        return found, 0, "utf-16-be", 0
    try:
        text = b.decode(codec)
    except (UnicodeDecodeError, LookupError):
        text, codec = b.decode(DEFAULT_CODEC, "replace"), DEFAULT_CODEC
    substitutes = text.count("\x1a")
    text, left_out = _CONTROLS.subn("", text.replace("\x1a", "•"))
    return text, left_out, codec, substitutes


def readable(b: bytes) -> str:
    """The bytes as EBCDIC, or as Latin-1 if more of that can be printed; white space collapsed."""
    a, c = b.decode(DEFAULT_CODEC, "replace"), b.decode("latin-1")
    better = a if sum(map(str.isprintable, a)) >= sum(map(str.isprintable, c)) else c
    return " ".join(better.split())


# Typefaces by the third character of a coded-font name, and substitutes by what a typeface's name holds.
CODED_TYPEFACES = {"H": "HELVETICA", "4": "COURIER", "N": "TIMES", "T": "TIMES", "S": "TIMES", "5": "TIMES"}
SUBSTITUTES = [
    (("COURIER", "MONO"), "Courier New, monospace", "Courier New"),
    (("TIMES", "ROMAN", "SERIF"), "Times New Roman, serif", "Times New Roman"),
    (("HELVETICA", "ARIAL", "SANS"), "Arial, sans-serif", "Arial"),
]
LABELS = {family: label for _, family, label in SUBSTITUTES}


def substitute(typeface: str) -> tuple[str, str] | None:
    """(family, weight) that stands for a typeface, if its name tells."""
    name = typeface.upper()
    for marks, family, _ in SUBSTITUTES:
        if any(m in name for m in marks):
            return family, "bold" if "BOLD" in name else "normal"
    return None


def coded_typeface(name: str) -> str:
    return CODED_TYPEFACES.get(name[2], "") if len(name) >= 3 and name.startswith("C0") else ""


def coded_points(name: str) -> float | None:
    """Points by the seventh character of a coded-font name: 0 is 10, letters go on from 11."""
    if len(name) < 7 or not name.startswith("C0"):
        return None
    c = name[6]
    return 10.0 if c == "0" else 10.0 + ord(c) - 64 if "A" <= c <= "Z" else None
