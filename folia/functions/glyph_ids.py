"""Identifiers of characters: what a glyph of an embedded font is called, whatever the code page."""

from __future__ import annotations

import codecs

# Identifiers of the Latin set's characters by their code points in code page 500.
LATIN = {
    0x40: "SP010000", 0x4A: "SM060000", 0x4B: "SP110000", 0x4C: "SA030000", 0x4D: "SP060000", 0x4E: "SA010000", 0x4F: "SP020000",
    0x50: "SM030000", 0x5A: "SM080000", 0x5B: "SC030000", 0x5C: "SM040000", 0x5D: "SP070000", 0x5E: "SP140000", 0x5F: "SD150000",
    0x60: "SP100000", 0x61: "SP120000", 0x6B: "SP080000", 0x6C: "SM020000", 0x6D: "SP090000", 0x6E: "SA050000", 0x6F: "SP150000",
    0x79: "SD130000", 0x7A: "SP130000", 0x7B: "SM010000", 0x7C: "SM050000", 0x7D: "SP050000", 0x7E: "SA040000", 0x7F: "SP040000",
    0xA1: "SD190000", 0xBB: "SM130000", 0xC0: "SM110000", 0xD0: "SM140000", 0xE0: "SM070000",
}
# Digits, zero after nine; small and capital letters are the letter with 01 and 02.
DIGITS = {"1": "ND010000", "2": "ND020000", "3": "ND030000", "4": "ND040000", "5": "ND050000", "6": "ND060000", "7": "ND070000", "8": "ND080000", "9": "ND090000", "0": "ND100000"}

_SIGNS = {bytes([code]).decode("cp500"): name for code, name in LATIN.items()}


def of_character(c: str) -> str | None:
    """The identifier of a character; those beyond the Latin set go by their Unicode number."""
    if len(c) != 1:
        return None
    if found := _SIGNS.get(c) or DIGITS.get(c):
        return found
    if c.isascii() and c.isalpha():
        return f"L{c.upper()}{'02' if c.isupper() else '01'}0000"
    return f"UNIC{ord(c):04X}" if 0 < ord(c) <= 0xFFFF else None


def of_codec(codec: str) -> list[tuple[int, str]]:
    """(code point, identifier) of every byte that a codec maps; none of an unknown codec."""
    try:
        decode = codecs.lookup(codec).decode
    except LookupError:
        return []
    found = []
    for code in range(256):
        try:
            name = of_character(decode(bytes([code]))[0])
        except UnicodeDecodeError:
            continue
        if name:
            found.append((code, name))
    return found
