import pytest

from folia.functions import describe, scans, text
from folia.sources import writer as w


def test_framing():
    assert scans.fields(b"") == []
    name = bytes.fromhex("c4d6c3f0f0f0f0f1")
    (offset, sf_id, flags, sequence, data), = scans.fields(bytes.fromhex("5a0010d3a8a8000000") + name)
    assert (offset, sf_id, flags, sequence, data) == (0, 0xD3A8A8, 0, 0, name)
    assert scans.type_name(sf_id) == "BDT (Begin Document)" and text.ebcdic(data) == "DOC00001"
    assert scans.type_name(0xD3FFFF) == "Unknown (0xD3FFFF)"


@pytest.mark.parametrize("stream", [b"\n\n<!doctype html>", bytes.fromhex("5a0010d3a8"), bytes.fromhex("5a0004d3a8a8000000"), bytes.fromhex("5a0040d3a8a8000000")])
def test_framing_errors(stream):
    with pytest.raises(scans.FramingError):
        scans.fields(stream)


@pytest.mark.parametrize("data, kinds", [("2bd304c7006404d300c804dac1c2", [0xC6, 0xD2, 0xDA]), ("2bd304dac1c204c70064", [0xDA]), ("2bd3ff", []), ("", [])])
def test_control_sequences(data, kinds):
    assert [k for k, _ in scans.control_sequences(bytes.fromhex(data))] == kinds


def test_image_fields():
    assert scans.image_fields(bytes.fromhex("9101fffe92000361626393 00")) == [(0x91, b"\xff"), (0xFE92, b"abc"), (0x93, b"")]
    assert scans.image_fields(bytes.fromhex("fe920000") + b"rest") == [(0xFE92, b"rest")]


def test_orders():
    head = lambda size, flag=0: b"\x70\x0c" + bytes(4) + bytes([0, flag]) + size.to_bytes(2, "big") + bytes(4)
    body = bytes.fromhex("0a02 c10400010002 00 fedc0001ff")
    assert scans.orders(head(len(body)) + body) == [(0x0A, b"\x02"), (0xC1, bytes.fromhex("00010002")), (0x00, b""), (0xFEDC, b"\xff")]
    assert scans.orders(head(len(body), 0x80) + body) == []


def test_triplets_fill_their_place():
    assert scans.field_triplets(0xD3A8A8, w.name8("DOC") + bytes.fromhex("00060601ffff01f4")) == [(None, 1, bytes.fromhex("ffff01f4"))]
    group = w.group(w.triplet(0x24, b"\x05\x01"))
    assert scans.field_triplets(0xD3AB8A, group) == [(0, 0x24, b"\x05\x01")]
    assert scans.field_triplets(0xD3AB8A, group + b"\0") == []


@pytest.mark.parametrize("tid, data, said", [
    (0x01, "000001f4", "CCSID 500 → cp500"), (0x26, "2d00", "90°"), (0x8B, "000000b4", "9 pt"), (0x4C, "02000320000140", "800 × 320"), (0x25, "07", "section 7"),
    (0x24, "0503", "coded font, local id 3"), (0x68, "01", "landscape"), (0x57, "00000010", "16 bytes"), (0x4B, "000038403840", "14400 × 14400 units per 10 in"), (0x99, "00", ""),
])
def test_triplet_descriptions(tid, data, said):
    assert describe.triplet(tid, bytes.fromhex(data)) == said


def test_date_stamp():
    assert describe.triplet(0x62, b"\0" + "02415001020304"[:14].encode("cp500")) == "created 1924 day 150, 01:02:03"


@pytest.mark.parametrize("name, codec", [("T1V10500", "cp500"), ("T1001140", "cp1140"), ("T1AAAAAA", None), ("T1EX0000", None)])
def test_codec_of_name(name, codec):
    assert text.codec_of_name(name) == codec


@pytest.mark.parametrize("name, points", [("C0H200B0", 12), ("C0H200F0", 16), ("C0H200H0", 18), ("C0H20000", 10), ("C0H400D0", 14), ("Arial", None)])
def test_points_of_name(name, points):
    assert text.coded_points(name) == points


def test_run_text():
    assert text.run_text("Hällö".encode("cp273"), "cp273")[0] == "Hällö"
    assert text.run_text("Wide".encode("utf-16-be")) == ("Wide", 0, "utf-16-be", 0)
    assert text.run_text(bytes.fromhex("3f403f403f403f40"))[3] == 4
    assert text.run_text(b"\xc1\x00\xc2") == ("AB", 1, "cp500", 0)


def test_search_text_and_summary():
    tag = w.triplet(0x02, b"\x0b\x00" + "CustomerID".encode("cp500")) + w.triplet(0x36, b"\0\0" + "12345".encode("cp500"))
    assert describe.search_text(0xD3A090, tag) == "CustomerID 12345"
    size = w.page_descriptor(1000, 2000)[9:]
    assert describe.summary(0xD3A6AF, size, None) == "page 1000×2000 L-units · 1440 units/inch"
    assert describe.page_size(bytes(2) + b"\0\5" * 2 + bytes(6)) == (0, 0, 1440)
