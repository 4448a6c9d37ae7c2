import struct

import pytest

from loomwork.operators import heic as H
from tests.test_containers import cleaned, tiff


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def infe(item, kind, content=b""):
    return box(b"infe", struct.pack(">IHH4s", 2 << 24, item, 0, kind) + b"\0" + content)


def heic(version=1, base=False, wide=False, extra=b"", primary=1, overlap=False, brand=b"heic"):
    """Picture 1, Exif 2 between the picture's two extents, XMP 3, picture 4."""
    exif, xmp = b"\0\0\0\0" + tiff("MM", 6), b"<x:xmpmeta/>"
    parts = [b"PICTURE", exif, b"REST", xmp, b"THUMB"]
    ftyp = box(b"ftyp", brand + b"\0\0\0\0mif1")

    def build(at):
        places = []
        for p in parts:
            places.append((at, len(p)))
            at += len(p)
        start = places[0][0] if base else 0
        held = {1: [places[0], places[2]], 2: [places[1]], 3: [places[3]], 4: [places[4]]}
        if overlap:
            held[4] = [(places[3][0] + 1, 5)]
        rows = b""
        for item, extents in held.items():
            rows += struct.pack(">H", item) + (b"\0\0" if version else b"") + b"\0\0" + (struct.pack(">I", start) if base else b"") + struct.pack(">H", len(extents))
            rows += b"".join(struct.pack(">II", x - start, n) for x, n in extents)
        iloc = box(b"iloc", bytes([version, 0, 0, 0, 0x44, 0x40 if base else 0]) + struct.pack(">H", 4) + rows)
        iinf = box(b"iinf", struct.pack(">IH", 0, 4) + infe(1, b"hvc1") + infe(2, b"Exif") + infe(3, b"mime", b"application/rdf+xml\0") + infe(4, b"hvc1"))
        iref = box(b"iref", b"\0\0\0\0" + box(b"cdsc", struct.pack(">HHH", 2, 1, 1)) + box(b"dimg", struct.pack(">HHHH", 1, 2, 3, 4)))
        ipma = box(b"ipma", b"\0\0\0\0" + struct.pack(">I", 2) + struct.pack(">HBB", 1, 1, 1) + struct.pack(">HBB", 2, 1, 1))
        pitm = box(b"pitm", struct.pack(">IH", 0, primary))
        return ftyp + box(b"meta", b"\0\0\0\0" + pitm + iloc + iinf + iref + box(b"iprp", box(b"ipco", b"") + ipma) + extra)

    head = build(0)
    return build(len(head) + (16 if wide else 8)) + box(b"mdat", b"".join(parts), wide)


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("base", [False, True])
@pytest.mark.parametrize("wide", [False, True])
def test_items_go_and_the_rest_is_found(version, base, wide):
    b = heic(version, base, wide)
    strips, payload, out = H.heic_without_metadata(b)
    assert [x for x, _ in strips] == ["EXIF metadata", "XMP metadata"] and payload[4:6] == b"MM"
    meta = H.boxes(out, 0, len(out))[1]
    inside = {x.kind: x for x in H.boxes(out, meta.data + 4, meta.stop)}
    items, _ = H.locations(out, inside[b"iloc"])
    assert {x.id: b"|".join(out[e.begin : e.begin + e.size] for e in x.extents) for x in items} == {1: b"PICTURE|REST", 4: b"THUMB"}
    assert out.endswith(b"PICTURERESTTHUMB") and b"xmpmeta" not in out and b"Exif" not in out
    assert out[inside[b"iref"].start :].startswith(box(b"iref", b"\0\0\0\0" + box(b"dimg", struct.pack(">HHH", 1, 1, 4))))
    assert box(b"ipma", b"\0\0\0\0" + struct.pack(">IHBB", 1, 1, 1, 1)) in out
    assert H.heic_without_metadata(out) == ([], None, out)


def test_layouts_that_stay_untouched():
    for b in (heic(extra=box(b"grpl", b"")), heic(primary=2), heic(overlap=True), heic() + box(b"moov", b"")):
        with pytest.raises(H.Unsuited):
            H.heic_without_metadata(b)


def test_every_cut_is_told_and_none_crashes():
    b = heic()
    for n in range(len(b)):
        try:
            assert H.heic_without_metadata(b[:n])
        except (ValueError, IndexError, H.Unsuited):
            pass


def test_union_of_removed_ranges():
    assert H.union([(5, 7), (0, 2), (2, 4), (5, 7), (6, 9)]) == [(0, 4), (5, 9)]


def test_clean_tells_heic_files(spark):
    ok, cut, moov, brand, other = cleaned(spark, heic(), heic()[:-3], heic() + box(b"moov", b""), heic(brand=b"avif"), heic(brand=b"avif").replace(b"mif1", b"heix"))
    assert ok[:2] == ("heic", "ok") and [x[0] for x in ok[2]] == ["EXIF metadata", "XMP metadata"] and ok[3].orientation == 6 and b"xmpmeta" not in ok[4]
    assert cut[:2] == ("heic", "corrupt") and cut[4] is None
    assert moov[:2] == ("heic", "unsupported_layout") and moov[4] is None
    assert brand[:2] == (None, "unsupported")
    assert other[:2] == ("heic", "ok")
