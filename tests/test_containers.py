import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.operators import containers as C


def seg(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def tiff(order, orientation, gps=None):
    """One directory with a maker, an orientation and, if given, a place."""
    o = {"II": "<", "MM": ">"}[order]
    entries = [struct.pack(o + "HHI4s", 0x010F, 2, 4, b"Ab\x01\0"), struct.pack(o + "HHIHH", 0x0112, 3, 1, orientation, 0)]
    end = 8 + 2 + 12 * (len(entries) + bool(gps)) + 4
    tail = b""
    if gps:
        entries.append(struct.pack(o + "HHII", 0x8825, 4, 1, end))
        at = end + 2 + 48 + 4
        rows = [struct.pack(o + "HHI4s", 1, 2, 2, b"S\0\0\0"), struct.pack(o + "HHII", 2, 5, 3, at), struct.pack(o + "HHI4s", 3, 2, 2, b"E\0\0\0"), struct.pack(o + "HHII", 4, 5, 3, at + 24)]
        tail = struct.pack(o + "H", 4) + b"".join(rows) + b"\0" * 4 + b"".join(struct.pack(o + "II", n, d) for n, d in gps)
    return order.encode() + struct.pack(o + "HI", 42, 8) + struct.pack(o + "H", len(entries)) + b"".join(entries) + b"\0" * 4 + tail


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def cleaned(spark, *files):
    rows = C.clean(spark.createDataFrame([(k, f, 1) for k, f in enumerate(files)], "k int, content binary, tail_ int")).orderBy("k").collect()
    return [(r.kind, r.outcome, [(s.label, s.detail, s.size) for s in r.strips or []], r.preview, r.cleaned and bytes(r.cleaned)) for r in rows]


ICC, ADOBE, SOF = seg(0xE2, b"ICC_PROFILE\0x"), seg(0xEE, b"Adobe"), seg(0xC0, b"12345")
SCAN = seg(0xDA, b"\1") + b"\x12\xff\x00\x34\xff\xd3\x56" + seg(0xDA, b"\2") + b"\x99"


def test_jpeg(spark):
    exif = seg(0xE1, b"Exif\0\0" + tiff("MM", 6, [(10, 1), (30, 1), (0, 1), (20, 1), (0, 0), (36, 1)]))
    xmp, mpf, iptc, other, note = seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>"), seg(0xE2, b"MPF\0"), seg(0xED, b"Photoshop 3.0\0"), seg(0xE5, b"?"), seg(0xFE, b"hi")
    app0 = seg(0xE0, b"JFIF\0")
    whole = b"\xff\xd8" + app0 + exif + xmp + ICC + mpf + iptc + other + ADOBE + b"\xff\xff" + note + SOF + SCAN + b"\xff\xd9junk"
    turned = seg(0xE1, b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0")
    [(kind, outcome, strips, seen, out)] = cleaned(spark, whole)
    assert (kind, outcome) == ("jpeg", "ok") and out == b"\xff\xd8" + app0 + turned + ICC + ADOBE + SOF + SCAN + b"\xff\xd9"
    assert strips == [("EXIF metadata", None, len(exif)), ("XMP metadata", None, len(xmp)), ("Multi-picture data (gain map)", None, len(mpf)), ("IPTC / Photoshop", None, len(iptc)), ("Vendor segment", "APP5", len(other)), ("Comment", None, len(note) + 2), ("Data after image end", None, 4)]
    assert (seen.make, seen.orientation, seen.fields) == ("Ab", 6, 7) and abs(seen.lat + 10.5) < 1e-9 and abs(seen.lon - 20.01) < 1e-9
    # no end marker: accepted, every byte of the scan stays
    assert cleaned(spark, b"\xff\xd8" + SOF + SCAN)[0][1:3] == ("ok", [])


def test_png(spark):
    sig = b"\x89PNG\r\n\x1a\n"
    ihdr, idat, end = chunk(b"IHDR", b"\0" * 13), chunk(b"IDAT", b"data"), chunk(b"IEND", b"")
    gone = [chunk(b"tEXt", b"Author\0me"), chunk(b"tIME", b"\0" * 7), chunk(b"eXIf", tiff("II", 3)), chunk(b"prVt", b"?"), chunk(b"zTXt", b"")]
    fctl = chunk(b"fcTL", b"\0" * 26)
    good, cut, wrong = cleaned(spark, sig + ihdr + gone[0] + gone[1] + fctl + gone[2] + idat + gone[3] + gone[4] + end + b"tail", sig + ihdr + idat, b"\x89P" + b"\0" * 30)
    assert good[1] == "ok" and good[4] == sig + ihdr + fctl + idat + end and good[3].orientation == 3
    assert [s[:2] for s in good[2]] == [("Text chunk", "Author"), ("Timestamp chunk", None), ("EXIF metadata", None), ("Extra chunk", "prVt"), ("Text chunk", "zTXt"), ("Data after image end", None)]
    assert cut[1] == wrong[1] == "corrupt" and cut[4] is None


def test_webp(spark):
    x = b"\x2c" + b"\0" * 9
    whole = riff((b"VP8X", x), (b"EXIF", b"Exif\0\0" + tiff("II", 1)), (b"VP8 ", b"abc"), (b"XMP ", b"<x>"))
    good, short, long_, wave, tail = cleaned(spark, whole, riff((b"VP8X", b"\0" * 9)), whole[:-1], riff((b"fmt ", b"\0" * 9)).replace(b"WEBP", b"WAVE"), whole + b"more")
    assert good[4] == riff((b"VP8X", b"\x20" + x[1:]), (b"VP8 ", b"abc")) and good[3].make == "Ab" and [s[0] for s in good[2]] == ["EXIF metadata", "XMP metadata"]
    assert [f[1] for f in (short, long_, wave)] == ["corrupt"] * 3 and tail[4] == good[4] and tail[2][-1] == ("Data after image end", None, 4)


def test_odd_content(spark):
    assert [(r[0], r[1]) for r in cleaned(spark, None, b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\x00\x00", b"\xff\xd8\xff\xff")] == [(None, "unsupported")] * 4 + [("jpeg", "corrupt")] * 2
    empty = C.clean(spark.createDataFrame([], "content binary, k int"))
    assert empty.count() == 0 and empty.columns[:2] == ["content", "k"]


def test_every_cut_is_safe(spark):
    """No prefix of a file fails, and what comes out of a whole file cleans to itself."""
    jpeg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff("II", 8, [(1, 2)] * 6)) + SOF + SCAN + b"\xff\xd9"
    webp = riff((b"VP8X", b"\0" * 10), (b"EXIF", tiff("MM", 2)), (b"VP8 ", b"ab"))
    cuts = [f[:k] for f in (jpeg, webp) for k in range(len(f) + 1)]
    made = cleaned(spark, *cuts)
    assert all(m[1] in ("ok", "corrupt", "unsupported") and (m[4] is None) == (m[1] != "ok") for m in made)
    again = cleaned(spark, made[len(jpeg)][4], made[-1][4])
    assert [a[4] for a in again] == [made[len(jpeg)][4], made[-1][4]]


def test_tiles(spark):
    df = spark.createDataFrame([(100.0, 100.0), (0.0, 5.0), (None, 5.0)], "w double, h double")
    got = C.tiles(df, F.col("w"), F.col("h"), F.lit(0.0), F.lit(10), F.lit(1)).collect()
    r = 50 * 2**0.5
    want, y, row = set(), -r, 0
    while y <= r:
        x = -r - (5.5 if row % 2 else 0)
        while x <= r + 11:
            want.add((row, round(x, 6), round(y, 6)))
            x += 11
        y, row = y + 20, row + 1
    assert {(t.tile_row, round(t.x, 6), round(t.y, 6)) for t in got} == want and {t.font for t in got} == {10.0}


def test_preview_of_long_directories():
    """Of 600 entries 512 count; of equal tags the last tells; short values stand in the entry, others where it points to."""
    entry = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
    entries = [entry(0x010F, 2, 20, 8)] + [entry(0x9999, 3, 1, 7)] * 598 + [entry(0x0110, 2, 3, 0x0041)]
    entries[100:102] = [entry(0x0112, 3, 1, 3), entry(0x0112, 3, 1, 6)]
    entries[200] = entry(0x0131, 2, 3, 0x007A01)
    t = b"II*\0" + struct.pack("<I", 28) + b"A\x01\xff b\0rest".ljust(20, b"\0") + struct.pack("<H", 600) + b"".join(entries)
    got = C.tiff_preview(t)
    assert (got["make"], got["model"], got["software"], got["orientation"], got["fields"]) == ("A b", None, "z", 6, 512)
    for cut in range(len(t) - 100, len(t)):
        assert C.tiff_preview(t[:cut])["fields"] == 512
    assert C.tiff_preview(t[: 30 + 12 * 9 + 5])["fields"] == 9


def test_scan_reads_arrow():
    """Files go through the scan as Arrow arrays, null kinds and broken files included."""
    whole = b"\xff\xd8" + SCAN + b"\xff\xd9"
    got = C._scan(pa.array(["jpeg", None, "png"]), pa.array([whole, b"", b"\x89PNG"], pa.binary())).to_pylist()
    assert len(got[0]["parts"]) == 3 and got[0]["tail"] == 0 and got[1]["parts"] is None and got[2]["parts"] is None
