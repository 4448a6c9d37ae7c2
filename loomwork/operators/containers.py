"""Metadata of JPEG, PNG, WebP and HEIC files: parts, what goes, a preview, and the file without it.

A scanner (Python, Arrow batches) finds the parts of a file and nothing else.  Which parts
stay, their labels and the rebuilt bytes are SQL expressions over the row's array of
parts, so a file is never shuffled.  HEIC files, whose items point into the file, are
rewritten by ``heic``.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.binary import latin, starts, u_be
from loomwork.operators import heic

# Names of the ancillary PNG chunks that rendering needs, and entries of a directory that are read.
PNG_KEPT = ("tRNS", "gAMA", "cHRM", "sRGB", "iCCP", "sBIT", "bKGD", "pHYs", "hIST", "sPLT", "acTL", "fcTL", "fdAT")
ENTRY_CAP = 512
# Bytes of a value of each TIFF type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

PART = "struct<start:bigint,stop:bigint,tag:string,data:bigint>"
PREVIEW = "struct<make:string,model:string,software:string,taken:string,original:string,orientation:int,lat:double,lon:double,fields:int>"
STRIP = "struct<label:string,detail:string,size:bigint>"
SCANNED = f"struct<parts:array<{PART}>,tail:bigint,preview:{PREVIEW},orientation:int,outcome:string,strips:array<{STRIP}>,cleaned:binary>"
_PART = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("tag", pa.string()), ("data", pa.int64())])
_PREVIEW = pa.struct([*((name, pa.string()) for name in ("make", "model", "software", "taken", "original")), ("orientation", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("fields", pa.int32())])
_STRIP = pa.struct([("label", pa.string()), ("detail", pa.string()), ("size", pa.int64())])
_SCANNED = pa.struct([("parts", pa.list_(_PART)), ("tail", pa.int64()), ("preview", _PREVIEW), ("orientation", pa.int32()), ("outcome", pa.string()), ("strips", pa.list_(_STRIP)), ("cleaned", pa.binary())])
_HEAD = re.compile(rb"\xff+([^\xff])", re.S)
_ALONE = re.compile(rb"[\x01\xd0-\xd7\xd9]", re.S)
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


#: What tiff_preview() looks up in a directory.
_READ = frozenset((0x010F, 0x0110, 0x0112, 0x0131, 0x0132, 0x8769, 0x8825, 0x9003, 1, 2, 3, 4))
_ENTRY = {order: struct.Struct(order + "HHII") for order in "<>"}
_SHOWN = bytes(b if 32 <= b < 127 else 32 for b in range(256))


def tiff_preview(t: bytes) -> dict | None:
    """Fields of the main, Exif and GPS directories that tell of a person or place; null if ``t`` is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    magic, first = struct.unpack((order or "<") + "HI", t[2:8].ljust(6, b"\0"))
    if order is None or magic != 42:
        return None

    def directory(at: int) -> tuple[dict, int]:
        if not 0 < at <= len(t) - 2:
            return {}, 0
        (stated,) = struct.unpack_from(order + "H", t, at)
        n = min(stated, ENTRY_CAP, (len(t) - at - 2) // 12)
        found = {}
        for k, (tag, kind, count, value) in enumerate(_ENTRY[order].iter_unpack(t[at + 2 : at + 2 + 12 * n])):
            if tag in _READ:
                found[tag] = (kind, count, at + 10 + 12 * k if TYPE_BYTES.get(kind, 1) * count <= 4 else value, value)
        return found, n

    def text(entry) -> str | None:
        if not entry or entry[0] != 2:
            return None
        raw = t[entry[2] : entry[2] + entry[1]].partition(b"\0")[0]
        return " ".join(raw.translate(_SHOWN).decode("ascii").split()) or None

    def degrees(entry) -> float:
        total = 0.0
        for k, unit in enumerate((1, 60, 3600)):
            at = entry[2] + 8 * k
            if at + 8 <= len(t):
                top, bottom = struct.unpack_from(order + "II", t, at)
                total += top / bottom / unit if bottom else 0
        return total

    main, n_main = directory(first)
    below = lambda tag: directory(main[tag][3]) if tag in main and main[tag][1] else ({}, 0)
    (exif, n_exif), (gps, n_gps) = below(0x8769), below(0x8825)
    kind, count, at, _ = main.get(0x0112, (0, 0, 0, 0))
    turned = struct.unpack_from(order + ("H" if kind == 3 else "I"), t, at)[0] if count and kind in (3, 4) and at + 4 <= len(t) else 0
    lat = lon = None
    if all(x in gps and gps[x][0] == 5 and gps[x][1] >= 3 for x in (2, 4)):
        lat = degrees(gps[2]) * (-1 if text(gps.get(1)) == "S" else 1)
        lon = degrees(gps[4]) * (-1 if text(gps.get(3)) == "W" else 1)
        if not lat and not lon:
            lat = lon = None
    return {
        "make": text(main.get(0x010F)), "model": text(main.get(0x0110)), "software": text(main.get(0x0131)), "taken": text(main.get(0x0132)), "original": text(exif.get(0x9003)),
        "orientation": min(turned, 2**31 - 1) or 1, "lat": lat, "lon": lon, "fields": n_main + n_exif + n_gps,
    }


def jpeg_parts(b: bytes) -> tuple[list[tuple], int] | None:
    """(start, stop, marker in hex, start of data) of each segment, and bytes after the end marker; null if broken."""
    parts, at = [], 2
    while at < len(b):
        head = _HEAD.match(b, at)
        if head is None:  # fill bytes may end a file; anything else there is broken
            if b[at:].strip(b"\xff"):
                return None
            break
        marker, data, stop = head[1], head.end(), head.end()
        if not _ALONE.match(marker):
            size = int.from_bytes(b[data : data + 2], "big")
            stop, data = data + size, data + 2
            if size < 2 or stop > len(b) or data > len(b):
                return None
        if marker == b"\xda":  # the scan's bits run up to the next marker that is not part of them
            after = _MARKER.search(b, stop)
            stop = after.start() if after else len(b)
        parts.append((at, stop, marker.hex(), data))
        if marker == b"\xd9":
            return parts, len(b) - stop
        at = stop
    return (parts, 0) if parts else None


def png_parts(b: bytes) -> tuple[list[tuple], int] | None:
    """Chunks up to IEND; a file without one is cut off, so null."""
    parts, at = [], 8
    while b.startswith(b"\x89PNG\r\n\x1a\n") and at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        stop = at + 12 + size
        if stop > len(b) or not (kind.isalpha() and kind.isascii()):
            return None
        parts.append((at, stop, kind.decode(), at + 8))
        if kind == b"IEND":
            return parts, len(b) - stop
        at = stop
    return None


def webp_parts(b: bytes) -> tuple[list[tuple], int] | None:
    """Chunks that fill the declared RIFF size exactly; null if they do not, or an extended header is short."""
    end = 8 + int.from_bytes(b[4:8], "little")
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP" or not 12 <= end <= len(b):
        return None
    parts, at = [], 12
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, at)
        if at + 8 + size > end or (kind == b"VP8X" and size < 10):
            return None
        stop = min(at + 8 + size + size % 2, end)
        parts.append((at, stop, kind.decode("latin-1"), at + 8))
        at = stop
    return (parts, len(b) - end) if parts and at == end else None


def _previews(kind: str, b: bytes, parts: list[tuple]):
    for start, stop, tag, data in parts:
        if kind == "jpeg" and tag == "e1" and b[data : min(data + 6, stop)] == b"Exif\0\0":
            yield tiff_preview(b[data + 6 : stop])
        elif kind == "png" and tag == "eXIf":
            yield tiff_preview(b[data : stop - 4])
        elif kind == "webp" and tag == "EXIF":
            body = b[data : data + int.from_bytes(b[start + 4 : start + 8], "little")]
            yield tiff_preview(body.removeprefix(b"Exif\0\0"))


_SCANNERS = {"jpeg": jpeg_parts, "png": png_parts, "webp": webp_parts}


def _heic(b: bytes) -> tuple:
    try:
        strips, payload, out = heic.heic_without_metadata(b)
    except heic.Unsuited:
        return None, None, None, None, "unsupported_layout", None, None
    except (ValueError, IndexError):
        return None, None, None, None, "corrupt", None, None
    at = heic.tiff_place(payload) if payload else None
    preview = tiff_preview(payload[at:]) if at is not None else None
    return None, None, preview, 1, "ok", [{"label": label, "detail": None, "size": size} for label, size in strips], out


def _scan(kinds: pa.Array, contents: pa.Array) -> pa.Array:
    rows = []
    for kind, content in zip(kinds.to_pylist(), contents.to_pylist()):
        if kind == "heic":
            rows.append(_heic(content))
            continue
        found = _SCANNERS[kind](content) if kind in _SCANNERS else None
        if found is None:
            rows.append((None,) * 7)
            continue
        parts, tail = found
        seen = [x for x in _previews(kind, content, parts) if x]
        rows.append((parts, tail, seen[0] if seen else None, seen[-1]["orientation"] if seen and kind == "jpeg" else 1, None, None, None))
    return pa.array(rows, _SCANNED)


def container_kind(content: Column) -> Column:
    """jpeg, png, webp or heic by leading bytes and least size; anything else is null.

    A HEIC file lists one of two still-image brands in its ftyp box.
    """
    n, size = F.octet_length(content), u_be(content, 0, 4)
    brand = lambda at: (F.substring(content, at + 1, F.lit(4)) == F.lit(b"heic")) | (F.substring(content, at + 1, F.lit(4)) == F.lit(b"heix"))
    listed = F.when(size >= 20, F.exists(F.sequence(F.lit(16), (size - 4).cast("int"), F.lit(4)), brand)).otherwise(False)
    boxed = (n >= 16) & (F.substring(content, 5, 4) == F.lit(b"ftyp"))
    still = F.when(boxed & size.between(16, n), brand(F.lit(8)) | listed).otherwise(False)
    return F.when((n >= 4) & starts(content, "ffd8"), "jpeg").when((n >= 20) & starts(content, "8950"), "png").when((n >= 20) & starts(content, "52494646"), "webp").when(still, "heic")


def _label(kind: Column, p: Column, content: Column) -> Column:
    """Why a part goes, or null if it stays."""
    head = latin(F.substring(content, (p["data"] + 1).cast("int"), F.least(p["stop"] - p["data"], F.lit(40)).cast("int")))
    tag, begins = p["tag"], lambda *texts: F.lit(False) if not texts else F.greatest(*(head.startswith(F.lit(x)) for x in texts), F.lit(False))
    app1, vendor = tag == "e1", tag.rlike("^e[1-9a-df]$")
    jpeg = (
        F.when(tag == "fe", "Comment").when(app1 & begins("Exif\0\0"), "EXIF metadata").when(app1 & begins("http://ns.adobe.com/xap/1.0/", "http://ns.adobe.com/xmp/extension/"), "XMP metadata")
        .when((tag == "e2") & begins("ICC_PROFILE"), None).when((tag == "e2") & begins("MPF"), "Multi-picture data (gain map)").when((tag == "ed") & begins("Photoshop 3.0"), "IPTC / Photoshop").when(vendor, "Vendor segment")
    )
    stays = tag.rlike("^[A-Z]") | tag.isin(*PNG_KEPT)
    png = F.when(stays, None).when(tag == "eXIf", "EXIF metadata").when(tag.isin("tEXt", "zTXt", "iTXt"), "Text chunk").when(tag == "tIME", "Timestamp chunk").otherwise("Extra chunk")
    webp = F.when(tag == "EXIF", "EXIF metadata").when(tag == "XMP ", "XMP metadata")
    return F.when(kind == "jpeg", jpeg).when(kind == "png", png).otherwise(webp)


def _detail(kind: Column, p: Column, content: Column, label: Column) -> Column:
    """Segment name, or the keyword of a text chunk."""
    room = F.greatest(F.least(p["stop"] - 4 - p["data"], F.lit(40)), F.lit(0)).cast("int")
    word = F.regexp_extract(latin(F.substring(content, (p["data"] + 1).cast("int"), room)), "^[^\\x00]*", 0)
    shown = F.coalesce(F.nullif(F.regexp_replace(word, "[^ -~]", "?"), F.lit("")), p["tag"])
    app = F.concat(F.lit("APP"), F.conv(F.substring(p["tag"], 2, 1), 16, 10))
    return F.when(label == "Vendor segment", app).when(label == "Text chunk", shown).when(label == "Extra chunk", p["tag"])


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def _rebuilt(kind: Column, orientation: Column, kept: Column, content: Column) -> Column:
    """Kept parts in order; a bare orientation segment, cleared flags and the new size where they are due."""
    hexed = lambda p: F.hex(F.substring(content, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")))
    joined = lambda a: F.array_join(F.transform(a, hexed), "")
    turned = F.concat(F.lit("FFE10022457869660000" "49492A0008000000" "0100" "1201030001000000"), F.lpad(F.hex(orientation.cast("long")), 2, "0"), F.lit("000000" "00000000"))
    # before the first kept segment that is not APP0
    places = F.transform(kept, lambda p, i: F.when(p["tag"] != "e0", i))
    at = F.array_min(places)
    due = orientation.between(2, 8) & at.isNotNull()
    jpeg = F.concat(F.lit("FFD8"), F.when(due, F.concat(joined(F.slice(kept, F.lit(1), at)), turned, joined(F.slice(kept, at + 1, F.size(kept))))).otherwise(joined(kept)))
    flags = lambda x: F.lpad(F.hex(F.conv(F.substring(x, 17, 2), 16, 10).cast("long").bitwiseAND(0xF3)), 2, "0")
    chunk = lambda p: F.when(p["tag"] == "VP8X", F.overlay(hexed(p), flags(hexed(p)), 17, 2)).otherwise(hexed(p))
    body = F.array_join(F.transform(kept, chunk), "")
    webp = F.concat(F.lit("52494646"), _le32(F.length(body) / 2 + 4), F.lit("57454250"), body)
    return F.unhex(F.when(kind == "jpeg", jpeg).when(kind == "png", F.concat(F.lit("89504E470D0A1A0A"), joined(kept))).when(kind == "webp", webp))


def clean(df: DataFrame, content_col: str = "content") -> DataFrame:
    """df with kind, outcome (ok, corrupt, unsupported, unsupported_layout), strips (label, detail, size), preview, orientation and cleaned.

    Null and unknown content is ``unsupported``; broken files are ``corrupt`` and have null
    strips and cleaned bytes, as have HEIC files that can't be rewritten without loss (``unsupported_layout``).  Rows repeat as they are; extra columns stay.
    """
    content = F.coalesce(F.col(content_col), F.lit(b""))
    scan = F.arrow_udf(_scan, SCANNED)
    found = df.withColumn("kind", container_kind(content)).withColumn("__s", scan(F.col("kind"), content))
    parts, kind = F.col("__s.parts"), F.col("kind")

    def told(p: Column) -> Column:
        label = _label(kind, p, content)
        return F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["tag"].alias("tag"), label.alias("label"), _detail(kind, p, content, label).alias("detail"))

    found = found.withColumn("__p", F.transform(parts, told))
    going = F.transform(F.filter("__p", lambda p: p["label"].isNotNull()), lambda p: F.struct(p["label"].alias("label"), p["detail"].alias("detail"), (p["stop"] - p["start"]).alias("size")))
    tail = F.when(F.col("__s.tail") > 0, F.array(F.struct(F.lit("Data after image end").alias("label"), F.lit(None).cast("string").alias("detail"), F.col("__s.tail").alias("size"))))
    strips = F.concat(going, F.coalesce(tail, F.slice(going, 1, 0)))
    kept = F.filter("__p", lambda p: p["label"].isNull())
    outcome = F.when(kind.isNull(), "unsupported").when(kind == "heic", F.col("__s.outcome")).when(parts.isNull(), "corrupt").otherwise("ok")
    return found.withColumns({
        "outcome": outcome, "strips": F.when(kind == "heic", F.col("__s.strips")).otherwise(strips), "preview": F.col("__s.preview"), "orientation": F.col("__s.orientation"),
        "cleaned": F.when(kind == "heic", F.col("__s.cleaned")).when(parts.isNotNull(), _rebuilt(kind, F.col("__s.orientation"), kept, content)),
    }).drop("__s", "__p")


def jpeg_turn(b: bytes) -> int:
    """The orientation that a viewer takes: of the first Exif segment before the picture; 1 for anything malformed or missing."""
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] not in (0xDA, 0xD9):
        if b[at + 1] == 0xFF:  # a fill byte
            at += 1
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        segment = b[at + 4 : at + 2 + size]
        if size < 2 or at + 2 + size > len(b):
            break
        if b[at + 1] == 0xE1 and size >= 16 and segment[:6] == b"Exif\0\0":
            return _turn(segment[6:])
        at += 2 + size
    return 1


def _turn(t: bytes) -> int:
    """Tag 0x0112 of a TIFF's first directory."""
    order = {b"II": "little", b"MM": "big"}.get(t[:2])
    if order is None or len(t) < 8:
        return 1
    number = lambda at, n: int.from_bytes(t[at : at + n], order)
    start = number(4, 4)
    if number(2, 2) != 42 or start + 2 > len(t):
        return 1
    for k in range(number(start, 2)):
        entry = start + 2 + 12 * k
        if entry + 12 > len(t):
            return 1
        if number(entry, 2) == 0x0112:
            return number(entry + 8, 2) if 1 <= number(entry + 8, 2) <= 8 else 1
    return 1


def upright(df: DataFrame, content_col: str = "content") -> DataFrame:
    """df with ``upright``: the orientation of JPEG content, 1 for other content and for null."""

    @F.pandas_udf("int")
    def turn(contents: pd.Series) -> pd.Series:
        return pd.Series([jpeg_turn(bytes(c)) if c is not None and bytes(c[:2]) == b"\xff\xd8" else 1 for c in contents], dtype="int32")

    return df.withColumn("upright", turn(F.col(content_col)))


def tiles(df: DataFrame, w: Column, h: Column, text_width: Column, percent: Column, gap: Column) -> DataFrame:
    """A row (tile_row, tile_col, x, y, font) for each place of a repeated mark, about the centre before it is turned by -30 degrees.

    Odd rows start half a step earlier.  Null or non-positive sizes give no tiles.
    """
    font = F.greatest(F.lit(8.0), F.floor(F.least(w, h) * percent / 100 + 0.5).cast("double"))
    sized = df.withColumn("font", font).withColumn("__x", F.greatest(F.lit(1.0), text_width) + F.col("font") * gap).withColumn("__y", F.col("font") * (1 + gap)).withColumn("__r", F.sqrt(w * w + h * h) / 2)
    upto = lambda span, step: F.sequence(F.lit(0), F.floor(span / step).cast("int"))
    rows = sized.filter((w > 0) & (h > 0)).withColumn("tile_row", F.explode(upto(2 * F.col("__r"), F.col("__y")))).withColumn("__o", F.when(F.col("tile_row") % 2 == 1, F.col("__x") / 2).otherwise(0.0))
    cells = rows.withColumn("tile_col", F.explode(upto(2 * F.col("__r") + F.col("__o") + F.col("__x"), F.col("__x"))))
    return cells.withColumn("x", F.col("tile_col") * F.col("__x") - F.col("__r") - F.col("__o")).withColumn("y", F.col("tile_row") * F.col("__y") - F.col("__r")).drop("__x", "__y", "__r", "__o")
