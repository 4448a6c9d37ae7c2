"""Byte readers, signature sniffing, dumps and checksums over BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures in the order they are tried.
MAGIC = (
    ("png", "89504e470d0a1a0a"), ("jpeg", "ffd8ff"), ("gif", "47494638"), ("bmp", "424d"), ("pdf", "25504446"), ("zip", "504b0304"),
    ("rar", "52617221"), ("sevenz", "377abcaf271c"), ("gzip", "1f8b"), ("bzip2", "425a68"), ("elf", "7f454c46"), ("ogg", "4f676753"),
    ("riff", "52494646"), ("flac", "664c6143"), ("mkv", "1a45dfa3"), ("bom", "efbbbf"),
)
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1")


def starts(data: Column, hexed: str) -> Column:
    return F.substring(data, 1, len(hexed) // 2) == F.lit(bytes.fromhex(hexed))


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def payload_kind(data: Column) -> Column:
    """Key of the first signature that fits, 'text' after six printable bytes, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for key, sig in MAGIC:
        out = out.when(starts(data, sig), key)
    return out.when(text_run(data) >= 6, "text")


def text_run(data: Column) -> Column:
    return F.length(F.regexp_extract(latin(data), r"^[\t\n\r -~]*", 0))


def image_kind(data: Column) -> Column:
    riff = starts(data, "52494646") & (F.substring(data, 9, 4) == F.lit(b"WEBP"))
    return F.when(starts(data, "ffd8"), "jpeg").when(starts(data, "89504e47"), "png").when(riff, "webp").when(starts(data, "474946"), "gif").when(is_heif(data), "heif")


def is_heif(data: Column) -> Column:
    """An ftyp box with one of ten brands among the first 64 bytes."""
    head = latin(F.substring(data, 1, 64))
    brands = F.transform(F.sequence(F.lit(9), F.lit(61), F.lit(4)), lambda i: F.substring(head, i, F.lit(4)))
    return (F.substring(head, 5, 4) == "ftyp") & F.exists(brands, lambda b: b.isin(*HEIF_BRANDS))


def u_be(data: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")


def u_le(data: Column, at: int, n: int) -> Column:
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(data, at + 1, n)), F.lit(".."), F.lit(0))), ""), 16, 10).cast("long")


def printable(data: Column) -> Column:
    return F.regexp_replace(latin(data), r"[^\t\n\r -~]", "·")


def hex_dump(data: Column) -> Column:
    """Lines of offset, sixteen bytes with a gap in the middle, and a gutter."""
    def line(off: Column) -> Column:
        part = F.substring(data, off + 1, F.lit(16))
        pairs = F.regexp_extract_all(F.lower(F.hex(part)), F.lit(".."), F.lit(0))
        half = lambda k: F.rpad(F.concat(F.array_join(F.slice(pairs, k, 8), " "), F.when(F.size(pairs) >= k, " ").otherwise("")), 24, " ")
        return F.concat(F.lpad(F.lower(F.hex(off.cast("long"))), 8, "0"), F.lit("  "), half(1), F.lit(" "), half(9), F.lit(" "), F.regexp_replace(latin(part), "[^ -~]", "."))

    n = F.octet_length(data)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1, F.lit(16)), line), "\n")).otherwise("")


def dos_time(ts: Column) -> Column:
    return F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.shiftright(F.second(ts), 1))


def dos_date(ts: Column) -> Column:
    return F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
