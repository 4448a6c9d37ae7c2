"""Archive layout, store-only ZIP bytes and names that do not collide."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.prefix import has_hot_key, running_totals

MAX_BYTES, MAX_ENTRIES, MAX_NAME = 0xFFFF0000, 0xFFFF, 0xFFFF
#: Bytes that a value of the engine holds at most; larger archives are files (sources/zips.py).
VALUE_BYTES = (1 << 31) - (1 << 16)


def layout(entries: DataFrame, key: str, order: str, name_len: Column, data_len: Column) -> DataFrame:
    """entries with ``header_at``: the offset of each local header. Many tasks share a hot archive."""
    return running_totals(entries, [key], [order], {"header_at": (30 + name_len + data_len).cast("long")}, before=True, spread=has_hot_key(entries, [key]))


def sizes(entries: DataFrame, key: str, name_len: Column, data_len: Column) -> DataFrame:
    """Exact archive size and whether a limit is passed."""
    out = entries.groupBy(key).agg((22 + F.sum(76 + 2 * name_len + data_len)).cast("long").alias("bytes"), F.count("*").alias("entries"), F.max(name_len).cast("long").alias("longest"))
    return out.withColumn("too_big", (F.col("bytes") > MAX_BYTES) | (F.col("entries") > MAX_ENTRIES) | (F.col("longest") > MAX_NAME))


def zip_bytes(entries: list[tuple[str, bytes]], dos_date: int = 0x5C21, dos_time: int = 0, utf8: bool = True) -> bytes:
    """A store-only ZIP of entries in order."""
    body, central, flag = bytearray(), bytearray(), 0x0800 if utf8 else 0
    for name, data in entries:
        raw, at = name.encode(), len(body)
        fixed = struct.pack("<HHHHHIIIHH", 20, flag, 0, dos_time, dos_date, zlib.crc32(data), len(data), len(data), len(raw), 0)
        body += b"PK\x03\x04" + fixed + raw + data
        central += b"PK\x01\x02" + struct.pack("<H", 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw
    return bytes(body + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), len(body), 0))


def dos_stamp(made_at: datetime | None = None) -> tuple[int, int]:
    """Date and time of headers: local time, 2026-01-01 if none is given, so that bytes do not vary."""
    at = made_at or datetime(2026, 1, 1)
    return (at.year - 1980 & 0x7F) << 9 | at.month << 5 | at.day, at.hour << 11 | at.minute << 5 | at.second >> 1


def make_zips(entries: DataFrame, made_at: datetime | None = None, utf8: bool = True) -> DataFrame:
    """(archive_id, content, error_code) from (archive_id, ord, name, content).

    The limits are checked on sizes first: an archive that passes one has error_code
    'zipbig' and null content, and its bytes go nowhere.  So has one of 2 GiB or more, which
    no value holds (write_zips() writes those).  The others are one value and so one task's
    work each.  Null content is empty.
    """
    date, time = dos_stamp(made_at)
    size = sizes(entries.select("archive_id", "name", "content"), "archive_id", F.octet_length("name"), F.coalesce(F.octet_length("content"), F.lit(0)))
    large = size.filter(F.col("too_big") | (F.col("bytes") > VALUE_BYTES)).select("archive_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        made = zip_bytes([(n, bytes(c or b"")) for n, c in zip(pdf["name"], pdf["content"])], date, time, utf8)
        return pd.DataFrame({"archive_id": [pdf["archive_id"].iloc[0]], "content": [made]})

    kind = entries.schema["archive_id"].dataType.simpleString()
    made = entries.join(large, "archive_id", "left_anti").groupBy("archive_id").applyInPandas(run, f"archive_id {kind}, content binary")
    return made.withColumn("error_code", F.lit(None).cast("string")).unionByName(large.select("archive_id", F.lit(None).cast("binary").alias("content"), F.lit("zipbig").alias("error_code")))


def distinct_names(names: list[str]) -> list[str]:
    """Names in order; one that is taken gets the next free number before its extension."""
    taken: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for name in names:
        pick = name
        stem, dot, ext = name.rpartition(".")
        while pick in taken:
            n = following.get(name, 2)
            following[name] = n + 1
            pick = f"{stem}({n}).{ext}" if dot else f"{name}({n})"
        taken.add(pick)
        out.append(pick)
    return out


def dedupe_names(entries: DataFrame, key: str, order: str, name: str, most: int = MAX_ENTRIES) -> DataFrame:
    """entries with ``unique_name``. Names depend on all before them, so a key's entries are one group.

    A key with more entries than an archive can have gets null names and is not gathered.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(unique_name=distinct_names(pdf[name].fillna("").tolist()))

    slim = entries.select(key, order, name)
    large = slim.groupBy(key).count().filter(F.col("count") > most).select(F.col(key).alias("large_"))
    fits, beyond = (slim.join(large, F.col(key).eqNullSafe(F.col("large_")), how) for how in ("left_anti", "left_semi"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return fits.groupBy(key).applyInPandas(run, fields + ", unique_name string").unionByName(beyond.withColumn("unique_name", F.lit(None).cast("string")))
