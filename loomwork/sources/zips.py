"""ZIP archives as files: a sink whose tasks write at places that running totals give.

Where every local header, central record and end record stands follows from sizes alone,
so tasks write their entries of one archive side by side and no task or driver sees an
archive whole.  An entry may come in chunks; its checksum is combined from theirs.  Files
are written under a name of the attempt and renamed when all tasks have ended.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomwork.operators.archives import MAX_BYTES, MAX_ENTRIES, MAX_NAME, dos_stamp
from loomwork.operators.prefix import running_totals
from loomwork.shared import arrow_batches, settings, stash

#: Contents that a reader holds at once.
CONTENTS = "16"
#: The checksum's polynomial, bits from low to high power: its first bit is that of 1.
POLYNOMIAL, ONE = 0xEDB88320, 1 << 31


def _product(a: int, b: int) -> int:
    """Of two polynomials over GF(2), modulo the checksum's."""
    out = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes one after another, from (CRC-32, length) of each part: the earlier part's is moved up by x ** (8 * length)."""
    whole = 0
    for crc, size in parts:
        moved, square = whole, ONE >> 8  # x ** 8
        while size:
            if size & 1:
                moved = _product(moved, square)
            square, size = _product(square, square), size >> 1
        whole = moved ^ crc
    return whole


def _combined(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([combined_crc(list(zip(map(int, c), map(int, n)))) for c, n in zip(crcs, sizes)])


def _folder(uri: str) -> str:
    """The path of a folder that can be written at any place; stores that take whole objects only cannot."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"archives are written side by side, which {found.scheme} does not allow: name a shared folder")
    return unquote(found.path)


class ZipFiles(DataSource):
    """Sink of pieces (archive, at, piece): bytes and where they stand in ``archive``.zip below path."""

    @classmethod
    def name(cls) -> str:
        return "zip_pieces"

    def schema(self) -> str:
        return "archive string, at long, piece binary"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(_folder(self.options["path"]), self.options["attempt"])


class PieceWriter(DataSourceWriter):
    def __init__(self, folder: str, attempt: str):
        self.folder, self.attempt = folder, attempt

    def _open(self, archive: str) -> str:
        return os.path.join(self.folder, f".{archive}.{self.attempt}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """A task that runs twice writes the same bytes at the same places."""
        os.makedirs(self.folder, exist_ok=True)
        name, file = None, None
        for archive, at, piece in rows:
            if archive != name:
                if file is not None:
                    os.close(file)
                name, file = archive, os.open(self._open(archive), os.O_RDWR | os.O_CREAT, 0o644)
            left, place = memoryview(bytes(piece)), at
            while left:
                done = os.pwrite(file, left, place)
                left, place = left[done:], place + done
        if file is not None:
            os.fsync(file)
            os.close(file)
        return WriterCommitMessage()

    def _mine(self) -> list[str]:
        return [x for x in os.listdir(self.folder) if x.startswith(".") and x.endswith(f".{self.attempt}")] if os.path.isdir(self.folder) else []

    def commit(self, messages: list) -> None:
        for x in self._mine():
            os.replace(os.path.join(self.folder, x), os.path.join(self.folder, x[1 : -len(self.attempt) - 1] + ".zip"))

    def abort(self, messages: list) -> None:
        for x in self._mine():
            os.remove(os.path.join(self.folder, x))


def read_zips(manifest: DataFrame, path: str) -> DataFrame:
    """(archive_id, bytes, entries, content_bytes, sound, first_name, last_name) of each archive of write_zips(), read by a standard reader; sound says that every checksum fits."""
    folder = _folder(path)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for archive in b.column(0).to_pylist():
                file = os.path.join(folder, f"{archive}.zip")
                with zipfile.ZipFile(file) as z:
                    held = z.infolist()
                    rows.append((archive, os.path.getsize(file), len(held), sum(x.file_size for x in held), z.testzip() is None, held[0].filename, held[-1].filename))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()))], names=["archive_id", "bytes", "entries", "content_bytes", "sound", "first_name", "last_name"])

    written = manifest.filter("error_code is null").select("archive_id")
    return written.repartition("archive_id").mapInArrow(run, "archive_id string, bytes long, entries long, content_bytes long, sound boolean, first_name string, last_name string")


def write_zips(entries: DataFrame, path: str, made_at: datetime | None = None, utf8: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Write (archive_id, ord, name, content) as archive_id.zip below path; (archive_id, bytes, entries, error_code) of each archive.

    With a column ``chunk`` an entry's content comes in rows of (ord, chunk), in that order;
    its name is that of the first.  Entries of an archive have different ``ord``.  Archives
    beyond ``max_bytes``, 65,535 entries or a name's 65,535 bytes have error_code 'zipbig'
    and no file.  Null content is empty; ids name files, so they are not null and hold no
    slash.  ``path`` is a folder that all executors can write at any place.
    """
    _folder(path)
    date, time = dos_stamp(made_at)
    chunked = entries if "chunk" in entries.columns else entries.withColumn("chunk", F.lit(0))
    rows = stash(chunked.select(F.col("archive_id").cast("string").alias("a"), "ord", "chunk", "name", F.coalesce("content", F.lit(b"")).alias("content")).withColumns({"size": F.octet_length("content").cast("long"), "crc": F.crc32("content")}), "chunks")
    spark = rows.sparkSession
    bad = rows.filter(F.col("a").isNull() | F.col("a").contains("/") | F.col("a").isin("", ".", "..")).limit(1).count()
    if bad:
        raise ValueError("an archive's id is no file name")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "crc", "size")))
    one = rows.groupBy("a", "ord").agg(F.min_by("name", "chunk").alias("name"), parts.alias("parts"), F.sum("size").alias("size"))
    one = one.withColumn("crc", F.pandas_udf(_combined, "long")(F.transform("parts", lambda p: p["crc"]), F.transform("parts", lambda p: p["size"]))).withColumn("n", F.octet_length("name").cast("long")).drop("parts")
    placed = running_totals(one, ["a"], ["ord"], {"at": 30 + F.col("n") + F.col("size"), "record_at": 46 + F.col("n"), "nth": F.lit(1).cast("long")}, before=True)
    placed = stash(placed, "places")
    total = placed.groupBy("a").agg(F.count("*").alias("entries"), F.sum(30 + F.col("n") + F.col("size")).alias("data"), F.sum(46 + F.col("n")).alias("records"), F.max("n").alias("longest"))
    total = stash(total.withColumn("bytes", F.col("data") + F.col("records") + 22).withColumn("big", (F.col("bytes") > max_bytes) | (F.col("entries") > MAX_ENTRIES) | (F.col("longest") > MAX_NAME)), "archives")
    fits = total.filter("not big").select("a", "entries", "data", "records")
    known = placed.join(fits, "a")

    def le(value, width: int):
        h = F.lpad(F.hex(F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")), 2 * width, "0")
        return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))])

    flag = 0x0800 if utf8 else 0
    fixed = F.concat(le(20, 2), le(flag, 2), le(0, 2), le(time, 2), le(date, 2), le(F.col("crc"), 4), le(F.col("size"), 4), le(F.col("size"), 4), le(F.col("n"), 2), le(0, 2))
    raw = F.hex(F.encode("name", "UTF-8"))
    header = F.unhex(F.concat(F.lit(b"PK\x03\x04".hex()), fixed, raw))
    record = F.unhex(F.concat(F.lit(b"PK\x01\x02".hex()), le(20, 2), fixed, le(0, 2), le(0, 2), le(0, 2), le(0, 4), le(F.col("at"), 4), raw))
    end = F.unhex(F.concat(F.lit(b"PK\x05\x06".hex()), le(0, 2), le(0, 2), le(F.col("entries"), 2), le(F.col("entries"), 2), le(F.col("records"), 4), le(F.col("data"), 4), le(0, 2)))
    pieces = known.select("a", F.explode(F.array(F.struct(F.col("at").alias("at"), header.alias("piece")), F.struct((F.col("data") + F.col("record_at")).alias("at"), record.alias("piece")))).alias("p")).select(F.col("a").alias("archive"), "p.at", "p.piece")
    pieces = pieces.unionByName(fits.select(F.col("a").alias("archive"), (F.col("data") + F.col("records")).alias("at"), end.alias("piece")))
    # contents are shuffled once, to their places
    inside = running_totals(rows.select("a", "ord", "chunk", "size"), ["a", "ord"], ["chunk"], {"into": F.col("size")}, before=True).select("a", "ord", "chunk", "into")
    starts = known.select("a", "ord", (F.col("at") + 30 + F.col("n")).alias("data_at"))
    to = inside.join(starts, ["a", "ord"])
    data = rows.select("a", "ord", "chunk", "content").join(to, ["a", "ord", "chunk"]).select(F.col("a").alias("archive"), (F.col("data_at") + F.col("into")).alias("at"), F.col("content").alias("piece"))
    spark.dataSource.register(ZipFiles)
    every = pieces.unionByName(data).filter(F.octet_length("piece") > 0)
    with arrow_batches(spark), settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": CONTENTS}):
        every.write.format("zip_pieces").option("attempt", uuid.uuid4().hex).mode("append").save(path)
    return total.select(F.col("a").alias("archive_id"), "bytes", "entries", F.when(F.col("big"), "zipbig").alias("error_code"))
