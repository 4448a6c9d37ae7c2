"""Archives that many tasks write side by side: read back with a standard reader, over 2 GB too."""

import os
import random
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.operators import archives
from loomwork.sources import zips

R = random.Random(4)


def test_combined_checksums():
    for _ in range(30):
        parts = [R.randbytes(R.choice([0, 1, 5, 300, 70_000])) for _ in range(R.randint(0, 5))]
        assert zips.combined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_written_archives_are_those_of_one_value(spark, tmp_path):
    entries = [(a, k, f"é{k}.txt", R.randbytes(R.choice([0, 10, 5000])) if k % 4 else None) for a in ("one", "two") for k in range(40)] + [("three", 0, "only", b"")]
    df = spark.createDataFrame(entries, "archive_id string, ord int, name string, content binary").repartition(5)
    at = datetime(2026, 3, 4, 5, 6, 8)
    told = {r.archive_id: (r.bytes, r.entries, r.error_code) for r in zips.write_zips(df, f"file://{tmp_path}", at).collect()}
    for r in archives.make_zips(df, at).collect():
        assert (tmp_path / f"{r.archive_id}.zip").read_bytes() == bytes(r.content) and told[r.archive_id] == (len(r.content), 1 if r.archive_id == "three" else 40, None)
    assert sorted(os.listdir(tmp_path)) == ["one.zip", "three.zip", "two.zip"]


def test_chunks_and_limits(spark, tmp_path):
    data = [R.randbytes(1000) for _ in range(6)]
    rows = [("a", 0, k, "x" if k == 0 else None, d) for k, d in enumerate(data)] + [("a", 1, 0, "y", b"tail"), ("b", 0, 0, "large", b"z" * 5000)]
    df = spark.createDataFrame(rows, "archive_id string, ord int, chunk int, name string, content binary").repartition(4)
    told = {r.archive_id: r.error_code for r in zips.write_zips(df.filter("archive_id = 'a' or archive_id = 'b'"), f"file://{tmp_path}", max_bytes=6300).collect()}
    assert told == {"a": None, "b": None}
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and z.read("x") == b"".join(data) and z.read("y") == b"tail"
    assert {r.archive_id: r.error_code for r in zips.write_zips(df, f"file://{tmp_path}/again", max_bytes=6000).collect()} == {"a": "zipbig", "b": None}
    assert os.listdir(tmp_path / "again") == ["b.zip"]
    with pytest.raises(ValueError, match="no file name"):
        zips.write_zips(spark.createDataFrame([("a/b", 0, "n", b"")], "archive_id string, ord int, name string, content binary"), f"file://{tmp_path}")
    with pytest.raises(ValueError, match="shared folder"):
        zips.write_zips(df, "s3://bucket/x")


def test_an_archive_over_two_gigabytes(spark, tmp_path):
    mb, n = 2 << 20, 1040
    df = spark.range(n).repartition(16).select(F.lit("big").alias("archive_id"), F.floor(F.col("id") / 52).cast("int").alias("ord"), (F.col("id") % 52).cast("int").alias("chunk"), F.concat(F.lit("f"), F.floor(F.col("id") / 52).cast("string")).alias("name"), F.expr(f"cast(repeat(chr(65 + id % 26), {mb}) AS binary)").alias("content"))
    told = zips.write_zips(df, f"file://{tmp_path}").first()
    path = tmp_path / "big.zip"
    assert told.bytes == path.stat().st_size > 2**31 and told.entries == n // 52
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and [i.file_size for i in z.infolist()] == [52 * mb] * (n // 52)
        with z.open("f1") as f:
            assert f.read(mb) == b"A" * mb and f.read(1) == b"B"
    path.unlink()
