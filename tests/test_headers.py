"""Headers by ranges equal what whole contents declare, and cost some hundred bytes."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions.binary import image_kind
from loomwork.operators import guards
from loomwork.sources import files, headers
from tests.test_containers import chunk, riff
from tests.test_guards import FTYP, heif, ispe, png
from tests.test_heic import box


def test_headers_of_written_files(spark, tmp_path):
    text = chunk(b"tEXt", b"x" * 1_000_000)
    frame = chunk(b"fcTL", b"\0\0\0\0" + (9000).to_bytes(4, "big") + (9000).to_bytes(4, "big") + b"\0" * 14)
    cases = {
        "a.png": png(40, 50, text, text, frame), "b.png": png(40, 50, text)[:-3], "c.heic": FTYP + box(b"mdat", b"y" * 500_000) + heif(ispe(30, 20))[len(FTYP) :], "d.jpg": b"\xff\xd8" + b"z" * 100_000, "e.webp": riff((b"VP8 ", b"w" * 3000)),
        "f.txt": b"nothing", "g.bin": None,
    }
    where = f"file://{tmp_path}/images"
    rows = spark.createDataFrame(list(cases.items()), "name string, content binary").repartition(3)
    assert {r.name: r.length for r in files.write(rows, where).collect()} == {k: len(v or b"") for k, v in cases.items()}
    whole = guards.declared(files.scan(spark, where)).withColumn("kind", image_kind(F.col("content")))
    told = lambda df: {r.path.rpartition("/")[2]: (r.length, r.kind, r.declared_pixels, r.allowed) for r in df.collect()}
    got = headers.image_headers(spark, where)
    # a scan for contents passes over empty files
    assert told(got) == {**told(whole), "g.bin": (0, None, None, None)}
    cost = {r.path.rpartition("/")[2]: r.bytes_read for r in got.collect()}
    assert max(cost.values()) < 600 and cost["a.png"] > 512 and cost["d.jpg"] == 512 and cost["f.txt"] == 7
    assert headers.image_headers(spark, where, ending=".png").count() == 2


def test_headers_of_nothing(spark, tmp_path):
    assert headers.image_headers(spark, f"file://{tmp_path}").count() == 0
    with pytest.raises(Exception, match="not a file's name"):
        files.write(spark.createDataFrame([("a/b", b"")], "name string, content binary"), f"file://{tmp_path}/x")


def test_partitions_by_bytes(tmp_path, monkeypatch):
    for i in range(10):
        (tmp_path / f"{i}.png").write_bytes(b"x" * 1000)
    monkeypatch.setattr(headers, "PARTITION", 3 * (headers.OPENING + headers.HEAD))
    parts = headers.HeaderReader({"path": f"file://{tmp_path}"}).partitions()
    assert [len(p.files) for p in parts] == [3, 3, 3, 1]
