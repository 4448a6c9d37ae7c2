import io
import math
import zipfile
import zlib

from pyspark.sql import functions as F

from loomwork.functions import binary, gamma, names
from loomwork.operators import archives, sealing
from loomwork.sources import feeds


def test_names_do_not_collide():
    assert archives.distinct_names(["a.x", "a.x", "a(2).x", "b", "b"]) == ["a.x", "a(2).x", "a(2)(2).x", "b", "b(2)"]


def test_zip_reads_back():
    entries = [("é.txt", b"one"), ("empty", b"")]
    with zipfile.ZipFile(io.BytesIO(archives.zip_bytes(entries))) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == entries


def test_checksum_is_zlibs(spark):
    assert spark.sql("SELECT crc32(X'00FF41') AS c").first().c == zlib.crc32(b"\x00\xffA")


def test_gamma_against_closed_forms(spark):
    xs = [0.01, 0.5, 1.0, 2.5, 9.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", gamma.gamma_p(F.lit(1.0), F.col("x"), F.lit(0.0)).alias("one"), gamma.gamma_p(F.lit(0.5), F.col("x"), F.lit(math.lgamma(0.5))).alias("half")).collect()
    for r in got:
        assert abs(r.one - (1 - math.exp(-r.x))) < 1e-12 and abs(r.half - math.erf(math.sqrt(r.x))) < 1e-12


def test_page_ranges(spark):
    cases = {"1-3, 7": ([0, 1, 2, 6], None, False), "": None, "-": (list(range(10)), None, False), "3–1": ([2, 1, 0], None, False), "1，2；2": ([0, 1, 1], None, False), "x,99": None, "99,x": (None, 99, False), "0": None, "8-": ([7, 8, 9], None, False)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", names.page_ranges(F.col("t"), F.lit(10)).alias("r"))
    assert {r.t: r.r and (r.r.indices, r.r.over, r.r.many) for r in df.collect()} == cases
    assert spark.range(1).select(names.page_ranges(F.lit("-"), F.lit(5000)).alias("r")).first().r.many


def test_signatures(spark):
    for key, sig in binary.MAGIC:
        assert spark.range(1).select(binary.payload_kind(F.lit(bytes.fromhex(sig) + b"\x00")).alias("k")).first().k == key


def test_sealed_container(spark):
    one = spark.range(1).select(F.lit(b"data").alias("d"))
    s = sealing.seal(one, F.col("d"), F.lit("a/b.txt"), F.lit(""), F.lit("pw"), F.lit(b"s" * 16), F.lit(b"n" * 12), 10).drop("error_code")
    r = sealing.unseal(s, F.col("container"), F.lit("pw"), 10).first()
    assert (r.name, r.type, bytes(r.bytes), r.error_code) == ("a_b.txt", "application/octet-stream", b"data", None)
    assert sealing.unseal(s, F.lit(b"SNSE1"), F.lit("pw"), 10).first().error_code == "magic"
    assert sealing.unseal(s, F.col("container"), F.lit("no"), 10).first().error_code == "pass"


def test_standings(spark):
    text = '{"children":[{"standings":{"entries":[{"team":{"id":"1","name":"X"},"stats":[{"name":"wins","value":1},{"name":"wins","value":2}]},{"team":{"id":"2"}}]}},{"name":"Group B"}]}'
    got = feeds.standings(spark.createDataFrame([(text,)], "payload string")).collect()
    assert [(r.group, r.team, r.won, r.pos) for r in got] == [("Group", "X", 2, 0), ("Group", "?", 0, 0)]
