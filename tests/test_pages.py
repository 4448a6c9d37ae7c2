"""Caps, page lists, routes, whole files, archives, standings, fallback and recordings on small tables."""

import io
import struct
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import gamma
from loomwork.functions import matches as M
from loomwork.operators import archives, containers, guards, intervals, pages, pixels
from loomwork.plans import table_queries
from loomwork.sources import feeds, files
from loomwork.streaming import recorder
from tests.test_guards import png


def exif(turn, order="<", tag=0x0112, magic=42, at=8):
    head = b"II" if order == "<" else b"MM"
    tiff = head + struct.pack(order + "HIHHHIHHI", magic, at, 1, tag, 3, 1, turn, 0, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def test_jpeg_turn():
    start = b"\xff\xd8\xff\xe0\0\4ab"
    cases = [
        (start + exif(6), 6), (start + exif(3, ">"), 3), (start + exif(9), 1), (start + exif(0), 1), (start + exif(6, tag=0x0100), 1), (start + exif(6, magic=43), 1), (start + exif(6, at=200), 1), (start + b"\xff\xff" + exif(8)[1:], 8),
        (start + b"\xff\xda" + exif(6), 1), (start + exif(6)[:-12], 1), (b"\xff\xd8", 1), (b"\xff\xd8\0\0\0\0", 1), (start + exif(6)[:12] + b"XX" + exif(6)[14:], 1), (start + exif(5) + exif(6), 5),
    ]
    for content, turn in cases:
        assert containers.jpeg_turn(content) == turn
        for cut in range(len(content)):
            assert 1 <= containers.jpeg_turn(content[:cut]) <= 8


def test_routes(spark):
    cases = [(b"\xff\xd8\xff\xe0\0\4ab" + exif(6), "jpeg", None), (b"\xff\xd8\xff\xd9", "asis", None), (png(4, 4), "asis", None), (png(9000, 9000), None, "pixels"), (png(0, 4), None, "img"), (b"GIF89a", "png", None), (b"?", None, "img"), (None, None, "img")]
    df = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(cases)], "k int, content binary")
    assert [(r.route, r.error_code) for r in pages.routed(df).orderBy("k").collect()] == [c[1:] for c in cases]
    assert pages.routed(df.limit(0)).count() == 0


def test_whole_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(png(4, 5))
    (tmp_path / "two.png").write_bytes(b"\x89PNG" + b"\0" * 40)
    (tmp_path / "large.png").write_bytes(b"x" * 500)
    (tmp_path / "other.txt").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path), "*.png", most=400)
    got = {r.path.rpartition("/")[2]: r for r in guards.declared(containers.clean(found)).collect()}
    assert {n: (r.outcome, r.declared_pixels, r.error_code) for n, r in got.items()} == {"one.png": ("ok", 20, None), "two.png": ("corrupt", None, None), "large.png": ("unsupported", None, "big")} and got["large.png"].content is None


def test_caps_and_lists(spark):
    df = spark.createDataFrame([("a", k, 5) for k in range(21)] + [("b", 0, None), ("b", 1, 101 << 20), ("c", 0, 100 << 20)], "call string, k int, size long")
    assert {r.call: (r.files, r.over, r.error_code) for r in pages.capped(df, "call", F.col("size")).collect()} == {"a": (21, 0, "many"), "b": (2, 1, "big"), "c": (1, 0, None)}
    one, two = df.filter("call = 'b'").select("call", "k", "size"), df.filter("call = 'b'").select("call", "k", "size")
    both = pages.appended(one, two, key="call", order="k")
    assert [(r.src, r.k, r.ord) for r in both.orderBy("ord").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)]
    assert [(r.pages, r.many) for r in pages.running_pages(both, "call", F.lit(900)).orderBy("ord").collect()] == [(900, False), (1800, False), (2700, True), (3600, True)]


def test_geometry(spark):
    row = spark.range(1).select(pages.fit_a4(F.lit(100.0), F.lit(400.0)).alias("f"), pages.fit_a4(F.lit(0.0), F.lit(1.0)).alias("none"), pages.page_of(F.lit(40_000.0), F.lit(100.0)).alias("p"), pages.to_points(F.lit(30.0), F.lit(60.0), F.lit(2.0), F.lit(800.0)).alias("t")).first()
    assert abs(row.f.h - 769.89) < 1e-9 and abs(2 * row.f.x + row.f.w - 595.28) < 1e-9 and row.none is None
    assert (row.p.w, row.p.h, row.t.x, row.t.y) == (14_400.0, 36.0, 15.0, 770.0)


def test_zips(spark):
    rows = [(1, 0, "é.txt", b"one"), (1, 1, "b", None), (2, 0, "c", b"x")]
    df = spark.createDataFrame(rows, "archive_id int, ord int, name string, content binary")
    got = {r.archive_id: r for r in archives.make_zips(df, datetime(2024, 3, 5, 7, 9, 11)).collect()}
    with zipfile.ZipFile(io.BytesIO(got[1].content)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == [("é.txt", b"one"), ("b", b"")] and z.infolist()[0].date_time == (2024, 3, 5, 7, 9, 10)
    many = df.filter("archive_id = 2").crossJoin(spark.range(65_536)).select("archive_id", F.col("id").alias("ord"), "name", "content")
    out = archives.make_zips(many.unionByName(df.filter("archive_id = 1"))).collect()
    assert {(r.archive_id, r.error_code, r.content is None) for r in out} == {(1, None, False), (2, "zipbig", True)}
    named = archives.dedupe_names(df.withColumn("name", F.lit("n")), "archive_id", "ord", "name", most=1).collect()
    assert {(r.archive_id, r.ord, r.unique_name) for r in named} == {(1, 0, None), (1, 1, None), (2, 0, "n")}


def test_standings_in_order(spark):
    team = lambda i, rank: f'{{"team":{{"id":"{i}","name":"T{i}"}},"stats":[{{"name":"rank","value":{rank}}}]}}'
    text = f'{{"children":[{{"name":"b","standings":{{"entries":[{team(1, 2)},{team(2, 1)},{team(3, 2)}]}}}},{{"name":"A","standings":{{"entries":[{team(1, 1)}]}}}},{{"standings":{{"entries":[{team(4, 1)},{team("", 2)}]}}}}]}}'
    table = feeds.standings(spark.createDataFrame([(text,)], "payload string"))
    assert [(r.group, [t.team for t in r.table]) for r in feeds.nested(table).collect()] == [("A", ["T1"]), ("b", ["T2", "T1", "T3"]), ("Group", ["T4", "T"])]
    assert {r.team_id: r.label for r in feeds.group_index(table).collect()} == {"1": "A", "2": "b", "3": "b", "4": ""}


def test_fallback(spark):
    none, empty = (spark.createDataFrame([(t,)], "payload string") for t in ('{"events": 3}', '{"events": []}'))
    some = spark.createDataFrame([('{"events": [{"idEvent": "7"}]}',)], "payload string")
    second = (some, feeds.SEASON, feeds.season)
    assert feeds.first_available((none, feeds.SCOREBOARD, feeds.scoreboard), second).count() == 1
    assert feeds.first_available((empty, feeds.SCOREBOARD, feeds.scoreboard), second).count() == 0
    assert feeds.first_available((none, feeds.SCOREBOARD, feeds.scoreboard)) is None


def test_labels_fail_softly(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in {
        "bad": M.date_label(F.lit(None).cast("timestamp"), F.lit("nonsense text")), "none": M.date_label(F.lit(None).cast("timestamp"), F.lit(None).cast("string"), "No/Where"), "clock": M.time_label(F.lit(None).cast("timestamp")),
        "off": M.days_from(F.lit(None).cast("timestamp"), F.lit("x"), F.lit("2026-01-01").cast("timestamp")), "near": M.near_today(F.lit(None).cast("timestamp"), F.lit("x"), F.lit("2026-01-01").cast("timestamp")), "days": M.in_days(F.lit(""), F.array(F.lit(""))),
    }.items()]).first()
    assert (row.bad, row.none, row.clock, row.off, row.near, row.days) == ("Invalid Date", "", "Invalid Date", None, False, False)


def test_points_before_the_cut(spark):
    points = spark.createDataFrame([(1, 5), (1, 20)], "f int, at long")
    gone = spark.createDataFrame([(1, 10, 4)], "f int, start long, len long")
    assert {(r.at, r.moved, r.error_code) for r in intervals.rebased(points, gone, "f", 7, cut=10).collect()} == {(5, None, "offset"), (20, 23, None)}


def test_recordings(spark):
    lives = {
        "twice": ["start", "granted", "chunk", "pause", "pause", "resume", "chunk", "stop", "stop", "ended", "chunk", "flushed", "chunk"], "voided": ["start", "abort", "granted", "chunk"], "denied": ["start", "denied"], "broken": ["start", "granted", "chunk", "error", "flushed"],
        "empty": ["start", "granted", "stop", "flushed"], "frozen": ["start", "granted", "pause", "stop", "flushed"], "open": ["start", "granted", "chunk"],
    }
    rows = [(s, t, k, 10) for s, kinds in lives.items() for t, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "session string, t int, kind string, size long").selectExpr("session", "timestamp_seconds(t) AS at", "kind", "size")
    got = {r.session: (r.state, r.seconds, r.bytes, r.outcome) for r in recorder.recordings(df).collect()}
    assert got == {
        "twice": ("done", 4.0, 30, "ok"), "voided": ("idle", 0.0, 0, None), "denied": ("idle", 0.0, 0, None), "broken": ("done", 2.0, 10, "failed"), "empty": ("done", 1.0, 0, "failed"), "frozen": ("done", 1.0, 0, "failed"), "open": ("rec", 0.0, 10, None),
    }
    assert recorder.recordings(df.limit(0)).count() == 0


def test_tails_in_numpy(spark):
    r = np.random.default_rng(1)
    df = r.integers(-1, 128, 400)
    chi2 = np.where(r.random(400) < 0.1, 0.0, r.gamma(2, 40, 400))
    want = spark.createDataFrame([(float(c), int(d)) for c, d in zip(chi2, df)], "c double, d int").select(gamma.chi_square_tail(F.col("c"), F.col("d")).alias("p")).toPandas()["p"]
    assert np.abs(gamma.chi_square_tails(chi2, df) - want).max() < 1e-11


@pytest.mark.parametrize("opaque, last", [(True, None), (False, 4)])
def test_channel_verdicts(spark, opaque, last):
    r = np.random.default_rng(2)
    px = r.integers(0, 256, (4000, 4), dtype=np.uint8)
    px[:, 0] = 7
    px[:, 3] = 255 if opaque else r.integers(0, 2, 4000)
    df = spark.createDataFrame([(1, px.tobytes()), (2, b""), (3, None)], "i int, b binary")
    got = pixels.channel_verdicts(df, "i", F.col("b")).collect()
    assert [x.i for x in got] == [1] and got[0].has_alpha is (not opaque) and len(got[0].ratios) == (3 if opaque else 4)
    assert np.allclose(got[0].ratios, [(px[:, c] % 2).mean() for c in range(3 if opaque else 4)]) and 0 < got[0].max_p <= 1


def test_per_mille_of_an_exact_half(spark, tmp_path):
    """1,001 of 2,000 odd values are 500.5 per mille, though their share times 1000 is less."""
    assert 1001 / 2000 * 1000 < 500.5
    # green has 1,001 odd values, red and blue have 1,000
    px = ["ba"[k % 2] + "ba"[k < 1001] + "ba"[k % 2] + "b" for k in range(2000)]
    spark.createDataFrame([(1, "".join(px))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert table_queries.channel_verdicts(spark, str(tmp_path)).first().odd_per_mille == "500,501,500,0"
