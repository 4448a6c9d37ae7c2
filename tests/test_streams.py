"""The recorder in pieces and on a stream, and a feed that is refreshed with failures, repeats and restarts."""

import json
import random

from pyspark.sql import functions as F

from loomwork.plans import edge_queries
from loomwork.shared import settings
from loomwork.sources import feeds
from loomwork.streaming import recorder
from loomwork.streaming.refresh import ATTEMPT, LatestTable, Source, refresh, refresh_step

R = random.Random(9)
KINDS = ["start", "granted", "chunk", "pause", "resume", "stop", "flushed", "abort", "error", "denied", "ended", "odd"]


def session(n, seed):
    r = random.Random(seed)
    return [(t * 3 + r.randint(0, 2), r.choice(KINDS[: r.choice([5, 12])]), r.randint(0, 9)) for t in range(n)]


def one_by_one(events):
    held = ("idle", 0, 0, 0, False, 0, "", 0)
    for e in sorted(events):
        held = recorder._advance(held, *e)
    state, us, _, size, bad = held[:5]
    return state, us / 1e6, size, ("failed" if bad or not size else "ok") if state == "done" else None


def frame(spark, sessions):
    rows = [(s, t, k, n) for s, es in sessions.items() for t, k, n in es]
    return spark.createDataFrame(rows, "session string, t long, kind string, size long").select("session", F.timestamp_micros("t").alias("at"), "kind", "size")


def test_pieces_of_any_size_give_the_fold(spark, monkeypatch):
    sessions = {f"s{i}": session(R.choice([1, 5, 40, 700]), i) for i in range(40)} | {"rec": [(1, "start", 0), (2, "granted", 0)] + [(t, "chunk", 1) for t in range(3, 900)]}
    want = {s: one_by_one(es) for s, es in sessions.items()}
    for piece, fan in ((4096, 512), (7, 3)):
        monkeypatch.setattr(recorder, "PIECE", piece)
        monkeypatch.setattr(recorder, "FAN", fan)
        got = recorder.recordings(frame(spark, sessions).repartition(6)).collect()
        assert {r.session: (r.state, r.seconds, r.bytes, r.outcome) for r in got} == want


def test_a_very_long_session(spark):
    n = 1_000_000
    e = spark.range(n).select(F.lit("hot").alias("session"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") == 0, "start").when(F.col("id") == 1, "granted").when(F.col("id") % 1000 == 500, "pause").when(F.col("id") % 1000 == 600, "resume").otherwise("chunk").alias("kind"), F.lit(1).alias("size"))
    got = recorder.recordings(e).first()
    assert (got.state, got.bytes) == ("rec", n - 2 - 2000)
    # 1000 pauses of 100 seconds each lie between the grant and the last resume
    assert got.seconds == 999_500 - 1 - 999 * 100


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_after_a_restart_gives_the_batch_rows(spark, tmp_path):
    lives = {
        "whole": [(1, "start", 0), (2, "granted", 0), (3, "chunk", 5), (9, "pause", 0), (12, "resume", 0), (14, "chunk", 6), (20, "stop", 0), (21, "flushed", 0)],
        "open": [(1, "start", 0), (2, "granted", 0), (30, "chunk", 1)],
        "bad": [(5, "start", 0), (6, "granted", 0), (7, "error", 0), (8, "flushed", 0)],
    }
    late = [("open", 2, "granted", 0), ("whole", 3, "chunk", 5)]  # come again
    rows = [(s, t * 1_000_000, k, n) for s, es in lives.items() for t, k, n in es]
    source, schema = str(tmp_path / "in"), "session string, t long, kind string, size long"
    rows.sort(key=lambda r: r[1])

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)

    def drain():
        stream = spark.readStream.schema(schema).json(source).select("session", F.timestamp_micros("t").alias("at"), "kind", "size")
        out = recorder.record_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        got = []
        run(out.foreachBatch(lambda df, i: got.extend(df.collect())).trigger(availableNow=True).start())
        return {r.session: (r.state, r.seconds, r.bytes, r.outcome) for r in got}

    arrive(rows[:9])
    state = drain()
    arrive(rows[9:] + [(s, t * 1_000_000, k, n) for s, t, k, n in late])
    state |= drain()
    want = recorder.recordings(frame(spark, {s: [(t * 1_000_000, k, n) for t, k, n in es] for s, es in lives.items()})).collect()
    assert state == {r.session: (r.state, r.seconds, r.bytes, r.outcome) for r in want}


def test_stream_flushes_what_stopped(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "session string, t long, kind string, size long"
    first = [("s", 1, "start", 0), ("s", 2, "granted", 0), ("s", 3, "chunk", 4), ("s", 4, "stop", 0)]
    spark.createDataFrame([(s, t * 1_000_000, k, n) for s, t, k, n in first], schema).coalesce(1).write.json(source)
    got = []

    def drain():
        stream = spark.readStream.schema(schema).json(source).select("session", F.timestamp_micros("t").alias("at"), "kind", "size")
        out = recorder.record_stream(stream, late="1 second", flush_after=10).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        run(out.foreachBatch(lambda df, i: got.extend(df.collect())).trigger(availableNow=True).start())

    drain()
    assert got[-1].state == "stopping"
    spark.createDataFrame([("other", 100_000_000, "start", 0)], schema).coalesce(1).write.mode("append").json(source)
    drain()
    assert {(r.session, r.state, r.seconds, r.outcome) for r in got if r.session == "s"} >= {("s", "done", 2.0, "ok")}


def attempt(source, at, events):
    return source, at, None if events is None else json.dumps({"events": events})


SCORES = lambda ids, name: [{"id": str(i), "date": "2026-06-11T19:00Z", "status": {"type": {"name": name, "state": "in"}}} for i in ids]
SEASON = lambda ids: [{"idEvent": str(i), "strTimestamp": "2026-06-11T19:00:00", "strStatus": "FT"} for i in ids]
COLUMNS = ("fetched", "source", "id", "utcDate", "status")
SOURCES = [Source("one", feeds.SCOREBOARD, lambda p: feeds.scoreboard(p).select(*COLUMNS)), Source("two", feeds.SEASON, lambda p: feeds.season(p).select(*COLUMNS))]
TICKS = [
    [attempt("one", 0, None), attempt("two", 0, SEASON(range(8)))],  # the second source stands in
    [attempt("one", 60, SCORES([0], "STATUS_HALFTIME"))],  # still fresh: not looked at
    [attempt("one", 95, None), attempt("two", 95, None)],  # both fail
    [attempt("one", 105, SCORES([1], "STATUS_HALFTIME"))],  # too soon after the failure
    [attempt("one", 116, SCORES([2, 3, 99], "STATUS_HALFTIME")), attempt("two", 116, SEASON([5]))],
    [attempt("one", 300, []), attempt("two", 300, SEASON([6]))],  # an empty list is an answer
]
WANT = {(str(i), "two", "FINISHED") for i in (0, 1, 4, 5, 6, 7)} | {(str(i), "one", "PAUSED") for i in (2, 3, 99)}


def given(spark, rows):
    return spark.createDataFrame([(s, t, p) for s, t, p in rows], "source string, t long, payload string").select("source", F.timestamp_seconds("t").alias("fetched"), "payload")


def told(table):
    return {(r.id, r.source, r.status) for r in table.rows().collect()}


def test_refreshes_with_failures_and_repeats(spark, tmp_path):
    table = LatestTable(spark, f"file://{tmp_path}/table", buckets=4)
    assert table.rows() is None and not table.fresh(0)
    step = refresh_step(table, SOURCES)
    for k, tick in enumerate(TICKS):
        step(given(spark, tick), k)
        step(given(spark, TICKS[0][:1] + [attempt("two", 10_000, SEASON([1234]))]), k)  # the batch comes again
    assert told(table) == WANT
    head = table.head()
    assert (head["batch"], head["good"], head["due"]) == (5, 300_000_000, 390_000_000)
    assert table.fresh(389_000_000) and not table.fresh(390_000_000)
    assert table.vacuum() > 0 and told(table) == WANT and table.vacuum() == 0


def test_refresh_as_a_stream_with_a_restart(spark, tmp_path):
    table = LatestTable(spark, f"file://{tmp_path}/table", buckets=4)
    source = str(tmp_path / "in")

    def drain():
        stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).json(source)
        run(refresh(stream, table, SOURCES, str(tmp_path / "cp")).trigger(availableNow=True).start())

    for k, tick in enumerate(TICKS):
        given(spark, tick).coalesce(1).write.mode("append").json(source)
        if k in (2, 5):
            drain()
    assert told(table) == WANT


def test_many_ticks_in_one_batch(spark, tmp_path):
    table = LatestTable(spark, f"file://{tmp_path}/table")
    refresh_step(table, SOURCES)(given(spark, [a for tick in TICKS for a in tick]), 0)
    assert told(table) == WANT


def test_no_task_holds_a_whole_attempt_or_bucket(spark, tmp_path, monkeypatch):
    """Payloads of a tick are written by many tasks and taken in one trigger; a bucket is written by many tasks where the session is wide."""
    monkeypatch.setattr(edge_queries, "scratch", lambda s, name: f"file://{tmp_path}/{name}")
    with settings(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}):
        got = edge_queries.refreshed(spark, "/root/testdata/sf0.001")
        assert got.groupBy("source").count().count() == 2 and got.count() == got.select("id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert len(list((tmp_path / "attempts").glob("*.json"))) > 40
    assert len(list((tmp_path / "table" / "rows" / "batch=0").rglob("*.parquet"))) > 16
