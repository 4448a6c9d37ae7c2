"""The recorder's states: sessions folded in pieces that merge, in batches and on a stream.

An event is a map from the state before it to the state after it, with the time recorded
and the bytes gained on the way.  Such maps compose, and how they are bracketed does not
matter, so a session of any length is folded piece by piece, and the pieces' maps are
composed level by level, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from loomwork.operators.prefix import running_totals
from loomwork.shared import free_name

#: Where an event leads from each state; an event that a state does not list changes nothing.
TURNS = {
    "idle": {"start": "asking"}, "asking": {"granted": "rec", "denied": "idle", "abort": "idle"}, "rec": {"pause": "paused", "stop": "stopping", "abort": "stopping", "ended": "stopping", "error": "stopping"},
    "paused": {"resume": "rec", "stop": "stopping", "abort": "stopping", "ended": "stopping", "error": "stopping"}, "stopping": {"flushed": "done"}, "done": {},
}
STATES = list(TURNS)
#: Events of a piece, and maps that are composed at once.
PIECE, FAN = 4096, 512
#: States in which chunks count, and those in which an error is one of the recording.
TAKING, AT_WORK = ("rec", "paused", "stopping"), ("rec", "paused")


def _stepped(a: Column, e: Column) -> Column:
    """What an event (t, k, n) makes of (state, us, since, owes, bytes, bad).

    A null ``since`` is that of the state before the piece; where such a recording ends,
    the map ``owes`` it.
    """
    turns = F.create_map(*[F.lit(x) for s, to in TURNS.items() for k, b in to.items() for x in (f"{s} {k}", b)])
    now = F.coalesce(turns[F.concat_ws(" ", a["state"], e["k"])], a["state"])
    leaves, enters = (a["state"] == "rec") & (now != "rec"), (now == "rec") & (a["state"] != "rec")
    return F.struct(
        now.alias("state"), (a["us"] + F.when(leaves, e["t"] - F.coalesce(a["since"], F.lit(0))).otherwise(0)).alias("us"), F.when(enters, e["t"]).otherwise(a["since"]).alias("since"),
        (a["owes"] | (leaves & a["since"].isNull())).alias("owes"), (a["bytes"] + F.when((e["k"] == "chunk") & a["state"].isin(*TAKING), e["n"]).otherwise(0)).alias("bytes"),
        (a["bad"] | (F.coalesce(e["k"] == "error", F.lit(False)) & a["state"].isin(*AT_WORK))).alias("bad"),
    )


def _start() -> Column:
    """The map that changes nothing: each state leads to itself."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return F.array(*[F.struct(F.lit(s).alias("state"), zero.alias("us"), F.lit(None).cast("long").alias("since"), no.alias("owes"), zero.alias("bytes"), no.alias("bad")) for s in STATES])


def folded(events: Column) -> Column:
    """The map of an array of events (t, k, n) in order."""
    return F.aggregate(events, _start(), lambda acc, e: F.transform(acc, lambda a: _stepped(a, e)))


def composed(first: Column, then: Column) -> Column:
    """The map of two pieces one after the other."""
    number = F.create_map(*[x for i, s in enumerate(STATES) for x in (F.lit(s), F.lit(i))])

    def follow(a: Column) -> Column:
        b = F.get(then, number[a["state"]])
        return F.struct(
            b["state"].alias("state"), (a["us"] + b["us"] - F.when(b["owes"], F.coalesce(a["since"], F.lit(0))).otherwise(0)).alias("us"), F.coalesce(b["since"], a["since"]).alias("since"),
            (a["owes"] | (b["owes"] & a["since"].isNull())).alias("owes"), (a["bytes"] + b["bytes"]).alias("bytes"), (a["bad"] | b["bad"]).alias("bad"),
        )

    return F.transform(first, follow)


def recordings(events: DataFrame, key: str = "session", at: str = "at", kind: str = "kind", size: str = "size") -> DataFrame:
    """(key, state, seconds, bytes, outcome) of each session, folded over its events in order of time.

    Time runs in state rec only, and stands still from the first stop on: later stops,
    ends and errors change nothing.  Chunks count until the session is done; an abort
    while permission is asked for leaves it idle.  outcome is null before ``done``, then
    ``failed`` after an error or without a byte, else ``ok``.  Ties go by kind and size;
    null sizes are 0 bytes.  Many tasks share a session; none holds more than PIECE events
    or FAN maps of it.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    told = events.select(F.col(key).alias("key"), micros.alias("t"), F.col(kind).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    ranked = running_totals(told, ["key"], ["t", "k", "n"], {"piece": F.lit(1).cast("long")}).withColumn("piece", F.expr(f"(piece - 1) div {PIECE}"))
    top = ranked.agg(F.max("piece")).first()[0] or 0
    maps = ranked.groupBy("key", "piece").agg(folded(F.sort_array(F.collect_list(F.struct("t", "k", "n")))).alias("map"))
    while top:
        top //= FAN
        held = F.sort_array(F.collect_list(F.struct("piece", "map")))
        joined = F.aggregate(held, _start(), lambda acc, x: composed(acc, x["map"]))
        maps = maps.withColumn("up", F.expr(f"piece div {FAN}")).groupBy("key", "up").agg(joined.alias("map")).withColumnRenamed("up", "piece")
    whole = maps.select(F.col("key").alias(key), F.get("map", F.lit(0)).alias("s"))
    return whole.select(key, "s.state", (F.col("s.us") / 1_000_000).alias("seconds"), "s.bytes", outcome(F.col("s.state"), F.col("s.bad"), F.col("s.bytes")).alias("outcome"))


def outcome(state: Column, bad: Column, size: Column) -> Column:
    return F.when(state == "done", F.when(bad | (size == 0), "failed").otherwise("ok"))


HELD = "state string, us long, since long, bytes long, bad boolean, t long, k string, n long"


def _advance(held: tuple, t: int, k: str, n: int) -> tuple:
    """The held state after one event, for the stream: the same step as _stepped."""
    state, us, since, size, bad, *_ = held
    now = TURNS[state].get(k, state)
    size += n if k == "chunk" and state in TAKING else 0
    bad = bad or (k == "error" and state in AT_WORK)
    us += t - since if state == "rec" != now else 0
    since = t if now == "rec" != state else since
    return now, us, since, size, bad, t, k, n


def record_stream(events: DataFrame, late: str = "10 minutes", flush_after: int = 60, key: str = "session", at: str = "at", kind: str = "kind", size: str = "size") -> DataFrame:
    """The row of recordings() of each session that changed, from a stream of events (update mode).

    State lives in the query's state store, a few numbers a session.  Events no later than
    the last of their session are ignored: they are late or came again.  A session that
    stops and isn't flushed is flushed ``flush_after`` seconds of event time later.  ``at``
    is a timestamp; the watermark lags ``late`` behind.
    """
    taken = (at, key, kind, size)
    t, n = free_name("t", *taken), free_name("n", *taken)
    rows = events.withWatermark(at, late).select(key, at, F.unix_micros(at).alias(t), F.col(kind).alias("kind"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(n))
    out = T.StructType([events.schema[key]]).add("state", "string").add("seconds", "double").add("bytes", "long").add("outcome", "string")

    def run(name: tuple, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        held = store.get if store.exists else ("idle", 0, 0, 0, False, -(2**62), "", 0)
        if store.hasTimedOut:
            held = _advance(held, held[5], "flushed", 0)
        else:
            came = sorted({(int(a), b or "", int(c)) for pdf in frames for a, b, c in zip(pdf[t], pdf["kind"], pdf[n])})
            for e in came:
                if e > held[5:]:
                    held = _advance(held, *e)
            if held[0] == "stopping":
                due = held[5] // 1000 + 1000 * flush_after
                if due <= store.getCurrentWatermarkMs():
                    held = _advance(held, held[5], "flushed", 0)
                else:
                    store.setTimeoutTimestamp(due)
        store.update(held)
        state, us, _, bytes_, bad = held[:5]
        told = ("failed" if bad or not bytes_ else "ok") if state == "done" else None
        yield pd.DataFrame([(*name, state, us / 1_000_000, bytes_, told)], columns=out.names)

    return rows.groupBy(key).applyInPandasWithState(run, out, HELD, "update", "EventTimeTimeout")
