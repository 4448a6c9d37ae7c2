"""Queries of the match schedule: events stand for matches, nations for teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import matches as M
from loomwork.operators import schedule
from loomwork.sources import feeds


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The raw status name and state that each event type stands for.
RAW_NAME = "CASE event_type WHEN 'click' THEN 'STATUS_HALFTIME' WHEN 'error' THEN 'STATUS_ABANDONED' ELSE 'STATUS_X' END"
RAW_STATE = "CASE event_type WHEN 'view' THEN 'in' WHEN 'purchase' THEN 'post' ELSE 'pre' END"
SQL_STATUS = "CASE event_type WHEN 'click' THEN 'PAUSED' WHEN 'error' THEN 'SUSPENDED' WHEN 'view' THEN 'IN_PLAY' WHEN 'purchase' THEN 'FINISHED' ELSE 'SCHEDULED' END"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ev.select(F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.col("ts").alias("kickoff"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"), M.feed_status(F.expr(RAW_NAME), F.expr(RAW_STATE)).alias("status"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    s = F.col("status")
    return m.select("id", "status", M.badge(s).alias("badge"), M.has_score(s).alias("scored"), M.is_live(s).alias("live"), M.is_upcoming(s).alias("upcoming"))


STATUS_SQL = f"""
WITH m AS (SELECT event_id AS id, {SQL_STATUS} AS status FROM events)
SELECT id, status, CASE status WHEN 'IN_PLAY' THEN 'LIVE' WHEN 'PAUSED' THEN 'HT' WHEN 'FINISHED' THEN 'FT' WHEN 'SUSPENDED' THEN 'SUSP' END AS badge,
  status IN ('IN_PLAY', 'PAUSED', 'FINISHED', 'SUSPENDED') AS scored, status IN ('IN_PLAY', 'PAUSED') AS live, status = 'SCHEDULED' AS upcoming FROM m
"""


def day_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day keys, date and time labels in a zone, in none, and in one that does not exist."""
    m = matches(spark, sf_dir)
    kick, raw = F.col("kickoff"), F.col("utcDate")
    return m.select(
        "id", M.day_key(kick, raw, "Asia/Tokyo").alias("tokyo"), M.day_key(kick, raw, "No/Where").alias("nowhere"), M.date_label(kick, raw).alias("label"), M.time_label(kick).alias("clock"),
        M.date_label(kick, raw, "Asia/Tokyo").alias("tokyo_label"), M.time_label(kick, "Asia/Tokyo").alias("tokyo_clock"), M.date_label(kick, raw, "No/Where").alias("no_label"), M.time_label(kick, "No/Where").alias("no_clock"),
    )


DAY_SQL = """SELECT event_id AS id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS tokyo, strftime(ts, '%Y-%m-%d') AS nowhere,
 strftime(ts, '%a, %b ') || CAST(day(ts) AS VARCHAR) AS label, strftime(ts, '%I:%M %p') AS clock,
 strftime(ts + INTERVAL 9 HOUR, '%a, %b ') || CAST(day(ts + INTERVAL 9 HOUR) AS VARCHAR) AS tokyo_label, strftime(ts + INTERVAL 9 HOUR, '%I:%M %p') AS tokyo_clock,
 strftime(ts, '%Y-%m-%d') AS no_label, '' AS no_clock FROM events"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    day = M.day_key(F.col("kickoff"), F.col("utcDate"), "Asia/Tokyo")
    return schedule.by_day(m, day).select("day", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


DAYS_SQL = """SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids
FROM events GROUP BY 1"""


def window_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose text is of the days around the last instant, and how they lie to it in a zone."""
    last = read(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    m = matches(spark, sf_dir).crossJoin(F.broadcast(last))  # with one row
    m = m.withColumn("window", M.utc_window(F.col("now"))).filter(M.in_days(F.col("utcDate"), F.col("window.days")))
    off = M.days_from(F.col("kickoff"), F.col("utcDate"), F.col("now"), "Asia/Tokyo")
    near = M.near_today(F.col("kickoff"), F.col("utcDate"), F.col("now"), "Asia/Tokyo")
    return m.select("id", "utcDate", (off == 0).alias("today"), (off == 1).alias("tomorrow"), (off == -1).alias("yesterday"), near.alias("near"), F.col("window.fetch_range").alias("fetch_range"))


WINDOW_SQL = """
WITH d AS (SELECT CAST(max(ts) AS DATE) AS d, CAST(max(ts) + INTERVAL 9 HOUR AS DATE) AS j FROM events), e AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) - j AS off FROM events, d)
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "utcDate", off = 0 AS today, off = 1 AS tomorrow, off = -1 AS yesterday, off BETWEEN -1 AND 1 AS near,
 strftime(d - 2, '%Y%m%d') || '-' || strftime(d + 1, '%Y%m%d') AS fetch_range FROM e WHERE CAST(ts AS DATE) BETWEEN d - 1 AND d + 1
"""


def orders_of_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place in the day by instant and by text; every third text has another offset, so that the two differ."""
    far = F.concat(F.date_format(F.col("kickoff") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    m = matches(spark, sf_dir).withColumn("utcDate", F.when(F.col("id") % 3 == 0, far).when(F.col("id") % 50 != 7, F.col("utcDate")))
    m = m.withColumn("day", F.coalesce(F.substring("utcDate", 1, 10), F.lit("?")))
    a = schedule.ranked(m, "day", schedule.by_kickoff()).withColumnRenamed("place", "by_instant")
    return schedule.ranked(a, "day", schedule.by_text()).select("id", "day", F.col("by_instant").cast("long").alias("by_instant"), F.col("place").cast("long").alias("by_text"))


ORDERS_SQL = """WITH e AS (SELECT event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00') WHEN event_id % 50 <> 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS t FROM events),
d AS (SELECT *, coalesce(substr(t, 1, 10), '?') AS day FROM e)
SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY ts, id) AS by_instant, row_number() OVER (PARTITION BY day ORDER BY coalesce(t, ''), id) AS by_text FROM d"""


#: A case for each tier of the pick: statuses that are left out, and the instant.
CASES = {1: ((), "2024-01-15 12:00:00"), 2: (("IN_PLAY", "PAUSED"), "2024-01-15 12:00:00"), 3: (("IN_PLAY", "PAUSED", "SCHEDULED"), "2024-01-15 12:00:00"), 4: ((), "2030-01-01 00:00:00"), 5: (("SCHEDULED",), "2030-01-01 00:00:00")}


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The featured match of five lists, one for each tier."""
    m, out = matches(spark, sf_dir), None
    for case, (without, now) in CASES.items():
        near = M.near_today(F.col("kickoff"), F.col("utcDate"), F.to_timestamp_ntz(F.lit(now)), "Etc/UTC")
        got = schedule.featured(m.filter(~F.col("status").isin(*without)) if without else m, near).select(F.lit(case).alias("case"), "tier", "id")
        out = got if out is None else out.unionByName(got)
    return out


FEATURED_SQL = f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({c}, '{'|'.join(w)}', DATE '{n[:10]}')" for c, (w, n) in CASES.items())}) AS k("case", without, d)),
m AS (SELECT k."case", event_id AS id, ts, {SQL_STATUS} AS status, CAST(ts AS DATE) BETWEEN d - 1 AND d + 1 AS w FROM events, k WHERE NOT list_contains(string_split(without, '|'), {SQL_STATUS})),
c AS (SELECT "case", 1 AS tier, id, epoch_us(ts) AS k, id AS o FROM m WHERE w AND status IN ('IN_PLAY', 'PAUSED')
  UNION ALL SELECT "case", 2, id, epoch_us(ts), id FROM m WHERE w AND status = 'SCHEDULED' UNION ALL SELECT "case", 3, id, -epoch_us(ts), -id FROM m WHERE w
  UNION ALL SELECT "case", 4, id, epoch_us(ts), id FROM m WHERE status = 'SCHEDULED' UNION ALL SELECT "case", 5, id, -epoch_us(ts), -id FROM m)
SELECT "case", tier, id FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY tier, k, o) AS nth FROM c) WHERE nth = 1
"""


def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.first_and_last(matches(spark, sf_dir), "status")


FIRST_SQL = f"""SELECT {SQL_STATUS} AS status, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1"""


def _payloads(events: DataFrame, order: str, one: Column) -> DataFrame:
    """A payload for each user, with that user's events in order."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("one")))), lambda x: x["one"])
    return events.groupBy("user_id").agg(F.to_json(F.struct(held.alias("events"))).alias("payload")).select("payload")


def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a user's matches, parsed back; nations are teams, regions their groups."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    home, away = F.broadcast(nation.select(F.col("n_nationkey").alias("hk"), F.col("n_name").alias("hn"))), F.broadcast(nation.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("an")))
    e = ev.join(home, F.col("user_id") % 25 == F.col("hk")).join(away, F.col("event_id") % 25 == F.col("ak"))
    team = lambda k, n: F.struct(F.col(k).cast("string").alias("id"), F.col(n).alias("displayName"), F.upper(F.substring(n, 1, 3)).alias("abbreviation"))
    side = lambda flag, k, n, s: F.struct(F.lit(flag).alias("homeAway"), s.cast("string").alias("score"), team(k, n).alias("team"))
    slug = F.when(F.col("event_id") % 3 == 0, "round-of-16").otherwise("group-stage")
    one = F.struct(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.struct(slug.alias("slug")).alias("season"),
        F.struct(F.struct(F.expr(RAW_NAME).alias("name"), F.expr(RAW_STATE).alias("state")).alias("type")).alias("status"),
        F.array(F.struct(F.struct(F.col("hn").alias("fullName"), F.struct(F.when(F.col("event_id") % 2 == 0, F.col("an")).alias("city")).alias("address")).alias("venue"), F.array(side("away", "ak", "an", F.col("event_id") % 4), side("home", "hk", "hn", F.col("event_id") % 5)).alias("competitors"))).alias("competitions"),
    )
    payloads = _payloads(e, "event_id", one)
    region = read(spark, sf_dir, "region")
    groups = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("team_id"), F.col("r_name").alias("label"))
    out = feeds.scoreboard(payloads, groups)
    return out.select("id", "ord", "utcDate", "status", "group", "stage", "venue", F.col("homeTeam.name").alias("home"), F.col("homeTeam.score").cast("long").alias("home_score"), F.col("awayTeam.name").alias("away"), F.col("awayTeam.score").cast("long").alias("away_score"))


SCOREBOARD_SQL = f"""
WITH e AS (SELECT e.*, {SQL_STATUS} AS status, h.n_name AS hn, a.n_name AS an, r.r_name AS g FROM events e JOIN nation h ON e.user_id % 25 = h.n_nationkey
 JOIN nation a ON e.event_id % 25 = a.n_nationkey JOIN region r ON h.n_regionkey = r.r_regionkey)
SELECT CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, strftime(ts, '%Y-%m-%dT%H:%MZ') AS "utcDate", status, CASE WHEN event_id % 3 <> 0 THEN g END AS "group", CASE WHEN event_id % 3 = 0 THEN 'Round of 16' END AS stage,
 hn || CASE WHEN event_id % 2 = 0 THEN ', ' || an ELSE '' END AS venue, hn AS home, CASE WHEN status <> 'SCHEDULED' THEN event_id % 5 END AS home_score, an AS away, CASE WHEN status <> 'SCHEDULED' THEN event_id % 4 END AS away_score FROM e
"""


def season_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season payloads of a user's matches: zone-less stamps, raw statuses, rounds and names."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    names = F.array(*[F.lit(x) for x in ("Germany", "CÔTE D'IVOIRE", "Atlantis", "usa", "")])
    raw = F.expr("CASE event_type WHEN 'click' THEN ' ht ' WHEN 'error' THEN 'Abandoned' WHEN 'view' THEN '1H' WHEN 'purchase' THEN 'Match Finished' ELSE 'who knows' END")
    k = F.col("event_id")
    one = F.struct(
        k.cast("string").alias("idEvent"), F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("strTimestamp"), F.date_format("ts", "yyyy-MM-dd").alias("dateEvent"),
        F.when(k % 4 == 1, F.date_format("ts", "HH:mm:ss")).alias("strTime"), raw.alias("strStatus"), F.when(k % 7 == 0, "YES").alias("strPostponed"), F.concat((k % 3).cast("string"), F.lit("x")).alias("intRound"),
        F.get(names, (k % 5).cast("int")).alias("strHomeTeam"), (k % 6).cast("string").alias("intHomeScore"), F.get(names, ((k + 1) % 5).cast("int")).alias("strAwayTeam"), F.lit("x").alias("intAwayScore"),
    )
    return _payloads(ev, "event_id", one)


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.season(season_payloads(spark, sf_dir))
    return out.select("id", "ord", "utcDate", F.date_format("kickoff", "yyyy-MM-dd HH:mm:ss").alias("kick"), "status", F.col("matchday").cast("long").alias("matchday"), F.col("homeTeam.name").alias("home"), F.col("homeTeam.code").alias("code"), F.col("homeTeam.score").cast("long").alias("score"), F.col("awayTeam.code").alias("away_code"))


SEASON_SQL = f"""
WITH n AS (SELECT ['Germany', 'CÔTE D''IVOIRE', 'Atlantis', 'usa', ''] AS names, ['GER', 'CIV', '', 'USA', ''] AS codes),
e AS (SELECT event_id AS k, user_id, ts, CASE WHEN event_id % 7 = 0 THEN 'POSTPONED' ELSE {SQL_STATUS} END AS status FROM events),
s AS (SELECT *, CASE WHEN k % 2 = 0 OR k % 4 = 1 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS t FROM e)
SELECT CAST(k AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS ord, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS "utcDate", strftime(t, '%Y-%m-%d %H:%M:%S') AS kick, status, nullif(k % 3, 0) AS matchday, coalesce(nullif(names[k % 5 + 1], ''), '?') AS home,
 codes[k % 5 + 1] AS code, CASE WHEN status IN ('IN_PLAY', 'PAUSED', 'FINISHED', 'SUSPENDED') THEN k % 6 END AS score, codes[(k + 1) % 5 + 1] AS away_code FROM s, n
"""


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as statistics of an order: return flag and quantity; the last of a repeated flag counts."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), "l_returnflag", "l_quantity")
    wide = feeds.pivot_stats(rows, ["l_orderkey"], "l_returnflag", "l_quantity", "ord", {"A": "rank", "N": "won", "R": "lost"})
    return wide.select("l_orderkey", "rank", "won", "lost", M.advances(F.col("rank")).alias("advances"))


STANDINGS_SQL = """SELECT l_orderkey, coalesce(arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (l_returnflag = 'A'), 0) AS rank, coalesce(arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (l_returnflag = 'N'), 0) AS won,
 coalesce(arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (l_returnflag = 'R'), 0) AS lost, coalesce(arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) FILTER (l_returnflag = 'A'), 0) <= 2 AS advances FROM lineitem GROUP BY l_orderkey"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and competition labels, slug titles and leading integers over part types and document sources."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    letter = F.substring(F.lit("abcdefghijklmnop"), F.col("p_size") % 16 + 1, F.lit(1))
    g = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("GROUP_"), letter)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("group "), letter)).otherwise("")
    slug = F.lower(F.regexp_replace("p_type", " ", "-of-"))
    return p.select("p_partkey", M.group_label(g).alias("label"), M.competition_label(g, F.col("p_type")).alias("comp"), M.slug_title(slug).alias("title"), M.leading_int(F.concat(F.lit("  "), F.col("p_size"), F.lit("px"))).cast("long").alias("n"), M.unicode_trim(F.concat(F.lit("  "), F.col("p_type"), F.lit("﻿"))).alias("trimmed"))


LABELS_SQL = """
WITH p AS (SELECT *, substr('abcdefghijklmnop', p_size % 16 + 1, 1) AS c FROM part), q AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'GROUP_' || c WHEN 1 THEN 'group ' || c ELSE '' END AS g,
 CASE WHEN c <= 'l' THEN 'Group ' || upper(c) END AS known, list_transform(string_split(lower(replace(p_type, ' ', '-of-')), '-'), lambda w: CASE WHEN w = 'of' THEN w ELSE upper(w[1]) || w[2:] END) AS words FROM p)
SELECT p_partkey, CASE WHEN g <> '' THEN coalesce(known, g) ELSE g END AS label, CASE WHEN g <> '' THEN coalesce(known, g) ELSE p_type END AS comp, array_to_string(words, ' ') AS title, CAST(p_size AS BIGINT) AS n, p_type AS trimmed FROM q
"""

QUERIES = {
    "prj2_status": status, "dt2_day_keys": day_keys, "agg3_days": days, "prd5_window_days": window_days, "srt1_orders": orders_of_matches, "top1_featured": featured,
    "win4_first_last": first_last, "src1_scoreboard": scoreboard, "src2_season": season, "agg1_standings": standings, "prj10_labels": labels,
}
ORACLES = {
    "prj2_status": STATUS_SQL, "dt2_day_keys": DAY_SQL, "agg3_days": DAYS_SQL, "prd5_window_days": WINDOW_SQL, "srt1_orders": ORDERS_SQL, "top1_featured": FEATURED_SQL,
    "win4_first_last": FIRST_SQL, "src1_scoreboard": SCOREBOARD_SQL, "src2_season": SEASON_SQL, "agg1_standings": STANDINGS_SQL, "prj10_labels": LABELS_SQL,
}
