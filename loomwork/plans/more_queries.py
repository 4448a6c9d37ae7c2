"""Queries of page lists, caps, archives, image routes, standings and source fallback over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import binary as B
from loomwork.operators import archives, containers, pages
from loomwork.plans import container_queries as C
from loomwork.plans.container_queries import _be
from loomwork.plans.schedule_queries import read, season_payloads
from loomwork.shared import scratch, settings, stash
from loomwork.sources import feeds, files, headers
from loomwork.streaming import recorder


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the second source where the first has no list, and none where it has an empty one."""
    second = season_payloads(spark, sf_dir)
    region = read(spark, sf_dir, "region")
    out = []
    for case, text in (("no list", '{"events": null}'), ("empty list", '{"events": []}')):
        first = region.select(F.lit(text).alias("payload"))
        got = feeds.first_available((first, feeds.SCOREBOARD, feeds.scoreboard), (second, feeds.SEASON, feeds.season))
        out.append(got.select(F.lit(case).alias("case"), "id", "status"))
    return out[0].unionByName(out[1])


FALLBACK_SQL = """SELECT 'no list' AS "case", CAST(event_id AS VARCHAR) AS id,
 CASE WHEN event_id % 7 = 0 THEN 'POSTPONED' ELSE CASE event_type WHEN 'click' THEN 'PAUSED' WHEN 'error' THEN 'SUSPENDED' WHEN 'view' THEN 'IN_PLAY' WHEN 'purchase' THEN 'FINISHED' ELSE 'SCHEDULED' END END AS status FROM events"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standings payload of all nations by region: tables by rank, groups as people sort them, one without a name."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    stat = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
    k = F.col("n_nationkey")
    entry = F.struct(
        F.struct(k.cast("string").alias("id"), F.col("n_name").alias("displayName")).alias("team"),
        F.array(stat("wins", k), stat("rank", k * 7 % 5), stat("points", k % 4), stat("points", k * 3)).alias("stats"),
    )
    entries = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e")))), lambda x: x["e"]).alias("entries"))
    named = F.when(F.col("r_regionkey") == 3, "").when(F.col("r_regionkey") % 2 == 0, F.lower("r_name")).otherwise(F.col("r_name"))
    child = F.struct(F.col("r_regionkey").alias("k"), F.struct(named.alias("name"), F.struct("entries").alias("standings")).alias("c"))
    payload = region.join(entries, F.col("r_regionkey") == F.col("n_regionkey")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["c"]).alias("children"))).alias("payload"))
    table = feeds.standings(payload)
    flat = feeds.placed_groups(table).select("group_place", "group", F.posexplode("table").alias("place", "t"))
    flat = flat.select("group_place", "group", F.col("place").cast("long").alias("place"), "t.team_id", "t.team", F.col("t.pos").cast("long").alias("pos"), F.col("t.pts").cast("long").alias("pts"), F.col("t.draw").cast("long").alias("draw"))
    return flat.join(feeds.group_index(table), "team_id")


GROUPS_SQL = """
WITH n AS (SELECT *, CASE WHEN r_regionkey = 3 THEN 'Group' WHEN r_regionkey % 2 = 0 THEN lower(r_name) ELSE r_name END AS g, n_nationkey * 7 % 5 AS pos FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT dense_rank() OVER (ORDER BY lower(g)) - 1 AS group_place, g AS "group", row_number() OVER (PARTITION BY r_regionkey ORDER BY pos, n_nationkey) - 1 AS place, CAST(n_nationkey AS VARCHAR) AS team_id, n_name AS team,
 CAST(pos AS BIGINT) AS pos, CAST(n_nationkey * 3 AS BIGINT) AS pts, CAST(0 AS BIGINT) AS draw, CASE WHEN r_regionkey = 3 THEN '' ELSE g END AS label FROM n
"""


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files that are written from all pages, a kind a page, then scanned whole and cleaned, and read by header ranges alone."""
    texts = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    made = [C.jpeg_files(spark, sf_dir), C.png_files(texts).withColumnRenamed("doc_id", "page_id"), C.webp_files(texts).withColumnRenamed("doc_id", "page_id"), C.heic_files(spark, sf_dir)]
    every = None
    for k, (ending, one) in enumerate(zip(("jpg", "png", "webp", "heic"), made)):
        named = one.filter(F.pmod("page_id", F.lit(4)) == k).select(F.concat(F.col("page_id").cast("string"), F.lit(f".{ending}")).alias("name"), "content")
        every = named if every is None else every.unionByName(named)
    where = scratch(spark, "images")
    files.write(every, where)
    name = F.regexp_extract("path", "[^/]+$", 0)
    cleaned = containers.clean(files.scan(spark, where)).select(name.alias("name"), "length", "outcome", F.aggregate("strips", F.lit(0).cast("long"), lambda a, s: a + s["size"]).alias("removed"), F.octet_length("cleaned").cast("long").alias("left"))
    with settings(spark, files.MANY):
        cleaned = stash(cleaned, "cleaned")
    told = headers.image_headers(spark, where).select(name.alias("name"), F.col("length").alias("listed"), "kind", "declared_pixels", F.col("allowed").cast("string").alias("allowed"), "bytes_read")
    return cleaned.join(told, "name")


FILES_SQL = """
WITH p AS (SELECT page_id, page_id % 4 AS k, page_id % 7 = 0 AS off, page_id % 3 = 0 AS third, page_id % 10 BETWEEN 2 AND 8 AS turned, octet_length(encode(url)) AS u, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
s AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN off THEN 47 ELSE 8 + 36 + 4 + u + 10 + CASE WHEN third THEN 2 ELSE 0 END END WHEN 1 THEN 33 + 12 + n + 12 + CASE WHEN off THEN 0 ELSE 12 + CASE WHEN page_id % 2 = 1 THEN 5 ELSE 0 END END
 WHEN 2 THEN 12 + 18 + 12 + 8 + n + n % 2 ELSE 16 + 112 + 8 + n + 3 + CASE WHEN off THEN 8 ELSE 0 END END AS length FROM p),
r AS (SELECT *, CASE WHEN k = 3 AND off THEN 'unsupported_layout' WHEN off THEN 'corrupt' ELSE 'ok' END AS outcome,
 CASE WHEN NOT off THEN CASE k WHEN 0 THEN 36 + 4 + u + CASE WHEN third THEN 2 ELSE 0 END WHEN 1 THEN 12 + n + CASE WHEN page_id % 2 = 1 THEN 5 ELSE 0 END WHEN 2 THEN 8 + n + n % 2 ELSE n END END AS removed FROM s)
SELECT page_id || '.' || ['jpg', 'png', 'webp', 'heic'][CAST(k + 1 AS INTEGER)] AS name, length, length AS listed, ['jpeg', 'png', 'webp', 'heif'][CAST(k + 1 AS INTEGER)] AS kind, outcome, CAST(removed AS BIGINT) AS removed,
 CAST(CASE WHEN NOT off THEN CASE k WHEN 0 THEN 18 + CASE WHEN turned THEN 36 ELSE 0 END WHEN 1 THEN 33 + 12 + 12 WHEN 2 THEN 12 + 18 + 12 ELSE 16 + 112 - 14 - 21 + 8 + 3 END END AS BIGINT) AS "left",
 CASE WHEN k IN (1, 3) THEN CAST(0 AS BIGINT) END AS declared_pixels, CASE WHEN k IN (1, 3) THEN 'false' END AS allowed,
 -- the head, then four bytes of size and four of kind for each chunk or box behind it
 CAST(least(length, 512) + CASE k WHEN 1 THEN 0 WHEN 3 THEN CASE WHEN off AND 139 + n + 4 > 512 THEN 4 ELSE 0 END + CASE WHEN off AND 139 + n + 8 > 512 THEN 4 ELSE 0 END ELSE 0 END AS BIGINT) AS bytes_read
FROM r
"""


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a customer's call; a kilobyte a unit of price."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") * 500).cast("long").alias("bytes"))
    return pages.capped(o, "o_custkey", F.col("bytes"))


CAPS_SQL = """SELECT o_custkey, count(*) AS files, count(*) FILTER (floor(o_totalprice * 500) > 104857600) AS over,
 CASE WHEN count(*) > 20 THEN 'many' WHEN count(*) FILTER (floor(o_totalprice * 500) > 104857600) > 0 THEN 'big' END AS error_code FROM orders GROUP BY 1"""


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each conversation, a file for each turn; sizes, entries and the name of the first, read from the bytes."""
    c = read(spark, sf_dir, "conversations")
    made = archives.make_zips(c.select(F.col("conv_id").alias("archive_id"), F.col("turn").alias("ord"), F.concat(F.lit("é"), F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")))
    b, n = F.col("content"), F.octet_length("content")
    number = lambda at, k: B.u_le(F.substring(b, at, F.lit(k)), 0, k)
    name = F.decode(F.substring(b, F.lit(31), number(F.lit(27), 2).cast("int")), "UTF-8")
    return made.select(F.col("archive_id").alias("conv_id"), n.cast("long").alias("bytes"), number(n - 11, 2).alias("entries"), name.alias("first_name"), number(F.lit(13), 2).alias("dos_date"), (number(F.lit(15), 4) == F.crc32(F.substring(b, F.lit(31) + number(F.lit(27), 2).cast("int"), number(F.lit(19), 4).cast("int")))).alias("sound"), "error_code")


ZIPS_SQL = """SELECT conv_id, CAST(22 + sum(76 + 2 * octet_length(encode('é' || turn || '.txt')) + octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, count(*) AS entries, 'é' || min(turn) || '.txt' AS first_name,
 CAST(23585 AS BIGINT) AS dos_date, true AS sound, CAST(NULL AS VARCHAR) AS error_code FROM conversations GROUP BY 1"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of each kind with each orientation and size, a kind a page: how they get into a document, and what a marked copy is called."""
    p = read(spark, sf_dir, "pages").select("page_id").withColumn("k", F.col("page_id"))
    exif = F.concat(F.lit("FFE1002245786966000049492A00080000000100" "1201030001000000"), _be(F.col("k") % 10, 1), F.lit("00000000000000"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FF"), exif, F.lit("FFDA000211FFD9"))
    png = F.concat(F.lit("89504E470D0A1A0A" "0000000D49484452"), _be(F.col("k") * 1000, 4), _be(F.col("k") % 7 * 1000, 4), F.lit("0806000000" "00000000" "0000000049454E44AE426082"))
    heif = F.concat(F.lit("00000010667479706865696300000000" "000000306D65746100000000" "0000002469707270" "0000001C6970636F" "000000146973706500000000"), _be(F.col("k") * 500, 4), _be(F.col("k") % 3 * 1000, 4))
    made = F.array(jpeg, png, heif, F.lit("474946383961"), F.lit("524946460000000057454250"), F.lit("00010203"))
    d = p.select("page_id", F.unhex(F.element_at(made, (F.col("k") % 6).cast("int") + 1)).alias("content"))
    got = containers.upright(pages.routed(d))
    return got.select("page_id", "kind", "route", "error_code", "upright", pages.marked_kind(F.col("content")).alias("marked"))


ROUTES_SQL = """
WITH p AS (SELECT page_id, page_id % 6 AS m, CASE WHEN page_id % 10 BETWEEN 1 AND 8 THEN page_id % 10 ELSE 1 END AS turn,
 CASE page_id % 6 WHEN 1 THEN page_id * 1000 * (page_id % 7 * 1000) WHEN 2 THEN page_id * 500 * (page_id % 3 * 1000) END AS px FROM pages),
e AS (SELECT *, CASE WHEN m = 5 OR (m IN (1, 2) AND px = 0) THEN 'img' WHEN m IN (1, 2) AND px > 64000000 THEN 'pixels' END AS code FROM p)
SELECT page_id, CASE m WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'heif' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' END AS kind,
 CASE WHEN code IS NULL THEN CASE WHEN m = 0 AND turn > 1 THEN 'jpeg' WHEN m IN (0, 1) THEN 'asis' WHEN m = 3 THEN 'png' ELSE 'jpeg' END END AS route, code AS error_code, CAST(CASE WHEN m = 0 THEN turn ELSE 1 END AS INTEGER) AS upright,
 CASE WHEN m IN (1, 3) THEN 'png' ELSE 'jpg' END AS marked FROM e
"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as those of a recorder."""
    kinds = F.create_map(*[F.lit(x) for p in {"view": "start", "click": "granted", "purchase": "chunk", "signup": "pause", "error": "stop"}.items() for x in p])
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), kinds[F.col("event_type")].alias("kind"), F.floor("value").cast("long").alias("size"))
    return recorder.recordings(ev)


_NOW = "CASE " + " ".join(f"WHEN a.s = '{s}' AND e.k = '{k}' THEN '{b}'" for s, to in recorder.TURNS.items() for k, b in to.items()) + " ELSE a.s END"
RECORDINGS_SQL = f"""
WITH m AS (SELECT user_id AS session, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'granted' WHEN 'purchase' THEN 'chunk' WHEN 'signup' THEN 'pause' WHEN 'error' THEN 'stop' END AS k, CAST(floor(coalesce(value, 0)) AS BIGINT) AS n FROM events),
l AS (SELECT session, list({{'s': '', 'us': CAST(0 AS BIGINT), 'since': CAST(0 AS BIGINT), 'size': CAST(0 AS BIGINT), 'bad': false, 't': t, 'k': k, 'n': n}} ORDER BY t, k, n) AS es FROM m GROUP BY session),
f AS (SELECT session, list_reduce(list_prepend({{'s': 'idle', 'us': CAST(0 AS BIGINT), 'since': CAST(0 AS BIGINT), 'size': CAST(0 AS BIGINT), 'bad': false, 't': CAST(0 AS BIGINT), 'k': '', 'n': CAST(0 AS BIGINT)}}, es), lambda a, e: {{
  's': {_NOW}, 'us': a.us + CASE WHEN a.s = 'rec' AND {_NOW} <> 'rec' THEN e.t - a.since ELSE 0 END, 'since': CASE WHEN a.s <> 'rec' AND {_NOW} = 'rec' THEN e.t ELSE a.since END,
  'size': a.size + CASE WHEN e.k = 'chunk' AND a.s IN ('rec', 'paused', 'stopping') THEN e.n ELSE 0 END, 'bad': a.bad OR (e.k = 'error' AND a.s IN ('rec', 'paused')), 't': e.t, 'k': e.k, 'n': e.n}}) AS r FROM l)
SELECT session, r.s AS state, r.us / 1000000 AS seconds, r.size AS bytes, CASE WHEN r.s = 'done' THEN CASE WHEN r.bad OR r.size = 0 THEN 'failed' ELSE 'ok' END END AS outcome FROM f
"""


QUERIES = {
    "src4_fallback": fallback, "agg2_groups": groups, "src5_files": whole_files, "prd16_caps": caps, "snk2_zips": zips, "fmt16_routes": routes, "agg15_recordings": recordings,
}
ORACLES = {"src4_fallback": FALLBACK_SQL, "agg2_groups": GROUPS_SQL, "prd16_caps": CAPS_SQL, "snk2_zips": ZIPS_SQL, "src5_files": FILES_SQL, "fmt16_routes": ROUTES_SQL, "agg15_recordings": RECORDINGS_SQL}
