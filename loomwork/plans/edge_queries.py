"""Queries of orders, caps, refusals and refreshes that the plain queries don't reach, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import matches as M
from loomwork.operators import archives, intervals, pixels, schedule, sealing
from loomwork.plans import schedule_queries, table_queries
from loomwork.plans.schedule_queries import SQL_STATUS, matches, read, season_payloads
from loomwork.shared import scratch, stash
from loomwork.sources import feeds, zips
from loomwork.streaming.refresh import ATTEMPT, LatestTable, Source, refresh


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days in order and their matches in order, in Tokyo's time; every ninth match has no kickoff."""
    m = matches(spark, sf_dir).withColumn("kickoff", F.when(F.col("id") % 9 != 0, F.col("kickoff")))
    return schedule.days_in_order(m, F.when(F.col("kickoff").isNotNull(), M.day_key(F.col("kickoff"), F.col("utcDate"), "Asia/Tokyo")))


DAYS_SQL = """WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN ts END AS k FROM events), d AS (SELECT *, coalesce(strftime(k + INTERVAL 9 HOUR, '%Y-%m-%d'), '?') AS day FROM m)
SELECT day, dense_rank() OVER (ORDER BY day) - 1 AS day_place, row_number() OVER (PARTITION BY day ORDER BY coalesce(k, TIMESTAMP '1970-01-01'), id) - 1 AS place, id FROM d"""


def rebase_with_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New offsets of surviving extents, an error for those before the cut."""
    x = table_queries._extents(spark, sf_dir)
    gone = intervals.merged(x.filter("gone"), "l_orderkey")
    kept = x.filter("NOT gone").select("l_orderkey", "item", F.col("start").alias("at"))
    return intervals.rebased(kept, gone, "l_orderkey", 7, cut=60)


CUT_SQL = f'SELECT l_orderkey, item, "at", removed, CASE WHEN "at" >= 60 THEN moved END AS moved, CASE WHEN "at" < 60 THEN \'offset\' END AS error_code FROM ({table_queries.REBASE_SQL})'


def rechecked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order, every third of which has a number in brackets already or no extension."""
    word, k = F.substring_index("p_name", " ", 1), F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(k % 3 == 0, F.concat(word, F.lit("("), (k % 4 + 1).cast("string"), F.lit(").x"))).when(k % 7 == 0, word).otherwise(F.concat(word, F.lit(".x"))).alias("name"))
    return archives.dedupe_names(p, "p_brand", "p_partkey", "name")


#: Each name in turn, or the first free number from 2 on.
RECHECKED_SQL = """
WITH w AS (SELECT p_brand, p_partkey AS k, split_part(p_name, ' ', 1) AS word FROM part),
p AS (SELECT p_brand, k, CASE WHEN k % 3 = 0 THEN word || '(' || (k % 4 + 1) || ').x' WHEN k % 7 = 0 THEN word ELSE word || '.x' END AS name FROM w),
l AS (SELECT p_brand, list(k ORDER BY k) AS ks, list(name ORDER BY k) AS names, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list([name] ORDER BY k)), lambda a, e: list_append(a, CASE WHEN NOT list_contains(a, e[1]) THEN e[1]
 ELSE list_filter(list_transform(range(2, len(a) + 3), lambda n: CASE WHEN contains(e[1], '.') THEN regexp_replace(e[1], '\\.([^.]*)$', '(' || n || ').\\1') ELSE e[1] || '(' || n || ')' END), lambda x: NOT list_contains(a, x))[1] END)) AS made FROM p GROUP BY p_brand)
SELECT p_brand, unnest(ks) AS p_partkey, unnest(names) AS name, unnest(made) AS unique_name FROM l"""


def bit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low bits of whole texts packed from the other end of each byte, and column after column."""
    images, out = table_queries._images(spark, sf_dir), None
    for msb, columns in ((False, False), (True, True), (False, True)):
        got = pixels.extract_bits(images, "doc_id", F.col("data"), F.lit(8), "rgb", 0, msb, columns)
        one = got.select("doc_id", F.lit(f"{'msb' if msb else 'lsb'} {'columns' if columns else 'rows'}").alias("packing"), F.md5(F.hex("bytes")).alias("bits"), "total")
        out = one if out is None else out.unionByName(one)
    return out


ORDERS_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, 8 * (length(h) // 64) AS px, h FROM b),
c AS (SELECT doc_id, px, px * 3 // 8 AS total, translate(regexp_replace(substr(h, 1, CAST(px * 8 AS INTEGER)), '.(.).(.).(.)..', '\\1\\2\\3', 'g'), '0123456789ABCDEF', '0101010101010101') AS rows FROM n),
d AS (SELECT *, CASE WHEN px > 0 THEN array_to_string(list_transform(range(0, px), lambda k: substr(rows, CAST((k % (px // 8) * 8 + k // (px // 8)) * 3 + 1 AS INTEGER), 3)), '') ELSE '' END AS columns FROM c),
e AS (SELECT doc_id, total, 'lsb rows' AS packing, rows AS bits, true AS turned FROM d UNION ALL SELECT doc_id, total, 'msb columns', columns, false FROM d UNION ALL SELECT doc_id, total, 'lsb columns', columns, true FROM d),
f AS (SELECT *, list_transform(range(0, least(4096, total)), lambda j: substr(bits, CAST(j * 8 + 1 AS INTEGER), 8)) AS eights FROM e)
SELECT doc_id, packing, total, md5(array_to_string(list_transform(eights, lambda x: lpad(upper(to_hex(CAST('0b' || CASE WHEN turned THEN reverse(x) ELSE x END AS INTEGER))), 2, '0')), '')) AS bits FROM f"""

#: Bytes of a chunk of an archive's entry.
ZIP_CHUNK = 4_000
#: Bytes that a sealed text may have here, and what is put behind some containers so that they pass the cap.
SEAL_CAP, FILLING = 20_000, 100_000


def sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document sealed at the format's own cost, a salt a source, and opened again.

    By its id's remainder a wrong passphrase is given, the magic is spoilt, the frame's
    length is beyond its cap, the meta part is no JSON, the container is cut short, or has
    too many bytes; a text over the cap isn't sealed at all.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    some = lambda c, n: F.substring(F.unhex(F.sha2(c, 256)), 1, n)
    k, word = F.pmod("doc_id", F.lit(8)), F.lit("a passphrase")
    d = d.withColumn("salt", some(F.coalesce("source", F.lit("")), 16)).withColumn("nonce", some(F.col("doc_id").cast("string"), 12))
    made = sealing.seal(d, F.col("data"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("text/plain"), word, F.col("salt"), F.col("nonce"), cap=SEAL_CAP)
    made = stash(made.withColumnRenamed("error_code", "seal_code"), "sealed")
    frame = F.when(k == 2, F.concat(F.unhex(F.lit("00010001")), F.col("data"))).when(k == 3, F.concat(F.unhex(F.lit("00000003")), F.lit("{x}").cast("binary"), F.col("data")))
    odd = sealing.sealed_frame(frame, sealing.derived_key(F.when(k.isin(2, 3), word), F.col("salt")), F.col("salt"), F.col("nonce"))
    spoilt = (
        F.when(k == 1, F.concat(F.lit(b"XXXXX"), F.substring("container", F.lit(6), F.octet_length("container")))).when(k.isin(2, 3) & F.col("container").isNotNull(), odd).when(k == 4, F.substring("container", 1, 40))
        .when(k == 5, F.concat("container", F.repeat(F.lit("x"), FILLING).cast("binary"))).otherwise(F.col("container"))
    )
    given = made.select("doc_id", "seal_code", spoilt.alias("container"))
    opened = sealing.unseal(given, F.col("container"), F.when(k == 0, "wrong").otherwise(word), cap=SEAL_CAP)
    return opened.select("doc_id", "seal_code", "name", "type", F.md5("bytes").alias("bytes"), "error_code")


SEALED_SQL = f"""
WITH d AS (SELECT doc_id, doc_id % 8 AS k, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT *, CASE WHEN octet_length(b) > {SEAL_CAP} THEN 'magic' ELSE ['pass', 'magic', 'magic', NULL, 'magic', 'big', NULL, NULL][CAST(k + 1 AS INTEGER)] END AS code FROM d)
SELECT doc_id, CASE WHEN octet_length(b) > {SEAL_CAP} THEN 'big' END AS seal_code, CASE WHEN code IS NULL THEN CASE WHEN k = 3 THEN 'decrypted.bin' ELSE 'doc' || doc_id || '.txt' END END AS name,
 CASE WHEN code IS NULL THEN CASE WHEN k = 3 THEN 'application/octet-stream' ELSE 'text/plain' END END AS type, CASE WHEN code IS NULL THEN md5(b) END AS bytes, code AS error_code FROM c"""


def written_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each source, an entry for each document in chunks of 4,000 bytes; written side by side and read back."""
    d = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("archive_id"), F.col("doc_id").alias("ord"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    places = F.sequence(F.lit(0), F.greatest(F.octet_length("data") - 1, F.lit(0)), F.lit(ZIP_CHUNK))
    chunks = d.select("archive_id", "ord", "data", F.posexplode(places).alias("chunk", "from")).select("archive_id", "ord", "chunk", F.concat(F.lit("d"), F.col("ord").cast("string")).alias("name"), F.substring("data", F.col("from") + 1, F.lit(ZIP_CHUNK)).alias("content"))
    where = scratch(spark, "zips")
    return zips.read_zips(zips.write_zips(chunks, where), where)


WRITTEN_SQL = """SELECT coalesce(source, 'none') AS archive_id, CAST(22 + sum(76 + 2 * length('d' || doc_id) + octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, count(*) AS entries, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS content_bytes,
 true AS sound, 'd' || min(doc_id) AS first_name, 'd' || max(doc_id) AS last_name FROM documents GROUP BY 1"""


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a stream of refreshes leaves: a stand-in, one that is too early, a failure, a retry too soon, and one with a third of the matches."""
    ev = read(spark, sf_dir, "events")
    third = schedule_queries._payloads(ev.filter("event_id % 3 = 0"), "event_id", F.struct(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.struct(F.struct(F.expr(schedule_queries.RAW_NAME).alias("name"), F.expr(schedule_queries.RAW_STATE).alias("state")).alias("type")).alias("status")))
    failed = spark.range(1).select(F.lit(None).cast("string").alias("payload"))
    ticks = [("two", 0, season_payloads(spark, sf_dir)), ("one", 60, third), ("one", 95, failed), ("one", 110, third), ("one", 120, third)]
    landing, checkpoint = scratch(spark, "attempts"), scratch(spark, "refresh")
    columns = ("fetched", "source", "id", "status")
    sources = [Source("one", feeds.SCOREBOARD, lambda p: feeds.scoreboard(p).select(*columns)), Source("two", feeds.SEASON, lambda p: feeds.season(p).select(*columns))]
    table = LatestTable(spark, scratch(spark, "table"))
    for source, at, payloads in ticks:
        # as many files as the payloads have partitions; the trigger takes what the tick wrote, and all of it
        payloads.select(F.lit(source).alias("source"), F.timestamp_seconds(F.lit(at)).alias("fetched"), "payload").write.mode("append").json(landing)
        stream = spark.readStream.schema(ATTEMPT).json(landing)
        refresh(stream, table, sources, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.rows().select("id", "source", "status", F.unix_seconds("fetched").alias("fetched"))


REFRESHED_SQL = f"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 'one' ELSE 'two' END AS source, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'POSTPONED' ELSE {SQL_STATUS} END AS status,
 CAST(CASE WHEN event_id % 3 = 0 THEN 120 ELSE 0 END AS BIGINT) AS fetched FROM events"""

QUERIES = {"srt5_days": days, "win3_cut": rebase_with_cut, "win6_rechecked": rechecked_names, "bin9_orders": bit_orders, "enc3_sealed": sealed, "snk3_written": written_zips, "feed1_refreshed": refreshed}
ORACLES = {"srt5_days": DAYS_SQL, "win3_cut": CUT_SQL, "win6_rechecked": RECHECKED_SQL, "bin9_orders": ORDERS_SQL, "enc3_sealed": SEALED_SQL, "snk3_written": WRITTEN_SQL, "feed1_refreshed": REFRESHED_SQL}
