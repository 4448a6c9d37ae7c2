"""Queries of image containers and tile places over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import containers, guards
from loomwork.plans.schedule_queries import read
from loomwork.shared import dealt


def _be(n: Column, width: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * width, "0")


def _le(n: Column) -> Column:
    h = _be(n, 4)
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def _told(df: DataFrame, key: str) -> DataFrame:
    removed = F.aggregate("strips", F.lit(0).cast("long"), lambda a, s: a + s["size"])
    return containers.clean(df).select(key, "kind", "outcome", F.array_join(F.transform("strips", lambda s: s["label"]), "; ").alias("labels"), removed.alias("removed"), F.hex("cleaned").alias("cleaned"))


def jpeg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page: its address as a comment, an orientation, every seventh cut off."""
    p = read(spark, sf_dir, "pages").select("page_id", F.hex(F.encode("url", "UTF-8")).alias("u"))
    exif = F.concat(F.lit("FFE1002245786966000049492A00080000000100" "1201030001000000"), F.lpad(F.hex(F.col("page_id") % 10), 2, "0"), F.lit("00000000000000"))
    whole = F.concat(F.lit("FFD8FFE000044A46"), exif, F.lit("FFFE"), _be(F.length("u") / 2 + 2, 2), F.col("u"), F.lit("FFDA000211FF0022FFD9"), F.when(F.col("page_id") % 3 == 0, "AABB").otherwise(""))
    cut = F.when(F.col("page_id") % 7 == 0, F.substring(whole, 1, 94)).otherwise(whole)
    return p.select("page_id", F.unhex(cut).alias("content"))


def jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(jpeg_files(spark, sf_dir), "page_id")


JPEG_SQL = """
WITH p AS (SELECT page_id, page_id % 7 = 0 AS cut, page_id % 3 = 0 AS tail, page_id % 10 AS o FROM pages)
SELECT page_id, 'jpeg' AS kind, CASE WHEN cut THEN 'corrupt' ELSE 'ok' END AS outcome, CASE WHEN NOT cut THEN 'EXIF metadata; Comment' || CASE WHEN tail THEN '; Data after image end' ELSE '' END END AS labels,
 CASE WHEN NOT cut THEN CAST(36 + 4 + octet_length(encode(url)) + CASE WHEN tail THEN 2 ELSE 0 END AS BIGINT) END AS removed,
 CASE WHEN NOT cut THEN 'FFD8FFE000044A46' || CASE WHEN o BETWEEN 2 AND 8 THEN 'FFE1002245786966000049492A000800000001001201030001000000' || lpad(CAST(o AS VARCHAR), 2, '0') || '00000000000000' ELSE '' END || 'FFDA000211FF0022FFD9' END AS cleaned
FROM p JOIN pages USING (page_id)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def png_files(texts: DataFrame) -> DataFrame:
    """A file for each text: the whole text in a text chunk, without an end for every seventh."""
    d = texts.select("doc_id", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("t"))
    chunk = F.concat(_be(F.length("t") / 2, 4), F.lit("74455874"), F.col("t"), F.lit("00000000"))
    end = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("0000000049454E44AE426082"), F.when(F.col("doc_id") % 2 == 1, "0102030405").otherwise("")))
    whole = F.concat(F.lit("89504E470D0A1A0A" "0000000D49484452"), F.repeat(F.lit("00"), 17), chunk, F.lit("0000000073524742" "00000000"), end)
    return d.select("doc_id", F.unhex(whole).alias("content"))


def png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(png_files(_texts(spark, sf_dir)), "doc_id")


PNG_SQL = """
SELECT doc_id, 'png' AS kind, CASE WHEN doc_id % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 7 <> 0 THEN 'Text chunk' || CASE WHEN doc_id % 2 = 1 THEN '; Data after image end' ELSE '' END END AS labels,
 CASE WHEN doc_id % 7 <> 0 THEN CAST(12 + octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 2 = 1 THEN 5 ELSE 0 END AS BIGINT) END AS removed,
 CASE WHEN doc_id % 7 <> 0 THEN '89504E470D0A1A0A0000000D49484452' || repeat('00', 17) || '0000000073524742000000000000000049454E44AE426082' END AS cleaned FROM documents
"""


def webp_files(texts: DataFrame) -> DataFrame:
    """A file for each text: the whole text as Exif data, flags set; the declared size wrong for every seventh."""
    d = texts.select("doc_id", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("t")).withColumn("n", F.length("t") / 2)
    body = F.concat(F.lit("57454250" "565038580A000000" "2C000000000000000000" "5650382003000000AABBCC00" "45584946"), _le(F.col("n")), F.col("t"), F.when(F.col("n") % 2 == 1, "00").otherwise(""))
    size = F.length(body) / 2 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    return d.withColumn("body", body).select("doc_id", F.unhex(F.concat(F.lit("52494646"), _le(size), F.col("body"))).alias("content"))


def webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(webp_files(_texts(spark, sf_dir)), "doc_id")


WEBP_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, doc_id % 7 = 0 AS bad FROM documents)
SELECT doc_id, 'webp' AS kind, CASE WHEN bad THEN 'corrupt' ELSE 'ok' END AS outcome, CASE WHEN NOT bad THEN 'EXIF metadata' END AS labels, CASE WHEN NOT bad THEN CAST(8 + n + n % 2 AS BIGINT) END AS removed,
 CASE WHEN NOT bad THEN '524946462200000057454250565038580A000000200000000000000000005650382003000000AABBCC00' END AS cleaned FROM d
"""


def heic_of(payload: Column) -> Column:
    """A HEIC file, in hex, with a payload in hex as Exif item before the picture."""
    n = F.length(payload) / 2
    items = F.concat(F.lit("0000002C696C6F63" "00000000" "44000002" "000100000001"), _be(n + 136, 4), F.lit("00000003" "00020000000100000088"), _be(n, 4))
    entries = F.lit("0000003869696E66" "000000000002" "00000015696E6665" "02000000" "00010000" "6876633100" "00000015696E6665" "02000000" "00020000" "4578696600")
    return F.concat(F.lit("00000010667479706865696300000000" "000000706D65746100000000"), items, entries, _be(n + 11, 4), F.lit("6D646174"), payload, F.lit("AABBCC"))


def heic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page: its whole html as an Exif item before the picture; every seventh holds tracks too."""
    p = read(spark, sf_dir, "pages").select("page_id", F.hex(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("t"))
    tracks = F.when(F.col("page_id") % 7 == 0, "000000086D6F6F76").otherwise("")
    return p.select("page_id", F.unhex(F.concat(heic_of(F.col("t")), tracks)).alias("content"))


def heic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(heic_files(spark, sf_dir), "page_id")


HEIC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, page_id % 7 = 0 AS tracks FROM pages)
SELECT page_id, 'heic' AS kind, CASE WHEN tracks THEN 'unsupported_layout' ELSE 'ok' END AS outcome, CASE WHEN NOT tracks THEN 'EXIF metadata' END AS labels, CASE WHEN NOT tracks THEN CAST(n AS BIGINT) END AS removed,
 CASE WHEN NOT tracks THEN '00000010667479706865696300000000' || '0000004D6D65746100000000' || '0000001E696C6F63' || '00000000' || '44000001' || '000100000001' || '0000006500000003'
  || '0000002369696E66' || '000000000001' || '00000015696E6665' || '02000000' || '00010000' || '6876633100' || '0000000B6D646174' || 'AABBCC' END AS cleaned FROM p
"""


def declared_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two planes for each document: its bytes by its id's last three digits, and a small one."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    plane = lambda w, h: F.concat(F.lit("000000146973706500000000"), _be(w, 4), _be(h, 4))
    boxed = F.concat(F.lit("00000010667479706865696300000000" "000000446D65746100000000" "0000003869707270" "000000306970636F"), plane(F.col("n"), F.col("doc_id") % 1000 * 100), plane(F.col("doc_id") % 5, F.lit(7)))
    return guards.declared(d.select("doc_id", F.unhex(boxed).alias("content"))).select("doc_id", "declared_pixels", "allowed")


DECLARED_SQL = """
WITH d AS (SELECT doc_id, greatest(octet_length(encode(coalesce(text, ''))) * (doc_id % 1000 * 100), doc_id % 5 * 7) AS px FROM documents)
SELECT doc_id, CAST(px AS BIGINT) AS declared_pixels, px BETWEEN 1 AND 64000000 AS allowed FROM d
"""


def tile_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a repeated mark over a rectangle for each part."""
    p = dealt(read(spark, sf_dir, "part")).select("p_partkey", (F.col("p_size") * 20.0).alias("w"), F.col("p_retailprice").alias("h"))
    got = containers.tiles(p, F.col("w"), F.col("h"), F.lit(180.0), F.lit(6), F.lit(1.5))
    return got.select("p_partkey", "font", "tile_row", "tile_col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


TILES_SQL = """
WITH p AS (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_retailprice AS h FROM part),
f AS (SELECT *, greatest(8.0, floor(least(w, h) * 6 / 100 + 0.5))::DOUBLE AS font, sqrt(w * w + h * h) / 2 AS r FROM p),
s AS (SELECT *, 180.0::DOUBLE + font * 1.5::DOUBLE AS sx, font * 2.5::DOUBLE AS sy FROM f),
a AS (SELECT *, unnest(range(0, CAST(floor(2 * r / sy) AS BIGINT) + 1)) AS tile_row FROM s),
b AS (SELECT *, CASE WHEN tile_row % 2 = 1 THEN sx / 2 ELSE 0 END AS o FROM a),
c AS (SELECT *, unnest(range(0, CAST(floor((2 * r + o + sx) / sx) AS BIGINT) + 1)) AS tile_col FROM b)
SELECT p_partkey, font, CAST(tile_row AS INTEGER) AS tile_row, CAST(tile_col AS INTEGER) AS tile_col, round(tile_col * sx - r - o, 4) AS x, round(tile_row * sy - r, 4) AS y FROM c
"""

QUERIES = {"fmt3_jpeg": jpeg, "fmt4_png": png, "fmt5_webp": webp, "fmt14_heic": heic, "agg9_declared": declared_sizes, "mth5_tiles": tile_places}
ORACLES = {"fmt3_jpeg": JPEG_SQL, "fmt4_png": PNG_SQL, "fmt5_webp": WEBP_SQL, "fmt14_heic": HEIC_SQL, "agg9_declared": DECLARED_SQL, "mth5_tiles": TILES_SQL}
