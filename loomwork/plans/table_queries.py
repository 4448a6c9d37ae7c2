"""Queries of bytes, names, intervals, archives and statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import binary as B
from loomwork.functions import names as N
from loomwork.operators import archives, intervals, items, pages, pixels
from loomwork.plans.schedule_queries import read


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range texts from part sizes, expanded to rows."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("k"))
    text = F.when(F.col("k") % 4 == 0, F.concat("k", F.lit("-"), F.col("k") + 2, F.lit("，1"))).when(F.col("k") % 4 == 1, F.concat(F.col("k") + 1, F.lit("–"), "k")).when(F.col("k") % 4 == 2, F.concat("k", F.lit("-; x"))).otherwise(F.concat(F.lit("1,"), F.col("k") + 100))
    got = p.withColumn("r", N.page_ranges(text, F.lit(60)))
    return got.select("p_partkey", F.col("r.over").alias("over"), F.col("r").isNull().alias("unread"), F.posexplode_outer("r.indices").alias("at", "page")).select("p_partkey", "over", "unread", F.col("at").cast("long").alias("at"), F.col("page").cast("long").alias("page"))


RANGES_SQL = """
WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS k FROM part), r AS (
 SELECT p_partkey, k, CASE k % 4 WHEN 0 THEN [k - 1, k, k + 1, 0] WHEN 1 THEN [k, k - 1] END AS pages FROM p)
SELECT p_partkey, CASE WHEN k % 4 = 3 THEN k + 100 END AS "over", k % 4 = 2 AS unread, "at", page FROM (
 SELECT p_partkey, k, unnest(range(0, len(pages))) AS "at", unnest(pages) AS page FROM r WHERE pages IS NOT NULL
 UNION ALL SELECT p_partkey, k, NULL, NULL FROM r WHERE pages IS NULL)
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    return p.select("page_id", N.download_name(u, "html").alias("download"), N.container_name(u).alias("container"), N.clean_base(u).alias("base"), N.marked_name(u, F.lit("png")).alias("marked"))


NAMES_SQL = r"""
WITH p AS (SELECT page_id, url, trim(regexp_replace(url, '[/\\:*?"<>|\x00-\x1F]', '', 'g')) AS d, substr(coalesce(nullif(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[/\\\x00-\x1F]', '', 'g'), ''), 'image'), 1, 120) AS base FROM pages),
q AS (SELECT *, regexp_replace(CASE WHEN length(d) > 5 AND lower(d) LIKE '%.html' THEN substr(d, 1, length(d) - 5) ELSE d END, '[. ]+$', '') AS e FROM p)
SELECT page_id, CASE WHEN e = '' THEN 'Untitled' ELSE e END || '.html' AS download, substr(regexp_replace(url, '[/\\:*?"<>|\x00-\x1F]', '_', 'g'), 1, 200) AS container, base, base || '-wm.png' AS marked FROM q
"""


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("item"), (F.col("l_partkey") % 200).alias("start"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_linenumber") % 2 == 0).alias("gone"))


EXT = "WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS item, l_partkey % 200 AS start, CAST(l_quantity AS BIGINT) AS len, l_linenumber % 2 = 0 AS gone FROM lineitem)"


def union_of_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(_extents(spark, sf_dir), "l_orderkey")


UNION_SQL = EXT + """, y AS (SELECT *, start + len AS stop, max(start + len) OVER (PARTITION BY l_orderkey ORDER BY start, start + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
z AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT l_orderkey, min(start) AS start, max(stop) - min(start) AS len FROM z GROUP BY l_orderkey, island"""


def rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New offsets of surviving extents once removed ones are cut out."""
    x = _extents(spark, sf_dir)
    gone = intervals.merged(x.filter("gone"), "l_orderkey")
    kept = x.filter("NOT gone").select("l_orderkey", "item", F.col("start").alias("at"))
    return intervals.rebased(kept, gone, "l_orderkey", 7)


REBASE_SQL = "WITH m AS (" + UNION_SQL.replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber % 2 = 0)") + """)
SELECT *, CAST("at" + 7 - removed AS BIGINT) AS moved FROM (SELECT k.l_orderkey, CAST(k.l_linenumber AS BIGINT) AS item, k.l_partkey % 200 AS "at",
 CAST(coalesce((SELECT sum(m.len) FROM m WHERE m.l_orderkey = k.l_orderkey AND m.start < k.l_partkey % 200), 0) AS BIGINT) AS removed FROM lineitem k WHERE k.l_linenumber % 2 = 1)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _extents(spark, sf_dir)
    return intervals.overlapping(x.filter("NOT gone").select("l_orderkey", "item", "start", "len"), x.filter("gone"), "l_orderkey")


OVERLAP_SQL = EXT + " SELECT l_orderkey, item, start, len FROM x a WHERE NOT gone AND EXISTS (SELECT 1 FROM x b WHERE b.gone AND b.l_orderkey = a.l_orderkey AND a.start < b.start + b.len AND b.start < a.start + a.len)"


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _extents(spark, sf_dir)
    return intervals.contained(x.filter("NOT gone").select("l_orderkey", "item", "start", "len"), intervals.merged(x.filter("gone"), "l_orderkey"), "l_orderkey")


CONTAIN_SQL = "WITH m AS (" + UNION_SQL.replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber % 2 = 0)") + """)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS item, l_partkey % 200 AS start, CAST(l_quantity AS BIGINT) AS len FROM lineitem k WHERE l_linenumber % 2 = 1
 AND EXISTS (SELECT 1 FROM m WHERE m.l_orderkey = k.l_orderkey AND k.l_partkey % 200 >= m.start AND k.l_partkey % 200 + CAST(l_quantity AS BIGINT) <= m.start + m.len)"""


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left after an anti-join, primary item removed, removed item without a place, block totals."""
    x = _extents(spark, sf_dir)
    gone = x.filter("gone").select("l_orderkey", "item")
    stripped = x.groupBy("l_orderkey").agg(F.sum(F.when(F.col("gone"), F.col("len")).otherwise(0)).alias("stripped"))
    primary = x.select("l_orderkey").distinct().withColumn("item", F.lit(2).cast("long"))
    flags = items.primary_gone(primary, gone, ["l_orderkey"], "item")
    left = items.without(x, gone, ["l_orderkey", "item"]).groupBy("l_orderkey").agg(F.count("*").alias("left"))
    return flags.join(stripped, "l_orderkey").join(left, "l_orderkey", "left").select("l_orderkey", "primary_gone", "stripped", F.coalesce("left", F.lit(0)).alias("left"))


SURVIVORS_SQL = EXT + " SELECT l_orderkey, bool_or(item = 2 AND gone) AS primary_gone, CAST(sum(CASE WHEN gone THEN len ELSE 0 END) AS BIGINT) AS stripped, count(*) FILTER (NOT gone) AS \"left\" FROM x GROUP BY l_orderkey"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("name_len"), F.octet_length("text").cast("long").alias("data_len"))


def zip_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.layout(_entries(spark, sf_dir), "source", "doc_id", F.col("name_len"), F.col("data_len")).select("source", "doc_id", "header_at")


LAYOUT_SQL = """SELECT source, doc_id, CAST(coalesce(sum(30 + length('d' || doc_id) + octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS header_at FROM documents"""


def zip_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.sizes(_entries(spark, sf_dir), "source", F.col("name_len"), F.col("data_len"))


SIZES_SQL = """SELECT source, CAST(22 + sum(76 + 2 * length('d' || doc_id) + octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS entries, max(length('d' || doc_id)) AS longest,
 22 + sum(76 + 2 * length('d' || doc_id) + octet_length(encode(text))) > 4294901760 OR count(*) > 65535 AS too_big FROM documents GROUP BY source"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat(F.substring_index("p_name", " ", 1), F.lit(".x")).alias("name"))
    return archives.dedupe_names(p, "p_brand", "p_partkey", "name")


#: No name here has a number in brackets, so the n-th of a name is the one that gets n.
UNIQUE_SQL = """SELECT p_brand, p_partkey, name, CASE WHEN nth = 1 THEN name ELSE regexp_replace(name, '\\.x$', '(' || nth || ').x') END AS unique_name
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY p_partkey) AS nth FROM (SELECT p_brand, p_partkey, split_part(p_name, ' ', 1) || '.x' AS name FROM part))"""


#: What the pages of a remainder begin with, and the kinds that follow: every signature, the image kinds, and the page itself.
LEADS = (
    ("89504e470d0a1a0a", "png", "png"), ("ffd8ff", "jpeg", "jpeg"), ("47494638", "gif", "gif"), ("424d", "bmp", None), ("25504446", "pdf", None), ("504b0304", "zip", None), ("52617221", "rar", None),
    ("377abcaf271c", "sevenz", None), ("1f8b", "gzip", None), ("425a68", "bzip2", None), ("7f454c46", "elf", None), ("4f676753", "ogg", None), ("52494646", "riff", None), ("664c6143", "flac", None),
    ("1a45dfa3", "mkv", None), ("efbbbf", "bom", None), ("524946460000000057454250", "riff", "webp"), ("00000018667479706d69663100000000", None, "heif"), ("0000001866747970787878780000000068656963", None, "heif"), ("", "text", None),
)


def sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, first printable run, numbers and the whole dump of pages that begin with each signature in turn."""
    lead = F.element_at(F.array(*[F.lit(x[0]) for x in LEADS]), (F.col("page_id") % len(LEADS)).cast("int") + 1)
    d = read(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(lead), F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("b"))
    b = F.col("b")
    return d.select("page_id", B.payload_kind(b).alias("kind"), B.text_run(b).cast("long").alias("run"), B.image_kind(b).alias("image"), F.md5(B.printable(b)).alias("shown"), F.md5(B.hex_dump(b)).alias("dump"), B.u_be(b, 0, 4).alias("be"), B.u_le(b, 0, 4).alias("le"))


_LISTED = lambda k: "[" + ", ".join("NULL" if x[k] is None else f"'{x[k]}'" for x in LEADS) + "]"
SNIFF_SQL = rf"""
WITH p AS (SELECT page_id, CAST(page_id % {len(LEADS)} + 1 AS INTEGER) AS k, html FROM pages),
q AS (SELECT page_id, k, regexp_extract_all(upper({_LISTED(0)}[k]) || hex(encode(coalesce(html, ''))), '..') AS h FROM p),
r AS (SELECT *, coalesce(list_position(list_transform(h, lambda x: x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E')), false) - 1, len(h)) AS run FROM q),
s AS (SELECT *, array_to_string(list_transform(h, lambda x: CASE WHEN x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E') THEN chr(CAST('0x' || x AS INTEGER)) ELSE '·' END), '') AS shown FROM r),
t AS (SELECT *, lower(array_to_string(h, '')) AS x, array_to_string(list_transform(h, lambda x: CASE WHEN x >= '20' AND x <= '7E' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '') AS g FROM s)
SELECT page_id, CASE WHEN k < {len(LEADS)} THEN coalesce({_LISTED(1)}[k], CASE WHEN run >= 6 THEN 'text' END) WHEN h[1] = '42' AND h[2] = '4D' THEN 'bmp' WHEN run >= 6 THEN 'text' END AS kind,
 CAST(run AS BIGINT) AS run, {_LISTED(2)}[k] AS image, md5(shown) AS shown,
 md5(array_to_string(list_transform(range(0, (len(h) + 15) // 16), lambda o: lpad(lower(hex(o * 16)), 8, '0') || '  ' || rpad(regexp_replace(substr(x, o * 32 + 1, 16), '(..)', '\1 ', 'g'), 24, ' ') || ' ' ||
  rpad(regexp_replace(substr(x, o * 32 + 17, 16), '(..)', '\1 ', 'g'), 24, ' ') || ' ' || substr(g, o * 16 + 1, 16)), chr(10))) AS dump,
 CAST('0x' || h[1] || h[2] || h[3] || h[4] AS BIGINT) AS be, CAST('0x' || h[4] || h[3] || h[2] || h[1] AS BIGINT) AS le FROM t
"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of the whole text of every document and page."""
    d = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("b"))
    p = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("b"))
    return d.unionByName(p).select("kind", "id", F.crc32("b").alias("crc"))


#: The checksum byte by byte, over a table of 256 remainders made by its rule.
CRC_SQL = """WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT 'document' AS kind, doc_id AS id, text AS s FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
b AS (SELECT kind, id, s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d)
SELECT kind, id, CASE WHEN s IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295) END AS crc FROM b, t"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))


BYTES = """WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents), c AS (SELECT doc_id, unnest(h) AS x, unnest(range(0, len(h))) AS i, len(h) // 4 AS n FROM b),
v AS (SELECT doc_id, i // 4 AS px, i % 4 AS channel, CAST('0x' || x AS INTEGER) AS value, n FROM c WHERE i // 4 < n)"""


def channel_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pixels.histograms(_images(spark, sf_dir), "doc_id", F.col("data"))
    return h.groupBy("doc_id", "channel").agg(F.sum("cnt").alias("n"), F.count("*").alias("bins"), F.sum(F.when(F.col("value") % 2 == 1, F.col("cnt")).otherwise(0)).alias("odd"), F.bool_or((F.col("channel") == 3) & (F.col("value") != 255)).alias("alpha"), F.sum(F.when(pixels.bit_plane(F.col("value"), 4) == 255, F.col("cnt")).otherwise(0)).alias("plane4"))


HIST_SQL = BYTES + " SELECT doc_id, CAST(channel AS INTEGER) AS channel, count(*) AS n, count(DISTINCT value) AS bins, CAST(sum(value % 2) AS BIGINT) AS odd, bool_or(channel = 3 AND value <> 255) AS alpha, count(*) FILTER ((value // 16) % 2 = 1) AS plane4 FROM v GROUP BY doc_id, channel"


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, occupied values and chi-square probability of each of 64 segments of each text's bytes."""
    h = pixels.segment_tests(_images(spark, sf_dir), "doc_id", F.col("data"))
    return h.select("doc_id", "seg", "n", F.col("bins").cast("long").alias("bins"), F.round("chi2", 9).alias("chi2"), F.col("df").cast("long").alias("df"), F.round("p", 7).alias("p"))


#: The chance of a greater chi-square, as one minus a sum over whole steps of the Poisson-like terms.
TAIL = """CASE WHEN df <= 0 THEN 0.0 WHEN chi2 <= 0 THEN 1.0 WHEN x > s + 12 * sqrt(s) + 200 THEN 0.0
 ELSE greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, {steps}), lambda k: exp((s + k) * ln(x) - x - lgamma(s + k + 1)))))) END"""
SEG_SQL = BYTES + """,
g AS (SELECT doc_id, px * 64 // n AS seg, value, count(*) AS cnt FROM v WHERE n >= 64 AND channel < 3 GROUP BY 1, 2, 3),
p AS (SELECT doc_id, seg, value // 2 AS pair, sum(cnt) AS n, sum(CASE WHEN value % 2 = 0 THEN cnt ELSE 0 END) AS even, count(*) AS bins FROM g GROUP BY 1, 2, 3),
c2 AS (SELECT doc_id, seg, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bins) AS BIGINT) AS bins, count(*) FILTER (n >= 2) - 1 AS df,
  coalesce(sum(CASE WHEN n >= 2 THEN (even - n / 2.0) * (even - n / 2.0) / (n / 2.0) END), 0.0)::DOUBLE AS chi2 FROM p GROUP BY 1, 2),
t AS (SELECT *, df / 2.0 AS s, chi2 / 2.0 AS x FROM c2)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, n, bins, round(chi2, 9) AS chi2, df, round(""" + TAIL.format(steps=600) + ", 7) AS p FROM t"


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pixels.extract_bits(_images(spark, sf_dir), "doc_id", F.col("data"), F.lit(8), "rgb", 0, True, False)
    return got.select("doc_id", F.hex("bytes").alias("bits"), "total")


#: Whole bytes of the low bits of red, green and blue, row after row: a hex digit's low bit, then eight of them a byte.
BITS_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, 8 * (length(h) // 64) AS px, h FROM b),
c AS (SELECT doc_id, px * 3 // 8 AS total, translate(regexp_replace(substr(h, 1, CAST(px * 8 AS INTEGER)), '.(.).(.).(.)..', '\\1\\2\\3', 'g'), '0123456789ABCDEF', '0101010101010101') AS bits FROM n)
SELECT doc_id, total, array_to_string(list_transform(range(0, least(4096, total)), lambda j: lpad(upper(to_hex(CAST('0b' || substr(bits, CAST(j * 8 + 1 AS INTEGER), 8) AS INTEGER))), 2, '0')), '') AS bits FROM c"""


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pixels.channel_tests(_images(spark, sf_dir), "doc_id", F.col("data"), 1)
    return got.select("doc_id", F.round("chi2", 6).alias("chi2"), F.col("df").cast("long").alias("df"), F.round("p", 7).alias("p"), "constant", pixels.verdict(F.round("p", 7)).alias("verdict"))


CHI_SQL = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), c AS (SELECT doc_id, CAST('0x' || x AS INTEGER) AS value, count(*) AS cnt FROM b GROUP BY 1, 2),
p AS (SELECT doc_id, value // 2 AS pair, sum(cnt) AS n, sum(CASE WHEN value % 2 = 0 THEN cnt ELSE 0 END) AS even, count(*) AS bins FROM c GROUP BY 1, 2),
s AS (SELECT doc_id, coalesce(sum(CASE WHEN n / 2.0 >= 1 THEN (even - n / 2.0) * (even - n / 2.0) / (n / 2.0) END), 0.0)::DOUBLE AS chi2, count(*) FILTER (n / 2.0 >= 1) - 1 AS df, sum(bins) <= 1 AS constant FROM p GROUP BY doc_id),
t AS (SELECT *, df / 2.0 AS s, chi2 / 2.0 AS x FROM s),
u AS (SELECT *, """ + TAIL.format(steps=1500) + """ AS p FROM t)
SELECT doc_id, round(chi2, 6) AS chi2, df, round(p, 7) AS p, constant, CASE WHEN round(p, 7) >= 0.9 THEN 'likely' WHEN round(p, 7) >= 0.3 THEN 'possible' ELSE 'unlikely' END AS verdict FROM u"""


def channel_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest p over the channels of each text's bytes; every third text is made opaque."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    h = F.hex("raw")
    opaque = F.unhex(F.regexp_replace(F.substring(h, F.lit(1), F.floor(F.length(h) / 8).cast("int") * 8), "(.{6})..", "$1FF"))
    made = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, opaque).otherwise(F.col("raw")).alias("data"))
    got = pixels.channel_verdicts(made, "doc_id", F.col("data"))
    # from the counts: a share times 1000 falls below a half that odd * 1000 / n meets
    shown = F.array_join(F.transform("counts", lambda x: F.round(x["odd"] * 1000 / x["n"]).cast("long").cast("string")), ",")
    return got.select("doc_id", "has_alpha", F.round("max_p", 7).alias("max_p"), pixels.verdict(F.round("max_p", 7)).alias("verdict"), shown.alias("odd_per_mille"))


VERDICTS_SQL = BYTES + """,
w AS (SELECT doc_id, channel, CASE WHEN doc_id % 3 = 0 AND channel = 3 THEN 255 ELSE value END AS value FROM v),
g AS (SELECT doc_id, channel, value, count(*) AS cnt FROM w GROUP BY 1, 2, 3),
p AS (SELECT doc_id, channel, value // 2 AS pair, sum(cnt) AS n, sum(CASE WHEN value % 2 = 0 THEN cnt ELSE 0 END) AS even, count(*) AS bins, max(CASE WHEN value = 255 THEN cnt ELSE 0 END) AS full_ FROM g GROUP BY 1, 2, 3),
c2 AS (SELECT doc_id, channel, sum(n) AS n, sum(bins) AS bins, sum(even) AS even, max(full_) AS full_, count(*) FILTER (n >= 2) - 1 AS df,
  coalesce(sum(CASE WHEN n >= 2 THEN (even - n / 2.0) * (even - n / 2.0) / (n / 2.0) END), 0.0)::DOUBLE AS chi2 FROM p GROUP BY 1, 2),
t AS (SELECT *, df / 2.0 AS s, chi2 / 2.0 AS x FROM c2 WHERE channel < 3 OR full_ < n),
u AS (SELECT *, CASE WHEN bins <= 1 THEN 0.0 ELSE """ + TAIL.format(steps=1500) + """ END AS p FROM t),
m AS (SELECT doc_id, bool_or(channel = 3) AS has_alpha, round(max(p), 7) AS max_p, string_agg(CAST(CAST(round((n - even) * 1000.0::DOUBLE / n) AS BIGINT) AS VARCHAR), ',' ORDER BY channel) AS odd_per_mille FROM u GROUP BY 1)
SELECT doc_id, has_alpha, max_p, CASE WHEN max_p >= 0.9 THEN 'likely' WHEN max_p >= 0.3 THEN 'possible' ELSE 'unlikely' END AS verdict, odd_per_mille FROM m"""


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture on a page of its own size and on A4, a rendered place, colour fractions and packed times, from part sizes and prices."""
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 900.0).alias("w"), F.col("p_retailprice").alias("h"))
    fit, page, at = pages.fit_a4(F.col("w"), F.col("h")), pages.page_of(F.col("w"), F.col("h")), pages.to_points(F.col("w"), F.col("h"), F.lit(1.5), F.lit(841.89))
    colour = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")))
    made = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("p_partkey") * 86_407)
    r = lambda c: F.round(c, 6)
    return p.select(
        "p_partkey", r(fit["x"]).alias("fit_x"), r(fit["y"]).alias("fit_y"), r(fit["w"]).alias("fit_w"), r(page["w"]).alias("page_w"), r(page["h"]).alias("page_h"), r(at["x"]).alias("x"), r(at["y"]).alias("y"),
        F.round(N.rgb_fractions(colour)[1], 9).alias("green"), B.dos_date(made).cast("long").alias("dos_date"), B.dos_time(made).cast("long").alias("dos_time"),
    )


GEOMETRY_SQL = """WITH p AS (SELECT p_partkey, p_size * 900.0::DOUBLE AS w, p_retailprice AS h, epoch_ms((1767225600 + p_partkey * 86407) * 1000) AS t FROM part),
s AS (SELECT *, least(523.28::DOUBLE / w, 769.89::DOUBLE / h) AS f, least(1.0::DOUBLE, 14400 / greatest(w * 0.75::DOUBLE, h * 0.75::DOUBLE)) AS k FROM p)
SELECT p_partkey, round((595.28::DOUBLE - w * f) / 2, 6) AS fit_x, round((841.89::DOUBLE - h * f) / 2, 6) AS fit_y, round(w * f, 6) AS fit_w, round(w * 0.75::DOUBLE * k, 6) AS page_w, round(h * 0.75::DOUBLE * k, 6) AS page_h,
 round(w / 1.5::DOUBLE, 6) AS x, round(841.89::DOUBLE - h / 1.5::DOUBLE, 6) AS y, round((p_partkey * 7919 % 16777216 // 256 % 256) / 255.0::DOUBLE, 9) AS green,
 CAST((year(t) - 1980) * 512 + month(t) * 32 + day(t) AS BIGINT) AS dos_date, CAST(hour(t) * 2048 + minute(t) * 32 + second(t) // 2 AS BIGINT) AS dos_time FROM s"""


def unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each nation one after another, and the running page total with its cap."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("id"))
    both = pages.appended(c, s, key="c_nationkey", order="id")
    return pages.running_pages(both, "c_nationkey", F.col("id") % 90).select("c_nationkey", "src", "id", "ord", "pages", "many")


UNIONS_SQL = """WITH b AS (SELECT c_nationkey, c_custkey AS id, 0 AS src FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier), w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY src, id) AS ord,
 CAST(sum(id % 90) OVER (PARTITION BY c_nationkey ORDER BY src, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pages FROM b) SELECT c_nationkey, src, id, ord, pages, pages > 2000 AS many FROM w"""


QUERIES = {
    "str1_ranges": ranges, "str2_names": names, "win1_union": union_of_extents, "win3_rebase": rebase, "join7_overlap": overlaps, "join6_containment": containment, "join5_survivors": survivors,
    "win2_zip_layout": zip_layout, "agg13_zip_sizes": zip_sizes, "win6_unique_names": unique_names, "bin1_sniff": sniff, "bin7_checksums": checksums, "agg4_histograms": channel_histograms,
    "agg5_segments": segment_stats, "bin9_bits": bits, "agg6_chi_square": chi_square, "agg7_channels": channel_verdicts, "mth4_geometry": geometry, "set1_unions": unions,
}
ORACLES = {
    "str1_ranges": RANGES_SQL, "str2_names": NAMES_SQL, "win1_union": UNION_SQL, "win3_rebase": REBASE_SQL, "join7_overlap": OVERLAP_SQL, "join6_containment": CONTAIN_SQL, "join5_survivors": SURVIVORS_SQL,
    "win2_zip_layout": LAYOUT_SQL, "agg13_zip_sizes": SIZES_SQL, "bin1_sniff": SNIFF_SQL, "agg4_histograms": HIST_SQL,
    "agg5_segments": SEG_SQL, "bin9_bits": BITS_SQL, "agg6_chi_square": CHI_SQL, "agg7_channels": VERDICTS_SQL, "win6_unique_names": UNIQUE_SQL, "bin7_checksums": CRC_SQL, "mth4_geometry": GEOMETRY_SQL, "set1_unions": UNIONS_SQL,
}
