"""Queries of parts of files as rows, previews, and HEIC tables, gates and rewriting by joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import containers, heic_rows, parts
from loomwork.plans import container_queries as C
from loomwork.plans.container_queries import _be, _le
from loomwork.plans.schedule_queries import read
from loomwork.shared import dealt, stash


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a JPEG, a PNG and a WebP file of each page's html, with labels, and of each document's."""
    texts = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    name = lambda df, key, at: df.select((F.col(key) * 3 + at).alias("file"), "content")
    files = name(C.jpeg_files(spark, sf_dir), "page_id", 0).unionByName(name(C.png_files(texts), "doc_id", 1)).unionByName(name(C.webp_files(texts), "doc_id", 2))
    rows = parts.labelled_parts(files, "file")
    return rows.select("file", "kind", "ord", (F.col("stop") - F.col("start")).alias("size"), F.trim("tag").alias("tag"), "label", "detail", "error")


PARTS_SQL = """
WITH p AS (SELECT page_id, page_id % 7 = 0 AS off, page_id % 3 = 0 AS third, octet_length(encode(url)) AS u, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (
  SELECT page_id * 3 AS file, 'jpeg' AS kind, off, [{'size': CAST(6 AS BIGINT), 'tag': 'e0', 'label': NULL}, {'size': 36, 'tag': 'e1', 'label': 'EXIF metadata'}, {'size': 4 + u, 'tag': 'fe', 'label': 'Comment'}, {'size': 8, 'tag': 'da', 'label': NULL}, {'size': 2, 'tag': 'd9', 'label': NULL}]
    || CASE WHEN third THEN [{'size': CAST(2 AS BIGINT), 'tag': 'tail', 'label': 'Data after image end'}] ELSE [] END AS parts FROM p
  UNION ALL
  SELECT page_id * 3 + 1, 'png', off, [{'size': CAST(25 AS BIGINT), 'tag': 'IHDR', 'label': NULL}, {'size': 12 + n, 'tag': 'tEXt', 'label': 'Text chunk'}, {'size': 12, 'tag': 'sRGB', 'label': NULL}, {'size': 12, 'tag': 'IEND', 'label': NULL}]
    || CASE WHEN page_id % 2 = 1 THEN [{'size': CAST(5 AS BIGINT), 'tag': 'tail', 'label': 'Data after image end'}] ELSE [] END FROM p
  UNION ALL
  SELECT page_id * 3 + 2, 'webp', off, [{'size': CAST(18 AS BIGINT), 'tag': 'VP8X', 'label': NULL}, {'size': 12, 'tag': 'VP8', 'label': NULL}, {'size': 8 + n + n % 2, 'tag': 'EXIF', 'label': 'EXIF metadata'}] FROM p
), d AS (SELECT page_id * 3 + 1 AS file, nullif(regexp_replace(regexp_extract(array_to_string(list_transform(regexp_extract_all(substr(hex(encode(coalesce(html, ''))), 1, 80), '..'), lambda x: chr(CAST('0x' || x AS INTEGER))), ''), '^[^\\x00]*'), '[^ -~]', '?', 'g'), '') AS word FROM pages),
x AS (SELECT file, kind, unnest(range(0, len(parts))) AS ord, unnest(parts) AS part FROM r WHERE NOT off)
SELECT file, kind, CAST(ord AS INTEGER) AS ord, part.size AS size, part.tag AS tag, part.label AS label, CASE WHEN part.tag = 'tEXt' THEN coalesce(word, 'tEXt') END AS detail, NULL AS error FROM x LEFT JOIN d USING (file)
UNION ALL SELECT file, kind, NULL, NULL, NULL, NULL, NULL, 'corrupt' FROM r WHERE off
"""

_ENTRIES = 600


def _ascii(text: Column, width: int) -> Column:
    """Hex of a text in ``width`` bytes, the last one nought."""
    return F.rpad(F.hex(F.encode(F.substring(text, 1, width - 1), "UTF-8")), 2 * width, "0")


def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, tiff): all fields that a preview reads, of each customer, in hex; every fifth lists 600 entries."""
    c = dealt(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment"))
    k = F.col("k")
    entry = lambda tag, kind, n, value: F.concat(F.lit(tag + kind), _le(n) if isinstance(n, Column) else F.lit(n.to_bytes(4, "little").hex()), value if isinstance(value, Column) else F.lit(value.to_bytes(4, "little").hex()))
    ratio = lambda a, b: F.concat(_le(a), F.lit(b.to_bytes(4, "little").hex()))
    # texts and places in fixed widths before the directories
    make, model, soft = _ascii(F.col("c_name"), 24), _ascii(F.concat(F.lit("M\x01 "), F.col("c_mktsegment"), F.lit("  \x02x")), 24), _ascii(F.concat(F.lit("v"), k.cast("string")), 16)
    taken = F.concat(F.lit("2026:01:"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" 03:04:05"))
    original = F.concat(F.lit("2025:12:"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" 23:59:59"))
    data = F.concat(make, model, soft, _ascii(taken, 20), _ascii(original, 20), ratio(k % 90, 1), ratio(k % 60, 1), ratio(k * 7 % 6000, 100), ratio(k % 180, 1), ratio(k % 7, 0), ratio(k % 60, 2))
    exif_at, gps_at = 8 + 104 + 48, 8 + 104 + 48 + 18
    main_at = gps_at + 54
    exif = F.concat(F.lit("0100"), entry("0390", "0200", 20, 8 + 84), F.lit("00000000"))
    side = lambda tag, on, letters: F.concat(F.lit(tag + "020002000000"), F.when(on, letters[1].encode().hex()).otherwise(letters[0].encode().hex()), F.lit("000000"))
    gps = F.concat(F.lit("0400"), side("0100", k % 2 == 1, "NS"), entry("0200", "0500", 3, 8 + 104), side("0300", k % 3 == 1, "EW"), entry("0400", "0500", 3, 8 + 128), F.lit("00000000"))
    more = F.when(k % 5 == 0, F.repeat(F.lit("9999" "0300" "01000000" "00000000"), _ENTRIES - 7)).otherwise("")
    main = F.concat(
        F.when(k % 5 == 0, _ENTRIES.to_bytes(2, "little").hex()).otherwise("0700"), entry("0F01", "0200", 24, 8), entry("1001", "0200", 24, 32), entry("3101", "0200", 16, 56), entry("3201", "0200", 20, 72),
        F.lit("12010300" "01000000"), _le(k % 10), entry("6987", "0400", 1, exif_at), entry("2588", "0400", 1, gps_at), more, F.lit("00000000"),
    )
    tiff = F.concat(F.lit("49492A00"), F.lit(main_at.to_bytes(4, "little").hex()), data, exif, gps, main)
    return c.select("k", tiff.alias("tiff"))


def preview_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG, PNG or WebP file of each customer with those fields."""
    c = previewed(spark, sf_dir)
    k, tiff = F.col("k"), F.col("tiff")
    n = F.octet_length(tiff) / 2
    jpeg = F.concat(F.lit("FFD8FFE1"), _be(n + 8, 2), F.lit("457869660000"), tiff, F.lit("FFDA000211FF0022FFD9"))
    png = F.concat(F.lit("89504E470D0A1A0A" "0000000D49484452"), F.repeat(F.lit("00"), 17), _be(n, 4), F.lit("65584966"), tiff, F.lit("00000000" "0000000049454E44AE426082"))
    body = F.concat(F.lit("57454250" "5650382003000000AABBCC00" "45584946"), _le(n), tiff)
    webp = F.concat(F.lit("52494646"), _le(F.lit(24) + n), body)
    return c.select("k", F.unhex(F.when(k % 3 == 0, jpeg).when(k % 3 == 1, png).otherwise(webp)).alias("content"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers.clean(preview_files(spark, sf_dir))
    p = F.col("preview")
    return found.select(F.col("k").alias("c_custkey"), "kind", "outcome", p["make"].alias("make"), p["model"].alias("model"), p["software"].alias("software"), p["taken"].alias("taken"), p["original"].alias("original"), p["orientation"].alias("turned"), F.round(p["lat"], 9).alias("lat"), F.round(p["lon"], 9).alias("lon"), p["fields"].alias("fields"))


PREVIEWS_SQL = f"""
WITH c AS (SELECT c_custkey, c_custkey AS k, c_name, c_mktsegment, (k % 90 + (k % 60) / 60.0::DOUBLE + (k * 7 % 6000) / 100.0::DOUBLE / 3600) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END AS lat,
 (k % 180 + (k % 60) / 2.0::DOUBLE / 3600) * CASE WHEN k % 3 = 1 THEN -1 ELSE 1 END AS lon FROM customer)
SELECT c_custkey, ['jpeg', 'png', 'webp'][CAST(k % 3 + 1 AS INTEGER)] AS kind, 'ok' AS outcome, trim(substr(c_name, 1, 23)) AS make, 'M ' || c_mktsegment || ' x' AS model, 'v' || k AS software, '2026:01:' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 03:04:05' AS taken,
 '2025:12:' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || ' 23:59:59' AS original, CAST(greatest(k % 10, 1) AS INTEGER) AS turned, CASE WHEN lat <> 0 OR lon <> 0 THEN round(lat, 9) END AS lat, CASE WHEN lat <> 0 OR lon <> 0 THEN round(lon, 9) END AS lon,
 CAST(CASE WHEN k % 5 = 0 THEN {containers.ENTRY_CAP} ELSE 7 END + 5 AS INTEGER) AS fields FROM c
"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of HEIC files whose Exif item begins with the fields, with a mark before them, or with how far away they are."""
    c, t = previewed(spark, sf_dir), F.col("tiff")
    lead = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, "457869660000").when(F.col("k") % 4 == 2, "00000006" "457869660000").otherwise("7FFFFFFF")
    found = containers.clean(c.select("k", F.unhex(C.heic_of(F.concat(lead, t))).alias("content")))
    p = F.col("preview")
    return found.select(F.col("k").alias("c_custkey"), "outcome", F.element_at("strips", 1)["size"].alias("removed"), p["make"].alias("make"), p["original"].alias("original"), p["fields"].alias("fields"), "orientation")


LOCATED_SQL = f"""SELECT c_custkey, 'ok' AS outcome, CAST([0, 6, 10, 4][CAST(c_custkey % 4 + 1 AS INTEGER)] + 238 + CASE WHEN c_custkey % 5 = 0 THEN {_ENTRIES} ELSE 7 END * 12 AS BIGINT) AS removed, CASE WHEN c_custkey % 4 < 3 THEN substr(c_name, 1, 23) END AS make,
 CASE WHEN c_custkey % 4 < 3 THEN '2025:12:' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || ' 23:59:59' END AS original, CASE WHEN c_custkey % 4 < 3 THEN CAST(CASE WHEN c_custkey % 5 = 0 THEN {containers.ENTRY_CAP} ELSE 7 END + 5 AS INTEGER) END AS fields,
 CAST(1 AS INTEGER) AS orientation FROM customer"""


def heic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A HEIC file of each page: a picture in two parts with its html as Exif between them, its address as XMP, a thumbnail.

    By its id's remainder it can be rewritten, or has its metadata as primary item, a
    thumbnail that overlaps, tracks, a metadata item without a place, or one outside the data.
    """
    p = dealt(read(spark, sf_dir, "pages").select("page_id", "html", "url")).select("page_id", F.hex(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("t"), F.hex(F.encode("url", "UTF-8")).alias("x"))
    v, n, u = F.pmod("page_id", F.lit(6)), F.octet_length("t") / 2, F.octet_length("x") / 2
    back = F.when(v == 4, 14).otherwise(0)
    place = lambda item, *extents: F.concat(F.lit(f"{item:04X}0000{len(extents):04X}"), *[F.concat(_be(at - back, 4), _be(size, 4)) for at, size in extents])
    exif = place(2, (F.lit(333), n + F.when(v == 5, 100_000).otherwise(0)))
    rows = F.concat(place(1, (F.lit(330), F.lit(3)), (333 + n, F.lit(2))), F.when(v == 4, "").otherwise(exif), place(3, (335 + n, u)), place(4, (335 + n + u - F.when(v == 2, 1).otherwise(0), F.lit(2))))
    iloc = F.concat(_be(80 - back, 4), F.lit("696C6F63" "00000000" "4400"), F.when(v == 4, "0003").otherwise("0004"), rows)
    infe = lambda item, kind, more="": f"{21 + len(more) // 2:08X}" + "696E6665" + "02000000" + f"{item:04X}0000" + kind.encode().hex() + "00" + more
    iinf = F.lit("00000076" "69696E66" "00000000" "0004" + infe(1, "hvc1") + infe(2, "Exif") + infe(3, "mime", b"application/rdf+xml\0".hex()) + infe(4, "hvc1"))
    iref = F.lit("0000002A" "69726566" "00000000" "0000000E" "63647363" "0002" "0001" "0001" "00000010" "64696D67" "0001" "0002" "0003" "0004")
    iprp = F.lit("00000028" "69707270" "00000008" "6970636F" "00000018" "69706D61" "00000000" "00000002" "00010101" "00020101")
    pitm = F.concat(F.lit("0000000E" "7069746D" "00000000"), F.when(v == 1, "0002").otherwise("0001"))
    meta = F.concat(_be(306 - back, 4), F.lit("6D657461" "00000000"), pitm, iloc, iinf, iref, iprp)
    mdat = F.concat(_be(n + u + 15, 4), F.lit("6D646174" "AABBCC"), F.col("t"), F.lit("DDEE"), F.col("x"), F.lit("0102"))
    whole = F.concat(F.lit("00000010" "66747970" "68656963" "00000000"), meta, mdat, F.when(v == 3, "000000086D6F6F76").otherwise(""))
    return p.select("page_id", F.unhex(whole).alias("content"))


HEIC = "WITH p AS (SELECT page_id, page_id % 6 AS v, CASE WHEN page_id % 6 = 4 THEN 14 ELSE 0 END AS back, octet_length(encode(coalesce(html, ''))) AS n, octet_length(encode(url)) AS u FROM pages)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of entries with their places by id, and bytes of each extent."""
    files = stash(heic_files(spark, sf_dir), "files")
    items, extents = parts.rows_of(files, parts.heif_items, "page_id", "content"), parts.rows_of(files, parts.heif_extents, "page_id", "content")
    return items.select("page_id", "item", "label", "is_primary").join(extents.select("page_id", "item", "extent", "begin", "size"), ["page_id", "item"], "left")


PLACES_SQL = HEIC + """, e AS (
 SELECT *, unnest([{'item': 1, 'extent': 0, 'begin': 330, 'size': CAST(3 AS BIGINT)}, {'item': 1, 'extent': 1, 'begin': 333 + n, 'size': 2}, {'item': 2, 'extent': 0, 'begin': 333, 'size': n + CASE WHEN v = 5 THEN 100000 ELSE 0 END},
  {'item': 3, 'extent': 0, 'begin': 335 + n, 'size': u}, {'item': 4, 'extent': 0, 'begin': 335 + n + u - CASE WHEN v = 2 THEN 1 ELSE 0 END, 'size': 2}]) AS x FROM p)
SELECT page_id, CAST(x.item AS BIGINT) AS item, CASE x.item WHEN 2 THEN 'EXIF metadata' WHEN 3 THEN 'XMP metadata' END AS label, x.item = CASE WHEN v = 1 THEN 2 ELSE 1 END AS is_primary,
 CASE WHEN v <> 4 OR x.item <> 2 THEN x.extent END AS extent, CASE WHEN v <> 4 OR x.item <> 2 THEN x.begin - back END AS begin, CASE WHEN v <> 4 OR x.item <> 2 THEN x.size END AS size FROM e"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between items, and how many properties each has of its own."""
    files = stash(heic_files(spark, sf_dir), "files")
    refs = parts.rows_of(files, parts.heif_references, "page_id", "content").select("page_id", "ref", "kind", "from_item", "to_item", "slot")
    linked = parts.rows_of(files, parts.heif_associations, "page_id", "content").select("page_id", F.col("item").alias("to_item"), "properties")
    return refs.join(linked, ["page_id", "to_item"], "left")


REFERENCES_SQL = """SELECT page_id, r.ref AS ref, r.kind AS kind, CAST(r.f AS BIGINT) AS from_item, CAST(r.t AS BIGINT) AS to_item, r.slot AS slot, CASE WHEN r.t = 1 THEN 1 END AS properties FROM (SELECT page_id, unnest([
 {'ref': 0, 'kind': 'cdsc', 'f': 2, 't': 1, 'slot': 0}, {'ref': 1, 'kind': 'dimg', 'f': 1, 't': 3, 'slot': 0}, {'ref': 1, 'kind': 'dimg', 'f': 1, 't': 4, 'slot': 1}]) AS r FROM pages)"""


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files can't be rewritten, each gate a flag."""
    files = stash(heic_files(spark, sf_dir).withColumnRenamed("page_id", "f"), "files")
    told = heic_rows.gates(heic_rows.Tables(files)).withColumn("outcome", heic_rows.outcome())
    return told.select(F.col("f").alias("page_id"), "corrupt", "plain", *heic_rows.GATES, "outcome")


GATES_SQL = HEIC + """ SELECT page_id, false AS corrupt, false AS plain, v = 3 AS tracks, false AS groups, false AS layout, v = 4 AS no_place, v = 1 AS "primary", false AS nothing_left, v = 5 AS outside,
 v IN (2, 5) AS shared, false AS early, CASE WHEN v = 0 THEN 'ok' ELSE 'unsupported_layout' END AS outcome FROM p"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without their metadata, by joins."""
    return heic_rows.without_metadata(heic_files(spark, sf_dir), "page_id").select("page_id", "outcome", "removed", F.hex("cleaned").alias("cleaned"))


REWRITTEN_SQL = HEIC + """ SELECT page_id, CASE WHEN v = 0 THEN 'ok' ELSE 'unsupported_layout' END AS outcome, CASE WHEN v = 0 THEN CAST(n + u AS BIGINT) END AS removed, CASE WHEN v = 0 THEN
 '00000010667479706865696300000000' || '000000C46D65746100000000' || '0000000E7069746D000000000001' || '00000034696C6F6300000000' || '44000002' || '000100000002' || '000000DC00000003' || '000000DF00000002' || '000400000001' || '000000E100000002'
 || '0000003869696E66000000000002' || '00000015696E666502000000000100006876633100' || '00000015696E666502000000000400006876633100' || '0000001A6972656600000000' || '0000000E64696D67000100010004'
 || '0000002469707270' || '000000086970636F' || '0000001469706D61000000000000000100010101' || '0000000F6D646174' || 'AABBCCDDEE0102' END AS cleaned FROM p"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents that stay, before and after: those of every twelfth file with its first byte of data changed differ."""
    files = stash(heic_files(spark, sf_dir).withColumnRenamed("page_id", "f"), "files")
    t = heic_rows.Tables(files)
    made = heic_rows.rewritten(files, t).filter("cleaned is not null")
    spoilt = F.when(F.col("f") % 12 == 0, F.unhex(F.overlay(F.hex("cleaned"), F.lit("00"), F.lit(2 * 220 + 1), F.lit(2)))).otherwise(F.col("cleaned"))
    return heic_rows.compared(t, stash(made.select("f", spoilt.alias("content")), "spoilt")).withColumnRenamed("f", "page_id")


COMPARED_SQL = "SELECT page_id, CAST(e.item AS BIGINT) AS item, e.extent AS extent, NOT (page_id % 12 = 0 AND e.item = 1 AND e.extent = 0) AS same FROM (SELECT page_id, unnest([{'item': 1, 'extent': 0}, {'item': 1, 'extent': 1}, {'item': 4, 'extent': 0}]) AS e FROM pages WHERE page_id % 6 = 0)"

QUERIES = {"fmt2_parts": part_rows, "fmt6_previews": previews, "fmt13_located": located, "join4_places": places, "fmt10_references": references, "fmt12_gates": gates, "fmt14_joined": rewritten, "fmt15_compared": compared}
ORACLES = {"fmt2_parts": PARTS_SQL, "fmt6_previews": PREVIEWS_SQL, "fmt13_located": LOCATED_SQL, "join4_places": PLACES_SQL, "fmt10_references": REFERENCES_SQL, "fmt12_gates": GATES_SQL, "fmt14_joined": REWRITTEN_SQL, "fmt15_compared": COMPARED_SQL}
