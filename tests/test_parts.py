"""Parts of files as rows, and HEIC files rewritten by joins: the same bytes as file by file."""

import hashlib
import struct

from pyspark.sql import functions as F

from loomwork.operators import containers, heic, heic_rows, parts
from tests.test_containers import ADOBE, ICC, SCAN, SOF, chunk, riff, seg
from tests.test_heic import box
from tests.test_heic import heic as heic_file


def test_labelled_parts_are_those_of_clean(spark):
    note = seg(0xFE, b"hi")
    files = [
        b"\xff\xd8" + seg(0xE1, b"Exif\0\0II*\0") + ICC + seg(0xE5, b"?") + ADOBE + note + SOF + SCAN + b"\xff\xd9junk", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Title\0x") + chunk(b"tIME", b"\0" * 7) + chunk(b"IEND", b""),
        riff((b"VP8 ", b"abc"), (b"EXIF", b"II"), (b"XMP ", b"<x/>")), b"\xff\xd8\xff\xe0", None, b"plain text of some length",
    ]
    df = spark.createDataFrame(list(enumerate(files)), "k int, content binary")
    rows = parts.labelled_parts(df, "k")
    got = {r.k: (r.labels, r.removed) for r in parts.stripped_totals(rows, "k").collect()}
    for r in containers.clean(df).collect():
        want = ("; ".join(s.label for s in r.strips), sum(s.size for s in r.strips)) if r.strips is not None else ("", 0)
        assert got[r.k] == want
    details = {r.k: sorted(x for x in r.d if x) for r in rows.groupBy("k").agg(F.collect_list("detail").alias("d")).collect()}
    assert details[0] == ["APP5"] and details[1] == ["Title"]
    assert {r.k: r.error for r in rows.filter("error is not null").collect()} == {3: "corrupt", 4: "unsupported", 5: "unsupported"}


def test_functions_in_sql(spark):
    parts.register_all(spark)
    spark.createDataFrame([(1, heic_file())], "k int, content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT k, r.kind, r.from_item, r.to_item FROM some_files, LATERAL heif_references(content) r ORDER BY ref, slot").collect()
    assert [tuple(r) for r in got] == [(1, "cdsc", 2, 1), (1, "dimg", 1, 3), (1, "dimg", 1, 4)]
    labels = spark.sql("SELECT i.item, i.label, e.begin IS NOT NULL AS placed FROM some_files, LATERAL heif_items(content) i, LATERAL heif_extents(content) e WHERE e.item = i.item AND e.extent = 0 ORDER BY i.item").collect()
    assert [tuple(r) for r in labels] == [(1, None, True), (2, "EXIF metadata", True), (3, "XMP metadata", True), (4, None, True)]


def by_file(b):
    try:
        strips, _, out = heic.heic_without_metadata(b)
        return "ok", sum(n for _, n in strips), out
    except heic.Unsuited:
        return "unsupported_layout", None, None
    except (ValueError, IndexError):
        return "corrupt", None, None


def test_heic_by_joins_is_heic_by_file(spark):
    whole = heic_file()
    cases = [heic_file(v, b, w) for v in (0, 1) for b in (False, True) for w in (False, True)]
    cases += [heic_file(primary=2), heic_file(overlap=True), heic_file(extra=box(b"grpl", b"")), whole + box(b"moov", b""), whole[:-3], b"", whole[:60], whole.replace(b"Exif\0", b"Exig\0").replace(b"mime", b"mimf"), whole + struct.pack(">I4s", 0, b"free") + b"abc"]
    cases.append(whole.replace(box(b"cdsc", struct.pack(">HHH", 2, 1, 1)) + box(b"dimg", struct.pack(">HHHH", 1, 2, 3, 4)), box(b"cdsc", struct.pack(">HHH", 2, 1, 1)) + box(b"dimg", struct.pack(">HHHH", 3, 2, 1, 4))))
    cases.append(whole.replace(box(b"cdsc", struct.pack(">HHH", 2, 1, 1)), box(b"cdsc", struct.pack(">HH", 4, 0) + b"\0\0")))
    df = spark.createDataFrame(list(enumerate(cases)), "k int, content binary").repartition(3)
    got = {r.k: (r.outcome, r.removed, r.cleaned and bytes(r.cleaned)) for r in heic_rows.without_metadata(df, "k").collect()}
    for k, b in enumerate(cases):
        want = by_file(b)
        assert got[k][:2] == want[:2], (k, got[k][:2], want[:2])
        assert got[k][2] == (want[2] or None), k


def test_all_tables_by_one_reading(spark):
    whole = heic_file()
    cases = [whole, heic_file(1, True, True), heic_file(overlap=True), whole[:-3], whole[:60], b"", None]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, content binary").repartition(2)
    every = parts.heif_rows(df, "k").cache()
    for name in parts.HEIF:
        got = every.filter(F.col("tbl") == name).select("k", f"{name}.*").collect()
        assert got and sorted(map(str, got)) == sorted(map(str, parts.rows_of(df, parts.FUNCTIONS[f"heif_{name}"], "k", "content").collect()))
    for r in every.filter("tbl = 'extents'").select("k", "extents.*", "fits", "sha").filter("begin is not null").collect():
        b = cases[r.k]
        assert r.fits == (r.begin + r.size <= len(b))
        assert r.sha == (hashlib.sha256(b[r.begin : r.begin + r.size]).hexdigest() if r.fits else None)
    far = parts._structs([(0, 1, 2, 3, None, 0, 0, 8, 0, 5, 2**63, 9, None)], parts._STRUCTS["extents"]).to_pylist()
    assert far[0]["begin"] is None and far[0]["size"] == 9
