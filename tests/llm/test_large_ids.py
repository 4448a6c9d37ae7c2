"""Ids above 2^53 beside null ones, values of a million characters, layouts that must lose no text, wide shuffles."""

import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, fingerprint, language, minhash, mixing, secrets, substrings, warc
from loomwork.operators import pixels

BIG = 2**60


def test_archived_ids(spark):
    rows = [(BIG + 1, "u", "same"), (BIG + 3, "u", "same"), (None, "u", "same"), (BIG + 5, "u", None), (None, "u", ""), (7, "u", "other")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    told = sorted(((-1 if r.page_id is None else r.page_id), r.record_type, r.refers_to) for r in got)
    assert told == [(-1, "response", None), (-1, "response", None), (7, "response", None), (BIG + 1, "response", None), (BIG + 3, "revisit", BIG + 1), (BIG + 5, "response", None)]


def test_predicted_ids(spark):
    rows = [(BIG + 1, "hello there", "en"), (None, "hallo da", "de"), (BIG + 5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = language.predict(df, language.learn(df)).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(BIG + 1, "en"), (None, "de"), (BIG + 5, "und")}
    assert language.predict(df.limit(0), language.learn(df)).count() == 0


def test_counted_ids(spark):
    df = spark.createDataFrame([(BIG + 1, b"abcd" * 64), (None, b"abce" * 64), (BIG + 5, b"xyzw" * 64)], "id long, data binary").coalesce(1)
    ids = {BIG + 1, None, BIG + 5}
    data = F.col("data")
    for made in (pixels.histograms(df, "id", data), pixels.channel_tests(df, "id", data), pixels.segment_tests(df, "id", data), pixels.extract_bits(df, "id", data, F.lit(8))):
        assert {r.id for r in made.select("id").collect()} == ids


@pytest.mark.parametrize("n", [3_000, 100_000, 1_000_000])
def test_long_secrets_do_not_recurse(spark, n):
    plain, escaped = "aB3$" * (n // 4), '\\"' * (n // 2)
    texts = [form % plain for form in ('password = "%s"', "token='%s'", "token=%s", "https://a.b/?secret_key=%s&x=1", "postgres://u:%s@host/db", "x;auth=%s;y")] + ['password = "%s"' % escaped]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", secrets.candidates(spark.createDataFrame([], "text string"), "text").alias("c")).collect()
    assert [len(r.c) for r in sorted(got)] == [1] * len(texts) and spark.range(3).count() == 3


SHAPES = [
    ('{"messages": [], "prompt": "p", "completion": "c"}', "prompt", [("user", "p"), ("assistant", "c")], []),
    ('{"conversations": [{"from": "human", "value": "v"}], "system": "s"}', "system_shared", [("system", "s"), ("user", "v")], []),
    ('{"question": "q", "answer": "a", "context": "c"}', "context_question", [("user", "c"), ("user", "q"), ("assistant", "a")], []),
    ('{"prompt": [{"role": "user", "content": "x"}], "completion": [{"role": "assistant", "content": "y"}]}', "prompt_turns", [("user", "x"), ("assistant", "y")], []),
    ('{"messages": [{"role": "user", "content": "x"}], "system": "s", "id": "z"}', "system_messages", [("system", "s"), ("user", "x")], ["id"]),
    ('{"messages": []}', "no_messages", [], []),
    ('{"instruction": "i", "output": "o", "meta": {"note": "n", "deep": [{"t": "u"}]}, "tags": ["a", "b"], "n": 3}', "instruction", [("user", "i"), ("assistant", "o")], ["meta.deep[].t", "meta.note", "tags[]"]),
]


def test_no_text_is_lost_uncounted(spark):
    df = spark.createDataFrame([(s[0], "mine") for s in SHAPES] + [('{"odd": 1}', "mine")], "r string, unformatted string")
    turned = chat.canonical_turns(df, F.parse_json("r"))
    got = {r.r: r for r in turned.collect()}
    for text, layout, turns, left in SHAPES:
        assert (got[text].layout, [tuple(t) for t in got[text].turns], sorted(got[text].unformatted)) == (layout, turns, left)
    assert got['{"odd": 1}'].unformatted is None
    assert {tuple(r) for r in chat.unformatted_counts(turned).collect()} == {("system_messages", "id", 1), ("instruction", "meta.deep[].t", 1), ("instruction", "meta.note", 1), ("instruction", "tags[]", 1)}


def test_mix_deals_as_wide_as_the_session(spark):
    docs = spark.createDataFrame([(i, f"w{i} x", "a") for i in range(6000)], "doc_id long, text string, source string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        mixed = mixing.mix(docs)
        assert mixed.select(F.spark_partition_id().alias("p")).distinct().count() > 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_windows_are_judged_alike_when_cores_come_and_go(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    shared = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(i, f"a{i} {shared} b{i}") for i in range(400)], "doc_id long, text string").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    whole = {tuple(r) for r in substrings.dedup_substrings(docs, stable=True).collect()}
    assert sum(r[2] for r in whole) == 399 * 30
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    try:
        assert {tuple(r) for r in substrings.dedup_substrings(docs, stable=True).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_other_ids_are_refused(spark):
    docs = spark.createDataFrame([("a", "u", "some text")], "doc_id string, url string, text string")
    for make in (fingerprint.edited_fingerprints, substrings.dedup_substrings, minhash.near_duplicates, lambda df: warc.write_warc(df, "nowhere", id_col="doc_id")):
        with pytest.raises(ValueError, match="ids must be integers"):
            make(docs)
