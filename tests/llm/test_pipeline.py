"""The pipeline's stages against brute force, and queries with SQL against their SQL."""

import os
import random
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from loomwork.llm import bpe, mixing
from loomwork.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SECRET = "ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA1bC3"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts of four invented languages with near copies of growing distance, a secret, and texts that no stage before can use."""
    r = random.Random(4)
    words = {x: ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(400)] for x, letters in {"en": "abcdefgh", "de": "ghijklmn", "fr": "mnopqrst", "es": "stuvwxyz"}.items()}
    rows = []
    for k in range(60):
        lang = list(words)[k % 4]
        text = [r.choice(words[lang]) for _ in range(80)]
        rows.append((len(rows), " ".join(text), lang, "abc"[k % 3]))
        if k % 5 == 0:
            for changed in range(0, 9):  # 76 shingles, five of them touched by each change
                near = list(text)
                for c in range(changed):
                    near[10 * c % 80] = f"{near[10 * c % 80]}x{len(rows)}"
                rows.append((len(rows), " ".join(near), lang if changed % 2 else None, None))
    rows += [(len(rows) + i, t, None, "z") for i, t in enumerate([None, "", "12 34 !!", f"{' '.join(words['en'][:30])} token = \"{SECRET}\" {' '.join(words['en'][30:60])}"])]
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    where = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{where}/documents.parquet")
    return where, spark.read.parquet(f"{where}/documents.parquet")


def one_of_each(rows):
    """Ids that brute force keeps: the smallest of each component of pairs alike in 0.8 of their five-word shingles."""
    sets = {}
    for r in rows:
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return {i for i in sets if least[i] == i}


def test_stages(spark, corpus):
    where, docs = corpus
    assert [name for name, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "bpe_encode"]
    every = {r.doc_id: r for r in docs.collect()}
    named = P.identify_languages(spark, docs, where)
    assert named.columns == docs.columns
    kept = {r.doc_id: r for r in named.collect()}
    assert set(kept) == {i for i, r in every.items() if any(c.isalpha() for c in r.text or "")}
    assert all(r.text == every[i].text and r.source == every[i].source and r.lang == (every[i].lang or r.lang) for i, r in kept.items())
    named = spark.createDataFrame(list(kept.values()), docs.schema)

    single = P.drop_near_duplicates(spark, named, where)
    alone = single.collect()
    assert single.columns == docs.columns and sorted(r.doc_id for r in alone) == sorted(one_of_each(kept.values()))
    single = spark.createDataFrame(alone, docs.schema)

    clean = P.redact_secrets(spark, single, where)
    redacted = clean.collect()
    assert clean.columns == docs.columns and len(redacted) == len(alone)
    for r in redacted:
        assert r.text == kept[r.doc_id].text.replace(SECRET, "[SECRET]") and r.n_chars == len(r.text)
    clean = spark.createDataFrame(redacted, docs.schema)

    mixed = P.mix_sources(spark, clean, where).collect()
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(clean).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    mixed = spark.createDataFrame(mixed, docs.schema)

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    for r in P.encode(spark, mixed, where).collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)


def test_repeated_and_null_ids(spark):
    """Rows are told apart by number: a text that shares its id with a copy stays, repeated rows come once, every stage takes null ids and empty tables."""
    a, b, c = (" ".join(f"{x}{k}e" for k in range(40)) for x in ("wa", "wb", "wc"))
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", None, 1), (9, c, None, "s", 1), (9, c, None, "s", 1), (None, c + " x", "en", "t", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, DIR).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("5", b), ("None", c + " x"), ("None", "")])
    for table in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, table, DIR)
            assert set(docs.columns) <= set(out.columns) and (out.count() > 0) == (table is docs), name


def test_run_is_the_stages(spark, corpus):
    where, _ = corpus
    first, again = (Counter((r.doc_id, tuple(r.token_ids)) for r in P.run(spark, where).collect()) for _ in range(2))
    assert first and first == again


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name].strip()})").fetchall()
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(key, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(key, want))
