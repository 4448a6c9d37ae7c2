"""Each operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import json
import random
import re
import subprocess
import sys
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import bpe, chat, fingerprint, language, minhash, mixing, secrets, substrings, topk, warc
from loomwork.llm.shared import scratch, with_row_key

R = random.Random(1)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, source string, size int, row int, id int, n int, kept string"


def corpus():
    texts = [" ".join(R.choice(WORDS) for _ in range(R.randint(0, 120))) for _ in range(60)]
    for k in range(20):
        w = texts[k].split()
        for _ in range(len(w) // 30):
            w[R.randrange(len(w))] = R.choice(WORDS)
        texts += [texts[k], " ".join(w)]
    texts += [None, "", "  \t ", "one", "A b C", "a B c", "x " * 6000, texts[3]]
    return [(i, t, [None, "a", "b", "ß"][i % 4], 1, 2, 3, 4, "5") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    odd = ["Héllo <|endoftext|>WORLD's 123 ΟΔΟΣ \x1c áb ﬁ", "ab" * 2000, "<|startoftext|>"]
    one = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for t in [r[1] or "" for r in rows] + odd:
        ids = own.encode(t, add_special_tokens=False).ids
        assert one.encode(t).tolist() == ids and one.decode(ids) == own.decode(ids, skip_special_tokens=False)
    got = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert len(got) == len(rows) and all(r.decoded == one.decode(one.encode(r.text)) for r in got)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = {r.doc_id: r for r in bpe.bpe_digests(docs).collect()}
    for i, t, *_ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert (told[i].n_tokens, told[i].ids_sha256, told[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    assert bpe.bpe_digests(empty).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    ids = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for k, i in enumerate(ids):
        t, nxt = text[i], text[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_next <= 1
    assert got[ids[0]].near_next == float(got[ids[0]].fingerprint == got[ids[1]].fingerprint)
    same = spark.createDataFrame([("Straße  A\n",), ("STRASSE a",), ("ﬁ é",), ("fi é",), (None,), ("",)], "text string")
    f = [r.fingerprint for r in fingerprint.fingerprints(same).collect()]
    assert f[0] == f[1] != f[2] == f[3] and f[4] == f[5]
    assert fingerprint.edited_fingerprints(empty).count() == 0


def lanes(text):
    """The fingerprint by its definition, with Python's own Unicode tables and xxhash64 as Spark chains it."""
    canon = re.sub(r"[\s\x85\x1c-\x1f\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())).strip(" ")
    lane = lambda name: xxhash.xxh64(canon.encode(), seed=xxhash.xxh64(name, seed=42).intdigest()).intdigest()
    return f"{lane(b'lane one'):016x}{lane(b'lane two'):016x}"


def test_fingerprint_values(spark):
    texts = ["", None, "Plain  ASCII\ttext", "ÀÉÎ õü ﬁ Straße", "İstanbul ΟΔΟΣ", "日本語　テキスト", "e\u0301 \u00e9", "x" * 100_000, "\u2003a\u00a0"]
    df = spark.createDataFrame([(t, "mine", 7) for t in texts], "text string, __canon string, fingerprint int")
    got = fingerprint.fingerprints(df).collect()
    assert sorted((r.text or "", r.fingerprint) for r in got) == sorted((t or "", lanes(t)) for t in texts) and got[0]["__canon"] == "mine"


@pytest.mark.parametrize("width", [200, 2000])
def test_next_row_at_any_width(spark, monkeypatch, width):
    """Hundreds of ranges, repeated and null keys, columns that clash; the plan does not grow with the cluster's width."""
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        rows = [(k * 7 % 2000 if k % 10 else 1234, f"t{k}" * (k % 4), k) for k in range(2000)] + [(None, "n1", -1), (None, "n2", -2)]
        df = spark.createDataFrame(rows, "k long, t string, __part int").repartition(5)
        got = [(r.k, r.t, r.next_t) for r in fingerprint.with_next(df, "k", ["t"]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got, key=str) == sorted(((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])), key=str)


def bundled(text):
    """A text's bundle by its definition."""
    out = np.zeros(language.DIMENSIONS)
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        word = f" {word} "
        for i in range(len(word) - 2):
            out += np.prod([np.roll(language.letter_vector(ord(c)), p) for p, c in enumerate(word[i : i + 3])], axis=0)
    return out


@pytest.mark.parametrize("chars, part, kept", [(400_000, 4_000, 8_000), (7, 5, 12)])
def test_bundles(monkeypatch, chars, part, kept):
    for name, value in (("CHARS", chars), ("SLICE", part), ("REMEMBERED", kept)):
        monkeypatch.setattr(language, name, value)
    texts = ["Hello wörld, été 12 x", "", None, "a", "the quick brown fox " * 3, "ab1cd", "语言识别 测试", "!!"]
    for got, text in zip(language.Bundler().bundle(texts), texts):
        assert (got == bundled(text)).all()


def test_bundle_of_a_large_alphabet_stays_small():
    """400,000 random characters of a large alphabet; the peak of a process of its own."""
    code = "import random, resource; from loomwork.llm.language import Bundler; r = random.Random(1); Bundler().bundle([''.join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(400_000))]); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 500


def test_language_edges(spark):
    """A carried text, a clash of names, repeated rows and a very long text."""
    proto = {"aa": bundled("kala mina"), "bb": bundled("strengst wurz")}
    rows = [(1, "kala kala", 5), (1, "kala kala", 5), (None, "wurz " * 60_000, 6), (2, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text int")
    got = language.predict(df, proto, carried=("doc_id", "text", "__text")).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r["__text"]) for r in got) == [("1", "aa", 5), ("1", "aa", 5), ("2", "und", 7), ("None", "bb", 6)]
    with pytest.raises(ValueError):
        language.predict(df.withColumn("score", F.lit(1)), proto, carried=("score",))


def test_language(spark):
    say = {"aa": "kala mina toro", "bb": "strengst flicht wurz"}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(say[lang].split()) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    proto = language.learn(df.filter(~language.held_out()))
    got = {x.doc_id: x for x in language.predict(df, proto).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(0 <= x.score <= 1 for x in got.values())
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert language.learn(df.limit(0)) == {} and language.predict(df, {}).filter("lang_pred = 'und'").count() == df.count()


def test_top_k(spark):
    r = random.Random(3)
    data = [(i, [r.randint(-300, 300) for _ in range(8)]) for i in range(400)] + [(400 + i, [7] * 8) for i in range(50)] + [(900, [1, 2]), (950, None)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<long>"), F.col("vec_id") % 50 == 0).collect()
    want = set()
    for q, v in data:
        if q % 50 == 0 and v:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q and w and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in got} == want
    assert not spark.createDataFrame([([1.0, None],), (None,), ([float("nan")],)], "e array<float>").filter(topk.usable(F.col("e"))).count()


@pytest.mark.parametrize("sizes", [(32_768, 4_096, 256), (60, 7, 5)])
def test_top_k_hot_and_large(spark, monkeypatch, sizes):
    """Many copies of one vector, repeated ids, values beyond doubles, small blocks; and that few exact vectors are read."""
    for name, value in zip(("CANDIDATES", "QUERIES", "SLICES"), sizes):
        monkeypatch.setattr(topk, name, value)
    r = random.Random(5)
    data = [(i, [r.randint(-(2**28), 2**28) for _ in range(4)]) for i in range(120)] + [(i % 3 * 50, [3, -3, 2**20, 7]) for i in range(100)] + [(1000 + i, [3, -3, 2**20, 7]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in data], "vec_id long, embedding array<long>, row int, score string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    want = set()
    asked = defaultdict(list)
    for q, v in data:
        if q % 50 == 0:
            asked[q] += [(-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q]
    for q, found in asked.items():
        want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(sorted(found)[:5])}
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in got} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc_null_ids(spark):
    rows = [(None, "u", "a", 1), (None, "u", "a", 2), (3, None, "a", 3), (2, "u", "a", 4), (5, "u", None, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row int")
    got = warc.archive_round_trip(df).collect()
    assert sorted((str(x.page_id), x.record_type, x.refers_to) for x in got) == [("2", "response", None), ("3", "revisit", 2), ("5", "response", None), ("None", "response", None), ("None", "response", None)]


def test_warc(spark):
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate(["a", "b", "a", None, "", "é\r\n\r\n", "a"])] + [(2, "u", "a")]
    got = warc.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    seen, want = {}, []
    for i, _, t in sorted(pages, key=lambda p: p[0]):
        data = (t or "").encode()
        first = seen.setdefault(data, i)
        want.append((i, len(data), warc.digest(data), data in [w[-1] for w in want], data))
        assert first <= i
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type == "revisit") for x in got) == sorted(w[:4] for w in want)
    assert all((x.refers_to is None) == (x.record_type == "response") for x in got)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        import io
        import zlib
        list(warc.members(io.BytesIO(zlib.compress(b"x" * 100, wbits=31)[:-5])))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_substrings(docs, rows, empty):
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs, width=6).collect()}
    seen = set()
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 5):
            key = tuple(w[k : k + 6])
            if key in seen:
                gone[k : k + 6] = [True] * 6
            seen.add(key)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert substrings.dedup_substrings(empty).count() == 0


def test_windows_need_all_their_bits(docs, rows, empty, monkeypatch):
    """With a 64-bit hash that says next to nothing, the 24 bits beside it still tell windows apart."""
    whole = substrings.window_hashes
    monkeypatch.setattr(substrings, "window_hashes", lambda h, w: whole(h, w) & np.uint64(0xF000000000000000) if w == 6 else whole(h, w))
    batch = substrings._Batch(np.arange(len(rows)), np.arange(len(rows)), [r[1] for r in rows], 6)
    known = {tuple(words(t)[k : k + 6]) for _, t, *_ in rows for k in range(len(words(t)) - 5)}
    assert len(batch.hashes) == len(known) and len(set(batch.hashes.tolist())) <= 16


def test_batches_by_bytes(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 16 * substrings.BATCH_ROWS)
    test_substrings(docs, rows, empty)


@pytest.mark.parametrize("stable", [True, False])
def test_rows_are_told_apart_however_a_scan_is_split(spark, tmp_path, stable):
    """A lost executor leaves fewer cores, and a later scan of the same files is split otherwise."""
    rows = [(i % 7, "w " * (i % 5 + 1), "abc"[i % 3], i, 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, tag int, _metadata int").repartition(9).write.parquet(f"{tmp_path}/t")
    keyed = with_row_key(spark.read.parquet(f"{tmp_path}/t"), "KEY", stable)
    seen = []
    for cores in ("1", "13"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        try:
            again = keyed.select("tag", "KEY")  # planned anew
            seen.append({r.tag: bytes(r.KEY) for r in again.collect()})
            parts = again.rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert parts > 1 and seen[0] == seen[1] and len(set(seen[0].values())) == 400


def test_near_duplicates_by_row(spark):
    """Of repeated rows one is kept; a text that only shares its id with a copy is kept."""
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[40:80])
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (9, " ".join(WORDS[80:120]), 3), (9, " ".join(WORDS[80:120]), 4), (None, a + " x", 5), (None, None, 6), (None, "", 7), (5, b, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.n: r for r in minhash.near_duplicates(df, row_col="n").collect()}
    assert len(got) == 9 and {n for n, r in got.items() if r.kept} in ({5, 2, 3, 6, 7}, {5, 8, 3, 6, 7}, {5, 2, 4, 6, 7})
    assert [got[n].component_id for n in (0, 1, 5)] == [None] * 3 and got[2].component_id == got[8].component_id == 5


@pytest.mark.parametrize("cell", [256, 3])
def test_minhash(docs, rows, empty, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words=4).collect()}
    sets = {}
    for i, text, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}
    if cell == 256:
        assert minhash.near_duplicates(empty).count() == 0


def test_mixing(docs, rows, empty):
    plan = mixing.mix_plan(docs).collect()
    size = {r[0]: len(words(r[1])) for r in rows}
    assert {r.doc_id: r["size"] for r in plan} == size and all(len(r.shards) == r.copies <= 2 for r in plan)
    by = defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    total = sum(r.target for r in (v[0] for v in by.values()))
    assert abs(total - 1.5 * sum(size.values())) < 1e-6
    for source, held in by.items():
        assert held[0].target <= 2 * held[0].source_size and abs(sum(r["size"] * r.copies for r in held) - held[0].target) <= max(r["size"] for r in held)
    again = {(r.doc_id, tuple(r.shards)) for r in mixing.mix_plan(docs).collect()}
    assert again == {(r.doc_id, tuple(r.shards)) for r in plan}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == sum(r.copies for r in plan) and set(docs.columns) <= set(mixed[0].asDict())
    assert mixing.mix_plan(empty).count() == 0
    tree = mixing.split_tree([100, 7, 0], 8, 1)
    assert [sum(x) for x in zip(*tree)] == [100, 7, 0] and max(map(sum, tree)) - min(map(sum, tree)) <= 1


def test_mix_follows_its_plan(spark):
    """Repeated ids, clashing names: each row comes as often as the plan says for that row."""
    rows = [(k % 40 if k % 3 else 1, "w " * (k % 7 + 1), "abc"[k % 3] if k % 11 else None, k, 5) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag int, shard int")
    mixed = mixing.mix(df).collect()
    plan = mixing.mix_plan(df, row_col="tag").collect()
    assert len(mixed) == sum(r.copies for r in plan) and max(Counter(r.tag for r in mixed).values()) <= 2
    for source in ("a", "b", "c", None):
        held = [r for r in plan if r.source == source]
        assert sum(len(r.text.split()) for r in mixed if r.source == source) == sum(r["size"] * r.copies for r in held)
    # water filling, by its definition: sources at their cap stop, the rest share by weight
    sizes = {s: sum(len(t.split()) for _, t, x, *_ in rows if x == s) for s in ("a", "b", "c", None)}
    weight = dict(zip(sizes, (5, 2, 1, 5)))
    want, open_ = {}, set(sizes)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(want.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over} if over else {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        open_ = open_ - over if over else set()
    assert all(abs(next(r.target for r in plan if r.source == s) - want[s]) < 1e-6 for s in sizes)


def test_secrets_by_place(spark):
    """Only the place that the scan means is masked; names never clash; many places, pieces and empty tables."""
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    r = random.Random(3)
    many = " ".join(f'token = "{"".join(r.choice("abcdef0123456789") for _ in range(40))}"' for _ in range(600))
    texts = [f'token = "{key}" but commit {key} was merged', None, "", "x " * 2044 + f' token = "{key}" ' + "y " * 50_000, many]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(0, texts[0], "c", "d")], "doc_id long, text string, __h1 string, __spans string")
    model = secrets.train(spark)
    got = secrets.redact(df, model=model).collect()
    first = sorted((x["__h1"], x["__spans"], x.text) for x in got if x.doc_id == 0)
    assert first == [(a, b, f'token = "[SECRET]" but commit {key} was merged') for a, b in (("a", "b"), ("c", "d"))]
    clean = {x.doc_id: x.text for x in got}
    assert (clean[1], clean[2], clean[3]) == (None, "", texts[3].replace(key, "[SECRET]")) and clean[4] == " ".join(['token = "[SECRET]"'] * 600)
    assert secrets.scan(df.limit(0), model).count() == 0 and secrets.redact(df.limit(0), model=model).count() == 0


def test_running_sums(spark):
    r = random.Random(4)
    for n in (1, 2, 31, 32, 33, 1024, 1025, 40_000):
        numbers = [r.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(numbers,)], "a array<int>").select(secrets.running_sums(F.col("a")).alias("x")).first().x
        assert got == list(itertools.accumulate(numbers))


def test_planted_secrets(spark):
    """Precision and recall of whole scans: planted findings of another seed, three to a document, between words of documents."""
    found = secrets.labelled_findings(1500, 123)
    prose = [r.text[:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400 and not text like '%token%'").limit(50).collect()]
    docs, planted = [], set()
    for k in range(0, len(found), 3):
        text = ""
        for n, f in enumerate(found[k : k + 3]):
            text += prose[(k + n) % len(prose)] + "\n"
            if f["secret"]:
                planted.add((k, len(text) + f["start"], len(text) + f["start"] + len(f["value"])))
            text += f["text"] + "\n"
        docs.append((k, text))
    got = {(r.doc_id, r.start, r.start + r.length) for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), secrets.train(spark)).filter("is_secret").collect()}
    by = defaultdict(list)
    for d, a, b in planted:
        by[d].append((a, b))
    caught = {(d, a, b) for d, a, b in planted if any(x == d and s < b and a < e for x, s, e in got)}
    right = [g for g in got if any(g[1] < b and a < g[2] for a, b in by[g[0]])]
    print(f"recall {len(caught) / len(planted):.3f} of {len(planted)}, precision {len(right) / len(got):.3f} of {len(got)}")
    assert len(caught) >= 0.9 * len(planted) and len(right) >= 0.9 * len(got)


def test_secrets(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    df = spark.createDataFrame([(1, f'la token = "{key}" fin', 0), (2, f"commit {key} was merged", 0), (3, None, 0), (4, "", 0), (5, "erungsteacherheitpfchen donaudampf", 0)], "doc_id long, text string, value int")
    model = secrets.train(spark)
    got = {(r.doc_id, r.start, r.length, r.is_secret) for r in secrets.scan(df, model).collect()}
    assert (1, 12, 40, True) in got and (2, 7, 40, False) in got and not any(g[3] for g in got if g[0] == 5)
    clean = {r.doc_id: r.text for r in secrets.redact(df, model=model).collect()}
    assert clean[1] == 'la token = "[SECRET]" fin' and clean[3] is None and key in clean[2]
    # held-out findings of another seed
    other = secrets.labelled_findings(1000, 99)
    rows = F.from_json(F.lit(json.dumps(other)), "array<struct<value:string,before:string,after:string,secret:double>>")
    scored = model.transform(secrets._assembled(spark.range(1).select(F.inline(rows))))
    assert scored.filter("prediction = secret").count() >= 950


def test_unquoted_secrets(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    mixed = "wJalrXUtnFEMIaK7MDENGbPxRfiCYzQ3kLmN8pTs"
    padded = "q83vEjRWeJq83vEjRWeJq83vEjRWeJq83vEjRWeJ9w8="
    cases = [(f"token={key}", key), (f"see https://host.example/cb?access_token={key}&a=1 now", key), (f"AWS_SECRET_ACCESS_KEY={mixed}\n", mixed), (f"la api_key={padded} fin", padded), (f"é CLIENT_SECRET_VALUE_A={mixed} AWS_SECRET_ACCESS_KEY={key}", mixed)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    model = secrets.train(spark)
    found = secrets.scan(df, model).filter("is_secret").collect()
    for i, (text, value) in enumerate(cases):
        assert (i, text.index(value), value) in {(r.doc_id, r.start, r.value) for r in found}
    assert len(found) == 6
    clean = {r.doc_id: r.text for r in secrets.redact(df, model=model).collect()}
    assert clean[1] == "see https://host.example/cb?access_token=[SECRET]&a=1 now" and clean[2] == "AWS_SECRET_ACCESS_KEY=[SECRET]\n"
    # held-out candidates of whole texts: no secret of another seed stays without a candidate
    other = secrets.labelled_findings(1000, 99)
    scored = model.transform(secrets._assembled(secrets.drawn(spark, other))).cache()
    assert scored.filter("secret = 1").count() >= 500 and scored.filter("prediction = secret").count() >= 0.95 * scored.count()


def test_short_secrets(spark):
    cases = [
        ('password = "hunter2!xyz"', "hunter2!xyz"), ("la postgres://user:S3cretPw99@db fin", "S3cretPw99"), ("DB_PASSWORD=Tr0ub4dor&3\n", "Tr0ub4dor&3"), ('{"passwd": "b7#kQ9,wz"}', "b7#kQ9,wz"),
        ("https://host.example/in?user=a&password=q8!Rt2zW&next=home", "q8!Rt2zW"), ("redis://:x9Kp4mQ2@localhost:6379/0", "x9Kp4mQ2"), ("Server=db;Password=k3y!Zebra7;Timeout=5", "k3y!Zebra7"), (f"token={'aB3' * 6},rest9!", "aB3" * 6),
    ]
    harmless = ["la secret garden of the authors was private property", "password = getPassword()", "password: required", "see http://host.example:8080/index"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in cases] + harmless)], "doc_id long, text string")
    model = secrets.train(spark)
    rows = secrets.scan(df, model).collect()
    assert len({(r.doc_id, r.start, r.value) for r in rows}) == len(rows)
    found = {(r.doc_id, r.start, r.value): r.is_secret for r in rows}
    missing = [(t, v) for i, (t, v) in enumerate(cases) if (i, t.index(v), v) not in found]
    wrong = [(t, v) for i, (t, v) in enumerate(cases) if not found.get((i, t.index(v), v))]
    assert not missing and not wrong
    assert not [k for k, v in found.items() if v and k[0] >= len(cases)]
    clean = {r.doc_id: r.text for r in secrets.redact(df, model=model).collect()}
    assert clean[0] == 'password = "[SECRET]"' and clean[1] == "la postgres://user:[SECRET]@db fin"
    # every secret of whole texts of another seed gets a candidate, short ones as well
    other = [dict(f, text=f["text"], secret=float(i)) for i, f in enumerate(secrets.labelled_findings(1000, 99)) if f["secret"]]
    reached = {r.secret for r in secrets.drawn(spark, other).filter("secret > 0").select("secret").distinct().collect()}
    assert not [f["text"] for f in other if f["secret"] not in reached]


def test_chat_layouts(spark):
    """Fields beside the needed ones, nested and empty lists, texts that are no strings; rejects are counted, never formatted."""
    records = [
        '{"id": 3, "messages": [{"role": "human", "content": "hi", "name": "n"}, {"role": "tool", "content": null, "x": {"content": [1]}}, {"role": "assistant", "content": [{"type": "text"}]}]}',
        '{"messages": []}', '{"id": 1, "system": "s", "instruction": "i", "input": "n", "output": "o"}', '{"meta": {"messages": [{"role": "a", "content": "b"}]}}', '{"prompt": "p", "completion": "c", "extra": [1]}', "[1]", "3",
        '{"`a: b`": {"role": 1}, "c d": [[{"e": []}]]}',
    ]
    df = spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(records)], "k int, record string, layout string, __pieces int")
    record = F.parse_json("record")
    turned = chat.canonical_turns(df, record)
    got = {r.k: r for r in chat.format_turns(turned).collect()}
    assert [got[k].layout for k in range(8)] == ["messages", "no_messages", "system_instruction_input", None, "prompt", None, None, None]
    assert [(t.role, t.text) for t in got[0].turns] == [("user", "hi"), ("tool", ""), ("assistant", '[{"type":"text"}]')] and got[1].formatted == "" and got[3].formatted is None and got[0]["__pieces"] == 1
    assert [(t.role, t.text) for t in got[2].turns] == [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]
    counts = {r.paths: r.n for r in chat.reject_counts(turned, record).collect()}
    assert counts == {"": 2, "meta meta.messages meta.messages[].content meta.messages[].role": 1, "```a: b``` ```a: b```.role `c d` `c d`[][].e `c d`[][].e[]!": 1} and chat.rejects(turned).count() == 4
    assert chat.format_turns(chat.canonical_turns(df.limit(0), record)).count() == 0
    long = "</s>[INST] é " * 20_000
    one = chat.format_turns(spark.createDataFrame([([("assistant", long)],)], "turns array<struct<role:string,text:string>>"))
    back = one.select(chat.read_turns(F.col("formatted"))[0]["text"].alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert back.t == back.l == long
    for layout in chat.LAYOUTS:
        paths = spark.range(1).select(chat.field_paths(F.parse_json(F.lit(layout.sample))).alias("p")).first().p
        assert layout.name == "row" or sorted(paths) == sorted(chat.needed_paths(json.loads(layout.sample)))


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|x", "[\\INST]", "a\n", "", None, "<|end|>\n<|end|>\n", "<\\\\|"]
    records = [json.dumps({"messages": [{"role": "user", "content": t}, {"role": "gpt", "content": t}]}) for t in texts]
    records += [json.dumps({"prompt": "p", "completion": "c"}), json.dumps({"instruction": "i", "input": "n", "output": "o"}), json.dumps({"who": "knows"})]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "k int, record string, turns string")
    made = chat.format_turns(chat.canonical_turns(df, F.parse_json("record")))
    got = {r.k: r for r in made.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[i].back] == [("user", t or ""), ("assistant", t or "")] and got[i].loss == (t or "")
    assert (got[9].layout, got[9].loss, got[10].layout, got[10].loss, got[11].layout, got[11].formatted) == ("prompt", "c", "instruction_input", "o", None, None)
