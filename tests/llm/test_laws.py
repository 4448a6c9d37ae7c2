"""The splitting tree against the multivariate hypergeometric law, and language profiles against their definition."""

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomwork.llm import language, mixing, topk


def test_splitting_tree_follows_the_law():
    """Blocks of a shard of a random split: counts of all outcomes against their exact chances (chi-square)."""
    quotas, shards, n = [4, 3, 2], 3, 6000
    seen = [Counter() for _ in range(shards)]
    for seed in range(n):
        split = mixing.split_tree(quotas, shards, seed)
        assert [sum(x) for x in zip(*split)] == quotas and all(sum(x) == 3 for x in split)
        for k, mine in enumerate(split):
            seen[k][tuple(mine)] += 1
    total = math.comb(sum(quotas), 3)
    chances = {(a, b, 3 - a - b): math.comb(4, a) * math.comb(3, b) * math.comb(2, 3 - a - b) / total for a in range(4) for b in range(4 - a) if 3 - a - b <= 2}
    assert sum(chances.values()) == pytest.approx(1)
    for found in seen:
        assert set(found) <= set(chances)
        chi2 = sum((found[x] - n * p) ** 2 / (n * p) for x, p in chances.items())
        # eight degrees of freedom: beyond 30 with a chance of 2e-4
        assert chi2 < 30
    # shards of one split are not independent, but two seeds are
    assert mixing.split_tree(quotas, shards, 1) == mixing.split_tree(quotas, shards, 1) != mixing.split_tree([40, 30, 20], 3, 2)


def profile(text):
    """The sum of bound trigrams whose middle is a letter, letters lower-cased, anything else one gap."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(runs.split()) + " "
    out = np.zeros(language.DIMENSIONS)
    for i in range(len(padded) - 2):
        gram = padded[i : i + 3]
        if gram[1] != " ":
            vector = np.ones(language.DIMENSIONS)
            for place, c in enumerate(gram):
                vector *= np.roll(language.letter_vector(ord(c)).astype(float), place)
            out += vector
    return out


def test_prototypes_and_cosines_by_definition(spark):
    rows = [("en", "the cat sat on the mat, twice"), ("en", "A dog; and the other dog"), ("de", "der Hund saß über dem Zaun"), ("de", "und die Katze schläft"), (None, "unlabelled"), ("fr", None)]
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id int, lang string, text string")
    learned = language.learn(df)
    unit = lambda v: v / np.linalg.norm(v)
    want = {k: unit(sum(unit(profile(t)) for lang, t in rows if lang == k)) for k in ("de", "en")}
    assert list(learned) == ["de", "en"]
    for k in want:
        assert learned[k] == pytest.approx(want[k], abs=1e-6)
    asked = ["the dog and the cat", "die Katze und der Hund", "123"]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), learned).collect()}
    for i, text in enumerate(asked[:2]):
        cos = {k: float(unit(profile(text)) @ v) for k, v in want.items()}
        best = max(cos, key=cos.get)
        assert (got[i].lang_pred, got[i].score) == (best, pytest.approx(max(cos[best], 0), abs=1e-6))
    assert (got[2].lang_pred, got[2].score) == ("und", 0)


def test_top_k_in_rounds_keeps_few_bounds(spark, monkeypatch):
    """Many small blocks: the same results as brute force, and bounds that grow with the logarithm of the blocks."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng, kept = np.random.default_rng(3), []
    vectors = rng.integers(-200, 200, (4000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<long>").repartition(2)
    made = topk.stash
    monkeypatch.setattr(topk, "stash", lambda df, name, *a: kept.append((name, made(df, name, *a))) or kept[-1][1])
    counts = []
    monkeypatch.setattr(topk, "discard", lambda *frames: counts.extend(f.count() for n, f in kept if n == "near"))
    got = topk.top_k(rows, F.col("vec_id") % 100 == 0, 5).collect()
    for q in range(0, 4000, 100):
        scores = vectors @ vectors[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best
    # 64 blocks: five a block without bars would be 320 a query
    assert len(counts) >= 6 and sum(counts) / 40 < 100
