"""Trie, Katz model and importance resampling against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwork.llm import importance, katz, trie

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeéAB") for _ in range(R.randint(1, 5))) for _ in range(80)]


# -- conversation prefix trie --------------------------------------------------------------------------
def conversations():
    rows = []
    for c in [*range(45), 60, 61, -7, 2**60 + 1]:
        rows += [(c, None if t == 0 and c % 9 == 0 else t, R.choice(["user", "assistant", None]), R.choice(["", None, "a b", "c", "  d  e\tf "]), 1, "x", 2) for t in range(R.randint(1, 6))]
    rows += rows[:3] + [(None, 1, "user", "lost", 1, "x", 2)] + [(7, t, "user", "deep " * 3, 1, "x", 2) for t in range(10, 90)]
    rows += [(c, t, "user", "hot", 1, "x", 2) for c in range(100, 140) for t in range(2)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, pos int, words string, id int"


def nodes_by_definition(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - math.fmod(c, 20)) if abs(c) < 2**50 else c - c % 20
        rebuilt[c] = own.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(rebuilt[c]) == len(n)))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]) if n in children else 0, leaves[n], saved[n], sha(n)) for n, m in list(members.items()))


def grown(spark, rows):
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    conv = F.col("conv")
    return trie.prefix_trie(*trie.with_shared_heads(turns, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3))


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    rows = conversations()
    got = sorted(tuple(-1 if x is None else x for x in r) for r in grown(spark, rows).collect())
    assert got == nodes_by_definition(rows)
    assert grown(spark, []).count() == 0


def test_trie_of_one_long_conversation(spark):
    rows = [(40, t, "user", f"t{t}", 1, "x", 2) for t in range(700)]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in grown(spark, rows).collect())
    assert got == nodes_by_definition(rows) and len(got) == 701


def test_subtree_sums_of_a_chain_and_a_star(spark):
    edges = [(0, None, 1)] + [(i, i - 1, 1) for i in range(1, 300)] + [(1000 + i, 5, 1) for i in range(500)]
    got = {r.id: r.n for r in trie.subtree_sums(spark.createDataFrame(edges, "id long, parent long, n long"), "n").collect()}
    assert got[0] == 800 and got[5] == 795 and got[6] == 294 and got[299] == got[1000] == 1 and len(got) == 800


# -- Katz backoff -------------------------------------------------------------------------------------
def texts():
    out = [(i, " ".join(R.choice(WORDS[: R.choice([5, 20, 80])]) for _ in range(R.randint(0, 60))), 1, 2) for i in range(80)]
    return out + [(80, None, 1, 2), (81, "", 1, 2), (82, "unheard of words", 1, 2), (83, WORDS[0] + " x", 1, 2), (None, "a b", 1, 2), (2**60 + 1, "a b c", 1, 2), (3, out[3][1], 1, 2), (84, "x " * 9000, 1, 2)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Brute:
    """The model by its definition, n-gram by n-gram."""

    def __init__(self, rows, order):
        self.order, self.grams = order, [Counter() for _ in range(order)]
        self.history = [Counter() for _ in range(order)]
        for text in rows:
            t = [0] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                for m in range(order):
                    self.grams[m][tuple(t[i - m : i + 1])] += 1
                    self.history[m][tuple(t[i - m : i])] += 1
        self.left = [katz.discounts([sum(n == r for n in g.values()) for r in range(1, katz.FITTED + 1)]) for g in self.grams]

    def kept(self, m, n):
        small, power = self.left[m]
        return n * (small[n] if n <= katz.TURING else (1 + 1 / n) ** power)

    def followers(self, m, h):
        return [(g, n) for g, n in self.grams[m].items() if g[:-1] == h]

    def chance(self, g):
        m = len(g) - 1
        n, of = self.grams[m][g], self.history[m][g[:-1]]
        if n:
            return self.kept(m, n) / of
        if not m:
            return 1 - sum(self.kept(0, n) for n in self.grams[0].values()) / of if of else 1.0
        if not of:
            return self.chance(g[1:])
        seen = self.followers(m, g[:-1])
        weight = (1 - sum(self.kept(m, n) for _, n in seen) / of) / (1 - sum(self.chance(x[1:]) for x, _ in seen))
        return weight * self.chance(g[1:])

    def score(self, text):
        t = [0] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.chance(tuple(t[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(t)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order):
    rows = texts()
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, n int").repartition(3)
    got = katz.score(df, fifth != 1, order=order).collect()
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    brute = Brute([t for i, t, *_ in rows if train(i)], order)
    n, v = sum(brute.grams[0].values()), len(brute.grams[0])
    want = []
    for i, t, *_ in rows:
        c = [brute.grams[0][(w,)] for w in tokens(t)]
        want.append((-1 if i is None else i, train(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), brute.score(t)))
    found = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_katz_normalises():
    rows = [t for _, t, *_ in texts() if t and len(t) < 2000]
    brute = Brute(rows, 2)
    for h in list(brute.history[1])[:25]:
        known = sum(brute.chance((*h, *w)) for w in brute.grams[0])
        assert known + brute.chance((*h, "never said")) == pytest.approx(1, abs=1e-9)


def test_katz_without_training_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = katz.score(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert katz.score(df.limit(0), F.lit(True)).count() == 0
    names = spark.createDataFrame([("a", "x y"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in katz.score(names, F.col("doc_id").isNotNull()).collect()} == {"a", None}


# -- importance resampling ----------------------------------------------------------------------------
@pytest.mark.parametrize("runs", [(1, 1), (1, 2)])
def test_importance(spark, runs, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 7)
    docs = [(i, None if i == 3 else " ".join(R.choice(WORDS) for _ in range(R.randint(0, 90))) + "!x-9Ä", 1, 2) for i in range(120)] + [(120, "", 1, 2), (2**60 + 1, "a b", 1, 2), (None, "z " * 30, 1, 2), (5, "same " * 25, 1, 2), (5, "same " * 25, 1, 2)]
    goal = [(i, " ".join(WORDS[:20])) for i in range(3)] + [(9, None)]
    buckets, percent = 50, 30
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string, rank int, ids int").repartition(4), spark.createDataFrame(goal, "item_id long, text string"), buckets=buckets, runs=runs, percent=percent)

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1))

    s, t = (sum((features(r[1])[1] for r in rows), Counter()) for rows in (docs, goal))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, text, *_ in docs:
        n, f = features(text)
        weight = sum(gain[b] * k for b, k in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, -1 if i is None else i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1]))
    place = [(*r[1:], k if k <= percent * len(fit) // 100 else -1) for k, r in enumerate(fit, 1)] + [(*r[1:], -1) for r in rows if r[0] < 20]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"] or -1) for r in got.collect()) == sorted(place)


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    goal = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(none, goal).count() == 0
    assert importance.resample(some, goal, percent=100).first()["rank"] == 1


def test_a_row_group_of_the_matrix_is_small_whatever_a_task_writes(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_ROWS", 50)
    monkeypatch.setattr(importance, "GROUP_BYTES", 20_000, raising=False)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.md5(F.concat(k.cast("string"), F.col("id").cast("string")))), " ")
    matrix = importance.count_matrix(spark.range(0, 2000, 1, 1).select("id", text.alias("text")), "id")
    assert matrix.count() == 40 and sum(importance._sums(matrix, 10_000)) == 200_000
    for path in matrix.inputFiles():
        held = pq.ParquetFile(path.removeprefix("file://")).metadata
        sizes = [held.row_group(i).total_byte_size for i in range(held.num_row_groups)]
        assert len(sizes) > 5 and max(sizes) < 40_000
