"""Two-level running totals: one hot key, null keys, ties, descending order, no keys, an empty table."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.operators import intervals
from loomwork.operators.prefix import FEW, has_hot_key, running_totals

R = random.Random(3)
ROWS = [(R.choice(["hot"] * 6 + ["a", "b", None]), i, R.choice([1, 2, None])) for i in range(3000)]


def expected(rows, key, order, before):
    sums, out = defaultdict(int), {}
    for r in sorted(rows, key=order):
        n = r[2] or 0
        sums[key(r)] += n
        out[r[1]] = sums[key(r)] - (n if before else 0)
    return out


def test_running_totals(spark):
    df = spark.createDataFrame(ROWS, "k string, i int, n int").withColumn("total", F.lit("mine")).repartition(5)
    for before in (False, True):
        got = running_totals(df, ["k"], ["i"], {"total": F.col("n"), "rank": F.lit(1)}, slices=8, before=before)
        assert got.columns == ["k", "i", "n", "total", "rank"]
        rows = got.collect()
        assert {r.i: r.total for r in rows} == expected(ROWS, lambda r: r[0], lambda r: r[1], before) and len(rows) == len(ROWS)
        assert {r.i: r["rank"] for r in rows} == expected([(k, i, 1) for k, i, _ in ROWS], lambda r: r[0], lambda r: r[1], before)
        # one window a key gives the same rows and schema
        one = running_totals(df, ["k"], ["i"], {"total": F.col("n"), "rank": F.lit(1)}, before=before, maxima={"most": F.col("n")}, spread=False)
        two = running_totals(df, ["k"], ["i"], {"total": F.col("n"), "rank": F.lit(1)}, slices=8, before=before, maxima={"most": F.col("n")})
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.dtypes == two.dtypes
    whole = running_totals(df, [], [F.desc("i")], {"total": F.col("n")}, slices=8).collect()
    assert {r.i: r.total for r in whole} == expected(ROWS, lambda r: 0, lambda r: -r[1], False)


def test_hot_key_is_shared_and_ties_count(spark):
    df = spark.createDataFrame([("hot", i // 4) for i in range(4000)], "k string, i int")
    got = running_totals(df, ["k"], ["i"], {"n": F.lit(1)}, slices=8)
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001))
    # at least 8 tasks share the key's rows
    used = got.withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.max("n").alias("n")).collect()
    assert used[0].n == 4000
    assert running_totals(df.limit(0), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_hot_keys_are_told_by_their_share(spark):
    even = spark.range(100_000).select((F.col("id") % 50).alias("k"))
    hot = even.unionAll(spark.range(FEW * 10).select(F.lit(None).cast("long").alias("k")))
    assert not has_hot_key(even, ["k"], 8)
    # a null key is a key; a share that is larger than the key holds it
    assert has_hot_key(hot, ["k"], 8) and not has_hot_key(hot, ["k"], 3)
    # many slices make no small key hot
    assert not has_hot_key(even, ["k"], 10_000)
    assert has_hot_key(even, []) and not has_hot_key(even.limit(0), ["k"])


def test_intervals_alike_with_and_without_a_hot_key(spark, monkeypatch):
    """Every interval operator gives the same rows by the window and by the two levels."""
    rows = [(R.choice([1, 2, 3, None]), i, R.randrange(400), R.randrange(1, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "f int, item int, start long, len long")
    left, right = df.filter("item % 2 = 0"), df.filter("item % 2 = 1").drop("item")

    def every():
        gone = intervals.merged(right, "f")
        points = left.select("f", "item", F.col("start").alias("at"))
        found = [gone, intervals.rebased(points, gone, "f", 7, cut=20), intervals.overlapping(left, right, "f"), intervals.contained(left, right, "f")]
        return [sorted(map(str, d.collect())) for d in found]

    told = []
    for hot in (True, False):
        monkeypatch.setattr(intervals, "has_hot_key", lambda *_, hot=hot: hot)
        told.append(every())
    assert told[0] == told[1] and all(told[0])


def test_extents_of_one_key(spark):
    """A million extents under one key: contained, overlapping and merged by running maxima."""
    n = 1_000_000
    outer = spark.range(n // 10).select(F.lit(1).alias("f"), (F.col("id") * 100).alias("start"), F.lit(60).alias("len"))
    nested = spark.createDataFrame([(1, 10, 5), (1, 0, 10**9)], "f int, start long, len int").filter("len < 10")
    inner = spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("item"), (F.col("id") * 10).alias("start"), F.lit(15).alias("len"))
    held = intervals.contained(inner, outer.unionByName(nested), "f")
    # of ten starts a hundred bytes, those at 0 to 40 leave 15 bytes inside 60
    assert held.agg(F.count("*"), F.countDistinct("item"), F.max((F.col("start") % 100))).first()[:] == (n // 2, n // 2, 40)
    touched = intervals.overlapping(inner, outer, "f")
    assert touched.count() == n // 10 * 7 - 1
    assert intervals.merged(inner, "f").collect()[0][:] == (1, 0, 10 * (n - 1) + 15)


@pytest.mark.parametrize("hot", [True, False])
def test_union_with_equal_extents(spark, monkeypatch, hot):
    """Of many copies of an extent one opens its island; in which order the copies come to the second totals must not matter."""
    monkeypatch.setattr(intervals, "has_hot_key", lambda *a: hot)
    monkeypatch.setattr(intervals, "running_totals", lambda df, *a, **b: running_totals(df.repartition(5, F.rand(1)), *a, **b))
    df = spark.createDataFrame([("k", k % 20 * 100, 10) for k in range(400)], "k string, start long, len long")
    assert sorted(map(tuple, intervals.merged(df, "k").collect())) == [("k", k * 100, 10) for k in range(20)]
