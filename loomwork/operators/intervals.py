"""Half-open extents: union, overlap, containment, removed lengths and re-based offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.prefix import has_hot_key, running_totals


def merged(extents: DataFrame, key: str) -> DataFrame:
    """Union of touching or overlapping extents (start, len) of each key."""
    ends = extents.select(key, "start", (F.col("start") + F.col("len")).alias("end"))
    spread = has_hot_key(ends, [key])
    seen = running_totals(ends, [key], ["start", "end"], {}, before=True, maxima={"reach": F.col("end")}, spread=spread)
    new = (F.col("start") > F.col("reach")).cast("int")
    # of equal extents the one that opens an island comes first, however the rows were sorted again
    opened = seen.withColumn("new", F.coalesce(new, F.lit(0)))
    island = running_totals(opened, [key], ["start", "end", F.desc("new")], {"island": F.col("new")}, spread=spread)
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(key, "start", (F.col("end") - F.col("start")).alias("len"))


def removed_before(points: DataFrame, gone: DataFrame, key: str, at: str = "at") -> DataFrame:
    """points with ``removed``: total length of disjoint removed extents that start before each point. No range join."""
    marks = points.select(key, F.col(at).alias("o"), F.lit(0).cast("long").alias("len"), F.lit(0).alias("kind"), F.struct(*points.columns).alias("row"))
    cuts = gone.select(key, F.col("start").alias("o"), F.col("len").cast("long").alias("len"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"))
    # a point comes before an extent that starts at it
    both = marks.unionByName(cuts)
    told = running_totals(both, [key], ["o", "kind"], {"removed": F.col("len")}, spread=has_hot_key(both, [key]))
    return told.filter("kind = 0").select("row.*", "removed")


def rebased(points: DataFrame, gone: DataFrame, key: str, delta: int, at: str = "at", cut: int | None = None) -> DataFrame:
    """points with ``removed``, ``moved``, and, if ``cut`` is given, ``error_code`` 'offset' for points before it, which have no new place."""
    out = removed_before(points, gone, key, at)
    if cut is None:
        return out.withColumn("moved", F.col(at) + delta - F.col("removed"))
    early = F.col(at) < cut
    return out.withColumn("moved", F.when(~early, F.col(at) + delta - F.col("removed"))).withColumn("error_code", F.when(early, "offset"))


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, start, end, mine, row): extents of both sides, ``mine`` those of left, which carry their row."""
    ends = lambda df: df.select(key, "start", (F.col("start") + F.col("len")).alias("end"), F.struct(*df.columns).alias("row"))
    a = ends(left).withColumn("mine", F.lit(True))
    b = ends(right.select(key, "start", "len")).withColumn("mine", F.lit(False)).withColumn("row", F.lit(None).cast(a.schema["row"].dataType))
    return a.unionByName(b)


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left that share a byte with an extent of right under the same key.

    The greatest end of right's extents that start no later, and the least start of those
    that start later, tell; no range join, and many tasks share a key.
    """
    every = _sides(left, right, key).filter("end > start")
    theirs = lambda c: F.when(~F.col("mine"), c)
    spread = has_hot_key(every, [key])
    reach = running_totals(every, [key], ["start", "mine"], {}, maxima={"reach": theirs(F.col("end"))}, spread=spread)
    # in the opposite order the greatest negative start is the least start
    seen = running_totals(reach, [key], [F.desc("start"), F.desc("mine")], {}, before=True, maxima={"later": theirs(-F.col("start"))}, spread=spread)
    hit = (F.col("reach") > F.col("start")) | (-F.col("later") < F.col("end"))
    return seen.filter(F.col("mine") & hit).select("row.*")


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Rows of inner that lie inside one extent of outer under the same key; outer's may overlap or nest.

    Of outer's extents that start no later, that with the greatest end holds the row if any
    does, so one running maximum tells; no range join, and many tasks share a key.
    """
    both = _sides(inner, outer, key)
    seen = running_totals(both, [key], ["start", "mine"], {}, maxima={"reach": F.when(~F.col("mine"), F.col("end"))}, spread=has_hot_key(both, [key]))
    return seen.filter(F.col("mine") & (F.col("reach") >= F.col("end"))).select("row.*")
