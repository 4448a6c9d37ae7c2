"""Matches by day, ordering, windows of days and the featured pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.matches import is_live, is_upcoming
from loomwork.operators.prefix import has_hot_key, running_totals


def by_kickoff() -> list[Column]:
    return [F.coalesce(F.col("kickoff"), F.lit("1970-01-01").cast("timestamp_ntz")), F.col("ord")]


def by_text() -> list[Column]:
    return [F.coalesce(F.col("utcDate"), F.lit("")), F.col("ord")]


def by_day(matches: DataFrame, day: Column) -> DataFrame:
    """Per day its matches in kickoff order; no kickoff goes under '?'."""
    keyed = matches.withColumn("day", F.coalesce(day, F.lit("?")))
    return keyed.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("kickoff", "ord", "id"))), lambda x: x["id"]).alias("ids"))


def days_in_order(matches: DataFrame, day: Column) -> DataFrame:
    """(day, day_place, place, id): matches as a list of days by code unit, '?' after digits, each in kickoff order; places from 0.

    A row for each match, so neither a full day nor all days are one value.
    """
    kick, ord_ = by_kickoff()
    keyed = matches.select(F.coalesce(day, F.lit("?")).alias("day"), kick.alias("k"), ord_.alias("o"), "id")
    placed = running_totals(keyed, ["day"], ["k", "o", "id"], {"place": F.lit(1).cast("long")}, before=True, spread=has_hot_key(keyed, ["day"]))
    days = running_totals(keyed.select("day").distinct(), [], ["day"], {"day_place": F.lit(1).cast("long")}, before=True)
    return placed.join(days, "day").select("day", "day_place", "place", "id")


def featured(matches: DataFrame, in_window: Column) -> DataFrame:
    """The featured match: earliest live in the window, earliest upcoming in it, latest in it, earliest upcoming, latest.

    One pass: each tier keeps its best row by a min or max of a struct, so nothing is
    sorted and no task gets all rows.
    """
    kick = F.coalesce(F.col("kickoff"), F.lit("1970-01-01").cast("timestamp_ntz"))
    row = F.struct(kick.alias("k"), F.col("ord").alias("o"), F.col("id").alias("id"))
    live, up = is_live(F.col("status")), is_upcoming(F.col("status"))
    best = matches.agg(
        F.min(F.when(in_window & live, row)).alias("t1"), F.min(F.when(in_window & up, row)).alias("t2"), F.max(F.when(in_window, row)).alias("t3"),
        F.min(F.when(up, row)).alias("t4"), F.max(row).alias("t5"),
    )
    tier = F.coalesce(*[F.when(F.col(f"t{k}").isNotNull(), F.lit(k)) for k in range(1, 6)])
    return best.select(tier.alias("tier"), F.coalesce(*[F.col(f"t{k}") for k in range(1, 6)])["id"].alias("id"))


def first_and_last(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by("id", F.struct("kickoff", "ord")).alias("first_id"), F.max_by("id", F.struct("kickoff", "ord")).alias("last_id"))


def ranked(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rows with ``place``: the place of each in its key's order, from 1. Many tasks share a hot key."""
    return running_totals(rows, [key], order, {"place": F.lit(1)}, spread=has_hot_key(rows, [key]))
