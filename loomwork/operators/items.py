"""What is left of items when some go: anti-joins by the keys that name an item. Null keys match nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without(items: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of items that gone does not name; repeated rows stay."""
    return items.join(gone.select(*keys), keys, "left_anti")


def primary_gone(primary: DataFrame, gone: DataFrame, keys: list[str], item: str) -> DataFrame:
    """primary's rows (a file's keys and its primary item) with ``primary_gone``: whether gone names that item."""
    named = gone.select(*keys, item).distinct().withColumn("primary_gone", F.lit(True))
    return primary.join(named, [*keys, item], "left").withColumn("primary_gone", F.coalesce("primary_gone", F.lit(False)))


def without_place(gone: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Named items that have no place."""
    return gone.join(places.select(*keys), keys, "left_anti")
