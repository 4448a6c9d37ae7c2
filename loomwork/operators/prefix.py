"""Running totals in two levels, so that one key with all rows is shared by many tasks.

The rows are dealt to slices by ranges of (keys, order) and written with their slice.
Each slice adds up its own rows of a key; the totals of a key's slices are added up in
turn; and what the earlier slices of its key hold is added to each row.  A slice
continues at most one key of the slice before it, so the carried totals are fewer than
the slices and may be broadcast whatever the size of the table.

The copy costs a write, which rows without a hot key need not pay: has_hot_key() counts
rows by keys, and where none has more than a slice's share, ``spread=False`` adds
up by one shuffle on the keys and a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.shared import shuffle_width, stash

#: Rows of one key that are no burden for a task, however many slices there are.
FEW = 4_096
#: Hash buckets a slice by which keys are counted.
BUCKETS = 16


def has_hot_key(df: DataFrame, keys: list[str], slices: int | None = None) -> bool:
    """Whether some key may have more rows than a slice's fair share, and more than ``FEW``. Without keys all rows are one key.

    Keys are counted by hash buckets, and a bucket has at least the rows of each of its
    keys, so no hot key is missed; what tasks exchange is a row a bucket, not a row a key.
    Reads the key columns only.
    """
    if not keys:
        return True
    width = slices or shuffle_width(df.sparkSession)
    counted = df.groupBy(F.pmod(F.hash(*keys), F.lit(BUCKETS * width))).agg(F.count("*").alias("n"))
    most, rows = counted.agg(F.max("n"), F.sum("n")).first()
    return most is not None and most > max(FEW, rows // width)


def running_totals(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], slices: int | None = None, before: bool = False, maxima: dict[str, Column] | None = None, spread: bool = True) -> DataFrame:
    """df with, for each name in ``sums``, that number added up over its key's rows in order up to this row.

    Names in ``maxima`` get the greatest value instead.  Both include the row itself, or
    only the rows ``before`` it (for the first 0, or a null maximum).  Null keys are a key
    of their own; without ``keys`` all rows are one key.  Null numbers count as 0 in sums
    and not at all in maxima.  Rows that tie in ``order`` follow each other in any order.
    Columns of df called as one of the names are replaced; the values, and ``order`` where
    it gives a plain name, see those of df.  ``slices`` defaults to the session's number of shuffle partitions.
    ``spread=False`` leaves each key's rows to one task; ask has_hot_key() first.
    """
    maxima = maxima or {}
    names = [*sums, *maxima]
    base = [c for c in df.columns if c not in names]
    at = "__slice"
    while any(c.lower().startswith(at) for c in [*df.columns, *names]):
        at = "_" + at
    own = {n: f"{at}_v{i}" for i, n in enumerate(names)}
    # columns of the names go on under others, so that they can order
    moved = {c: f"{at}_r{i}" for i, c in enumerate(c for c in df.columns if c in names)}
    sorts = [F.col(moved.get(c, c)) if isinstance(c, str) else c for c in order]
    values = [F.coalesce(c, F.lit(0)).alias(own[n]) for n, c in sums.items()] + [c.alias(own[n]) for n, c in maxima.items()]
    numbered = df.select(*base, *[F.col(c).alias(m) for c, m in moved.items()], *values)
    total = {n: F.sum if n in sums else F.max for n in names}
    last = -1 if before else Window.currentRow
    if not spread:
        whole = Window.partitionBy(*keys).orderBy(*sorts).rowsBetween(Window.unboundedPreceding, last)
        summed = numbered.withColumns({f"{c}_u": total[n](c).over(whole) for n, c in own.items()})
        return summed.select(*base, *[(F.coalesce(f"{c}_u", F.lit(0)) if n in sums else F.col(f"{c}_u")).alias(n) for n, c in own.items()])
    dealt = numbered.repartitionByRange(slices or shuffle_width(df.sparkSession), *keys, *sorts).withColumn(at, F.spark_partition_id())
    dealt = stash(dealt, "slices")
    upto = Window.partitionBy(at, *keys).orderBy(*sorts).rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, at).agg(*[total[n](c).alias(c) for n, c in own.items()])
    renamed = [F.col(k).alias(f"{at}_k{i}") for i, k in enumerate(keys)]
    place = Window.partitionBy(*keys).orderBy(at)
    carried = totals.select(*renamed, F.col(at).alias(f"{at}_s"), F.row_number().over(place).alias(f"{at}_nth"), *[total[n](c).over(earlier).alias(f"{c}_c") for n, c in own.items()]).filter(F.col(f"{at}_nth") > 1).drop(f"{at}_nth")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{at}_k{i}")) for i, k in enumerate(keys)], F.col(at) == F.col(f"{at}_s"))
    # held apart from the columns that they are made of
    summed = dealt.withColumns({f"{c}_u": total[n](c).over(upto) for n, c in own.items()})
    joined = summed.join(F.broadcast(carried), same, "left")
    none = F.lit(0)
    done = {n: F.coalesce(F.col(f"{c}_u"), none) + F.coalesce(F.col(f"{c}_c"), none) if n in sums else F.greatest(f"{c}_u", f"{c}_c") for n, c in own.items()}
    return joined.select(*base, *[c.alias(n) for n, c in done.items()])
