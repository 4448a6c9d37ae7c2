"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt to blocks by a hash of their id.  A source's quota is
whole passes over its blocks plus, in a permuted order, as many blocks as the rest asks
for; only the last block is cut, between documents.  The block quotas of all sources are
split in halves again and again, each time by a multivariate hypergeometric draw, until
each output shard has its own; shards take disjoint runs of the permuted blocks and
shuffle their rows locally.  The driver handles counts for each source, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import WORD_PATTERN, free_name, shuffle_width, stash, with_row_key

#: Blocks of a source; only one of them is ordered as a whole, so it bounds what a task sorts.
BLOCKS = 4096
#: Output shards.
SHARDS = 16
#: Sources up to which their small tables are broadcast (some 20 MB); beyond, they are shuffled.
BROADCAST_SOURCES = 100_000
#: Weights by place of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Plan:
    source: str | None
    size: int
    target: float
    passes: int
    rest: float


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, most: int = 2) -> list[Plan]:
    """The share of all sizes, dealt by weight; no source above ``most`` times its size, the excess reshared.

    Sources are in code-point order, null last.  Sources fill up in the order of their
    cap for each unit of weight, so one pass finds who stops at the cap.
    """
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(sizes)]
    left, weight = share * sum(n for _, n, _ in rows), sum(w for _, _, w in rows)
    got: dict[str | None, float] = {}
    for s, n, w in sorted(rows, key=lambda r: (most * r[1] / r[2], r[0] is None, r[0] or "")):
        got[s] = float(most * n) if most * n <= left / weight * w else left / weight * w
        if most * n <= left / weight * w:
            left, weight = left - most * n, weight - w
        if not weight:
            break
    out = []
    for s, n, _ in rows:
        passes = int(got[s] // n) if n else 0
        out.append(Plan(s, n, got[s], passes, got[s] - passes * n))
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard its blocks of each source; sums over shards give ``quotas``, shard totals differ by one at most."""
    if not quotas:
        return [[] for _ in range(shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    out: list[list[int]] = [[] for _ in range(shards)]

    def part(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have.tolist()
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        # earlier shards take the odd blocks
        each, odd = divmod(total, hi - lo)
        left = rng.multivariate_hypergeometric(have, each * (mid - lo) + min(odd, mid - lo), method="marginals")
        part(lo, mid, left)
        part(mid, hi, have - left)

    part(0, shards, np.array(quotas, dtype=np.int64))
    return out


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 7, blocks: int = BLOCKS, row_col: str | None = None) -> DataFrame:
    """For each row (id, size, source, source_size, target, copies, shards of its copies, seat).

    Null texts have size 0; a null source is a source.  Repeated rows count each and, with
    equal ids, share a block.  No row is taken more than twice.  ``row_col`` names a
    column that tells the rows apart; the plan carries it.  Where rows of one id and size
    are cut, their texts decide, then that column.  The driver sees one row for each source, and no document.
    """
    spark = docs.sparkSession
    number = [F.xxhash64(text_col).alias("text_"), F.col(row_col).alias("row_")] if row_col else []
    sized = stash(
        docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _digest(F.lit(f"mix-{seed}"), F.col(id_col)).alias("seat"), *number)
        .withColumn("block", (F.conv(F.substring("seat", 1, 8), 16, 10).cast("long") % blocks).cast("int")), "sizes",
    )
    by_block = stash(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "blocks")
    # one row for each source
    plans = targets([(r.source, int(r.size)) for r in by_block.groupBy("source").agg(F.sum("block_size").alias("size")).collect()])
    near = F.broadcast if len(plans) <= BROADCAST_SOURCES else (lambda df: df)
    schema = "source string, source_size long, target double, passes int, rest double"
    by_source = spark.createDataFrame([(p.source, p.size, p.target, p.passes, p.rest) for p in plans], schema)
    # permuted order within each pass; at most `blocks` rows a source
    turn = lambda k: _digest(F.lit(f"turn-{seed}"), F.lit(k), F.col("source"), F.col("block"))
    w = Window.partitionBy("source").orderBy(turn("rest"), "block")
    known = by_block.withColumn("source_key", F.struct("source")).join(near(by_source.select(F.struct("source").alias("source_key"), "source_size", "target", "passes", "rest")), "source_key").drop("source_key")
    run = known.withColumn("upto", F.sum("block_size").over(w)).withColumn("before", F.col("upto") - F.col("block_size"))
    run = run.withColumn("whole", F.col("upto") <= F.col("rest")).withColumn("cut", ~F.col("whole") & (F.col("before") < F.col("rest")))
    run = run.withColumn("uses", F.expr("transform(filter(sequence(0, 2), p -> p < passes or (p = passes and (whole or cut))), p -> p)"))
    run = stash(run, "runs")
    # quotas: blocks of a source, each as often as it is used
    used = {r.source: int(r.n) for r in run.groupBy("source").agg(F.sum(F.size("uses")).alias("n")).collect()}
    tree = split_tree([used.get(p.source, 0) for p in plans], shards, seed)
    upto = np.cumsum(np.array(tree, dtype=np.int64).reshape(shards, len(plans)), axis=0)
    seats = spark.createDataFrame([(p.source, [int(x) for x in upto[:, i]]) for i, p in enumerate(plans)], "source string, upto array<long>")
    flat = run.select("source", "block", F.explode("uses").alias("pass"))
    order = Window.partitionBy("source").orderBy("pass", _digest(F.lit(f"turn-{seed}"), F.col("pass"), F.col("source"), F.col("block")), "block")
    placed = flat.withColumn("nth", F.row_number().over(order)).withColumn("source_key", F.struct("source"))
    placed = placed.join(near(seats.select(F.struct("source").alias("source_key"), F.col("upto").alias("ends"))), "source_key").withColumn("shard", F.expr("size(filter(ends, e -> e < nth))"))
    placed = placed.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("placed"))
    key = lambda df, n: df.withColumn(n, F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("block")))
    info = key(run.join(placed.withColumnsRenamed({"source": "s_", "block": "b_"}), F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")), "left"), "k").select("k", F.col("source").alias("s_"), F.col("block").alias("b_"), "source_size", "target", "passes", "rest", "before", "whole", "cut", "placed")
    joined = key(sized, "k").join(info, "k").filter(F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")))
    # the one block of a source that is cut: documents in hash order as long as they come nearer to the target
    inside = Window.partitionBy("source").orderBy("seat", id_col, "size", *(["text_", "row_"] if row_col else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = joined.filter(~F.col("cut")).withColumn("last", F.col("whole"))
    cut = joined.filter("cut").withColumn("sum_", F.sum("size").over(inside)).withColumn("last", F.col("before") + F.col("sum_") - F.col("size") / 2 <= F.col("rest")).drop("sum_")
    every = plain.unionByName(cut)
    copies = F.least(F.col("passes") + F.col("last").cast("int"), F.lit(2))
    held = F.transform(F.filter("placed", lambda p: p["pass"] < copies), lambda p: p["shard"])
    numbered = [F.col("row_").alias(row_col)] if row_col else []
    return every.select(id_col, "size", "source", "source_size", "target", copies.alias("copies"), F.coalesce(held, F.array().cast("array<int>")).alias("shards"), "seat", *numbered)


def mix(docs: DataFrame, id_col: str = "doc_id", stable: bool = False, **options) -> DataFrame:
    """The mixed rows: docs' columns for each copy, with ``shard`` and ``place``, dealt to shards and ordered in them.

    Each row goes as often as the plan says for that row, whether or not its id repeats.
    Columns ``shard`` and ``place`` of docs are replaced; other names never clash.  docs is
    read twice, so it is written to the shared folder first unless ``stable`` says that it
    is a plain scan of Parquet files.
    """
    base = docs.drop("shard", "place")
    row, same, copy, seat = (free_name(n, *base.columns, "shard", "place") for n in ("__row", "__same", "__copy", "__seat"))
    numbered = with_row_key(base, row, stable)
    plan = mix_plan(numbered, id_col, row_col=row, **options).select(F.col(row).alias(same), F.posexplode("shards").alias(copy, "shard"), F.col("seat").alias(seat))
    rows = numbered.join(plan, F.col(row) == F.col(same))
    placed = rows.withColumn("place", _digest(F.lit("place"), F.col(copy), F.col(seat))).select(*base.columns, "shard", "place", seat, row)
    # as many pieces of each shard as leave no partition of the session's width without some
    digits = 1
    while options.get("shards", SHARDS) * 16**digits < 8 * shuffle_width(docs.sparkSession):
        digits += 1
    return placed.repartition("shard", F.substring("place", 1, digits)).sortWithinPartitions("shard", "place", row).drop(seat, row)
