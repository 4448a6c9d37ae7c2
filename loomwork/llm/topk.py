"""Exact top-k search by inner product with a vector-approximation file.

The file holds one byte a component: each block of vectors has its own grid of up to 256
slices a dimension.  It is scanned first, block against block of queries; one matrix
product over the codes gives a lower and an upper bound of every score.  Blocks are
scanned in rounds of one, two, four and so on; the k-th lower bound so far is the bar of a
query, and a later round keeps only candidates whose upper bound reaches it, so what is
kept grows with the logarithm of the blocks.  Exact vectors are read only of candidates
that reach the last bar, and decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, stash

#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 32_768, 4_096
#: Slices of each dimension (one byte each).
SLICES = 256
#: Scores whose bounds are held at once.
HELD = 2_000_000
LONG = 2**63 - 1
CODES = "dim int, block long, most long, ids binary, rows binary, codes binary, low binary, width binary"
ASKED = "dim int, block long, most long, ids binary, rows binary, vectors binary"


def floored(vec: Column, scale: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def _blocks(frames, size: int):
    """(ids, rows, vectors) of up to ``size`` rows of one length."""
    held: dict[int, list[tuple]] = {}
    for pdf in frames:
        for dim, part in pdf.groupby("dim", sort=False):
            vectors = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dim)
            held.setdefault(dim, []).append((part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64), vectors))
            while sum(len(x[0]) for x in held[dim]) >= size:
                ids, rows, vectors = (np.concatenate(x) for x in zip(*held[dim]))
                yield ids[:size], rows[:size], vectors[:size]
                held[dim] = [(ids[size:], rows[size:], vectors[size:])]
    for parts in held.values():
        ids, rows, vectors = (np.concatenate(x) for x in zip(*parts))
        if len(ids):
            yield ids, rows, vectors


def _reachable(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block that can be among k results: of equal vectors those of the k + 1 smallest ids, k rows of each.

    Equal vectors have equal scores, so later ids never come before them; one id more makes
    up for the query's own.
    """
    if not vectors.shape[1]:
        same = np.zeros(len(ids), np.int64)
    else:
        flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, 8 * vectors.shape[1]))).ravel()
        same = np.unique(flat, return_inverse=True)[1]
    order = np.lexsort((rows, ids, same))
    g, i = same[order], ids[order]
    at = np.arange(len(order))
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new_id = new_group | np.concatenate([[True], i[1:] != i[:-1]])
    nth_id = np.cumsum(new_id) - 1
    nth_id = nth_id - np.maximum.accumulate(np.where(new_group, nth_id, 0))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


def _bounds(c, q, k: int):
    """(query row, query id, candidate row, id, lower, upper) of the candidates of a cell that may be among the k best and reach the query's bar, if it has one."""
    bars = {} if q.bar_rows is None else dict(zip(q.bar_rows, q.bars))
    d, ids, rows = c.dim, np.frombuffer(c.ids, np.int64), np.frombuffer(c.rows, np.int64)
    q_ids, q_rows = np.frombuffer(q.q_ids, np.int64), np.frombuffer(q.q_rows, np.int64)
    # exact either way: whole numbers in doubles, or Python's own
    kind = np.float64 if 4 * max(d, 1) * max(c.most, 1) * max(q.q_most, 1) < 2**53 else object
    codes = np.frombuffer(c.codes, np.uint8).reshape(len(ids), d).astype(kind)
    low, width = (np.frombuffer(x, np.int64).astype(kind) for x in (c.low, c.width))
    asked = np.frombuffer(q.vectors, np.int64).reshape(len(q_ids), d).astype(kind)
    step = max(1, HELD // len(ids))
    for at in range(0, len(asked), step):
        a = asked[at : at + step]
        # twice the score at the middle of a cell, and how far a vector's may be from it
        middle = (2 * a * width) @ codes.T + (a @ (2 * low + width - 1))[:, None]
        reach = np.abs(a) @ (width - 1)
        own = ids[None, :] == q_ids[at : at + step, None]
        for j in range(len(a)):
            others = np.flatnonzero(~own[j])
            if not len(others):
                continue
            mine = middle[j, others]
            need = min(k, len(others))
            bar = (np.partition(mine, len(mine) - need) if kind is np.float64 else np.sort(mine))[len(mine) - need]
            near = mine >= bar - 2 * reach[j]
            if (least := bars.get(q_rows[at + j])) is not None:
                near &= mine >= 2 * int(least) - 1 - reach[j]
            for x, score in zip(others[near].tolist(), mine[near].tolist()):
                lower, upper = int(score - reach[j]) // 2, -(-int(score + reach[j]) // 2)
                yield q_rows[at + j], q_ids[at + j], rows[x], ids[x], max(lower, -LONG), min(upper, LONG)


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row that ``queries`` selects its k best other rows by inner product of integer vectors.

    ``vec_col`` holds arrays of integers (see floored()).  Returns query_id, rank, vec_id,
    score, and n_read, the exact vectors that were read for the query; ties go to the
    smaller id; fewer rows if there are fewer candidates.  Only vectors of equal length are
    compared; rows with the query's id are its own; a row repeated among the candidates can
    appear as often, up to k times; rows that repeat a query's id ask together.  Null ids and
    vectors take no part; other columns of df, whatever their names, are not read.
    """
    take = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("id is not null and v is not null")
    exact = stash(take.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")

    def encode(frames):
        for n, (ids, rows, v) in enumerate(_blocks(frames, CANDIDATES)):
            keep = _reachable(ids, rows, v, k)
            ids, rows, v = ids[keep], rows[keep], v[keep]
            low, high = (v.min(0), v.max(0)) if v.size else (v[0], v[0])
            width = np.maximum(-(-(high - low + 1) // SLICES), 1)
            codes = ((v - low) // width).astype(np.uint8)
            yield _frame(v, int(rows.min()), ids=ids, rows=rows, codes=codes, low=low, width=width)

    def ask(frames):
        for ids, rows, v in _blocks(frames, QUERIES):
            yield _frame(v, int(rows.min()), ids=ids, rows=rows, vectors=v)

    file = stash(exact.select("id", "row", "dim", "v").mapInPandas(encode, CODES), "codes")
    asked = stash(exact.filter("asks").select("id", "row", "dim", "v").mapInPandas(ask, ASKED), "asked")
    # every block of codes meets every block of queries of its length; one entry a block
    names = lambda t, other: t.groupBy("dim").agg(F.collect_list("block").alias(other))
    left = file.join(names(asked, "others"), "dim").withColumn("q_block", F.explode("others")).drop("others")
    # blocks of a length in rounds of doubling size; one row a block
    rounds = stash(file.select("dim", "block").withColumn("round", F.floor(F.log2(F.row_number().over(Window.partitionBy("dim").orderBy("block")))).cast("int")), "rounds")
    names_ = ["dim", "q_block", "q_row", "query_id", "row", "vec_id", "lower", "upper"]

    def scan(frames):
        for pdf in frames:
            for cell in pdf.itertuples(index=False):
                yield pd.DataFrame(_bounds(cell, cell, k), columns=names_[2:]).assign(dim=cell.dim, q_block=cell.q_block)[names_]

    def bar_of(near: DataFrame) -> DataFrame:
        kth = Window.partitionBy("query_id").orderBy(F.desc("lower"), "row", "q_row")
        best = near.withColumn("nth", F.row_number().over(kth)).filter(F.col("nth") <= k).groupBy("query_id").agg(F.min("lower").alias("bar"), F.count("*").alias("n"))
        return best.select(F.col("query_id").alias("asker"), F.when(F.col("n") == k, F.col("bar")).alias("bar"))

    none = "cast(null AS array<long>)"
    near, parts = None, []
    for nth in range((rounds.agg(F.max("round")).first()[0] or 0) + 1):
        told = asked.selectExpr("*", f"{none} AS bar_rows", f"{none} AS bars")
        if near is not None:
            # at most QUERIES bars beside a block of queries
            known = near.select("dim", "q_block", "q_row", "query_id").distinct().join(bar_of(near), F.col("query_id") == F.col("asker")).filter("bar is not null")
            held = known.groupBy("dim", F.col("q_block").alias("block")).agg(F.collect_list("q_row").alias("bar_rows"), F.collect_list("bar").alias("bars"))
            told = asked.join(held, ["dim", "block"], "left")
        mine = rounds.filter(F.col("round") == nth).select("dim", "block")
        asks = told.select("dim", F.col("block").alias("q_block"), F.col("most").alias("q_most"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "vectors", "bar_rows", "bars")
        right = asks.join(mine.groupBy("dim").agg(F.collect_list("block").alias("others")), "dim").withColumn("block", F.explode("others")).drop("others")
        cells = left.join(mine, ["dim", "block"], "left_semi").join(right, ["dim", "block", "q_block"])
        parts.append(stash(cells.mapInPandas(scan, ", ".join(f"{n} {'int' if n == 'dim' else 'long'}" for n in names_)), "near"))
        near = parts[0]
        for one in parts[1:]:
            near = near.unionByName(one)
    bar = bar_of(near)
    survivors = near.join(bar, F.col("query_id") == F.col("asker")).filter("bar is null or upper >= bar").select("q_row", "query_id", "row", "vec_id")
    pairs = survivors.join(exact.select("row", F.col("v").alias("c")), "row").join(exact.filter("asks").select(F.col("row").alias("q_row"), F.col("v").alias("q")), "q_row")
    score = F.aggregate(F.zip_with("c", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda x, y: x + y)
    scored = stash(pairs.select("query_id", "vec_id", "row", score.alias("score")), "scored")
    discard(exact, file, asked, rounds, *parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    read = scored.groupBy("query_id").agg(F.count("*").alias("n_read"))
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(read, "query_id").select("query_id", "rank", "vec_id", "score", "n_read")


def _frame(v: np.ndarray, block: int, **parts: np.ndarray) -> pd.DataFrame:
    """A row for a block, named by its least row."""
    most = int(np.abs(v).max(initial=0))
    return pd.DataFrame({"dim": [v.shape[1]], "block": [block], "most": [most], **{n: [np.ascontiguousarray(x).tobytes()] for n, x in parts.items()}})
