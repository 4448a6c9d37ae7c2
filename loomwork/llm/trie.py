"""Prefix trie of conversations, with counts and savings of every subtree.

A node is a distinct sequence of first turns, known by a digest: four sums, over those
turns, of 32 bits hashed from place, role and text.  Edges are keyed by the digests of
node and parent.  What a node adds to its ancestors goes up by pointer jumping: in round
k each node gives what it has gathered to the ancestor 2 ** k above it and takes over
that one's pointer, so a trie of depth d takes log d rounds, each on the nodes that are
still deeper than 2 ** k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import WORD_PATTERN, discard, shuffle_width, stash
from loomwork.operators.prefix import running_totals

#: Bytes of joined ids that travel in one piece.
PIECE = 1 << 20


def ordered_turns(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of each turn: its place from 1, SHA-256 of role and text, words in the text.

    Turns go by ``order_col``, null first, ties by role, then by digest; null roles and
    texts are empty; turns that repeat count each.  Rows without an id belong to no
    conversation.  Only these columns of df are read.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(order_col).alias("at"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"))
    return running_totals(rows, ["conv"], [F.asc_nulls_first("at"), "role", "digest"], {"pos": F.lit(1)}).select("conv", "pos", "digest", "words")


def with_shared_heads(turns: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv, length) of conversations rebuilt on the heads of others.

    Conversation c takes the first ``taken`` (at most ``most``) turns of conversation
    ``base``, all if it has fewer and none if it doesn't exist, then its own turns after
    its first ``taken``.  Both are expressions over the column conv.
    """
    turns = stash(turns, "turns")
    heads = turns.filter(F.col("pos") <= most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("base", base).withColumn("taken", taken)
    borrowed = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>"))
    plan = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").select("conv", "taken", borrowed.alias("head"), F.greatest(F.col("n") - F.col("taken"), F.lit(0)).alias("own"))
    plan = stash(plan.withColumn("lent", F.size("head").cast("long")), "plan")
    own = turns.join(plan.select("conv", "taken", "lent"), "conv").filter(F.col("pos") > F.col("taken")).select("conv", (F.col("pos") - F.col("taken") + F.col("lent")).alias("pos"), "digest", "words")
    lent = plan.select("conv", F.posexplode("head").alias("pos", "turn")).select("conv", (F.col("pos") + 1).cast("long").alias("pos"), "turn.digest", "turn.words")
    return own.unionByName(lent), plan.select("conv", (F.col("lent") + F.col("own")).alias("length"))


def prefix_nodes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written nodes (id, parent, depth, conv_id, n_convs, words) and ends (id, conv): where each conversation of (conv, length) ends.

    turns(conv, pos, digest, words) have places from 1 without gaps.
    """
    half = lambda h: [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    bits = [x for seed in ("one", "two") for x in half(F.xxhash64(F.lit(seed), "pos", "digest"))]
    lanes = turns.select("conv", "pos", "words", *[b.alias(f"own{i}") for i, b in enumerate(bits)])
    summed = running_totals(lanes, ["conv"], ["pos"], {f"sum{i}": F.col(f"own{i}") for i in range(len(bits))})
    known = lambda depth, sums: F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in sums])))
    sums = [F.col(f"sum{i}") for i in range(len(bits))]
    root = known(F.lit(0), [F.lit(0)] * len(bits))
    steps = summed.select("conv", F.col("pos").alias("depth"), known(F.col("pos"), sums).alias("id"), known(F.col("pos") - 1, [s - F.col(f"own{i}") for i, s in enumerate(sums)]).alias("parent"), "words")
    tops = lengths.select("conv", F.lit(0).cast("long").alias("depth"), root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"))
    steps = stash(steps.unionByName(tops), "steps")
    nodes = steps.groupBy("id").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    ends = steps.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]).select("id", "conv")
    return stash(nodes, "nodes"), stash(ends, "ends")


def subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """(id, values): each value of nodes(id, parent, values) added up over the node's subtree, itself included.

    The nodes form trees: a parent is a node or null.  Each round writes its pointers and
    sums to the shared folder.
    """
    over = lambda df: [F.sum(v).alias(v) for v in values]
    parts = [nodes.select("id", *values)]
    jumping = stash(nodes.filter("parent is not null").select("id", F.col("parent").alias("up"), *values), "jumping")
    while jumping.limit(1).count():
        # what the nodes up to 2 ** k below have gathered, by the node that gets it
        given = stash(jumping.groupBy("up").agg(*over(jumping)).withColumnRenamed("up", "id"), "given")
        parts.append(given)
        above = jumping.select(F.col("id").alias("up"), F.col("up").alias("next"))
        deeper = jumping.join(above, "up").select("id", F.col("next").alias("up"), *values)
        got = given.select("id", *[F.col(v).alias(f"got_{i}") for i, v in enumerate(values)])
        after = deeper.join(got, "id", "left").select("id", "up", *[(F.col(v) + F.coalesce(f"got_{i}", F.lit(0))).alias(v) for i, v in enumerate(values)])
        after = stash(after, "jumping")
        discard(jumping)
        jumping = after
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(*over(every))


def _pieces(batches) -> Iterator[pa.RecordBatch]:
    """Joined ids of each node, from rows in the order of (id, conv), in pieces of some PIECE bytes."""
    node, first, held, size, out = None, None, [], 0, []

    def flush() -> None:
        if held:
            out.append((node, first, ",".join(held)))

    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i != node or size >= PIECE:
                flush()
                node, first, held, size = i, c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if len(out) >= 1000 or sum(len(x[2]) for x in out) > PIECE:
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "first", "ids"), x)) for x in out], pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
            out = []
    flush()
    yield pa.RecordBatch.from_pylist([dict(zip(("id", "first", "ids"), x)) for x in out], pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces joined, from rows in the order of (id, first)."""
    node, sha, out = None, None, []
    schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        for i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i != node:
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = i, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
            out = []
    if sha:
        out.append((node, sha.hexdigest()))
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): of the decimal ids of conversations that end at a node, ascending, joined by commas.

    Ranges of (id, conv) join ids to pieces of a MB, so the one digest that a node with
    very many ends has reads few rows, in sequence, and holds one piece at a time.
    """
    dealt = ends.repartitionByRange(shuffle_width(ends.sparkSession), "id", "conv").sortWithinPartitions("id", "conv")
    pieces = dealt.select("id", "conv").mapInArrow(_pieces, "id binary, first long, ids string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "ids").mapInArrow(_digests, "id binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the smallest member of the node; a node saves its last turn's words for
    each member but one, and saved_tokens adds up its subtree.  Conversations without
    turns are members of the root.  Without conversations there is no node.
    """
    nodes, ends = prefix_nodes(turns, lengths)
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    own = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stash(own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "own")
    sums = subtree_sums(own.select("id", "parent", "n_leaves", "saved_tokens"), "n_leaves", "saved_tokens")
    above = own.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    placed = stash(own.drop("n_leaves", "saved_tokens").join(above, "parent", "left"), "placed")
    whole = placed.join(sums, "id").join(end_digests(ends), "id", "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
