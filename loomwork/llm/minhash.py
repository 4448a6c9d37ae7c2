"""MinHash near-dedup by min-max hashing, with an exact check of every link.

A document is a set of word shingles.  Under each permutation both the minimum and the
maximum are kept, so 64 permutations give 128 values, banded four by four.  Documents
with equal sets become one.  Sets that share a band are a bucket, and sets are compared
within their buckets only.  First each set is compared with the hub of its buckets, on
whole sets, and confirmed links are closed into classes.  In a bucket whose other members
are then of more than one class, members outside its largest class are compared with all
members, in blocks of ``CELL``; buckets with the same members are compared once.  Tasks
return links between classes, never all pairs, and no bucket has a cap.

A pair of the threshold's likeness misses every band with a chance of about 5e-8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.shared import discard, integer_ids, stash
from loomwork.llm.wordhash import pack, unpack, window_hashes, word_hashes, words_of

PERMUTATIONS, BAND = 64, 4
#: Sets of a bucket that are compared in one place, and sets of a block of a larger bucket.
CELL = 256
#: Candidates up to which their ids are broadcast (16 MB); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
_FACTORS = np.random.Generator(np.random.PCG64(10)).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words none. A-Z are lower-cased."""
    found = words_of_lower(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = word_hashes(found)
    return np.unique(window_hashes(hashes, words) if len(found) >= words else window_hashes(np.append(hashes, np.uint64(len(found))), len(found) + 1))


def words_of_lower(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation."""
    out = np.empty(2 * PERMUTATIONS, np.uint64)
    for k, f in enumerate(_FACTORS):
        x = s * f
        x ^= x >> np.uint64(32)
        out[2 * k], out[2 * k + 1] = x.min(), x.max()
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    # minima and maxima in turn; a band's number is part of its key
    rows = np.concatenate([sig[0::2], sig[1::2]]).reshape(-1, BAND)
    return window_hashes(np.column_stack([rows, np.arange(len(rows), dtype=np.uint64)]).ravel(), BAND + 1)[:: BAND + 1].view(np.int64)


def _links(ids: list, sets: list[np.ndarray], fresh: list[bool], joined: list, percent: int) -> list[tuple]:
    """Spanning links among sets: between each fresh one and any other, as pairs of ``joined``. Sets with equal ``joined`` are linked already."""
    order = sorted(range(len(ids)), key=lambda i: (fresh[i], ids[i]))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    if not len(order) or not sizes.all():
        raise ValueError("candidates are sets of at least one shingle")
    flat, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    root = list(range(len(order)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict = {}
    for k, i in enumerate(order):
        root[top(k)] = top(first.setdefault(joined[i], k))
    out, mark = [], np.zeros(len(flat), bool)
    for k in range(len(order)):
        if not fresh[order[k]]:
            continue
        mine = inverse[starts[k] : starts[k] + sizes[k]]
        mark[mine] = True
        # all before it: pairs of two fresh ones are seen once
        end = int(starts[k])
        if end:
            both = np.add.reduceat(mark[inverse[:end]], starts[:k], dtype=np.int64)
            for j in np.flatnonzero(100 * both >= percent * (sizes[:k] + sizes[k] - both)).tolist():
                if top(j) != top(k):
                    root[top(j)] = top(k)
                    out.append((joined[order[k]], joined[order[j]]))
        mark[mine] = False
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, stable: bool = False, row_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest id reachable.  Texts without words are linked with
    nothing.  Rows with equal ids and different texts are documents of their own.  Null
    ids are smallest and come back as null, others are integers.  kept: id = component_id, so that of repeated
    rows all are kept or none; with ``row_col``, a column that tells the rows apart and
    is returned too, exactly one row of each class is kept (least id, then digest of its
    set, then row), and each row without words.  Texts are read twice, so df is written to
    the shared folder first unless ``stable`` says that it is a plain scan; ``row_col`` is
    read once and must say the same to the caller, as with_row_key() does.
    """
    integer_ids(df, id_col)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    null = -(2**63)
    number = F.col(row_col) if row_col else F.lit(None).cast("long")
    row_kind = df.schema[row_col].dataType.simpleString() if row_col else "long"
    base = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(null)).alias("id"), F.col(text_col).alias("text"), number.alias("row"))
    base = base if stable else stash(base, "texts")

    def sign(frames):
        for pdf in frames:
            sets = [shingles(t, words) for t in pdf["text"]]
            bands = [_bands(signature(s)) if len(s) else None for s in sets]
            yield pdf[["id", "row"]].assign(n=[len(s) for s in sets], d=[digest(s) for s in sets], bands=bands)

    signed = stash(base.mapInPandas(sign, f"id long, row {row_kind}, n long, d binary, bands array<long>"), "signed")
    # equal sets are one, known by 128 bits; copies meet within a task first
    sets = stash(signed.filter("n > 0").groupBy("d").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")), "sets")
    bands = sets.select("d", F.explode("bands").alias("key"))
    shared = stash(bands.groupBy("key").agg(F.min("d").alias("hub"), F.count("*").alias("weight")).filter("weight > 1"), "buckets")
    met = stash(bands.join(shared, "key").select("key", "d", "hub", "weight"), "met")
    pairs = stash(met.filter("d <> hub").select("d", "hub").distinct(), "pairs")
    items = _items(base, sets.join(met.select("d").distinct(), "d", "left_semi").select("d", "rep"), words)

    def star(frames):
        for pdf in frames:
            good = []
            for a, b in zip(pdf["items"], pdf["hub_items"]):
                x, y = unpack(a), unpack(b)
                n = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pdf.loc[good, ["a", "b"]]

    both = pairs.join(items, "d").join(items.select(F.col("d").alias("hub"), F.col("items").alias("hub_items")), "hub")
    stars = stash(both.select(F.col("d").alias("a"), F.col("hub").alias("b"), "items", "hub_items").mapInPandas(star, "a binary, b binary"), "stars")
    near = stash(components(stars), "near")
    further = _open_links(met, near, items, percent)
    far = stash(components(further), "far")
    discard(stars, shared, met, pairs, items, further)

    # class of each set; sets without a link are their own
    named = sets.select("d", "rep").join(near.select(F.col("node").alias("d"), F.col("component").alias("c1")), "d", "left").withColumn("c1", F.coalesce("c1", "d"))
    named = named.join(far.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left").select("d", "rep", F.coalesce("c2", "c1").alias("class"))
    named = stash(named, "named")
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    classes = stash(named.join(least, "class").select("d", "class", "component_id"), "classes")
    discard(named, near, far, sets)
    full = signed.filter("n > 0").select("id", "row", "n", "d").join(classes, "d")
    alone = signed.filter("n = 0").select("id", "row", "n", F.col("id").alias("component_id"))
    back = lambda c: F.nullif(c, F.lit(null)).cast(kind)
    told = [back("id").alias(id_col), F.col("n").alias("n_shingles"), back("component_id").alias("component_id")]
    if not row_col:
        every = full.select("id", "n", "component_id").unionAll(alone.select("id", "n", "component_id"))
        return every.select(*told, (F.col("id") == F.col("component_id")).alias("kept"))
    first = stash(full.groupBy("class").agg(F.min(F.struct("id", "d", "row")).alias("first")).select(F.col("first.row").alias("first_row")), "first")
    every = full.select("id", "row", "n", "component_id").unionAll(alone.select("id", "row", "n", "component_id")).join(first, F.col("row") == F.col("first_row"), "left")
    return every.select(*told, ((F.col("n") == 0) | F.col("first_row").isNotNull()).alias("kept"), F.col("row").alias(row_col))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128(s.tobytes()).digest()


def _items(base: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(d, items): the whole set of each wanted (d, rep), from the texts of their ids."""
    wanted = stash(wanted, "wanted")
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids

    def whole(frames):
        for pdf in frames:
            found = [shingles(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"d": [digest(s) for s in found], "items": [pack(s) for s in found]})

    # an id may repeat with other texts: the digest decides
    read = base.join(ids, "id", "left_semi").select("text").mapInPandas(whole, "d binary, items binary")
    items = stash(read.join(wanted.select("d"), "d", "left_semi").dropDuplicates(["d"]), "items")
    discard(wanted)
    return items


def _open_links(met: DataFrame, near: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of sets that share a bucket and are not its hub.

    near: (node, component) of sets linked so far.
    """
    label = F.coalesce("component", "d")
    members = met.filter("weight > 2 AND d <> hub").select("key", "d").join(near, F.col("d") == F.col("node"), "left").select("key", "d", label.alias("label"))
    members = stash(members, "members")
    tell = [F.bit_xor(F.xxhash64(F.lit(k), F.col("d"))).alias(f"x{k}") for k in (1, 2)]
    by_class = members.groupBy("key", "label").agg(F.count("*").alias("n"), *tell)
    buckets = by_class.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).filter("classes > 1")
    # buckets of equal members count once
    once = buckets.groupBy("x1", "x2", "n").agg(F.min(F.struct("key", "main")).alias("b")).select("b.key", F.col("b.main.label").alias("main"), "n", (F.col("n") - F.col("b.main.n")).alias("open"))
    once = stash(once, "open")
    known = stash(members.join(once, "key").withColumn("fresh", F.col("label") != F.col("main")).join(items, "d").select("key", "d", "label", "fresh", "n", "open", "items"), "known")
    parts = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    seat = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("d")), parts(n)).cast("int")
    cell = F.xxhash64("key", "u", "v")
    columns = ["cell", "key", "d", "label", "fresh", "items"]
    large = known.filter(F.col("n") > CELL)
    asking = large.filter("fresh").withColumn("u", seat("open", "u")).withColumn("v", F.explode(F.sequence(F.lit(0), parts("n") - 1)))
    asked = large.withColumn("v", seat("n", "v")).withColumn("u", F.explode(F.sequence(F.lit(0), parts("open") - 1))).withColumn("fresh", F.lit(False))
    blocks = asking.unionByName(asked).withColumn("cell", cell).select(columns)
    # small buckets share cells of about CELL sets
    cells = max(1, (known.filter(F.col("n") <= CELL).count()) // CELL)
    small = known.filter(F.col("n") <= CELL).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))).select(columns)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple] = set()
        for _, part in pdf.groupby("key", sort=False):
            # a fresh set can also stand among the rest of its block
            part = part.sort_values("fresh", ascending=False).drop_duplicates("d")
            out.update(_links(part["d"].tolist(), [unpack(x) for x in part["items"]], part["fresh"].tolist(), part["label"].tolist(), percent))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    found = stash(small.unionByName(blocks).groupBy("cell").applyInPandas(compare, "a binary, b binary").distinct(), "links")
    discard(members, once, known)
    return found
