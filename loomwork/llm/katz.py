"""Katz backoff language model: Good-Turing discounts, backoff weights that normalise exactly.

Texts are read once into blocks: the distinct words of some texts and, for each place, the
number of its word.  An n-gram is known by a 64-bit rolling hash.  Each block sends the
sorted distinct n-grams of every order with their training counts to buckets of the hash
range; a bucket adds up the counts and answers every block with the totals of its n-grams,
and names one block as the owner of each.  Owners add up, for each history, the discounted
share of its followers and those followers' lower-order share, from which the backoff
weights come, a table by history.  A token's probability is found by recursion from the
longest n-gram down: a seen n-gram has its discounted share, an unseen one the backoff
weight of its history times the probability one order lower.  A common word is one entry
a block, and a history's followers lie in all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.llm.shared import shuffle_width, stash
from loomwork.llm.wordhash import BASE, from_planes, mixed, pack, planes, unpack, word_hashes

#: Texts and bytes of text of a block (a longer text is a block of its own), n-grams that a bucket should get.
BLOCK_ROWS, BLOCK_BYTES, BUCKET_GRAMS = 1 << 16, 16 << 20, 3_000_000
#: Counts up to this one have Turing's own discount; counts of counts that the fit for larger ones looks at.
TURING, FITTED = 5, 40
#: A-Z become a-z; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Hashes of the end of a text, which is a token, and of what stands before its first word, which is none.
#: No word has a space in it, so neither is a word's.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" begin"))


def _shift(keys: np.ndarray, starts: np.ndarray, pad: np.uint64) -> np.ndarray:
    """The key of the place before each place, ``pad`` before a text's first."""
    out = np.empty_like(keys)
    out[1:] = keys[:-1]
    out[starts] = pad
    return out


def gram_keys(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 the hash of the n-gram that ends at each place."""
    keys, pad = [words], BEGIN
    for _ in range(1, order):
        history = _shift(keys[-1], starts, pad)
        keys.append(mixed(history * BASE + words))
        pad = mixed(np.array([pad], np.uint64) * BASE + BEGIN)[0]
    return keys


#: What a block's places need of its row.
PLACES = ("block", "train", "sizes", "words", "codes")


class Block:
    """The words, places and texts of a written block."""

    def __init__(self, row: dict, order: int):
        held = np.frombuffer(row["train"], np.uint8).astype(bool)
        sizes = np.frombuffer(row["sizes"], np.int64)
        vocabulary = np.append(unpack(zstandard.decompress(row["words"])), END)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.train, self.sizes, self.trained = held, sizes, held[self.doc]
        self.keys = gram_keys(vocabulary[from_planes(zstandard.decompress(row["codes"]), np.int32)], self.starts, order)

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of an order, and the number among them of each place's."""
        return np.unique(self.keys[level], return_inverse=True)


def blocks(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written blocks (block, tokens, ids, train, sizes, words, codes) of df's whole texts; null texts are empty ones."""
    base = df.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType
    schema = T.StructType().add("block", "long").add("tokens", "long").add("ids", T.ArrayType(kind)).add("train", "binary").add("sizes", "binary").add("words", "binary").add("codes", "binary")

    def block(number: int, ids: list, train: list[bool], hashed: list[np.ndarray]) -> pa.RecordBatch:
        words, codes = np.unique(np.concatenate(hashed), return_inverse=True)
        sizes = np.array([len(h) + 1 for h in hashed], dtype=np.int64)
        # a text's end is the code after the last word's
        places = np.full(int(sizes.sum()), len(words), np.int32)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(places), bool)
        inner[ends] = False
        places[inner] = codes
        row = [pa.array([number], pa.int64()), pa.array([len(places)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids))]
        row += [pa.array([x], pa.binary()) for x in (np.array(train, dtype=np.uint8).tobytes(), sizes.tobytes(), zstandard.compress(pack(words)), zstandard.compress(planes(places)))]
        return pa.RecordBatch.from_arrays(row, names=schema.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, hashed, size = [], [], [], 0
        for b in batches:
            for at in range(b.num_rows):
                text = (b.column(2)[at].as_py() or "").encode()
                if hashed and (len(hashed) >= BLOCK_ROWS or size + len(text) > BLOCK_BYTES):
                    yield block(number, ids, train, hashed)
                    number, ids, train, hashed, size = number + 1, [], [], [], 0
                ids.append(b.column(0).slice(at, 1))
                train.append(b.column(1)[at].as_py())
                hashed.append(word_hashes(text.translate(FOLD).split()))
                size += len(text)
        if hashed:
            yield block(number, ids, train, hashed)

    return stash(base.mapInArrow(run, schema), "blocks")


COUNTED = "level int, bucket int, block long, n long, totals binary, owned binary, histogram array<long>"


def _counts(table: pa.Table) -> pa.Table:
    """The answers of a bucket to each block: total training counts of its n-grams, and a bit for each that it owns."""
    table = table.sort_by("block")
    keys = [unpack(x) for x in table["keys"].to_pylist()]
    h = np.concatenate(keys)
    c = np.concatenate([from_planes(x, np.int64) for x in table["counts"].to_pylist()])
    by = np.argsort(h, kind="stable")
    s, n = h[by], c[by]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    total = np.add.reduceat(n, starts)
    # the first block that has an n-gram owns it
    totals, owned = np.empty(len(h), np.int64), np.zeros(len(h), bool)
    totals[by] = total[group]
    owned[by[starts]] = total > 0
    seen = total[total > 0]
    # types, tokens, then how many n-grams were counted once, twice and so on
    histogram = [len(seen), int(seen.sum()), *np.bincount(np.minimum(seen, FITTED + 1), minlength=FITTED + 2)[1 : FITTED + 1].tolist()]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    m = table.num_rows
    return pa.table({
        "level": table["level"].cast(pa.int32()), "bucket": table["bucket"].cast(pa.int32()), "block": table["block"], "n": pa.array([len(k) for k in keys], pa.int64()),
        "totals": pa.array([zstandard.compress(planes(x)) for x in np.split(totals, ends)], pa.binary()), "owned": pa.array([np.packbits(x).tobytes() for x in np.split(owned, ends)], pa.binary()),
        "histogram": pa.array([histogram] + [None] * (m - 1), pa.list_(pa.int64())),
    })


def gram_counts(made: DataFrame, order: int) -> DataFrame:
    """The written answers (level, bucket, block, n, totals, owned, histogram) to every block about its n-grams of every order, by bucket of the hash range."""
    tokens = made.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(shuffle_width(made.sparkSession), -(-tokens // BUCKET_GRAMS))

    def send(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, order)
                for level in range(order):
                    keys, at = block.distinct(level)
                    n = np.bincount(at, block.trained, minlength=len(keys)).astype(np.int64)
                    cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(cuts)).tolist()
                    parts = [slice(cuts[i], cuts[i + 1]) for i in some]
                    columns = [pa.array([level] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([pack(keys[p]) for p in parts], pa.binary()), pa.array([planes(n[p]) for p in parts], pa.binary())], names=["level", "bucket", "block", "keys", "counts"])

    sent = made.select(*PLACES).mapInArrow(send, "level int, bucket int, block long, keys binary, counts binary")
    return stash(sent.groupBy("level", "bucket").applyInArrow(_counts, COUNTED), "counts")


def discounts(histogram: list[int]) -> tuple[np.ndarray, float]:
    """(for counts up to TURING, the exponent for larger ones): what Good and Turing leave of a count, between 0 and 1.

    ``histogram`` has how many n-grams were counted once, twice and so on.  Up to TURING
    a count r becomes (r + 1) n[r + 1] / n[r]; where that leaves nothing or everything,
    and beyond, n[r] is taken from a line fitted to log n by log r, which gives
    r (1 + 1 / r) ** (1 + slope).  Every count loses something, so every history has a
    share left for followers that it never had.
    """
    held = [(math.log(r), math.log(n)) for r, n in enumerate(histogram, 1) if n]
    slope = -2.0
    if len(held) > 1:
        weight = np.array([histogram[round(math.exp(x)) - 1] for x, _ in held], dtype=np.float64) ** 0.5
        slope = min(float(np.polyfit([x for x, _ in held], [y for _, y in held], 1, w=weight)[0]), -1.1)
    out = np.ones(TURING + 1)
    for r in range(1, TURING + 1):
        raw = (r + 1) * histogram[r] / (r * histogram[r - 1]) if histogram[r - 1] else 0.0
        out[r] = raw if 0 < raw < 1 else (1 + 1 / r) ** (1 + slope)
    return out, 1 + slope


class Model:
    """Discounts of each order and the sizes of the training texts."""

    def __init__(self, histograms: list[list[int]], texts: int):
        self.types, self.tokens = histograms[0][0], histograms[0][1]
        self.texts = texts
        self.left = [discounts(h[2:]) for h in histograms]
        #: share of unknown tokens: what the discounts of single tokens leave
        self.unknown = 1.0

    def kept(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small, power = self.left[level]
        r = np.maximum(counts, 1).astype(np.float64)
        return np.where(counts > 0, counts * np.where(counts <= TURING, small[np.minimum(counts, TURING)], (1 + 1 / r) ** power), 0.0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _model(counted: DataFrame, made: DataFrame, order: int) -> Model:
    rows = counted.filter("histogram is not null").select("level", F.posexplode("histogram").alias("at", "n")).groupBy("level", "at").agg(F.sum("n").alias("n")).collect()
    histograms = [[0] * (FITTED + 2) for _ in range(order)]
    for r in rows:  # FITTED + 2 numbers an order
        histograms[r.level][r["at"]] = r.n

    def texts(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(sum(x) for b in batches for x in b.column(0).to_pylist())], pa.int64())], names=["n"])

    return Model(histograms, made.select("train").mapInArrow(texts, "n long").agg(F.sum("n")).first()[0] or 0)


FOUND = "level int, h long, share double, lower double, block long, doc int, n long"


def _spelled(model: Model, order: int, id_type):
    """What each block's places say: rows of documents, of histories' sums and of backoff weights that are needed."""
    names = ["level", "h", "share", "lower", "block", "doc", "n", "id", "train", "n_tokens", "n_known", "base"]
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64()]

    def table(length: int, **given) -> pa.Table:
        """Rows of the given columns, the others null."""
        return pa.table([given[k] if k == "id" and k in given else pa.array(given[k], t) if k in given else pa.nulls(length, t) for k, t in zip(names, kinds)], names=names)

    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        if not held.num_rows:
            raise RuntimeError("an answer for a block that is not there")
        row = {k: held[k][0].as_py() for k in PLACES}
        block = Block(row, order)
        answers = answers.sort_by([("level", "ascending"), ("bucket", "ascending")])
        counts, owns, out = [], [], []
        for level in range(order):
            mine = answers.filter(pc.equal(answers["level"], level))
            total = np.concatenate([np.empty(0, np.int64), *[from_planes(zstandard.decompress(x), np.int64) for x in mine["totals"].to_pylist()]])
            owned = np.concatenate([np.empty(0, bool), *[np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(mine["owned"].to_pylist(), mine["n"].to_pylist())]])
            keys, at = block.distinct(level)
            if len(keys) != len(total):
                raise RuntimeError("a block lacks answers")
            counts.append(total[at])
            # one place of each n-gram that the block owns
            first = np.zeros(len(keys), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            owns.append(first[owned])
        known = counts[0]
        # the share of a seen n-gram is its discounted count over its history's count
        share, seen = model.kept(0, known) / max(model.tokens, 1), known > 0
        chance, shares = np.log10(np.where(seen, share, model.unknown)), [share]
        history, keys = _shift(known, block.starts, model.texts), block.keys
        pad = BEGIN
        for level in range(1, order):
            of = _shift(keys[level - 1], block.starts, pad)
            pad = mixed(np.array([pad], np.uint64) * BASE + BEGIN)[0]
            c = counts[level]
            share = model.kept(level, c) / np.maximum(history, 1)
            shares.append(share)
            i = owns[level]
            held_by, group = np.unique(of[i], return_inverse=True)
            m = len(held_by)
            out.append(table(m, level=np.full(m, level), h=held_by.view(np.int64), share=np.bincount(group, share[i], m), lower=np.bincount(group, shares[level - 1][i], m)))
            # a history that was never seen backs off with a weight of one
            unseen = (c == 0) & (history > 0)
            held_by, group = np.unique(of[unseen], return_inverse=True)
            pairs, n = np.unique(block.doc[unseen] * len(held_by) + group, return_counts=True)
            doc, group = np.divmod(pairs, max(len(held_by), 1))
            out.append(table(len(n), level=np.full(len(n), level), h=held_by[group].view(np.int64), block=np.full(len(n), row["block"]), doc=doc, n=n))
            chance = np.where(c > 0, np.log10(np.maximum(share, 1e-300)), chance)
            history = _shift(c, block.starts, model.texts)
        docs = len(block.sizes)
        add = lambda x: np.bincount(block.doc, x, docs)
        out.append(table(docs, block=np.full(docs, row["block"]), doc=np.arange(docs), id=pc.list_flatten(held["ids"]), train=block.train, n_tokens=block.sizes, n_known=add(known > 0).astype(np.int64), base=add(model.base(known)), share=add(chance)))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each whole text, learning from the rows where ``train`` is true.

    A-Z are lower-cased; tokens are runs of anything but ASCII white space, then one end.
    ``score`` is the model's log10 probability of the text, ``base_score`` that of single
    tokens with half a count added.  Null texts have one token, their end; repeated rows
    are learned from and scored each; ids may be of any type, null or repeated.  With no
    training text every token is unknown, with probability one.
    """
    made = blocks(docs, train, id_col, text_col)
    counted = gram_counts(made, order)
    model = _model(counted, made, order)
    model.unknown = 1 - _kept_share(counted, model)
    kind = made.schema["ids"].dataType.elementType
    schema = T.StructType.fromDDL(FOUND).add("id", kind).add("train", "boolean").add("n_tokens", "long").add("n_known", "long").add("base", "double")
    run = _spelled(model, order, to_arrow_type(kind))
    found = stash(made.groupBy("block").cogroup(counted.drop("histogram").groupBy("block")).applyInArrow(run, schema), "spelled")
    weights = backoff_weights(found)
    need = found.filter("n is not null").select("level", "h", "block", "doc", "n")
    lost = need.join(weights, ["level", "h"]).groupBy("block", "doc").agg(F.sum(F.col("n") * F.col("log_weight")).alias("lost"))
    told = found.filter("n_tokens is not null").select("block", "doc", "id", "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "share")
    return told.join(lost, ["block", "doc"], "left").select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("share") + F.coalesce("lost", F.lit(0.0))).alias("score"))


def _kept_share(counted: DataFrame, model: Model) -> float:
    """What the discounts leave of all single tokens, as a share."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = []
        for b in batches:
            for r in b.to_pylist():
                own = np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=r["n"]).astype(bool)
                sums.append(float(model.kept(0, from_planes(zstandard.decompress(r["totals"]), np.int64)[own]).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([math.fsum(sums)])], names=["x"])

    single = counted.filter("level = 0").select("n", "totals", "owned")
    return (single.mapInArrow(run, "x double").agg(F.sum("x")).first()[0] or 0.0) / max(model.tokens, 1)


def backoff_weights(found: DataFrame) -> DataFrame:
    """The written table (level, h, log_weight): log10 of what a history's discounts leave, over what its followers leave one order lower."""
    sums = found.filter("lower is not null").groupBy("level", "h").agg(F.sum("share").alias("share"), F.sum("lower").alias("lower"))
    return stash(sums.select("level", "h", F.log10((1 - F.col("share")) / F.greatest(1 - F.col("lower"), F.lit(1e-300))).alias("log_weight")), "backoff")
