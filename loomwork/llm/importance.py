"""Importance resampling towards a target distribution, over a sparse matrix in CSR blocks.

Each text is a row of a document-by-bucket count matrix: its features are runs of words,
hashed to buckets.  The matrix is written once, in blocks of compressed sparse rows
(ids, row ends, buckets, counts).  Column sums of the blocks of corpus and target give
the two distributions, and with them a gain for each bucket; the product of each block
with the gains gives the documents' weights.  A Gumbel number made from the id is added
to a weight, and the documents with the highest sums are the sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.shared import arrow_batches, stash
from loomwork.operators.prefix import running_totals

#: Rows and bytes of text of a block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Bytes of a row group of the written matrix. They grow about threefold when decoded, and a task holds one group.
GROUP_BYTES = 4 << 20
#: Words whose buckets a worker remembers; bounds its memory only.
REMEMBERED = 500_000
#: Anything but digits, letters and bytes of other scripts becomes a space, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Crc(dict):
    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_CRC = _Crc()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; null texts have none."""
    return (text or "").encode().translate(FOLD).split()


def feature_hashes(words: list[bytes], shortest: int, longest: int) -> np.ndarray:
    """CRC-32 of each run of shortest to longest words, joined by one space."""
    parts = []
    for n in range(shortest, longest + 1):
        if n == 1:
            parts.append(np.fromiter(map(_CRC.__getitem__, words), np.uint32, len(words)))
        else:
            runs = zip(*[words[i:] for i in range(n)])
            parts.append(np.fromiter((zlib.crc32(b" ".join(r)) for r in runs), np.uint32, max(0, len(words) - n + 1)))
    return np.concatenate([np.empty(0, np.uint32), *parts])


def count_matrix(df: DataFrame, id_col: str, text_col: str = "text", buckets: int = 10_000, runs: tuple[int, int] = (1, 1)) -> DataFrame:
    """The written blocks (block, n_words, ends, buckets, counts, ids) of the count matrix of df's whole texts.

    ``ends`` holds where each row's entries end in ``buckets`` and ``counts``.  Ids of any
    type, null or repeated, stay as they are; null texts are empty rows.  An empty table
    has no blocks.  Other columns of df are not read.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType
    schema = T.StructType.fromDDL("block long, n_words array<long>, ends array<int>, buckets array<int>, counts array<int>").add("ids", T.ArrayType(kind))

    def block(number: int, ids: list[pa.Array], n_words: list[int], hashed: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.repeat(np.arange(len(hashed), dtype=np.int64), [len(h) for h in hashed])
        cells, counts = np.unique(rows * buckets + np.concatenate(hashed) % buckets, return_counts=True)
        ends = np.searchsorted(cells, np.arange(1, len(hashed) + 1, dtype=np.int64) * buckets)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        ints = [pa.array(x, pa.int32()) for x in (ends.astype(np.int32), (cells % buckets).astype(np.int32), counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(pa.array(n_words, pa.int64())), *map(one, ints), one(pa.concat_arrays(ids))], names=schema.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, n_words, hashed, size = [], [], [], 0
        for b in batches:
            own = b.column(0).take(np.arange(b.num_rows))  # a slice of the batch's own would hold its texts as well
            for at in range(b.num_rows):
                words = words_of(b.column(1)[at].as_py())
                found = feature_hashes(words, *runs)
                if hashed and (len(hashed) >= BLOCK_ROWS or size + len(found) * 8 > BLOCK_BYTES):
                    yield block(number, ids, n_words, hashed)
                    number, ids, n_words, hashed, size = number + 1, [], [], [], 0
                ids.append(own.slice(at, 1))
                n_words.append(len(words))
                hashed.append(found.astype(np.int64))
                size += len(found) * 8
        if hashed:
            yield block(number, ids, n_words, hashed)

    return stash(base.mapInArrow(run, schema), "matrix", group=GROUP_BYTES)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The named list columns of each block of a batch, as arrays."""
    for i in range(batch.num_rows):
        yield [batch.column(batch.schema.get_field_index(n))[i].values.to_numpy() for n in names]


def column_sums(matrix: DataFrame) -> DataFrame:
    """(bucket, n) for each bucket with a count; tasks add up what they read."""

    def run(batches):
        sums = np.zeros(0, np.int64)
        for b in batches:
            for buckets, counts in _rows(b, "buckets", "counts"):
                found = np.bincount(buckets, counts, minlength=len(sums)).astype(np.int64)
                found[: len(sums)] += sums
                sums = found
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _sums(matrix: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    with arrow_batches(matrix.sparkSession):
        found = column_sums(matrix).collect()  # one row a bucket at most
    for r in found:
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """For each bucket 1000 times the log ratio of its share in the target and in the corpus, one added to every count, floored."""
    n, s, t = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus, target)], dtype=np.int64)


def weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) for each row: the floored mean gain of its features, 0 without any."""
    kind = matrix.schema["ids"].dataType.elementType
    schema = T.StructType().add("id", kind).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches):
        for b in batches:
            for i, (words, ends, buckets, counts) in enumerate(_rows(b, "n_words", "ends", "buckets", "counts")):
                upto = lambda x, ends=ends: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
                features, total = upto(counts.astype(np.int64)), upto(counts * gains[buckets])
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(words), pa.array(features), pa.array(mean)], names=schema.names)

    return matrix.select("ids", "n_words", "ends", "buckets", "counts").mapInArrow(run, schema)


def gumbel(id_text: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, floored, from the first 32 bits of SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", buckets: int = 10_000, runs: tuple[int, int] = (1, 1), seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank) for each document; rank is null for those that are not drawn.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) with
    the highest scores are drawn, ties to the smaller id (null first), then to weight and
    features.  Null texts have no features and weight 0; a null id counts as an empty
    string in the Gumbel number; repeated rows are drawn each.  With an empty target its
    distribution is even; of no documents comes no row.
    """
    matrix = count_matrix(docs, id_col, text_col, buckets, runs)
    goal = count_matrix(target, target_id, target_text, buckets, runs)
    gains = bucket_gains(_sums(matrix, buckets), _sums(goal, buckets))
    scored = weights(matrix, gains).withColumn("score", F.col("weight") + gumbel(F.col("id").cast("string"), seed))
    scored = stash(scored, "scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.filter(fit).count() // 100
    ranked = running_totals(scored.filter(fit), [], [F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_features")], {"rank": F.lit(1)})
    rest = scored.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long")).alias("rank")
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank)
