"""Substring dedup by Rabin-Karp hashes of every fixed-length window of words.

Rows are read in batches of about ``BATCH_BYTES`` of text.  A batch hashes every window of
its texts, keeps the first of each hash (by id, then start) and sends those, sorted and
packed, to buckets of the hash range.  A bucket finds for each hash the batch whose
document comes first and answers every other batch with one bit a window.  Removed windows
then merge into maximal intervals of words.  A hash that a third of all documents hold is
one entry a batch.

A window is known by 88 bits: a 64-bit hash that orders the buckets and 24 bits of an
independent polynomial beside it.  Among n windows about n * n / 2 ** 89 pairs agree by
chance: about one pair in all for the 2.5e13 windows of 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import alike_scans, integer_ids, shuffle_width, stash
from loomwork.llm.wordhash import from_planes, pack, planes, unpack, window_checks, window_hashes, word_hashes, words_of

#: Rows of a batch of short texts, bytes of text of any batch (a longer text is a batch of its own), and windows that a bucket should hold.
BATCH_ROWS, BATCH_BYTES, BUCKET_WINDOWS = 4096, 16 << 20, 2_000_000


def _finer(by: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """An order by h made one by h, then c, then place: only where equal h have unequal c."""
    s, t = h[by], c[by]
    return np.lexsort((c, h)) if bool(((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any()) else by


class _Batch:
    """Words, windows and first windows of some rows, in the order of (id, row)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, texts: list, width: int):
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.words = [words_of(texts[i]) for i in order]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        by_word = [word_hashes(w) for w in self.words]
        hashed = [window_hashes(h, width) for h in by_word]
        checked = [window_checks(h, width) for h in by_word]
        counts = np.array([len(h) for h in hashed], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        #: place of each window's first word among all words of the batch, and its document
        self.doc = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        self.place = np.arange(len(self.doc)) - np.repeat(first, counts) + np.repeat(begin, counts)
        h = np.concatenate([np.empty(0, np.uint64), *hashed])
        c = np.concatenate([np.empty(0, np.uint32), *checked])
        by = np.argsort(h, kind="stable")
        if len(by):
            by = _finer(by, h, c)
        s, t = h[by], c[by]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        self.hashes, self.checks, self.firsts = s[new], t[new], by[new]
        self.again = by[~new]
        self.width = width

    def stamp(self) -> int:
        """Tells whether a later reading holds the same rows."""
        return int(window_hashes(np.array([len(self.hashes), *self.rows, *self.sizes], dtype=np.int64).view(np.uint64), 2 * len(self.rows) + 1)[0]) >> 1

    def kept(self, lost: np.ndarray):
        """For each row (row, n_words, n_removed, kept text); lost: which first windows start earlier elsewhere."""
        total = int(self.sizes.sum())
        edge = np.zeros(total + 1, np.int64)
        starts = self.place[np.concatenate([self.again, self.firsts[lost]]).astype(np.int64)]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.width, -1)
        gone = np.cumsum(edge)[:total] > 0
        at = 0
        for i, (row, words) in enumerate(zip(self.rows, self.words)):
            mine = gone[at : at + len(words)]
            at += len(words)
            n = int(mine.sum())
            yield int(self.ids[i]), int(row), len(words), n, b" ".join(compress(words, (~mine).tolist()) if n else words).decode()


def _batches(frames, width: int):
    """Batches, each when its class of lengths goes on to the next; rows of one batch may come in several frames."""
    held: dict[int, tuple[int, list[pd.DataFrame]]] = {}
    made = lambda parts: _Batch(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("id", "row")), [t for p in parts for t in p["text"]], width)
    for pdf in frames:
        for b, part in pdf.groupby("batch", sort=True):
            kind = b % CLASSES
            if kind in held and held[kind][0] != b:
                last, parts = held.pop(kind)
                yield last, made(parts)
            held.setdefault(kind, (b, []))[1].append(part)
    for last, parts in held.values():
        yield last, made(parts)


#: Classes of text length, each up to eight times the one before; a batch holds texts of one class.
CLASSES = 8


def batch_of(row: Column, text: Column) -> Column:
    """The batch of a row: texts of one class from a run of rows that is an eighth as long for each class, one row for the longest."""
    least, size = BATCH_BYTES // BATCH_ROWS, F.coalesce(F.octet_length(text), F.lit(0))
    found = F.lit(BATCH_ROWS), F.lit(0)
    for kind in range(1, CLASSES):
        longer = size > least << 3 * (kind - 1)
        found = F.when(longer, F.lit(max(1, BATCH_ROWS >> 3 * kind))).otherwise(found[0]), F.when(longer, F.lit(kind)).otherwise(found[1])
    return F.call_function("div", row, found[0]) * CLASSES + found[1]


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each message of a bucket one bit a hash: whether an earlier document has it."""
    pdf = pdf.sort_values("batch", ignore_index=True)
    hashes = [unpack(x) for x in pdf["hashes"]]
    h, c = np.concatenate(hashes), np.concatenate([from_planes(x, np.uint32) for x in pdf["checks"]])
    d = np.concatenate([unpack(x).view(np.int64)[from_planes(y, np.uint16)] for x, y in zip(pdf["ids"], pdf["places"])])
    by = _finer(np.argsort(h, kind="stable"), h, c)
    s, t, d = h[by], c[by], d[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = d == np.minimum.reduceat(d, starts)[group]
    # of equal ids the batch that was read first
    first = np.minimum.reduceat(np.where(least, np.arange(len(s)), len(s)), starts)
    lost = np.ones(len(s), bool)
    lost[by[first]] = False
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "stamp": pdf["stamp"], "n": [len(x) for x in hashes], "bits": [np.packbits(x).tobytes() for x in np.split(lost, ends)]})


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, stable: bool = False, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row: its text without words of windows that also start earlier.

    Earlier means a smaller id or, in the same document, an earlier start; of rows that
    repeat an id, the one read first.  Windows are judged on the input.  ``kept`` joins the
    words by one space.  Null texts have no words; null ids come before all others and
    are returned as null, other ids are integers; texts under ``width`` words stay whole.

    df is read twice and must give the same rows both times: it is written to the shared
    folder first unless ``stable`` says that it is a plain scan.  Both readings split the
    files alike, whatever executors there are, and the result is written.  ``finish`` is
    applied to the result before that, for callers that need less than the texts.
    """
    integer_ids(df, id_col)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base if stable else stash(base, "texts")
    rows = base.withColumn("row", F.monotonically_increasing_id()).withColumn("batch", batch_of(F.col("row"), F.col("text"))).withColumn("id", F.coalesce("id", F.lit(-(2**63))))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_width(spark), -(-chars // (5 * BUCKET_WINDOWS)))

    def send(frames):
        for b, batch in _batches(frames, width):
            bucket = (batch.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            doc = batch.doc[batch.firsts]
            stamp = batch.stamp()
            sent: dict[str, list] = {k: [] for k in ("bucket", "hashes", "checks", "ids", "places")}
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[i], cuts[i + 1])
                # a batch is in the order of its ids, so a message's distinct documents are too
                held, place = np.unique(doc[mine], return_inverse=True)
                for k, v in zip(sent, (i, pack(batch.hashes[mine]), planes(batch.checks[mine]), pack(batch.ids[held].view(np.uint64)), planes(place.astype(np.uint16)))):
                    sent[k].append(v)
            if sent["bucket"]:
                yield pd.DataFrame({**sent, "batch": b, "stamp": stamp}).astype({"bucket": np.int32})[["bucket", "batch", "stamp", "hashes", "checks", "ids", "places"]]

    sent = rows.mapInPandas(send, "bucket int, batch long, stamp long, hashes binary, checks binary, ids binary, places binary")

    def apply(docs: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            raise RuntimeError("an answer for a batch that is not there")
        batch = _Batch(docs["id"].to_numpy(), docs["row"].to_numpy(), docs["text"].tolist(), width)
        bits = bits.sort_values("bucket")
        if int(bits["n"].sum()) != len(batch.hashes) or (bits["stamp"] != batch.stamp()).any():
            raise RuntimeError("the rows of a batch changed between two readings")
        lost = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(bits["bits"], bits["n"])]
        return pd.DataFrame(batch.kept(np.concatenate([np.empty(0, bool), *lost])), columns=["id", "row", "n_words", "n_removed", "kept"])

    with alike_scans(spark):
        answers = stash(sent.groupBy("bucket").applyInPandas(_answers, "batch long, bucket int, stamp long, n long, bits binary"), "answers")
        applied = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(apply, "id long, row long, n_words long, n_removed long, kept string")
        done = applied.select(F.nullif("id", F.lit(-(2**63))).cast(kind).alias(id_col), "n_words", "n_removed", "kept")
        return stash(finish(done) if finish else done, "kept")
