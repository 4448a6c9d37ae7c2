"""BPE encoding and decoding by a contiguous rank array.

A word is a list of part boundaries with, beside each boundary, the merge rank of the
two parts that start there.  The smallest rank is found by a scan, the boundary inside
that pair is deleted and the two neighbouring ranks are computed anew.  The scan is
quadratic in the parts of a word, so words over ``SHORT`` parts use a heap over the same
ranks, which makes the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Parts in a word up to which the ranks are scanned instead of held in a heap.
SHORT = 256
#: Words whose parts a worker remembers; bounds its memory, never what it encodes.
REMEMBERED = 200_000
#: Texts that are encoded at once.
ROWS = 1_000
NEVER = 1 << 20
#: White space as the tokenizer's pattern engine has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    shown = {b: chr(b) for b in plain}
    return [shown.get(b) or chr(next(rest)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memo(dict):
    """Results for short keys, computed when first asked for; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder for a vocabulary of byte-level pieces with word ends."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        if max(self.tokens, default=0) >= 1 << 17:
            raise ValueError("pairs are packed in 17 bits an id: the vocabulary may have 131,072 ids")
        #: left << 17 | right -> rank; the id of a union is in joined[rank]
        self.pairs: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(self.vocab[left] << 17 | self.vocab[right], rank)
            self.joined.append(self.vocab[left + right])
        shown = byte_alphabet()
        self.inner = [self.vocab[c] for c in shown]
        self.final = [self.vocab[c + end] for c in shown]
        self.splitter = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pack = lambda ids: array("i", ids).tobytes()
        self.word_raw = _Memo(lambda word: pack(self.word_ids(word)))
        #: ids as bytes of what stands between white space
        self.raw = _Memo(lambda chunk: b"".join(map(self.word_raw.__getitem__, self.splitter.findall(chunk))))
        size = max(self.tokens, default=-1) + 1
        self.decimal = list(map(str, range(size)))
        self.shown = [self.tokens.get(i, "") for i in range(size)]

    # -- words ---------------------------------------------------------------
    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.final[data[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, joined = self.pairs.get, self.joined
        ranks, left = [], parts[0]
        for right in parts[1:]:
            ranks.append(rank(left << 17 | right, NEVER))
            left = right
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            union = parts[at] = joined[best]
            del parts[at + 1]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(union << 17 | parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 17 | union, NEVER)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        rank, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 17 | parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or rank(parts[i] << 17 | parts[j], NEVER) != r:
                continue
            parts[i], live[j] = self.joined[r], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank(parts[a] << 17 | parts[after[a]], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [p for p, on in zip(parts, live) if on]

    # -- texts ---------------------------------------------------------------
    def _pieces(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(is a special token, chunks between white space), in order."""
        for k, piece in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield True, [piece]
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece)
                # a final sigma is lower-cased like any other
                low = piece.lower() if "\u03a3" not in piece else "".join(c.lower() for c in piece)
                # str.split() also cuts at four separators that the pattern takes for symbols
                yield False, self.splitter.findall(low) if SEPARATORS.search(low) else low.split()

    def encode(self, text: str | None) -> np.ndarray:
        out = [
            np.int32(self.special[c[0]]).tobytes() if mark else b"".join(map(self.raw.__getitem__, c))
            for mark, c in self._pieces(text or "")
        ]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by one space; unknown ids are skipped."""
        return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the ids and of the decoded text."""
        ids = array("i", self.encode(text).tobytes())
        sha = lambda table: hashlib.sha256(" ".join(map(table.__getitem__, ids)).encode()).hexdigest()
        return len(ids), sha(self.decimal), sha(self.shown)


_LOADED: dict[int, WordBpe] = {}


def _loaded(shipped) -> WordBpe:
    """One encoder for each Python worker and vocabulary."""
    source = shipped.value
    if hash(source) not in _LOADED:
        _LOADED[hash(source)] = WordBpe(source)
    return _LOADED[hash(source)]


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """Smaller batches: ROWS texts and their ids are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _ship(spark: SparkSession, vocabulary: str | None):
    """The vocabulary file is one of a few MB, read by the driver."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, text_col: str = "text", out_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """df with the ids of each whole text in ``out_col`` (replaced if df has such a column).

    Null and empty texts give an empty list; repeated rows stay; an empty table stays empty.
    """
    shipped = _ship(df.sparkSession, vocabulary)
    base = df.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if text_col not in base.columns:
        raise ValueError(f"no column {text_col}")

    def run(batches):
        bpe = _loaded(shipped)
        for b in _parts(batches):
            found = [bpe.encode(t) for t in b.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out_col])

    return base.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the tokens of ``ids_col`` joined by one space in ``out_col``; null lists give ''."""
    shipped = _ship(df.sparkSession, vocabulary)
    base = df.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        bpe = _loaded(shipped)
        for b in _parts(batches):
            texts = pa.array([bpe.decode(x or []) for x in b.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out_col])

    return base.mapInArrow(run, schema)


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode and decode each text; (id, n_tokens, ids_sha256, decoded_sha256), one row per input row."""
    shipped = _ship(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = _loaded(shipped)
        for b in _parts(batches):
            rows = [bpe.digests(t) for t in b.column(text_col).to_pylist()]
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
