"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram binds its letters' vectors,
each rotated by its place; a text bundles its n-grams; a language bundles the directions
of its documents.  A document takes the language whose prototype has the greatest cosine.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import arrow_batches, free_name

DIMENSIONS, SEED, GRAM = 1024, 11, 3
#: Characters and documents of a block that is bundled at once; longer texts go piece by piece.
CHARS, DOCS = 400_000, 64
#: Bound n-grams that a worker remembers, and n-grams whose counts are a matrix at once.
REMEMBERED, SLICE = 8_000, 4_000
#: Texts whose bundles are held at once, and of letters that are remembered.
TEXTS, LETTERS = 512, 20_000
GAP = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


@lru_cache(maxsize=LETTERS)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


def bind(grams: np.ndarray) -> np.ndarray:
    """A row for each n-gram: the product of its letters' vectors, each rotated by its place."""
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(GRAM):
        codes, at = np.unique(grams >> 21 * place & 0x1FFFFF, return_inverse=True)
        out *= np.roll(np.stack([letter_vector(c) for c in codes.tolist()]), place, axis=1)[at]
    return out


class Bundler:
    """Bundles of texts; keeps bound n-grams that it has met, in one matrix."""

    def __init__(self):
        self.where: dict[int, int] = {}
        self.table = np.zeros((REMEMBERED, DIMENSIONS), np.float32)

    def _bound(self, grams: np.ndarray) -> np.ndarray:
        """Rows of up to SLICE n-grams; new ones are remembered, all are forgotten when there is no room."""
        new = [g for g in grams.tolist() if g not in self.where]
        if len(self.where) + len(new) > REMEMBERED:
            self.where, new = {}, grams.tolist()
        if new:
            at = len(self.where)
            self.table[at : at + len(new)] = bind(np.array(new, dtype=np.int64))
            self.where.update(zip(new, range(at, at + len(new))))
        return self.table[[self.where[g] for g in grams.tolist()]]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; zeros if it has no letter."""
        out = np.zeros((len(texts), DIMENSIONS))
        block: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in self._codes(text or ""):
                block.append((i, piece))
                size += len(piece)
                if size >= CHARS or len(block) >= DOCS:
                    self._add(out, block)
                    block, size = [], 0
        self._add(out, block)
        return out

    @staticmethod
    def _codes(text: str):
        """Letters in pieces of about CHARS, other runs as one gap; each piece begins with the last two codes before it."""
        held = np.array([GAP], dtype=np.int64)
        for at in range(0, len(text) + 1, CHARS):
            codes = np.frombuffer(text[at : at + CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            last = [GAP] if at + CHARS > len(text) else []
            codes = np.concatenate([held, np.where(_letters()[codes], codes, GAP).astype(np.int64), last]).astype(np.int64)
            keep = np.ones(len(codes), bool)
            keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
            codes = codes[keep]
            if len(codes) >= GRAM:
                yield codes
            held = codes[1 - GRAM :]

    def _add(self, out: np.ndarray, block: list[tuple[int, np.ndarray]]) -> None:
        if not block:
            return
        codes = np.concatenate([c for _, c in block])
        doc = np.repeat(np.arange(len(block)), [len(c) - GRAM + 1 for _, c in block])
        begins = np.concatenate([[0], np.cumsum([len(c) for _, c in block])])[:-1]
        starts = np.concatenate([np.arange(len(c) - GRAM + 1) + b for (_, c), b in zip(block, begins)])
        # n-grams inside a word, its edges included
        inner = codes[starts + 1] != GAP
        starts, doc = starts[inner], doc[inner]
        alphabet = np.flatnonzero(np.bincount(codes))
        small = np.zeros(int(codes.max()) + 1, np.int64)
        small[alphabet] = np.arange(len(alphabet))
        c, k = small[codes], len(alphabet)
        gram = (c[starts] * k + c[starts + 1]) * k + c[starts + 2]
        if k**3 <= 4_000_000:
            seen = np.zeros(k**3, bool)
            seen[gram] = True
            met = np.flatnonzero(seen)
            index = np.cumsum(seen) - 1
            col = index[gram]
        else:
            met, col = np.unique(gram, return_inverse=True)
        ids = alphabet[met // (k * k)] | alphabet[met // k % k] << 21 | alphabet[met % k] << 42
        cuts = [0, len(col)]
        if len(met) > SLICE:  # n-grams in order, so that a slice of them is a run
            by = np.argsort(col, kind="stable")
            doc, col = doc[by], col[by]
            cuts = [*np.searchsorted(col, np.arange(0, len(met), SLICE)).tolist(), len(col)]
        sums = np.zeros((len(block), DIMENSIONS))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = ids[k * SLICE : (k + 1) * SLICE]
            counts = np.bincount(doc[a:b] * len(part) + (col[a:b] - k * SLICE), minlength=len(block) * len(part)).reshape(len(block), len(part))
            sums += counts.astype(np.float32) @ self._bound(part)
        np.add.at(out, [i for i, _ in block], sums)


_BUNDLER: list[Bundler] = []


def _bundler() -> Bundler:
    if not _BUNDLER:
        _BUNDLER.append(Bundler())
    return _BUNDLER[0]


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _slices(frames):
    for pdf in frames:
        for at in range(0, len(pdf), TEXTS):
            yield pdf.iloc[at : at + TEXTS]


#: Directions are summed as integers of this scale, so that sums don't hang on their order.
SCALE = 1 << 24


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language, from all rows with a label and a letter.

    Tasks bundle what they read; the driver gets one vector for each language.
    """

    def run(frames):
        sums: dict[str, np.ndarray] = {}
        for pdf in _slices(frames):
            units = np.rint(_units(_bundler().bundle(pdf["text"].tolist())) * SCALE).astype(np.int64)
            langs = pdf["lang"].to_numpy()
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + units[langs == lang].sum(0)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(DIMENSIONS, dtype=np.int32), "value": v})

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    parts = rows.mapInPandas(run, "lang string, place int, value long")
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    with arrow_batches(labelled.sparkSession):
        found = {r.lang: np.array([x.value for x in r.v], dtype=np.float64) for r in summed.collect()}
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.any(v)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred and score (the cosine, 0 to 1) for each whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned;
    equal cosines go to the language first in order.  Repeated rows stay.
    """
    names = list(prototypes)
    grid = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    clash = {"lang_pred", "score"} & set(carried)
    if clash:
        raise ValueError(f"columns {clash} are of the result")
    # the text goes to Python once, under the caller's name if it is carried
    text = text_col if text_col in carried else free_name("__text", *carried)
    kept = df.select(*carried) if text in carried else df.select(*carried, F.col(text_col).alias(text))

    def run(batches):
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            x = _bundler().bundle(b.column(b.schema.get_field_index(text)).to_pylist())
            some = np.any(x, axis=1) & bool(names)
            cos = _units(x) @ grid.T if names else np.zeros((len(x), 1))
            best = cos.argmax(1)
            lang = pa.array([names[i] if s else "und" for i, s in zip(best, some)], pa.string())
            score = pa.array(np.where(some, np.clip(cos.max(1), 0, 1), 0.0))
            # columns that are carried never leave Arrow: a pandas column of ids with a null would be of doubles
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], lang, score], names=[*carried, "lang_pred", "score"])

    schema = df.select(*carried).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
