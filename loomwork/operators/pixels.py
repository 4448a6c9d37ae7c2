"""Byte and pixel statistics: histograms, pair chi-square, segments, bit planes and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.gamma import chi_square_tails


#: Images whose counts are held at once.
IMAGES = 512


#: Rows of 256 counts that are tested at once: 4 MB, and some copies of them.
TESTED_ROWS = 2_048


def _parts(batches: Iterator[pa.RecordBatch], images: int = IMAGES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and bytes of so many images at a time. Ids stay in Arrow: a pandas column of ids with a null would be of doubles."""
    for b in batches:
        for at in range(0, b.num_rows, images):
            part = b.slice(at, images)
            yield part.column(0), [x or b"" for x in part.column(1).to_pylist()]


def _batch(ids: pa.Array, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in columns.values()]], names=["id", *columns])


def _counted(batches: Iterator[pa.RecordBatch], cells: int, place) -> Iterator[pa.RecordBatch]:
    """(id, cell, value, cnt) of the bytes that ``place`` gives a cell to: one count over IMAGES images, one batch out for them."""
    for ids, images in _parts(batches):
        keys = [np.empty(0, np.int64)]
        for row, raw in enumerate(images):
            cell, value = place(np.frombuffer(raw, np.uint8))
            keys.append((row * cells + cell).astype(np.int64) * 256 + value)
        cnt = np.bincount(np.concatenate(keys), minlength=1)
        met = np.flatnonzero(cnt)
        row = met // 256 // cells
        yield _batch(ids.take(pa.array(row)), cell=(met // 256 % cells).astype(np.int32), value=(met % 256).astype(np.int32), cnt=cnt[met])


def histograms(images: DataFrame, id_col: str, data: Column, channels: int = 4) -> DataFrame:
    """(id, channel, value, cnt) of interleaved bytes: one pass in numpy, one row for each value that occurs."""
    rows = images.select(F.col(id_col).alias("id"), data.alias("data"))

    def place(flat: np.ndarray):
        n = len(flat) // channels * channels
        return np.arange(n) % channels, flat[:n]

    kind = images.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(lambda batches: _counted(batches, channels, place), f"id {kind}, cell int, value int, cnt long")
    return found.select(F.col("id").alias(id_col), F.col("cell").alias("channel"), "value", "cnt")


TESTED = "n long, bins int, odd long, full long, chi2 double, df int, p double, constant boolean"


def _tested(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of rows of 256 counts: size, occupied values, odd values, values 255, and chi-square over value pairs; p is 0 for a constant row."""
    even, both = counts[:, 0::2], counts[:, 0::2] + counts[:, 1::2]
    used = both >= 2
    half = np.where(used, both, 2) / 2
    chi2, df, bins = np.where(used, (even - half) ** 2 / half, 0.0).sum(1), used.sum(1) - 1, (counts > 0).sum(1)
    p = np.where(bins <= 1, 0.0, chi_square_tails(chi2, df))
    return {"n": counts.sum(1), "bins": bins, "odd": counts[:, 1::2].sum(1), "full": counts[:, 255], "chi2": chi2, "df": df, "p": p, "constant": bins <= 1}


def _tests(images: DataFrame, id_col: str, data: Column, name: str, parts: int, count) -> DataFrame:
    """(id, name, statistics) of the ``parts`` rows of counts that ``count`` makes of each image, in one pass and without a shuffle."""
    rows = images.select(F.col(id_col).alias("id"), data.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in _parts(batches, max(1, min(IMAGES, TESTED_ROWS // parts))):
            made = [count(np.frombuffer(raw, np.uint8)) for raw in held]
            some = [k for k, c in enumerate(made) if c is not None]
            if some:
                told = _tested(np.concatenate([made[k] for k in some]))
                told = {k: v.astype(np.int32) if k in ("bins", "df") else v for k, v in told.items()}
                yield _batch(ids.take(pa.array(np.repeat(some, parts))), **{name: np.tile(np.arange(parts, dtype=np.int32), len(some))}, **told)

    kind = images.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {name} int, {TESTED}").withColumnRenamed("id", id_col)


def channel_tests(images: DataFrame, id_col: str, data: Column, channels: int = 4) -> DataFrame:
    """(id, channel, n, bins, odd, full, chi2, df, p, constant) of each channel; images without a pixel give nothing."""

    def count(flat: np.ndarray):
        n = len(flat) // channels
        return np.stack([np.bincount(flat[c : n * channels : channels], minlength=256) for c in range(channels)]) if n else None

    return _tests(images, id_col, data, "channel", channels, count)


def segment_tests(images: DataFrame, id_col: str, data: Column, segments: int = 64) -> DataFrame:
    """(id, seg, statistics), red, green and blue pooled; images with fewer pixels than segments give nothing."""

    def count(flat: np.ndarray):
        n = len(flat) // 4
        if n < segments:
            return None
        seg = np.arange(n) * segments // n
        return np.bincount((seg[:, None] * 256 + flat[: 4 * n].reshape(-1, 4)[:, :3]).ravel(), minlength=256 * segments).reshape(segments, 256)

    return _tests(images, id_col, data, "seg", segments, count)


def channel_verdicts(images: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, has_alpha, max_p, verdict, ratios, counts): the greatest p of an image's channels, and of each channel the share of odd values and (odd, n) that make it.

    Red, green and blue count, and alpha if one of its values is not 255; constant
    channels have p 0.  Images without a pixel have no row.
    """
    seen = channel_tests(images, id_col, data).filter("channel < 3 or full < n")
    told = seen.groupBy(id_col).agg(
        F.bool_or(F.col("channel") == 3).alias("has_alpha"), F.max("p").alias("max_p"),
        F.transform(F.sort_array(F.collect_list(F.struct("channel", "odd", "n"))), lambda x: F.struct(x["odd"].alias("odd"), x["n"].alias("n"))).alias("counts"),
    )
    return told.select(id_col, "has_alpha", "max_p", verdict(F.col("max_p")).alias("verdict"), F.transform("counts", lambda x: x["odd"] / x["n"]).alias("ratios"), "counts")


def verdict(p: Column) -> Column:
    return F.when(p >= 0.9, "likely").when(p >= 0.3, "possible").otherwise("unlikely")


def extract_bits(images: DataFrame, id_col: str, data: Column, width: Column, channels: str = "rgb", bit: int = 0, msb: bool = True, columns: bool = False, preview: int = 4096) -> DataFrame:
    """(id, bytes, total): one bit of each named channel, packed; total counts whole bytes, a preview of 0 gives total 0."""
    at = ["rgba".index(c) for c in channels]
    rows = images.select(F.col(id_col).alias("id"), data.alias("data"), width.cast("int").alias("w"))

    def run(batches):
        for b in batches:
            out = []
            for raw, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                flat = np.frombuffer(raw or b"", np.uint8)
                h = len(flat) // 4 // w if w and w > 0 else 0
                px = flat[: 4 * w * h].reshape(h, w, 4) if h else np.zeros((0, 1, 4), np.uint8)
                px = px.transpose(1, 0, 2) if columns else px
                bits = (px[:, :, at] >> bit & 1).ravel()
                total = len(bits) // 8
                bits = bits[: 8 * min(total, preview)]
                out.append((np.packbits(bits, bitorder="big" if msb else "little").tobytes(), total if preview else 0))
            yield _batch(b.column(0), bytes=pa.array([x for x, _ in out], pa.binary()), total=pa.array([t for _, t in out], pa.int64()))

    kind = images.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, bytes binary, total long").withColumnRenamed("id", id_col)


def bit_plane(value: Column, bit: int) -> Column:
    return F.when(value.bitwiseAND(1 << bit) != 0, 255).otherwise(0)
