"""Sizes that image files declare, read before anything is decoded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.binary import is_heif, starts

# Depth of nested boxes that is read, the pixel limit, and bytes before the children of a box.
DEPTH, PIXELS = 6, 64_000_000
CHILDREN_AFTER = {b"meta": 4, b"iprp": 0, b"ipco": 0}


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def heif_planes(b: bytes) -> Iterator[int]:
    """Pixels of each spatial-extent box. A box that does not fit ends its own level only."""
    levels = [(0, len(b), 0)]
    while levels:
        at, stop, depth = levels.pop()
        while at + 8 <= stop:
            size, data = _u32(b, at), at + 8
            if size == 1:
                size, data = int.from_bytes(b[at + 8 : at + 16], "big"), at + 16
                if size >= 2**32 or data > stop:
                    break
            end = at + size if size else stop
            if not data <= end <= stop:
                break
            kind = b[at + 4 : at + 8]
            if kind == b"ispe" and end - data >= 12:
                yield _u32(b, data + 4) * _u32(b, data + 8)
            elif kind in CHILDREN_AFTER and depth < DEPTH:
                levels.append((data + CHILDREN_AFTER[kind], end, depth + 1))
            at = end


def png_planes(b: bytes) -> list[int]:
    """Pixels of the header and of each animation frame; none if a chunk does not fit or the header is not first."""
    if len(b) < 33 or b[8:16] != b"\0\0\0\rIHDR" or not _u32(b, 16) * _u32(b, 20):
        return []
    found, at, kind = [_u32(b, 16) * _u32(b, 20)], 8, b""
    while kind != b"IEND" and at + 8 <= len(b):
        size, kind = _u32(b, at), b[at + 4 : at + 8]
        if size >= 2**31 or at + 12 + size > len(b):
            return []
        if kind == b"fcTL" and size >= 12:
            found.append(_u32(b, at + 12) * _u32(b, at + 16))
        at += 12 + size
    return found


def _largest(kinds: pd.Series, contents: pd.Series) -> pd.Series:
    read = {"heif": heif_planes, "png": png_planes}
    return pd.Series([min(max(read[k](bytes(c)), default=0), 2**63 - 1) if k in read else None for k, c in zip(kinds, contents)], dtype="Int64")


def declared(df: DataFrame, content_col: str = "content", limit: int = PIXELS) -> DataFrame:
    """df with declared_pixels (the largest plane; 0 if none is found) and allowed.

    HEIF and PNG only: other content, null too, has null in both.  Nothing declared is not
    allowed.  Products beyond a long become its largest value.  Rows repeat as they are.
    """
    content = F.coalesce(F.col(content_col), F.lit(b""))
    kind: Column = F.when(starts(content, "89504e470d0a1a0a"), "png").when(is_heif(content), "heif")
    pixels = F.pandas_udf(_largest, "long")(kind, content)
    return df.withColumn("declared_pixels", pixels).withColumn("allowed", F.col("declared_pixels").between(1, limit))
