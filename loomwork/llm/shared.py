"""What the operators share: the library's helpers for tables in the shared folder, words, values named once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.shared import alike_scans, arrow_batches, discard, free_name, scratch, shared_dir, shuffle_width, stash, table, with_row_key

__all__ = ["WORD_PATTERN", "alike_scans", "arrow_batches", "discard", "free_name", "let", "scratch", "shared_dir", "shuffle_width", "stash", "table", "with_row_key"]

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def integer_ids(df: DataFrame, id_col: str) -> None:
    """An error unless the ids are integers: texts of other kinds of id are numbered first, with a table of their own."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{id_col} is of type {kind.simpleString()}: ids must be integers")
