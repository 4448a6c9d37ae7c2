"""Parts of image files as rows: table functions that are joined laterally.

Each function reads one file's tables and yields a row for each entry with its place, so
keep rules, totals, lookups and anti-joins are plain SQL over rows.  A file that cannot
be read yields one row with ``error`` and nulls.  Results carry the columns that name a
file, not its content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.operators import containers, heic
from loomwork.operators.heic import Unsuited, boxes, number

#: Bytes of a part that tell what it is.
HEAD = 40


class _Parts:
    def eval(self, kind: str, content: bytes) -> Iterator[tuple]:
        b = bytes(content or b"")
        found = containers._SCANNERS[kind](b) if kind in containers._SCANNERS else None
        if found is None:
            yield None, None, None, None, None, None, "corrupt" if kind in containers._SCANNERS else "unsupported"
            return
        parts, tail = found
        for k, (start, stop, tag, data) in enumerate(parts):
            yield k, start, stop, tag, data, b[data : min(stop, data + HEAD)], None
        if tail:
            yield len(parts), len(b) - tail, len(b), "tail", len(b) - tail, b"", None


@lru_cache(maxsize=1)  # the readers of one file's tables follow each other
def _tables(b: bytes) -> tuple[list, heic.Box, list, dict]:
    """Top boxes, the meta box, its children, and of each kind of child the last."""
    tops = boxes(b, 0, len(b))
    meta = next((x for x in tops if x.kind == b"meta"), None)
    if meta is None:
        raise ValueError("no meta box")
    children = boxes(b, meta.data + 4, meta.stop)
    return tops, meta, children, {x.kind: x for x in children}


class _HeifTable:
    """Rows of one table of a HEIF file; a broken file is ``corrupt``, an odd table ``layout``."""

    width = 0

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            rows = list(self.rows(bytes(content or b"")))
        except Unsuited:
            rows = [(*[None] * self.width, "layout")]
        except (ValueError, IndexError):
            rows = [(*[None] * self.width, "corrupt")]
        yield from rows


class _Boxes(_HeifTable):
    width = 9

    def rows(self, b: bytes) -> Iterator[tuple]:
        tops, meta, children, _ = _tables(b)
        ord_, queue = 0, [(x, 0, None) for x in tops]
        while queue:
            box, depth, up = queue.pop(0)
            yield ord_, depth, up, box.start, box.data, box.stop, box.kind.decode("latin-1"), number(b, box.start, 4) == 1, number(b, box.start, 4) != 0, None
            inner = children if box == meta and depth == 0 else boxes(b, box.data, box.stop) if box.kind == b"iprp" and depth == 1 else boxes(b, box.data + 4, box.stop) if box.kind == b"iref" and depth == 1 else []
            queue += [(x, depth + 1, ord_) for x in inner]
            ord_ += 1


class _Items(_HeifTable):
    width = 7

    def rows(self, b: bytes) -> Iterator[tuple]:
        *_, last = _tables(b)
        iinf, pitm = last[b"iinf"] if b"iinf" in last else None, last.get(b"pitm")
        if iinf is None or b"iloc" not in last or min(iinf.stop - iinf.data, last[b"iloc"].stop - last[b"iloc"].data) < 6:
            raise ValueError("no item tables")
        labels, going, entries = heic.metadata_items(b, iinf)
        primary = number(b, pitm.data + 4, 2 if b[pitm.data] == 0 else 4) if pitm else None
        for k, x in enumerate(entries):
            known = x.stop - x.data >= 12 and b[x.data] >= 2
            item = number(b, x.data + 4, 2 if b[x.data] == 2 else 4) if known else None
            yield k, item, labels.get(item) if x in going else None, x.start, x.stop, item is not None and item == primary, 2 if b[iinf.data] == 0 else 4, None


class _Extents(_HeifTable):
    width = 12

    def rows(self, b: bytes) -> Iterator[tuple]:
        *_, last = _tables(b)
        try:
            items, (offset, _, base) = heic.locations(b, last[b"iloc"])
        except (ValueError, IndexError) as broken:
            raise Unsuited from broken
        for k, x in enumerate(items):
            for j, e in enumerate(x.extents or [None]):
                place = (j, e.at, e.begin, e.size) if e else (None,) * 4
                yield k, x.id, x.start, x.stop, x.base_at, x.base, base, offset, *place, None


class _References(_HeifTable):
    width = 8

    def rows(self, b: bytes) -> Iterator[tuple]:
        *_, last = _tables(b)
        iref = last.get(b"iref")
        if iref is None:
            return
        wide = 2 if b[iref.data] == 0 else 4
        for k, r in enumerate(boxes(b, iref.data + 4, iref.stop)):
            first, count = r.data + wide + 2, number(b, r.data + wide, 2)
            if first + wide * count > r.stop:
                raise Unsuited
            if not count:
                yield k, r.start, r.stop, r.kind.decode("latin-1"), number(b, r.data, wide), None, None, wide, None
            for j in range(count):
                yield k, r.start, r.stop, r.kind.decode("latin-1"), number(b, r.data, wide), number(b, first + wide * j, wide), j, wide, None


class _Associations(_HeifTable):
    width = 5

    def rows(self, b: bytes) -> Iterator[tuple]:
        _, _, children, _ = _tables(b)
        inside = [x for c in children for x in (boxes(b, c.data, c.stop) if c.kind == b"iprp" else [c]) if x.kind == b"ipma"]
        for box in inside:
            wide, each = 2 if b[box.data] == 0 else 4, 2 if b[box.data + 3] & 1 else 1
            at = box.data + 8
            for _ in range(number(b, box.data + 4, 4)):
                stop = at + wide + 1 + each * number(b, at + wide, 1)
                if stop > box.stop:
                    raise Unsuited
                yield box.start, number(b, at, wide), number(b, at + wide, 1), at, stop, None
                at = stop


#: Columns of the tables of a HEIF file.
HEIF = {
    "boxes": "ord int, depth int, up int, start long, data long, stop long, kind string, wide boolean, sized boolean, error string",
    "items": "ord int, item long, label string, start long, stop long, is_primary boolean, count_width int, error string",
    "extents": "ord int, item long, start long, stop long, base_at long, base long, base_width int, offset_width int, extent int, at long, begin long, size long, error string",
    "references": "ref int, start long, stop long, kind string, from_item long, to_item long, slot int, width int, error string",
    "associations": "box long, item long, properties int, start long, stop long, error string",
}
_READERS = {"boxes": _Boxes, "items": _Items, "extents": _Extents, "references": _References, "associations": _Associations}


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_STRUCTS = {name: pa.struct([(column, _ARROW[kind]) for column, kind in (c.split() for c in columns.split(", "))]) for name, columns in HEIF.items()}


def _structs(rows: list[tuple], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(rows, kind)
    except OverflowError:  # places beyond 63 bits are null
        return pa.array([tuple(None if type(x) is int and x >> 63 else x for x in row) for row in rows], kind)


def _read(batches: Iterator[pa.RecordBatch], tables: list[str], id_col: str) -> Iterator[pa.RecordBatch]:
    """Of a batch of files the rows of each table."""
    for b in batches:
        found = {name: ([], [], [], []) for name in tables}
        for k, content in enumerate(b.column(1).to_pylist()):
            content = content or b""
            for name in tables:
                file, rows, fits, sha = found[name]
                for row in _READERS[name]().eval(content):
                    *_, begin, size, _ = row if name == "extents" else (None,) * 3
                    inside = None if begin is None else begin + size <= len(content)
                    file.append(k), rows.append(row), fits.append(inside)
                    sha.append(hashlib.sha256(memoryview(content)[begin : begin + size]).hexdigest() if inside else None)
        for name, (file, rows, fits, sha) in found.items():
            structs = [_structs(rows, _STRUCTS[n]) if n == name else pa.nulls(len(rows), _STRUCTS[n]) for n in tables]
            columns = [b.column(0).take(pa.array(file, pa.int64())), pa.array([name] * len(rows), pa.string()), *structs, pa.array(fits, pa.bool_()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "tbl", *tables, "fits", "sha"])


container_parts = F.udtf(_Parts, returnType="ord int, start long, stop long, tag string, data long, head binary, error string")
heif_boxes, heif_items, heif_extents, heif_references, heif_associations = (F.udtf(reader, returnType=HEIF[name]) for name, reader in _READERS.items())
#: Names under which they can be registered for SQL (register_all).
FUNCTIONS = {"container_parts": container_parts, "heif_boxes": heif_boxes, "heif_items": heif_items, "heif_extents": heif_extents, "heif_references": heif_references, "heif_associations": heif_associations}


def register_all(spark) -> None:
    """Make the table functions known to SQL: SELECT ... FROM files, LATERAL heif_items(content)."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def rows_of(files: DataFrame, function, id_col: str, *args: str) -> DataFrame:
    """(id, the function's columns) of each file, joined laterally; a file without rows has none."""
    slim = files.select(id_col, *[a for a in args if a != id_col])
    return slim.lateralJoin(function(*[F.col(a).outer() for a in args])).drop(*[a for a in args if a != id_col])


def heif_rows(files: DataFrame, id_col: str, content_col: str = "content", tables: tuple[str, ...] = tuple(HEIF)) -> DataFrame:
    """(id, tbl, a struct for each table, fits, sha): rows of some tables of HEIF files by one reading of each file.

    A row's struct is that of its table, the others are null.  ``fits`` says of an extent
    whether it lies inside the file, ``sha`` is then the SHA-256 of its bytes: taken here,
    where the content is at hand, so that comparing extents shuffles no content.
    """
    names = [f"{name} struct<{re.sub('(?<=[a-z]) (?=[a-z])', ':', HEIF[name])}>" for name in tables]
    schema = StructType([files.schema[id_col], *StructType.fromDDL(f"tbl string, {', '.join(names)}, fits boolean, sha string").fields])
    return files.select(id_col, content_col).mapInArrow(lambda batches: _read(batches, list(tables), id_col), schema)


def labelled_parts(files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """(id, kind, ord, start, stop, tag, label, detail) of each part of JPEG, PNG and WebP files; label says why it goes, null if it stays.

    The keep rules are those of containers.clean().  Files that cannot be read have one row of nulls but for kind and error.
    """
    known = files.select(id_col, F.col(content_col).alias("content")).withColumn("kind", containers.container_kind(F.coalesce("content", F.lit(b""))))
    rows = known.lateralJoin(container_parts(F.col("kind").outer(), F.col("content").outer())).drop("content")
    part = F.struct(F.lit(0).alias("start"), (F.col("stop") - F.col("data")).alias("stop"), "tag", F.lit(0).alias("data"))
    label = F.when(F.col("tag") == "tail", "Data after image end").when(F.col("tag").isNotNull(), containers._label(F.col("kind"), part, F.col("head")))
    told = rows.withColumn("label", label)
    return told.withColumn("detail", F.when(F.col("tag") != "tail", containers._detail(F.col("kind"), part, F.col("head"), F.col("label")))).drop("data", "head")


def stripped_totals(parts: DataFrame, id_col: str) -> DataFrame:
    """(id, parts, removed, labels): of labelled_parts(), how many there are, the bytes that go, and the labels of what goes in order."""
    gone = F.col("label").isNotNull()
    labels = F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("ord", "label")))), lambda x: x["label"])
    return parts.groupBy(id_col).agg(F.count("ord").alias("parts"), F.sum(F.when(gone, F.col("stop") - F.col("start")).otherwise(0)).alias("removed"), F.array_join(labels, "; ").alias("labels"))


def _be(value: Column, width: Column | int) -> Column:
    return F.lpad(F.hex(value.cast("long")), F.lit(2) * (F.lit(width) if isinstance(width, int) else width), "0")
