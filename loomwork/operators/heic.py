"""Metadata items of HEIC files, and the file without them.

Every change to a file is a splice: a byte range and what stands there afterwards.  Item
entries, references, associations and payloads are cut by splices; then the sizes of the
boxes around them and the places that items point to follow from the splices alone.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Unsuited(Exception):
    """The layout can't be rewritten without loss."""


class Box(NamedTuple):
    start: int
    data: int
    stop: int
    kind: bytes


class Extent(NamedTuple):
    at: int
    begin: int
    size: int


class Item(NamedTuple):
    start: int
    stop: int
    id: int
    base_at: int
    base: int
    extents: list[Extent]


def number(b: bytes, at: int, width: int) -> int:
    if at + width > len(b):
        raise ValueError("past the end")
    return int.from_bytes(b[at : at + width], "big")


def boxes(b: bytes, at: int, stop: int) -> list[Box]:
    """Boxes that fill at..stop exactly; ValueError if they do not."""
    found = []
    while at < stop:
        size, data = number(b, at, 4), at + 8
        if size == 1:
            size, data = number(b, at + 8, 8), at + 16
        end = stop if size == 0 else at + size
        if not data <= end <= stop:
            raise ValueError("box does not fit")
        found.append(Box(at, data, end, b[at + 4 : at + 8]))
        at = end
    return found


def metadata_items(b: bytes, iinf: Box) -> tuple[dict[int, str], list[Box], list[Box]]:
    """Label of each Exif or XMP item, the entries of those items, and all entries."""
    entries = [x for x in boxes(b, iinf.data + (6 if b[iinf.data] == 0 else 8), iinf.stop) if x.kind == b"infe"]
    labels, going = {}, []
    for x in entries:
        if x.stop - x.data < 12 or b[x.data] < 2:
            continue
        wide = 2 if b[x.data] == 2 else 4
        item, kind = number(b, x.data + 4, wide), b[x.data + 6 + wide : x.data + 10 + wide]
        names = b[x.data + 10 + wide : x.stop].split(b"\0")
        if kind.lower() == b"exif" and kind[1:] == b"xif":
            labels[item] = "EXIF metadata"
        elif kind == b"mime" and re.search(rb"application/rdf\+xml", names[1] if len(names) > 1 else b"", re.I):
            labels[item] = "XMP metadata"
        else:
            continue
        going.append(x)
    return labels, going, entries


def locations(b: bytes, iloc: Box) -> tuple[list[Item], tuple[int, int, int]]:
    """Items and the widths of offsets, lengths and bases."""
    version, first, second = b[iloc.data], b[iloc.data + 4], b[iloc.data + 5]
    offset, length, base_width = first >> 4, first & 15, second >> 4
    if version > 1 or offset not in (4, 8) or length not in (4, 8) or base_width not in (0, 4, 8) or (version == 1 and second & 15):
        raise Unsuited
    at, items = iloc.data + 8, []
    for _ in range(number(b, iloc.data + 6, 2)):
        start, item = at, number(b, at, 2)
        if version == 1 and number(b, at + 2, 2) & 15:
            raise Unsuited
        base_at = at + (6 if version == 1 else 4)
        base, at = number(b, base_at, base_width), base_at + base_width + 2
        extents = []
        for _ in range(number(b, at - 2, 2)):
            extents.append(Extent(at, base + number(b, at, offset), number(b, at + offset, length)))
            at += offset + length
        items.append(Item(start, at, item, base_at, base, extents))
    if at > iloc.stop:
        raise Unsuited
    return items, (offset, length, base_width)


class Splices:
    """Edits of one file, by place."""

    def __init__(self, b: bytes):
        self.b, self.edits = b, {}

    def put(self, start: int, width: int, value: int) -> None:
        if not 0 <= value < 256**width:
            raise Unsuited
        if width:
            self.edits[start, start + width] = value.to_bytes(width, "big")

    def cut(self, start: int, stop: int) -> None:
        if stop > start:
            self.edits[start, stop] = b""

    def shift(self, upto: int, since: int = 0) -> int:
        """Bytes that edits starting in since..upto add (less than 0: take)."""
        return sum(len(new) - (y - x) for (x, y), new in self.edits.items() if since <= x < upto)

    def moved(self, place: int) -> int:
        return place + self.shift(place)

    def resize(self, box: Box) -> None:
        change = self.shift(box.stop, box.data)
        wide = number(self.b, box.start, 4) == 1
        if change and number(self.b, box.start, 4):
            self.put(box.start + 8 * wide, 8 if wide else 4, box.stop - box.start + change)

    def result(self) -> bytes:
        out, at = [], 0
        for (x, y), new in sorted(self.edits.items()):
            out += [self.b[at:x], new]
            at = y
        return b"".join([*out, self.b[at:]])


def _cut_references(b: bytes, iref: Box, gone: dict, s: Splices) -> None:
    wide = 2 if b[iref.data] == 0 else 4
    refs, dropped = boxes(b, iref.data + 4, iref.stop), []
    for r in refs:
        count = number(b, r.data + wide, 2)
        first = r.data + wide + 2
        if first + wide * count > r.stop:
            raise ValueError("references past their box")
        lost = [k for k in range(count) if number(b, first + wide * k, wide) in gone]
        if number(b, r.data, wide) in gone or len(lost) == count:
            dropped.append(r)
        elif lost:
            for k in lost:
                s.cut(first + wide * k, first + wide * (k + 1))
            s.put(r.data + wide, 2, count - len(lost))
            s.resize(r)
    if len(dropped) == len(refs):
        s.cut(iref.start, iref.stop)
        return
    for r in dropped:
        s.cut(r.start, r.stop)
    s.resize(iref)


def _cut_associations(b: bytes, ipma: Box, gone: dict, s: Splices) -> None:
    wide, each = 2 if b[ipma.data] == 0 else 4, 2 if b[ipma.data + 3] & 1 else 1
    count, at, lost = number(b, ipma.data + 4, 4), ipma.data + 8, 0
    for _ in range(count):
        stop = at + wide + 1 + each * number(b, at + wide, 1)
        if stop > ipma.stop:
            raise ValueError("associations past their box")
        if number(b, at, wide) in gone:
            s.cut(at, stop)
            lost += 1
        at = stop
    if lost:
        s.put(ipma.data + 4, 4, count - lost)
        s.resize(ipma)


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def tiff_place(payload: bytes) -> int | None:
    """Where the TIFF header of an Exif item's payload is."""
    if payload[:2] in (b"MM", b"II"):
        return 0
    if payload[:6] == b"Exif\0\0":
        return 6
    at = 4 + int.from_bytes(payload[:4], "big")
    return at if 4 <= len(payload) and at + 4 <= len(payload) else None


def _one(children: list[Box], kind: bytes) -> Box | None:
    return next((x for x in reversed(children) if x.kind == kind), None)


def heic_without_metadata(b: bytes) -> tuple[list[tuple[str, int]], bytes | None, bytes]:
    """(label and bytes of each metadata item, the first Exif payload, the file without them).

    ValueError if the file is broken, Unsuited if it can't be rewritten.  A file without
    such items comes back as it is, whatever its layout.
    """
    tops = boxes(b, 0, len(b))
    meta = next((x for x in tops if x.kind == b"meta"), None)
    if meta is None:
        raise ValueError("no meta box")
    children = boxes(b, meta.data + 4, meta.stop)
    iloc, iinf, iref = (_one(children, k) for k in (b"iloc", b"iinf", b"iref"))
    if iloc is None or iinf is None or min(iloc.stop - iloc.data, iinf.stop - iinf.data) < 6:
        raise ValueError("no item tables")
    gone, entries, listed = metadata_items(b, iinf)
    if not gone:
        return [], None, b
    if any(x.kind == b"moov" for x in tops) or any(x.kind == b"grpl" for x in children):
        raise Unsuited
    try:
        return _rewritten(b, tops, meta, children, iloc, iinf, iref, gone, entries, len(listed))
    except (ValueError, IndexError) as broken:  # tables that can't be read can't be rewritten
        raise Unsuited from broken


def _rewritten(b, tops, meta, children, iloc, iinf, iref, gone, entries, listed):
    items, (offset, _, base_width) = locations(b, iloc)
    pitm = _one(children, b"pitm")
    if pitm and number(b, pitm.data + 4, 2 if b[pitm.data] == 0 else 4) in gone:
        raise Unsuited
    mdats = [x for x in tops if x.kind == b"mdat"]
    place = {x.id: x for x in items}
    kept = [x for x in items if x.id not in gone]
    if not kept or gone.keys() - place.keys():
        raise Unsuited
    payloads = [(e.begin, e.begin + e.size) for i in gone for e in place[i].extents]
    removed = union(payloads)
    if any(not any(m.data <= x and y <= m.stop for m in mdats) for x, y in payloads):
        raise Unsuited
    for item in kept:
        # metadata is cut before offsets are re-based, so items must lie behind the tables and apart from what goes
        if any(e.begin < meta.stop or any(e.begin < y and x < e.begin + e.size for x, y in removed) for e in item.extents) or (base_width and item.base < meta.stop):
            raise Unsuited
    s = Splices(b)
    for x in entries:
        s.cut(x.start, x.stop)
    s.put(iinf.data + 4, 2 if b[iinf.data] == 0 else 4, listed - len(entries))
    s.resize(iinf)
    for x in items:
        if x.id in gone:
            s.cut(x.start, x.stop)
    s.put(iloc.data + 6, 2, len(kept))
    s.resize(iloc)
    if iref:
        _cut_references(b, iref, gone, s)
    for box in children:
        if box.kind == b"ipma":
            _cut_associations(b, box, gone, s)
        elif box.kind == b"iprp":
            for x in boxes(b, box.data, box.stop):
                if x.kind == b"ipma":
                    _cut_associations(b, x, gone, s)
            s.resize(box)
    s.resize(meta)
    for x, y in removed:
        for m in mdats:  # a union can span the seam of two payloads only if a header is inside, which no extent holds
            s.cut(max(x, m.data), min(y, m.stop))
    for m in mdats:
        s.resize(m)
    for item in kept:
        base = s.moved(item.base) if base_width else 0
        s.put(item.base_at, base_width, base)
        for e in item.extents:
            s.put(e.at, offset, s.moved(e.begin) - base)
    out = s.result()
    _verify(b, out, kept)
    exif = next((place[i] for i, label in gone.items() if label == "EXIF metadata" and len(place[i].extents) == 1), None)
    payload = b[exif.extents[0].begin : exif.extents[0].begin + exif.extents[0].size] if exif else None
    return [(label, sum(e.size for e in place[i].extents)) for i, label in sorted(gone.items())], payload, out


def _verify(before: bytes, after: bytes, kept: list[Item]) -> None:
    """Every item that stays must have the bytes that it had."""
    meta = next(x for x in boxes(after, 0, len(after)) if x.kind == b"meta")
    items, _ = locations(after, _one(boxes(after, meta.data + 4, meta.stop), b"iloc"))
    held = lambda b, found: [(x.id, [b[e.begin : e.begin + e.size] if e.begin + e.size <= len(b) else None for e in x.extents]) for x in found]
    then, now = held(before, kept), held(after, items)
    if then != now or any(None in parts for _, parts in now):
        raise Unsuited
