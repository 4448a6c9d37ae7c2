import struct

from loomwork.operators import guards as G
from tests.test_containers import chunk
from tests.test_heic import box

FTYP = box(b"ftyp", b"heic\0\0\0\0mif1")


def ispe(w, h):
    return box(b"ispe", struct.pack(">III", 0, w, h))


def heif(*boxes):
    return FTYP + box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", b"".join(boxes))))


def png(w, h, *more):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", w, h) + b"\x08\x06\0\0\0") + b"".join(more) + chunk(b"IEND", b"")


def test_largest_declared_plane(spark):
    frame = chunk(b"fcTL", struct.pack(">III", 0, 9000, 9000) + b"\0" * 14)
    deep = ispe(3, 3)
    for _ in range(7):
        deep = box(b"iprp", deep)
    cases = [
        (heif(ispe(4, 5), ispe(10, 20), ispe(0, 9)), 200, True),
        (heif(ispe(4, 5), struct.pack(">I4s", 99, b"ispe")), 20, True),  # does not fit: what came before counts
        (heif(box(b"ispe", b"\0" * 8), ispe(2, 2)), 4, True),
        (heif(box(b"free", ispe(8, 8))), 0, False),
        (FTYP + deep, 0, False),
        (heif(ispe(2**32 - 1, 2**32 - 1)), 2**63 - 1, False),
        (png(8000, 8000), 64_000_000, True),
        (png(4, 4, frame), 81_000_000, False),
        (png(4, 4)[:-1], 0, False),
        (png(0, 4), 0, False),
        (b"\xff\xd8\xff\xe0", None, None),
        (b"", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, c) for k, (c, _, _) in enumerate(cases)], "k int, content binary")
    assert [(r.declared_pixels, r.allowed) for r in G.declared(df).orderBy("k").collect()] == [(p, a) for _, p, a in cases]
    assert G.declared(df.limit(0)).count() == 0
