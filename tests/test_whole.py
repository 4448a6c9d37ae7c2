"""Registered queries do the whole job: their rows against brute force, without limits of their own."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.operators import pixels
from loomwork.plans import table_queries as Q

TEXTS = [None, "", "short", "é" * 20, "The quick brown fox. " * 40, "".join(chr(32 + k * k % 90) for k in range(127 * 4 + 3)), "ab c" * 6000]


def tables(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"u{k}", t) for k, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def chi(values):
    """Chi-square and degrees of freedom over value pairs."""
    cnt = np.bincount(values, minlength=256).reshape(-1, 2)
    e = cnt.sum(1) / 2
    return sum((cnt[e >= 1, 0] - e[e >= 1]) ** 2 / e[e >= 1]), int((e >= 1).sum()) - 1


def test_segments(spark, tmp_path):
    got = {(r.doc_id, r.seg): r for r in Q.segment_stats(spark, tables(spark, tmp_path)).collect()}
    want = 0
    for k, text in enumerate(TEXTS):
        data = (text or "").encode()
        n = len(data) // 4
        parts = [[] for _ in range(64)]
        for i in range(n if n >= 64 else 0):
            parts[min(int(i / (n / 64)), 63)] += data[4 * i : 4 * i + 3]
        for seg, values in enumerate(parts if n >= 64 else []):
            r, (chi2, df) = got[k, seg], chi(values)
            assert (r.n, r.bins, r.df) == (len(values), len(set(values)), df) and abs(r.chi2 - chi2) < 1e-5
            assert 0 <= r.p <= 1 and (r.p == 0 if df <= 0 else r.p == 1 if chi2 == 0 else True)
            if df == 2:
                assert abs(r.p - np.exp(-chi2 / 2)) < 1e-6
            want += 1
    assert len(got) == want and max(r.n for (k, _), r in got.items() if k == 5) == 6


def test_bits(spark, tmp_path):
    got = {r.doc_id: r for r in Q.bits(spark, tables(spark, tmp_path)).collect()}
    for k, text in enumerate(TEXTS):
        data = (text or "").encode()
        n = len(data) // 32 * 8
        bits = "".join(str(data[4 * i + c] & 1) for i in range(n) for c in range(3))
        whole = bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits) // 8 * 8, 8))
        assert got[k].bits == whole[:4096].hex().upper() and got[k].total == len(whole)


def test_dump(spark, tmp_path):
    """Whole pages that begin with each signature in turn, by the md5 of the whole dump."""
    got = {r.page_id: r for r in Q.sniff(spark, tables(spark, tmp_path)).collect()}
    for k, text in enumerate(TEXTS):
        lead, kind, image = Q.LEADS[k % len(Q.LEADS)]
        data, lines = bytes.fromhex(lead) + (text or "").encode(), []
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            half = lambda b: "".join(f"{v:02x} " for v in b).ljust(24)
            lines.append(f"{at:08x}  {half(part[:8])} {half(part[8:])} " + "".join(chr(v) if 32 <= v <= 126 else "." for v in part))
        assert (got[k].kind, got[k].image, got[k].dump) == (kind, image, hashlib.md5("\n".join(lines).encode()).hexdigest())


def test_checksums(spark, tmp_path):
    got = {(r.kind, r.id): r.crc for r in Q.checksums(spark, tables(spark, tmp_path)).collect()}
    assert got == {(kind, k): None if t is None else zlib.crc32(t.encode()) for kind in ("document", "page") for k, t in enumerate(TEXTS)}


def test_counts_held_at_once_are_few():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([b"x"] * 600)], names=["id", "data"])
    assert [len(held) for _, held in pixels._parts(iter([batch]), pixels.TESTED_ROWS // 64)] == [32] * 18 + [24]
