"""WARC archives: one gzip member a record, read in sequence.

The reader inflates a stream piece by piece, finds each member's end, frames the block
by Content-Length and verifies block and payload digests.  Files go to and come from any
store that pyarrow.fs opens; a manifest table names the files of the attempts that count,
so a task that ran twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import integer_ids, scratch, shuffle_width, stash, with_row_key

#: Bytes after which a writer begins another file, bytes read from a file at once.
FILE_BYTES, READ_BYTES = 256 << 20, 1 << 18
#: Copies of a repeated payload's entry, so that the rows of one payload meet it in many tasks.
SALTS = 32
RECORD = "record_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, verified boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None, row: str = "") -> str:
    return f"<urn:loomwork:row:{row}>" if page_id is None else f"<urn:loomwork:page:{page_id}>"


def _page(uri: str) -> int | None:
    """The id that _uri() wrote, null for a row without one."""
    kind, _, number = uri.strip("<>").removeprefix("urn:loomwork:").partition(":")
    return int(number) if kind == "page" else None


def record(page_id: int | None, uri: str | None, payload: bytes, payload_digest: str, refers_to: int | None, row: str = "") -> bytes:
    """One record: header, block, two line ends.  A revisit has no block; its digest and length are of the full payload."""
    block = payload if refers_to is None else b""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _uri(page_id, row)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((uri or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head[4:4] = [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The inflated content of each gzip member; a cut-off member is an error."""
    data, inflate, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        inflate = inflate or zlib.decompressobj(wbits=31)
        parts.append(inflate.decompress(data))
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = None, []
    if inflate is not None:
        raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    return fields, rest[:size]


def read_file(uri: str) -> Iterator[tuple]:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path, compression=None) as stream:
        for raw in members(stream):
            f, block = parse(raw)
            stated = f["warc-payload-digest"].removeprefix("sha1:")
            good = f["warc-block-digest"].removeprefix("sha1:") == digest(block)
            if f["warc-type"] == "response":
                good = good and stated == digest(block) and int(f["x-payload-length"]) == len(block)
            refers = f.get("warc-refers-to")
            yield _page(f["warc-record-id"]), f["warc-type"], _page(refers) if refers else None, f["warc-target-uri"], int(f["x-payload-length"]), stated, good


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", payload: Column | None = None, uri: Column | None = None, min_bytes: int = 0, stable: bool = False) -> DataFrame:
    """Write a record for each row below ``path`` and return the manifest (uri, records, bytes).

    Of rows with equal payloads (SHA-256) of at least ``min_bytes``, that with the smallest
    id is the response and the others revisit it; of rows that repeat an id and a payload,
    one is the response.  Null payloads count as empty.  Ids are integers; rows with null ids are responses,
    which nothing revisits.  Other columns of df are not read, whatever their names.  df
    is read twice, so what is read of it is written to the shared folder first unless
    ``stable`` says that it is a plain scan of Parquet files.
    """
    integer_ids(df, id_col)
    payload = F.coalesce(F.encode("html", "UTF-8") if payload is None else payload, F.lit(b""))
    taken = df.select(F.col(id_col).cast("long").alias("id"), (F.col("url") if uri is None else uri).alias("uri"), payload.alias("data"))
    rows = with_row_key(taken, "row", stable).withColumn("sha", F.sha2("data", 256))
    # where the first row of each repeated payload is: the payloads themselves stay
    first = rows.filter((F.octet_length("data") >= min_bytes) & F.col("id").isNotNull()).groupBy("sha").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("sha").alias("sha_"), F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, (F.col("sha") == F.col("sha_")) & (F.col("salt") == F.col("salt_")) & (F.octet_length("data") >= min_bytes) & F.col("id").isNotNull(), "left")
    refers = F.when(F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row")), F.col("first_id"))
    ready = joined.select("id", "row", "uri", "data", refers.alias("refers"))

    told = lambda *row: pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["uri", "records", "bytes"])

    def run(batches):
        out, where, size, count, uri_ = None, None, 0, 0, ""
        for b in batches:
            for i, row, u, data, ref in ([c[k].as_py() for c in b.columns] for k in range(b.num_rows)):
                if out is None:
                    uri_ = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    where, local = fs.FileSystem.from_uri(uri_)
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(local, compression=None)
                pack = zlib.compressobj(wbits=31)
                raw = record(i, u, data, digest(data), ref, row.hex())
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield told(uri_, count, size)
                    out, size, count = None, 0, 0
        if out is not None:
            out.close()
            yield told(uri_, count, size)

    return stash(ready.mapInArrow(run, "uri string, records long, bytes long"), "manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of the archives in ``manifest.uri``: (record_id, record_type, refers_to, target_uri, payload_bytes, payload_digest, verified).

    Null uris name no archive; an archive that is missing, cut off or badly framed is an
    error; one named twice is read twice.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.split(" ") for x in RECORD.split(", ")))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*held), types)], names=names)

    def run(batches):
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            held = []
            for r in read_file(uri):
                held.append(r)
                if len(held) == 5_000:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)

    spark = manifest.sparkSession
    return manifest.select("uri").filter("uri is not null").repartition(4 * shuffle_width(spark)).mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, stable: bool = False) -> DataFrame:
    """Write pages to archives in the shared folder and read them back; a digest that fails is an error."""
    manifest = write_warc(pages, scratch(pages.sparkSession, "warc"), min_bytes=min_bytes, stable=stable)
    back = read_warc(manifest).filter(F.assert_true("verified", "a digest does not fit its record").isNull())
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
