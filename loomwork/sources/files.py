"""Whole files as rows, and rows as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shared import stash

#: Bytes of a file that is read: those of a metadata clean.
MAX_BYTES = 256 << 20
#: Settings while many small files are scanned: a file counts as 32 KB beside its bytes (4 MB by default, 32 files a task), so up to 2,000 share a task.
MANY = {"spark.sql.files.openCostInBytes": str(32 << 10), "spark.sql.files.maxPartitionBytes": str(64 << 20)}


def scan(spark: SparkSession, path: str | list[str], glob: str | None = None, most: int = MAX_BYTES) -> DataFrame:
    """(path, length, error_code, content) of every file below path that is not empty, whole.

    A file over ``most`` bytes has error_code 'big' and null content; its bytes are not
    read, since the length comes from the listing.  Directories are searched in depth.
    Where files are small and many, read the result with the settings MANY.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    read = read.option("pathGlobFilter", glob) if glob else read
    files = read.load(path)
    small = files.filter(F.col("length") <= most).select("path", "length", F.lit(None).cast("string").alias("error_code"), "content")
    large = files.filter(F.col("length") > most).select("path", "length", F.lit("big").alias("error_code"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def write(files: DataFrame, path: str, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """Write each row's content as a file below path and return (name, length) of what was written.

    Names are single path parts and unlike each other; null content is an empty file.  A
    task that runs twice writes the same files.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file's name: {name}")
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "length"])

    return stash(files.select(F.col(name_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(run, "name string, length long"), "written")
