"""Image files by their headers: a data source that reads ranges of files, never a file whole."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwork.functions.binary import image_kind, is_heif, starts
from loomwork.operators.guards import PIXELS, heif_planes, png_planes

#: Bytes that are read of every file; what opening a file counts beside them, and what a partition should count.
HEAD, OPENING, PARTITION = 512, 1 << 16, 64 << 20


class Ranges:
    """A file that is sliced like bytes; the head is read once, any other slice when it is asked for."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.head = file.read_at(min(size, HEAD), 0)
        self.read = len(self.head)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        at, stop, _ = part.indices(self.size)
        if stop <= len(self.head) or stop <= at:
            return self.head[at:stop]
        data = self.file.read_at(stop - at, at)
        self.read += len(data)
        return data


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class ImageHeaders(DataSource):
    """path (a folder, searched in depth, of any store that pyarrow.fs opens) and ending, if only some files count."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, length long, head binary, largest_plane long, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.ending = options["path"], options.get("ending", "")

    def partitions(self) -> list[Listed]:
        """Files in the order of their names, dealt by what reading them counts."""
        store, path = fs.FileSystem.from_uri(self.uri)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(self.ending) and not f.base_name.startswith(("_", ".")))
        parts, held, load = [], [], 0
        for name, size in found:
            held.append((name, size))
            load += OPENING + min(size, HEAD)
            if load >= PARTITION:
                parts.append(Listed(held))
                held, load = [], 0
        return [*parts, Listed(held)] if held or not parts else parts

    def read(self, partition: Listed) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for name, size in partition.files:
            with store.open_input_file(name) as file:
                b = Ranges(file, size)
                planes = png_planes(b) if b.head.startswith(b"\x89PNG\r\n\x1a\n") else heif_planes(b) if b.head[4:8] == b"ftyp" else []
                largest = min(max(planes, default=0), 2**63 - 1)
                yield name, size, b.head, largest, b.read


def image_headers(spark: SparkSession, path: str, ending: str = "", limit: int = PIXELS) -> DataFrame:
    """(path, length, kind, declared_pixels, allowed, bytes_read) of every file below path.

    kind, declared_pixels and allowed are those of image_kind() and guards.declared(), found
    from the head and from chunk and box tables: a file of any size costs some hundred
    bytes and a few for each chunk.  An empty folder gives no rows.
    """
    spark.dataSource.register(ImageHeaders)
    found = spark.read.format("image_headers").option("ending", ending).load(path)
    sized = F.when(starts(F.col("head"), "89504e470d0a1a0a") | is_heif(F.col("head")), F.col("largest_plane"))
    told = found.withColumn("kind", image_kind(F.col("head"))).withColumn("declared_pixels", sized)
    return told.select("path", "length", "kind", "declared_pixels", F.col("declared_pixels").between(1, limit).alias("allowed"), "bytes_read")
