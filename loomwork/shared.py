"""Places that every executor and the driver can reach, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only an in-process master (tests) may fall back to a temporary folder; on a cluster
    a folder of one machine would lose data, so an unset value is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        own = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(remove, spark, own)
        spark.conf.set("spark.checkpoint.dir", own)
        spark.sparkContext.setCheckpointDir(own)
        return own
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at path, if it is there."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is the cluster's scratch space
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stash(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None, group: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``by`` names a column of few values, each in files of its own, so that a filter on it reads no others.
    ``group`` gives the bytes of a row group, or one row: for rows of MBs, as a reader decodes thousands of rows of a group at once.
    The table stays until discard() or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    # sizes are looked at after each row, by default after a hundred
    groups = {"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group else {}
    with arrow_batches(spark):
        df.write.options(compression=codec, **groups).parquet(path, partitionBy=by)
    back = spark.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    return back


def with_row_key(df: DataFrame, name: str, stable: bool = False) -> DataFrame:
    """df with a column ``name`` of 16 bytes that tells its rows apart, alike at every reading.

    It comes from the file and the place in that file of a Parquet scan.  Partition numbers
    would not do: how a scan is split follows the cores that are there when it is planned,
    so a lost executor could renumber the rows between two readings.  ``stable`` says that
    df is a plain scan (columns chosen or rows filtered, at most); what isn't is written to
    the shared folder first.  A column ``name`` of df is replaced.
    """
    df = df.drop(name)
    try:
        place = df.metadataColumn("_metadata") if stable else None
    except AnalysisException:  # rows that come from no file
        place = None
    if place is None:
        df = stash(df, "rows")
        place = df.metadataColumn("_metadata")
    where = F.concat_ws(":", place.getField("file_path"), place.getField("row_index").cast("string"))
    return df.withColumn(name, F.unhex(F.md5(where)))


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more: what was made of them is itself written."""
    for df in frames:
        remove(df.sparkSession, df.stashed_at)


#: Rows and bytes of an Arrow batch, so that whole texts of a batch stay small beside a worker's memory.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches while a table is written; the session's own settings come back."""
    before = {k: spark.conf.get(k) for k in ARROW}
    for k, most in ARROW.items():
        if not 0 < int(before[k].rstrip("b")) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """These settings of the session inside, its own afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: How many partitions a scan of files has at least; by default as many as there are cores when it is planned.
SPLITS = "spark.sql.files.minPartitionNum"


@contextmanager
def alike_scans(spark: SparkSession) -> Iterator[None]:
    """Scans planned inside split their files alike, though executors come and go between them."""
    before = spark.conf.get(SPLITS, None)
    if before is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SPLITS)


def free_name(name: str, *taken: str) -> str:
    """``name``, with underscores in front until no column is called so (case does not count)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame) -> DataFrame:
    """df's rows over as many tasks as the session is wide: for tables of few bytes, one split of a scan, whose rows become much work."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
