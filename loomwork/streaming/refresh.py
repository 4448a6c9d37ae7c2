"""Refreshing a feed: attempts come in as a stream, the latest row of each match is kept as a table.

An attempt is a payload (null if it failed) that a source gave at some time.  At each
time that is due, the first source in order of preference whose payload has its list is
taken; a time at which none has leaves the table as it is and is tried again sooner.  The
table is kept in buckets of its key.  A refresh writes the buckets that it touches anew,
beside the old ones, then one commit record that names every bucket's version, so readers
see whole refreshes only, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from loomwork.shared import remove, shuffle_width
from loomwork.sources.feeds import available
from loomwork.streaming.feed import latest

#: Attempts as the stream has them.
ATTEMPT = "source string, fetched timestamp, payload string"
#: Seconds for which a good answer is fresh, and after which a failure is tried again.
AGE, RETRY = 90, 20


class Source(NamedTuple):
    """A source's name, the schema of its payloads, and what makes rows of (payload, fetched, source)."""

    name: str
    schema: str
    parse: Callable[[DataFrame], DataFrame]


class LatestTable:
    """Rows by key below ``path``, written by commits; of one key the row with the greatest version stays."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", version: str = "fetched", buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path, key, version, buckets

    def head(self) -> dict:
        """The last commit: batch, due and good in microseconds, the version of each bucket, and the rows' schema."""
        try:
            commits = self.spark.read.schema("value string, batch long").text(f"{self.path}/commits")
            found = commits.agg(F.max_by("value", "batch")).first()[0]
        except AnalysisException:  # nothing is there yet
            found = None
        return json.loads(found) if found else {"batch": -1, "due": -(2**62), "good": None, "versions": {}, "schema": None}

    def rows(self, head: dict | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of a commit (the last), of some buckets only if they are named; null before the first rows."""
        head = head or self.head()
        if head["schema"] is None:
            return None
        kind = T.StructType.fromJson(json.loads(head["schema"]))
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in head["versions"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def fresh(self, micros: int) -> bool:
        """Whether the last answer is good and still fresh at that time."""
        head = self.head()
        return head["good"] is not None and micros < head["good"] + AGE * 1_000_000

    def commit(self, batch: int, due: int, good: int | None, new: DataFrame | None) -> None:
        """Take in rows, if there are any, and say when the next attempt is due. A batch that was committed is passed over."""
        head = self.head()
        if head["batch"] >= batch:
            return
        versions, kind = dict(head["versions"]), head["schema"]
        if new is not None:
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            kind = new.schema.json()
            touched = {r[0] for r in new.select(bucket).distinct().collect()}  # at most ``buckets``
            before = self.rows(head, touched)
            every = new if before is None else before.unionByName(new)
            kept = latest(every, self.key, self.version).select(*new.columns).withColumn("bucket", bucket)
            # a bucket is written by as many tasks as share the work alike, so that none holds a sixteenth of the rows
            pieces = -(-shuffle_width(self.spark) // self.buckets)
            kept.repartition("bucket", F.pmod(F.hash(self.key), F.lit(pieces))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
            versions.update({str(b): batch for b in touched})
        record = json.dumps({"batch": batch, "due": due, "good": good if good is not None else head["good"], "versions": versions, "schema": kind})
        self.spark.range(1).select(F.lit(record).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/batch={batch}")

    def vacuum(self) -> int:
        """Delete bucket versions that the last commit doesn't name, which readers of earlier ones may need; how many there were."""
        versions = {int(b): v for b, v in self.head()["versions"].items()}
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/rows").select(F.regexp_extract("path", r"batch=(\d+)/bucket=(\d+)/", 1).cast("long").alias("v"), F.regexp_extract("path", r"batch=(\d+)/bucket=(\d+)/", 2).cast("int").alias("b")).filter("v is not null").distinct().collect()
        old = [(r.v, r.b) for r in there if versions.get(r.b) != r.v]
        for v, b in old:
            remove(self.spark, f"{self.path}/rows/batch={v}/bucket={b}")
        return len(old)


def refresh_step(table: LatestTable, sources: list[Source], age: int = AGE, retry: int = RETRY) -> Callable[[DataFrame, int], None]:
    """What foreachBatch does with a batch of attempts."""

    def step(attempts: DataFrame, batch: int) -> None:
        head = table.head()
        if head["batch"] >= batch:
            return
        attempts = attempts.persist()
        try:
            has = F.lit(False)
            for s in sources:
                has = F.when(F.col("source") == s.name, available(attempts, s.schema)).otherwise(has)
            # a row for each time and source of a trigger
            told = attempts.groupBy(F.unix_micros("fetched").alias("at"), "source").agg(F.max(has).alias("has")).filter("at is not null").collect()
            due, good, taken = head["due"], None, []
            for at in sorted({r["at"] for r in told}):
                if at < due:
                    continue
                pick = next((s for s in sources if any(r["at"] == at and r.source == s.name and r.has for r in told)), None)
                due = at + (age if pick else retry) * 1_000_000
                if pick:
                    good = at
                    taken.append(pick.parse(attempts.filter((F.unix_micros("fetched") == at) & (F.col("source") == pick.name))))
            new = None
            for rows in taken:
                new = rows if new is None else new.unionByName(rows)
            table.commit(batch, due, good, None if new is None else latest(new, table.key, table.version).select(*new.columns))
        finally:
            attempts.unpersist()

    return step


def refresh(attempts: DataFrame, table: LatestTable, sources: list[Source], checkpoint: str, age: int = AGE, retry: int = RETRY) -> DataStreamWriter:
    """A writer for a stream of attempts (ATTEMPT); start it with a trigger of your own. It goes on from its checkpoint."""
    return attempts.writeStream.foreachBatch(refresh_step(table, sources, age, retry)).option("checkpointLocation", checkpoint)
