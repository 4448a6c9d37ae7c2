"""A feed that is refreshed: files of matches in, the latest state of each match out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """New JSON files below path as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).json(path)


def latest(rows: DataFrame, key: str = "id", version: str = "fetched") -> DataFrame:
    """The row of each key with the greatest version, batch or stream (complete or update mode)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def clock(events: DataFrame, key: str = "session", at: str = "at", kind: str = "kind", size: str = "size") -> DataFrame:
    """Recorded time without pauses, in seconds, and bytes of each session, from start, pause, resume, chunk and stop events."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at)
    turns = events.filter(F.col(kind) != "chunk").withColumn("until", F.lead(at).over(w))
    spans = turns.filter(F.col(kind).isin("start", "resume")).groupBy(key).agg(F.sum(F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))).alias("us"))
    parts = events.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(kind) == "chunk", F.col(size))), F.lit(0)).alias("bytes"))
    return parts.join(spans, key, "left").select(key, "bytes", (F.coalesce("us", F.lit(0)) / 1_000_000).alias("seconds"))
