"""A corpus pipeline of five stages; each reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, language, minhash, mixing, secrets
from loomwork.llm.shared import scratch, with_row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; those without a letter (``und``) go. lang is the predicted one."""
    prototypes = language.learn(docs.filter(~language.held_out()))
    found = language.predict(docs, prototypes, carried=tuple(COLUMNS))
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, likeness 0.8 or more): that with the smallest id.

    Rows are told apart by their place, not by id: of rows that repeat an id and a text one
    stays, and a text that only shares its id with a copy stays.  Texts without words stay.
    """
    keyed = with_row_key(docs, "row_key", stable=True)
    gone = minhash.near_duplicates(keyed, words=5, percent=80, stable=True, row_col="row_key").filter("NOT kept").select("row_key")
    return keyed.join(gone, "row_key", "left_anti").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mask; every document stays. n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, in shards; documents come as often as they are taken."""
    return mixing.mix(docs, stable=True).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return bpe.bpe_encode(docs.select(COLUMNS)).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe_encode", encode),
]

#: Hyperdimensional profiles, MinHash and the forest have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
