"""A corpus pipeline of five operators; each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import exact_dedup, jaccard_join, langid, mixing, packing
from pageloom.llm.common import release, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the classifier is fitted on labelled rows of its own input."""
    return langid.keep_identified(docs, *langid.train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingles at a Jaccard similarity of 0.8 or more."""
    return jaccard_join.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents once for each pass that takes them, in order of training."""
    return mixing.curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", source_mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables between stages are emptied once the next is written, but for the one that the last stage reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        table, path = stored(stage(spark, docs, sf_dir))
        if before:
            release(docs, before)
        docs, before = table, path
    return STAGES[-1][1](spark, docs, sf_dir)
