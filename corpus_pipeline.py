"""The corpus pipeline: five stages over ``documents``, each an operator of quillon.llm.

Null and empty texts fail the quality rules and go; a stage that is given some keeps them (near-dedup one without words
for each doc_id, packing as the id 0 alone).  Rows without doc_id stay through near-dedup.  Of repeated rows near-dedup keeps
one; before it, line dedup takes the lines of all but the smallest doc_id.  An empty table passes every stage
as an empty table.  Columns beside doc_id and text, whatever their names, are returned as they were, but for n_chars,
which is counted anew where a stage shortens texts; packing returns pieces instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import linededup, minhash, packing, quality, substring
from quillon.llm.components import written


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal, or are one edit from, an earlier line go."""
    return _recounted(linededup.remove_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that start at two places or more go."""
    return _recounted(substring.remove_repeats(docs, size=35))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return packing.pack(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: Compression bands and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
