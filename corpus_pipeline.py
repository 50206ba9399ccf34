"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.llm import line_dedup, mixing, near_duplicates, packing, quality_rules
from cubeweave.llm._scratch import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or whose posterior quality is low go.

    Rows of one id and text share a verdict, so the join is on both.
    """
    marked = docs.withColumn("q_text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    scored = quality_rules.score(docs.select(F.struct("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")).alias("doc"), "text"), id_col="doc")
    kept = scored.where("kept").select(F.col("doc.doc_id").alias("k_id"), F.col("doc.th").alias("k_text")).distinct()
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("q_text") == F.col("k_text")), "left_semi").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-copies of earlier lines go; every document stays, if with an empty text."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_duplicates.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that all sources weigh the same."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, consistent weighted sampling and tokenizing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
