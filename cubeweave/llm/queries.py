"""The operators bound to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.llm import archives, classifier, extraction, line_dedup, media, mixing, near_duplicates, packing, quality_rules, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    # The least id names a class; where ids repeat or are null, the key tells classes apart.
    key = F.coalesce(F.hex("comp"), F.concat(F.lit("no text "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return found.select("doc_id", "class_id", "class_size", key.alias("class_key"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "mix_copy", "mix_key")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.prefix_counts(_table(spark, sf_dir, "documents"), store=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_media_columns": op5_media_columns,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
}

OP7_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, n, (SELECT sum(n) FROM c) * 1.0::DOUBLE / ((SELECT count(*) FROM c) * 1.0::DOUBLE * n) AS rate FROM c),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM r),
b AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
d AS (SELECT doc_id, source, text, (CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
m AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM b WHERE b.source IS NOT DISTINCT FROM d.source AND b.below < d.u) AS n FROM d),
x AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM m WHERE n > 0)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS mix_copy,
       CAST('0x' || substr(md5('mix-1-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS mix_key
FROM x
"""

SQL: dict[str, str] = {"op7_source_mixing": OP7_SQL}
