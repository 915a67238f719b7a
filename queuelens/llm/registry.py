"""The text queries by name: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from queuelens.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    licenses,
    line_dedup,
    ngram_join,
    nn_descent,
    packing,
    periodic_runs,
    quality,
    secrets,
    sharding,
    substring_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality.train_on(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, weights).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the source is a repository with a directory per thousand and per
    hundred documents; every seventh document is the license file of its thousand."""
    doc = F.col("doc_id")
    thousand = F.concat_ws("/", "source", F.floor(doc / 1000).cast("string"))
    path = F.when(doc % 7 == 0, F.concat(thousand, F.lit("/LICENSE-"), doc)).otherwise(
        F.concat_ws("/", thousand, F.floor(doc / 100).cast("string"), F.concat(doc, F.lit(".txt")))
    )
    files = _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(files, id_col="doc_id").withColumnRenamed("file_id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.place(docs, [f"shard-{k:03d}" for k in range(256)])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.digest_rows(substring_dedup.remove_repeats(docs))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(_table(spark, sf_dir, "documents"), verbatim=True).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = periodic_runs.with_planted_period()
    docs = _table(spark, sf_dir, "documents")
    return periodic_runs.collapse_runs(docs, text_col=text, digest=True)


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        _table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label
    )


def op13_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_license_scans": op2_license_scans,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_run_detection": op11_periodic_run_detection,
    "op12_hard_negative_mining": op12_hard_negative_mining,
    "op13_approximate_nearest_neighbours": op13_approximate_nearest_neighbours,
    "pipeline": corpus_pipeline.run,
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
