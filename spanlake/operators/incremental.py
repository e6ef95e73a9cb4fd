"""Resumable results: last write wins, first row per key, merging and pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order values per key.

    The rank limit runs inside each task before the shuffle, so a hot key sends one row per task.
    """
    newest = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def first_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    oldest = W.partitionBy(*key).orderBy(*[F.col(c).asc() for c in order])
    return df.withColumn("_n", F.row_number().over(oldest)).where(F.col("_n") == 1).drop("_n")


def merge_results(*sources: DataFrame, key: str = "row_id", seq: str = "seq") -> DataFrame:
    """Union of result tables, later sources and later rows winning per key."""
    parts = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    order = ["_source", seq] if seq in rows.columns else ["_source"]
    return last_by_key(rows, [key], order).drop("_source")


def pending(work: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Work items without a finished row."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def unfinished_categories(work: DataFrame, status: DataFrame) -> DataFrame:
    """Categories without a status, or whose last status asks for another revision."""
    settled = status.where(F.col("decision") != "revise").select("category").distinct()
    return work.join(settled, "category", "left_anti")


def require_complete(results: DataFrame, expected: DataFrame, key: str = "row_id") -> DataFrame:
    """Raise while the job runs if any expected key has no result."""
    checked = expected.select(key).distinct().join(results.withColumn("_found", F.lit(True)), key, "left")
    return checked.where(
        F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete evaluation, missing "), F.col(key))).cast("boolean"))
    ).drop("_found")


def content_manifest(documents: DataFrame, version: str, text: str = "text") -> DataFrame:
    """Version and content hash of each document, to decide whether a stored table is still valid."""
    return documents.select("document_row_id", F.lit(version).alias("version"), F.sha2(F.col(text), 256).alias("text_sha256"))


def manifest_matches(stored: DataFrame, expected: DataFrame) -> bool:
    """True if both manifests hold exactly the same rows (one aggregate, one row to the driver)."""
    tagged = stored.select("document_row_id", "version", "text_sha256", F.lit(1).alias("side")).unionByName(
        expected.select("document_row_id", "version", "text_sha256", F.lit(-1).alias("side"))
    )
    differing = tagged.groupBy("document_row_id", "version", "text_sha256").agg(F.sum("side").alias("side")).where("side <> 0")
    return differing.isEmpty()
