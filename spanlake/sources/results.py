"""Result tables, logs, span and enrichment caches, splits and prompt dimensions."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.incremental import last_by_key, manifest_matches
from spanlake.operators.scoring import RESULT_COLUMNS, ensure_row_id, require_columns

RESULT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in RESULT_COLUMNS.items())
REVIEW_COLUMNS = (
    "document_row_id", "question_index", "category", "question", "gold_answers", "predicted_answer", "token_f1", "correct_at_0_5",
)
ENRICHMENT_SCHEMA = (
    "question_index INT, category STRING, question STRING, category_description STRING, enrichment_terms STRING, "
    "enriched_query STRING, provider STRING, status STRING, cache_key STRING"
)
STATUS_SCHEMA = (
    "category STRING, decision STRING, loop_count INT, candidate_prompt STRING, v1_prompt STRING, "
    "main_failure_mode STRING, completed_at STRING"
)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Stored parquet table, or None when nothing has been stored yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException:
        return None


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines: strict mode fails on a malformed line, tolerant mode drops it; blank lines never count.

    A ``_line`` column (file, then byte order inside the file) gives "later line" a meaning.
    """
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.schema(f"{schema}, _corrupt_record STRING").json(path)
        rows = rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    meta = F.col("_metadata")
    order = F.struct(meta["file_modification_time"], meta["file_name"], meta["file_block_start"], F.monotonically_increasing_id())
    return rows.withColumn("_line", order)


def latest_lines(rows: DataFrame, key: list[str]) -> DataFrame:
    """Last line per key."""
    return last_by_key(rows, key, ["_line"]).drop("_line")


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV with the fixed columns; a missing column is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = require_columns(ensure_row_id(raw), RESULT_COLUMNS, path)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in RESULT_COLUMNS.items()])


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result CSV for failure analysis: eight required columns, other columns kept."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = ensure_row_id(require_columns(raw, REVIEW_COLUMNS, path))
    return raw.select(*[F.col(c).try_cast(RESULT_COLUMNS.get(c, "string")).alias(c) for c in raw.columns])


def cached_results(results: DataFrame, rows: DataFrame, model_id: str, order: list[str]) -> DataFrame:
    """Stored results of one model for the requested rows, last write per row."""
    mine = results.where(F.col("model_id") == model_id).join(rows.select("row_id").distinct(), "row_id", "left_semi")
    return last_by_key(mine.select(*results.columns), ["row_id"], order)


def read_result_log(spark: SparkSession, path: str, rows: DataFrame, model_id: str) -> DataFrame:
    """Tolerant read of an append log: malformed lines are skipped, the last line per row wins."""
    return cached_results(read_json_lines(spark, path, RESULT_SCHEMA, strict=False), rows, model_id, ["_line"]).drop("_line")


def read_category_status(spark: SparkSession, path: str) -> DataFrame:
    return latest_lines(read_json_lines(spark, path, STATUS_SCHEMA, strict=False), ["category"])


def read_enrichment_cache(spark: SparkSession, path: str) -> DataFrame:
    rows = latest_lines(read_json_lines(spark, path, ENRICHMENT_SCHEMA), ["cache_key"])
    text = ("category_description", "enrichment_terms", "enriched_query", "provider")
    return rows.na.fill("", list(text)).na.fill("cached", ["status"])


def read_valid_cache(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame | None:
    """Stored spans or chunks if their manifest equals the expected one, else None."""
    stored = read_table(spark, f"{path}/manifest")
    if stored is None or "rows_name" not in stored.columns or not manifest_matches(stored, manifest):
        return None
    named = stored.select("rows_name").first()
    return None if named is None else read_table(spark, f"{path}/{named.rows_name}")


def cached_spans(spans: DataFrame, documents: DataFrame) -> DataFrame:
    return spans.join(documents.select("document_row_id").distinct(), "document_row_id", "left_semi")


def _small_json(spark: SparkSession, path: str):
    """A small JSON document from any store Spark reads."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()["value"])


def _named_table(spark: SparkSession, path: str, columns: set[str]) -> DataFrame | None:
    """A folder or file of JSON lines with these columns, as plans write them; None if it is something else."""
    found = spark.read.json(path)
    return found if columns <= set(found.columns) else None


def read_split_ids(spark: SparkSession, reference: str) -> DataFrame | None:
    """Row ids of ``PATH:SPLIT`` (or ``PATH`` holding a list).

    ``PATH`` is any path or URI: a JSON document, nested {"splits": {...}} or flat, or the folder of splits that prompt
    improvement writes, which stays distributed.
    """
    if not reference:
        return None
    path, _, name = reference.rpartition(":")
    if not path or "/" in name:
        path, name = reference, ""
    table = _named_table(spark, path, {"split", "row_id"})
    if table is not None:
        chosen = table.where(F.col("split") == name) if name else table
        if chosen.isEmpty():
            raise KeyError(f"split {name!r} not found in {path}")
        return chosen.select(F.col("row_id").cast("string").alias("row_id")).distinct()
    content = _small_json(spark, path)
    if name:
        named = content.get("splits", content)
        if name not in named:
            raise KeyError(f"split {name!r} not found in {path}")
        content = named[name]
    if not isinstance(content, list):
        raise ValueError(f"split in {path} is not a list of row ids")
    return spark.createDataFrame([(str(v),) for v in content], "row_id string")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt dimension (category, prompt): JSON lines as prompt improvement writes them, or one JSON object.

    ``path`` is any path or URI; nothing is executed.
    """
    table = _named_table(spark, path, {"category", "prompt"})
    if table is not None:
        return table.select(F.col("category").cast("string").alias("category"), F.col("prompt").cast("string").alias("prompt"))
    return spark.createDataFrame([(str(k), str(v)) for k, v in _small_json(spark, path).items()], "category string, prompt string")


def find_summary(path: str, name: str) -> str:
    """A summary file: the path itself, the named file of a folder, or the first one below it."""
    given = Path(path)
    if given.is_file():
        return str(given)
    if (given / name).is_file():
        return str(given / name)
    hits = sorted(given.rglob(f"*{name}"))
    if not hits:
        raise FileNotFoundError(f"no {name} below {path}")
    return str(hits[0])
