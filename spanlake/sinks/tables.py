"""Table sinks. Writes go through Spark's commit protocol, so a failed job leaves no half-written output."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import identifier, slugify
from spanlake.operators.incremental import last_by_key


def flat_cells(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; one file only for reports whose size is bounded."""
    rows = flat_cells(df)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_versioned(df: DataFrame, manifest: DataFrame, path: str) -> None:
    """Rows under a new name first, then the manifest that names them.

    Until the manifest is replaced the old one keeps pointing at the old rows, so a lost job or a reader in
    between never sees rows and manifest that do not belong together.
    """
    name = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    manifest.withColumn("rows_name", F.lit(name)).write.mode("overwrite").parquet(f"{path}/manifest")


def write_enrichments(df: DataFrame, path: str) -> None:
    latest = last_by_key(df, ["cache_key"], ["question_index"])
    write_json_lines(latest.orderBy("question_index"), path)


def write_question_files(enrichments: DataFrame, path: str) -> None:
    """One folder of JSON per question, named by number and category."""
    name = F.concat(F.lit("q"), F.lpad(F.col("question_index").cast("string"), 2, "0"), F.lit("_"), slugify("category"))
    enrichments.withColumn("question_file", name).write.mode("overwrite").partitionBy("question_file").json(path)


def write_document(value: dict, path: str) -> None:
    """Small JSON document, replaced atomically."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, ensure_ascii=False, default=str)
    os.replace(name, target)


def named_prompts(prompts: DataFrame) -> DataFrame:
    """Prompt dimension with a unique upper-case name per category (_2, _3, ... on collisions)."""
    from pyspark.sql import Window as W

    base = prompts.withColumn("base", F.concat(identifier("category"), F.lit("_SYSTEM_PROMPT")))
    n = F.row_number().over(W.partitionBy("base").orderBy("category"))
    return base.withColumn("n", n).select(
        "category", "prompt", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "n")).alias("name")
    )


def output_layout(root: str, run: str) -> dict[str, str]:
    """Paths of a run, as strings so that URIs stay what they are; dashboards live beside the output folder."""
    root = root.rstrip("/")
    above = root.rpartition("/")[0] if "/" in root else "."
    names = ("results", "results_log", "summary", "baseline", "rows", "retrieval", "ranking", "eligibility", "prompts")
    return {**{n: f"{root}/{run}/{n}" for n in names}, "html": f"{above}/dashboards/{run}.html"}
