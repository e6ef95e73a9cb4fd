"""Nested question-answer corpora and the category dimension."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import drop_prefix, extract_category, normalize_category, strip
from spanlake.session import cut_lineage
from spanlake.sources.json_records import read_record_texts

RECORD_SCHEMA = (
    "title STRING, paragraphs ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<"
    "question: STRING, is_impossible: BOOLEAN, answers: ARRAY<STRUCT<text: STRING>>>>>>"
)


def resolve_path(primary: str, aliases: tuple[str, ...] = (), folders: tuple[str, ...] = (".",)) -> str:
    """First existing path among the names in the folders (driver-side configuration only)."""
    for name in (primary, *aliases):
        for folder in folders:
            path = Path(name) if Path(name).is_absolute() else Path(folder) / name
            if path.exists():
                return str(path)
    raise FileNotFoundError(f"none of {', '.join((primary, *aliases))} found")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 in the given order: rows are sorted into ranges, and only range sizes are summed up."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, "_range").withColumn(name, at).drop("_range", "_at", "_start")


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records ``(record_pos, title, paragraphs)`` of a corpus: a file, several, or a folder.

    JSON files may hold ``{"data": [...]}``, lists of records and single records, on one line or on many; files of
    different layouts may be mixed. ``lines`` says that every line of every file is a value of its own, which is read
    with less work. Paths ending in ``.parquet`` are read as parquet with title and paragraphs. Positions number the
    records over all files, by file name and place in the file. All files are read in splits.
    """
    wrapped = f"data ARRAY<STRUCT<{RECORD_SCHEMA.replace('title STRING', 'title: STRING').replace('paragraphs ARRAY', 'paragraphs: ARRAY')}>>, {RECORD_SCHEMA}"
    records = F.coalesce("data", F.array(F.struct("title", "paragraphs"))).alias("records")
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path).select(F.array(F.struct("title", "paragraphs")).alias("records"), "_metadata.file_path", "_metadata.file_block_start")
    elif lines:
        raw = spark.read.schema(wrapped).option("mode", "FAILFAST").json(path).select(records, "_metadata.file_path", "_metadata.file_block_start")
    else:
        texts = read_record_texts(spark, path).select("file_path", "record_no", F.from_json("text", wrapped, {"mode": "FAILFAST"}).alias("r"))
        raw = texts.select("file_path", "record_no", "r.*").select(records, "file_path", F.col("record_no").alias("file_block_start"))
    raw = raw.withColumn("_row", F.monotonically_increasing_id())  # rises within a split
    each = explode_rows(raw, F.col("records"), "file_path", "file_block_start", "_row", names=("_item", "r"))
    order = ["file_path", "file_block_start", "_row", "_item"]
    numbered = number_rows(each.select(*order, "r.title", "r.paragraphs"), order, "record_pos")
    return numbered.select("record_pos", "title", "paragraphs")


def contracts_from_records(records: DataFrame, position: str = "record_pos") -> DataFrame:
    """One row per document with its id, paragraph count and first paragraph."""
    first = F.get("paragraphs", F.lit(0))
    return records.select(
        F.col(position).cast("int").alias("document_row_id"),
        F.col("title").alias("document_id"),
        "title",
        "paragraphs",
        F.coalesce(F.size("paragraphs"), F.lit(0)).alias("paragraphs_len"),
        first["context"].alias("context"),
        first["qas"].alias("qas"),
    )


def paragraphs_from_contracts(contracts: DataFrame) -> DataFrame:
    rows = explode_rows(
        contracts, F.col("paragraphs"), "document_row_id", "document_id", "title", names=("paragraph_index", "p")
    )
    rows = rows.where(F.col("p").isNotNull())
    return rows.select("document_row_id", "document_id", "title", "paragraph_index", "p.context", "p.qas")


def questions_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    keep = ("document_row_id", "document_id", "title", "paragraph_index")
    rows = explode_rows(paragraphs, F.col("qas"), *keep, names=("question_index", "q")).where(F.col("q").isNotNull())
    return rows.select(
        *keep,
        "question_index",
        "q.question",
        F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
        "q.answers",
        F.greatest(F.coalesce(F.size("q.answers"), F.lit(0)), F.lit(0)).alias("answers_len"),
    )


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category dimension from its CSV; the row order is the question order.

    The file is a small dimension read in one split, so the input position is its order.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    source = next(c for c in raw.columns if c.lstrip("\ufeff").startswith("Category"))
    return raw.coalesce(1).select(
        (F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1).alias("category_index"),
        drop_prefix(F.col(f"`{source}`"), "Category:").alias("category"),
        drop_prefix("Description", "Description:").alias("category_description"),
        drop_prefix("`Answer Format`", "Answer Format:").alias("answer_format"),
        drop_prefix("Group", "Group:").alias("category_group"),
    )


def lookup_join(left: DataFrame, dimension: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join that fails while running if the dimension holds a key twice.

    The dimension is reduced to one row per key with its count, which is also the check; no side is forced
    to be broadcast, so Spark decides by size.
    """
    others = [c for c in dimension.columns if c != right_key]
    once = dimension.groupBy(right_key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    # The count stays in the output path through the coalesce below, so the check cannot be pruned away.
    key = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(right_key).cast("string"))).cast(dimension.schema[right_key].dataType)).otherwise(F.col(right_key))
    checked = once.select(key.alias(right_key), *others)
    return left.join(checked, left[left_key] == checked[right_key], "left")


def check_question_order(questions: DataFrame, categories: DataFrame) -> DataFrame:
    """Problems with the question layout: wrong counts, differing sequences, category name mismatches.

    Each document's questions are folded into a hash of (position, question), so sequences are compared
    without collecting them; category names are compared by position.
    """
    expected = categories.agg(F.count(F.lit(1))).scalar()
    place = F.row_number().over(W.partitionBy("document_row_id").orderBy("paragraph_index", "question_index")) - 1
    placed = questions.select("document_row_id", "paragraph_index", "question_index", "question").withColumn("place", place)
    per_document = placed.groupBy("document_row_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("place", "question").cast("decimal(38,0)")).alias("sequence"),
    )
    counts = per_document.where(F.col("n") != expected).select(
        F.lit("question_count").alias("problem"), F.col("document_row_id").cast("string").alias("subject"), F.col("n").cast("string").alias("found")
    )
    sequences = per_document.agg(F.count_distinct("sequence").alias("n")).where(F.col("n") > 1)
    sequences = sequences.select(F.lit("question_order").alias("problem"), F.lit("all documents").alias("subject"), F.col("n").cast("string").alias("found"))
    found = placed.select("place", normalize_category(extract_category("question")).alias("found")).distinct()
    names = categories.select(F.col("category_index").alias("place"), normalize_category("category").alias("expected"))
    differing = found.join(names, "place").where(F.col("found") != F.col("expected"))
    mismatches = differing.select(F.lit("category_name").alias("problem"), F.col("place").cast("string").alias("subject"), "found")
    return counts.unionByName(sequences).unionByName(mismatches)


def require_question_order(questions: DataFrame, categories: DataFrame) -> None:
    """Raise with the first few problems, if any."""
    problems = check_question_order(questions, categories).limit(5).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem} {p.subject}: {p.found}" for p in problems))


def with_categories(questions: DataFrame, categories: DataFrame, validate: bool = True) -> DataFrame:
    if validate:
        require_question_order(questions, categories)
    return lookup_join(questions, categories, "question_index", "category_index")


def load_tables(spark: SparkSession, corpus_path: str, categories_path: str, validate: bool = True) -> dict[str, DataFrame]:
    """contracts, paragraphs and questions (with categories) of a corpus."""
    contracts = contracts_from_records(read_corpus(spark, corpus_path))
    paragraphs = paragraphs_from_contracts(contracts)
    questions = with_categories(questions_from_paragraphs(paragraphs), read_categories(spark, categories_path), validate)
    return {"contracts": contracts, "paragraphs": paragraphs, "questions": questions}


def document_texts(contracts: DataFrame) -> DataFrame:
    """(document_row_id, title, text): title falls back to the document id, text to an empty string."""
    blank = F.lit("")
    return contracts.select(
        "document_row_id",
        F.coalesce(F.nullif(F.col("title"), blank), F.col("document_id"), blank).alias("title"),
        F.coalesce("context", F.get("paragraphs", F.lit(0))["context"], blank).alias("text"),
    )


def column_counts(df: DataFrame) -> DataFrame:
    """Row count and non-null count of each column, one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    known = [c for c in first if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(strip(column) != "")
