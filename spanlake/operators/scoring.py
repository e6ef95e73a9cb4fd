"""Answer scoring: token F1, answer detection, summaries and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import (
    NO_ANSWER_MARKERS,
    answer_tokens,
    multiset_overlap,
    normalize_answer,
    normalize_marker,
    row_key,
    strip,
    words,
)

# Columns of a result row, in order.
RESULT_COLUMNS = {
    "model_id": "string",
    "row_id": "string",
    "document_row_id": "int",
    "title": "string",
    "question_index": "int",
    "category": "string",
    "category_description": "string",
    "answer_format": "string",
    "question": "string",
    "gold_answers": "string",
    "predicted_answer": "string",
    "predicted_marked_impossible": "boolean",
    "gold_marked_impossible": "boolean",
    "token_f1": "double",
    "correct_at_0_5": "boolean",
    "is_impossible": "boolean",
    "answers_len": "int",
}


def with_token_f1(df: DataFrame, prediction: str, golds: Column, output: str = "token_f1") -> DataFrame:
    """Multiset token F1 of a prediction against all golden texts of the row; no shuffle."""
    staged = df.withColumns(
        {
            "_pred": answer_tokens(prediction),
            "_gold": answer_tokens(F.array_join(golds, " ")),
            "_norm": normalize_answer(prediction),
        }
    )
    staged = staged.withColumn("_same", multiset_overlap(F.col("_pred"), F.col("_gold")))
    n_pred, n_gold = F.size("_pred"), F.size("_gold")
    score = F.when(n_gold == 0, F.when(F.col("_norm").isin(NO_ANSWER_MARKERS), 1.0).otherwise(0.0)).otherwise(
        F.coalesce(F.try_divide(2.0 * F.col("_same"), n_pred + n_gold), F.lit(0.0))
    )
    return staged.withColumn(output, score.cast("double")).drop("_pred", "_gold", "_norm", "_same")


def parse_bool(c: Column | str) -> Column:
    """Numbers are true unless zero; anything else is true if its text is one of the markers. Null stays null."""
    value = F.col(c) if isinstance(c, str) else c
    text = normalize_answer(value.cast("string"))
    marked = text.isin("true", "yes", "y", "1", "marked impossible", "impossible")
    numeric = F.typeof(value).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    return F.when(numeric, value.try_cast("double") != 0).otherwise(marked)


def parse_gold_answers(c: Column | str) -> Column:
    """Golden answers stored as a JSON list; anything else gives an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def is_no_answer(prediction: Column | str) -> Column:
    return normalize_answer(prediction).isin(NO_ANSWER_MARKERS)


def predicted_no_answer() -> Column:
    """The model says there is no answer, by flag or by text."""
    return F.coalesce("predicted_marked_impossible", F.lit(False)) | is_no_answer("predicted_answer")


def parse_answer(output: Column) -> Column:
    """Structured answer from model output: JSON if it parses, also inside a code fence, a marker, or the raw text."""
    text = strip(F.coalesce(output, F.lit("")))
    inside = F.regexp_replace(text, r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", "$1")
    parsed = F.from_json(inside, "reasoning string, answer string, marked_impossible string")
    marker = F.lower(text).isin(NO_ANSWER_MARKERS)
    fallback = F.struct(
        F.lit("unstructured_model_output").alias("reasoning"),
        F.when(marker, F.lit("NO_ANSWER")).otherwise(text).alias("answer"),
        marker.alias("marked_impossible"),
    )
    whole = F.struct(
        F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"),
        parsed["answer"].alias("answer"),
        F.coalesce(parse_bool(parsed["marked_impossible"]), F.lit(False)).alias("marked_impossible"),
    )
    return F.when(parsed["answer"].isNotNull(), whole).otherwise(fallback)


def result_rows(predictions: DataFrame, model_id: str) -> DataFrame:
    """Result rows in the fixed layout from rows with ``golds`` (array), prediction columns and question columns."""
    scored = with_token_f1(predictions, "predicted_answer", F.col("golds"))
    scored = scored.withColumns(
        {
            "model_id": F.lit(model_id),
            "gold_answers": F.to_json("golds"),
            "correct_at_0_5": F.col("token_f1") >= 0.5,
            "gold_marked_impossible": F.coalesce("is_impossible", F.lit(False)),
            "answer_format": F.coalesce("answer_format", F.lit("")),
        }
    )
    return scored.select(*[F.col(c).cast(t).alias(c) for c, t in RESULT_COLUMNS.items()])


def detection_columns() -> list[Column]:
    gold, pred = F.coalesce("gold_marked_impossible", F.lit(False)), predicted_no_answer()
    share = lambda hit, base: F.try_divide(100.0 * F.count_if(hit), F.count_if(base))
    return [
        F.count_if(gold).alias("gold_no_answer_count"),
        F.count_if(~gold).alias("gold_answer_count"),
        F.count_if(pred).alias("predicted_no_answer_count"),
        share(pred & gold, gold).alias("no_answer_detection_accuracy"),
        share(~pred & ~gold, ~gold).alias("answer_detection_accuracy"),
        F.try_divide(100.0 * F.count_if(pred == gold), F.count(F.lit(1))).alias("detection_accuracy"),
    ]


def score_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        (F.avg("token_f1") * 100).alias("mean_token_f1"),
        (F.avg(F.col("correct_at_0_5").cast("double")) * 100).alias("correct_at_0_5"),
    ]


def summarize(results: DataFrame, *groups: str) -> DataFrame:
    """Overall row (groups null) and one row per group, from one pass over the results."""
    groups = groups or ("question_index", "category")
    sets = results.groupingSets([[], [F.col(g) for g in groups]], *[F.col(g) for g in groups])
    level = F.when(F.grouping_id() == 0, "group").otherwise("overall").alias("level")
    return sets.agg(level, *score_columns(), *detection_columns())


def detection(results: DataFrame, *groups: str) -> DataFrame:
    return results.groupBy(*groups).agg(*detection_columns())


def ensure_row_id(results: DataFrame) -> DataFrame:
    if "row_id" in results.columns:
        return results
    return results.withColumn("row_id", row_key("document_row_id", "question_index"))


def require_columns(df: DataFrame, required, what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")
    return df


def join_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current rows with the baseline's scores and the differences, matched on row_id."""
    needed = ("row_id", "question_index", "category", "token_f1", "correct_at_0_5")
    current = require_columns(ensure_row_id(current), needed, "current results")
    baseline = require_columns(ensure_row_id(baseline), needed, "baseline results")
    kept = ["token_f1", "correct_at_0_5"]
    kept += [c for c in ("predicted_answer", "predicted_marked_impossible") if c in baseline.columns]
    joined = current.join(baseline.select("row_id", *[F.col(c).alias(f"baseline_{c}") for c in kept]), "row_id")
    as_number = lambda c: F.col(c).cast("boolean").cast("double")
    return joined.withColumns(
        {
            "token_f1_delta": F.col("token_f1") - F.col("baseline_token_f1"),
            "correct_at_0_5_delta": as_number("correct_at_0_5") - as_number("baseline_correct_at_0_5"),
        }
    )


def compare_to_baseline(current: DataFrame, baseline: DataFrame, *groups: str) -> DataFrame:
    """Means of both runs and of the differences, overall and per group, in one pass."""
    groups = groups or ("question_index", "category")
    joined = join_baseline(current, baseline)
    mean = lambda c: F.avg(F.col(c).cast("double")) * 100
    sets = joined.groupingSets([[], [F.col(g) for g in groups]], *[F.col(g) for g in groups])
    return sets.agg(
        F.when(F.grouping_id() == 0, "group").otherwise("overall").alias("level"),
        F.count(F.lit(1)).alias("matched_examples"),
        mean("baseline_token_f1").alias("baseline_mean_token_f1"),
        mean("token_f1").alias("candidate_mean_token_f1"),
        mean("token_f1_delta").alias("mean_token_f1_delta"),
        (F.avg(F.col("baseline_correct_at_0_5").cast("boolean").cast("double")) * 100).alias("baseline_correct_at_0_5"),
        (F.avg(F.col("correct_at_0_5").cast("boolean").cast("double")) * 100).alias("candidate_correct_at_0_5"),
        mean("correct_at_0_5_delta").alias("correct_at_0_5_delta"),
    )


def page_rows(results: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Result rows with the scores of their category and, where present, the same row of a baseline run.

    Rows stay flat; a page groups them by question when it is drawn.
    """
    scores = results.groupBy("question_index", "category").agg(
        F.count(F.lit(1)).alias("category_count"),
        (F.avg("token_f1") * 100).alias("category_mean_token_f1"),
        (F.avg(F.col("correct_at_0_5").cast("double")) * 100).alias("category_correct_at_0_5"),
    )
    page = results.join(scores, ["question_index", "category"], "left")
    if baseline is None:
        return page
    old = ensure_row_id(baseline).select("row_id", F.col("token_f1").alias("baseline_token_f1"), F.col("predicted_answer").alias("baseline_predicted_answer"))
    return page.join(old, "row_id", "left").withColumn("token_f1_delta", F.col("token_f1") - F.col("baseline_token_f1"))


def align_runs(summaries: DataFrame, labels: list[str], group: str = "category", value: str = "mean_token_f1") -> DataFrame:
    """One row per group and one column per run label; a missing run gives null."""
    return summaries.groupBy(group).pivot("label", labels).agg(F.first(value))


def failure_mode() -> Column:
    """Kind of error of a wrong result row, by ordered rules; needs columns golds, token_f1 and the flags."""
    prediction = strip(F.coalesce("predicted_answer", F.lit("")))
    has_gold = F.size("golds") > 0
    gold_words = F.size(words(F.array_join("golds", " ")))
    return (
        F.when(F.lower(prediction).isin("yes", "no") & has_gold, "classification_instead_of_span")
        .when(F.coalesce("predicted_marked_impossible", F.lit(False)) & has_gold, "false_no_answer")
        .when(~has_gold & ~normalize_marker(prediction).isin(NO_ANSWER_MARKERS), "false_positive_span")
        .when((F.col("token_f1") == 0) & ~F.coalesce("gold_marked_impossible", F.lit(False)), "false_positive_span")
        .when(F.col("token_f1") == 0, "format_error")
        .when((gold_words > 0) & (F.size(words(prediction)) > gold_words * 3), "overlong_span")
        .when((F.col("token_f1") > 0) & (F.col("token_f1") < 0.5), "partial_span")
        .otherwise("format_error")
    )
