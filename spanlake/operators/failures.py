"""Failure analysis: error rows, histograms, answer-format profiles, review of prompt patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import WS, strip
from spanlake.operators.scoring import ensure_row_id, failure_mode, parse_gold_answers


def error_rows(results: DataFrame) -> DataFrame:
    """Rows not marked correct, with the kind of failure."""
    wrong = ~F.lower(F.col("correct_at_0_5").cast("string")).isin("true", "1")
    rows = ensure_row_id(results).where(F.coalesce(wrong, F.lit(True)))
    golds = F.col("golds") if "golds" in rows.columns else parse_gold_answers("gold_answers")
    return rows.withColumn("golds", golds).withColumn("failure_mode", failure_mode())


def failure_examples(errors: DataFrame) -> DataFrame:
    return errors.select(
        "row_id",
        "category",
        F.col("title").alias("contract_title"),
        "question",
        F.array_join("golds", "\n").alias("golden_answer"),
        "predicted_answer",
        "gold_marked_impossible",
        "predicted_marked_impossible",
        "token_f1",
        "failure_mode",
    )


def failure_histogram(errors: DataFrame) -> DataFrame:
    return errors.groupBy("category", "failure_mode").agg(F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("first_row"))


def main_failure_mode(errors: DataFrame) -> DataFrame:
    """Most frequent failure per category; ties go to the one seen first in row order."""
    order = W.partitionBy("category").orderBy(F.col("rows").desc(), F.col("first_row"))
    ranked = failure_histogram(errors).withColumn("n", F.row_number().over(order))  # a handful of modes per category
    return ranked.where(F.col("n") == 1).select("category", F.col("failure_mode").alias("main_failure_mode"), "rows")


def sentence_units(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), rf"(?<=[.!?]){WS}+"), strip), lambda u: u != "")


def span_shape(answer: Column) -> Column:
    return (
        F.when(strip(answer) == "", "none").when(F.size(sentence_units(answer)) > 1, "multi_sentence").otherwise("single_sentence")
    )


def literal_pattern(text: Column) -> Column:
    """Regular expression that matches a text literally."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\p{M}\s])", r"\\$1")


def is_complete_sentence(answer: Column, text: Column) -> Column:
    """Some occurrence of the answer starts after a sentence (or at the start) and ends one."""
    pattern = F.concat(
        F.lit(rf"(?:\A|[.!?]){WS}*"), literal_pattern(answer), F.lit(rf"(?={WS}*(?:\z|[\p{{Lu}}\p{{Nd}}\"'(\[]))")
    )
    return answer.rlike(r"[.!?]$") & F.regexp_like(text, pattern)


def match_positions(answer: Column, text: Column) -> Column:
    """Number of (possibly overlapping) occurrences of an answer in a text."""
    return F.when(answer == "", F.lit(0)).otherwise(F.regexp_count(text, F.concat(F.lit("(?="), literal_pattern(answer), F.lit(")"))))


def format_profiles(results: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Shape of the golden answers of each category.

    Answers meet their document on the document id; every check is a flag on the answer row, and the flags
    are combined per category before they are shuffled.
    """
    rows = ensure_row_id(results)
    golds = F.col("golds") if "golds" in rows.columns else parse_gold_answers("gold_answers")
    rows = rows.withColumn("golds", F.filter(F.transform(golds, strip), lambda g: g != ""))
    per_row = rows.groupBy("category").agg(
        F.bool_or((F.size("golds") == 0) | F.coalesce("gold_marked_impossible", F.lit(False))).alias("allows_no_answer"),
        F.bool_or(F.size("golds") > 1).alias("allows_multiple_spans"),
        F.min_by("answer_format", F.when(F.col("answer_format") != "", F.col("row_id"))).alias("csv_answer_format"),
    )
    answers = explode_rows(rows, F.col("golds"), "category", "document_row_id", names=("answer_pos", "answer"))
    checked = answers.join(documents.select("document_row_id", F.col(text).alias("document_text")), "document_row_id", "left")
    label = F.lower("answer").isin("yes", "no")
    has_text = F.coalesce(F.col("document_text"), F.lit("")) != ""
    flags = checked.select(
        "category",
        label.alias("label"),
        span_shape(F.col("answer")).alias("shape"),
        has_text.alias("checked"),
        F.coalesce(has_text & F.contains("document_text", "answer"), F.lit(False)).alias("verbatim"),
        F.coalesce(has_text & is_complete_sentence(F.col("answer"), F.col("document_text")), F.lit(False)).alias("complete"),
    )
    per_answer = flags.groupBy("category").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if("label").alias("labels"),
        F.count_if("checked").alias("contract_match_check_count"),
        F.count_if("verbatim").alias("exact_contract_match_count"),
        F.count_if("verbatim").alias("complete_sentence_check_count"),
        F.count_if("complete").alias("complete_sentence_match_count"),
        F.min("shape").alias("shape_lo"),
        F.max("shape").alias("shape_hi"),
    )
    n, labels = F.coalesce("answers", F.lit(0)), F.coalesce("labels", F.lit(0))
    kind = (
        F.when(n == 0, "no_answer_only")
        .when(labels == n, "label_only")
        .when(labels > 0, "mixed")
        .otherwise("verbatim_contract_span")
    )
    shape = (
        F.when(F.col("allows_multiple_spans"), "multiple_spans")
        .when(n == 0, "none")
        .when(F.col("shape_lo") != F.col("shape_hi"), "mixed")
        .otherwise(F.col("shape_lo"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per_row.join(per_answer, "category", "left").select(
        "category",
        F.coalesce("csv_answer_format", F.lit("")).alias("csv_answer_format"),
        kind.alias("gold_answer_type"),
        kind.isin("verbatim_contract_span", "mixed").alias("requires_verbatim_contract_span"),
        ((n > 0) & (labels == n)).alias("yes_no_label_only"),
        shape.alias("typical_span_shape"),
        zero("exact_contract_match_count"),
        zero("contract_match_check_count"),
        zero("complete_sentence_match_count"),
        zero("complete_sentence_check_count"),
        "allows_multiple_spans",
        "allows_no_answer",
    )


def review_patches(patches: DataFrame) -> DataFrame:
    """Decision and score for proposed prompt texts.

    Input columns: category, current_prompt, candidate_prompt, requires_verbatim_contract_span,
    yes_no_label_only, csv_answer_format, loop_index, evaluator_examples (count), false_positives (count).
    """
    text = F.lower("candidate_prompt")
    span_rule = F.contains(text, F.lit("exact")) | F.contains(text, F.lit("span"))
    label_rule = F.contains(text, F.lit("yes or no")) | F.contains(text, F.lit("yes/no"))
    verbatim = F.col("requires_verbatim_contract_span")
    growth = F.length("candidate_prompt") - F.length("current_prompt") > 1800
    keep = lambda flag, message: F.when(flag, F.lit(message))
    requests = F.array_compact(
        F.array(
            keep(verbatim & ~span_rule, "State that the exact span must be quoted."),
            keep(
                verbatim & (F.lower("csv_answer_format") == "yes/no") & ~label_rule,
                "Say that a span is required although the category is listed as Yes/No.",
            ),
            keep(
                F.col("yes_no_label_only") & ~label_rule,
                "Say that the answer is a Yes/No label.",
            ),
            keep(growth, "Shorten the prompt to the rules of this category."),
        )
    )
    risks = F.array_compact(
        F.array(
            keep(growth, "The longer prompt may distract from extraction."),
            keep(F.col("false_positives") > 0, "Related clauses may still be quoted by mistake."),
        )
    )

    rows = patches.withColumns({"requested_changes": requests, "likely_regressions": risks})
    asked, risky = F.size("requested_changes") > 0, F.size("likely_regressions") > 0
    score = (
        F.lit(0.75)
        - F.when(asked, 0.25).otherwise(0.0)
        - F.when(risky, 0.1).otherwise(0.0)
        + F.least(F.lit(0.1), F.col("evaluator_examples") / F.lit(200.0))
    )
    decision = F.when(asked & (F.col("loop_index") < 3), "revise").when(asked, "reject").otherwise("accept")
    return rows.withColumns(
        {"decision": decision, "generalization_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))}
    )
