"""Golden answers: matching against sentences, eligibility of questions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import normalize_sentence, strip
from spanlake.operators.segment import sentence_array, split_texts

NO_ANSWER_ROW = "no_answer_row"
NOT_FOUND = "gold_answer_not_found"
PARTIAL = "partial_span_inside_sentence"


def answer_texts(answers: Column) -> Column:
    """Stripped, non-blank answer texts."""
    texts = F.transform(F.coalesce(answers, F.array()), lambda a: strip(F.coalesce(a["text"], F.lit(""))))
    return F.filter(texts, lambda t: t != "")


def raw_answer_texts(answers: Column) -> Column:
    """Answer texts as they are, blank ones included."""
    return F.transform(F.coalesce(answers, F.array()), lambda a: F.coalesce(a["text"], F.lit("")))


def gold_sentences(rows: DataFrame) -> DataFrame:
    """(row_id, document_row_id, answer_pos, piece_pos, text, normalized_text) of rows that have an answer."""
    answered = rows.where(~F.coalesce("is_impossible", F.lit(False)))
    answers = explode_rows(
        answered, answer_texts(F.col("answers")), "row_id", "document_row_id", names=("answer_pos", "answer")
    )
    pieces = split_texts(answers, "answer", ["row_id", "document_row_id", "answer_pos"])
    return pieces.select(
        "row_id",
        "document_row_id",
        "answer_pos",
        "piece_pos",
        F.col("piece").alias("text"),
        normalize_sentence("piece").alias("normalized_text"),
    )


def first_sentences(spans: DataFrame) -> DataFrame:
    """Earliest sentence for each distinct normalised text of a document (repeats combine before the shuffle)."""
    first = spans.groupBy("document_row_id", "normalized_text").agg(F.min("sentence_index").alias("sentence_index"))
    key = F.concat_ws(":s:", F.col("document_row_id").cast("string"), F.col("sentence_index").cast("string"))
    return first.withColumn("matched_sentence_id", key)


def searchable_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Normalised full text, and normalised sentences one per line, of each document.

    A normalised sentence holds no line break, so "inside some sentence" is one substring test on the
    joined text and never pairs golden answers with sentences.
    """
    sentences = F.transform(sentence_array(F.col(text)), lambda s: normalize_sentence(s["raw_text"]))
    return documents.select(
        "document_row_id",
        normalize_sentence(text).alias("document_text"),
        F.array_join(sentences, "\n").alias("sentence_lines"),
    )


def match_gold(golds: DataFrame, spans: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """Golden sentences with the matched sentence id, whole-text match flag and reason when unmatched."""
    # Only sentences that equal a golden one are grouped, so the texts of all others are not shuffled.
    key = ["document_row_id", "normalized_text"]
    matched = golds.join(first_sentences(spans.join(golds.select(*key).distinct(), key, "left_semi")), key, "left")
    # Only documents that have golden answers are segmented for the substring tests.
    wanted = documents.join(golds.select("document_row_id").distinct(), "document_row_id", "left_semi")
    checked = matched.join(searchable_texts(wanted, text), "document_row_id", "left")
    has_text = F.col("normalized_text") != ""
    inside = has_text & F.coalesce(F.contains("sentence_lines", "normalized_text"), F.lit(False))
    return checked.select(
        "row_id",
        "document_row_id",
        "answer_pos",
        "piece_pos",
        "text",
        "normalized_text",
        "matched_sentence_id",
        (has_text & F.coalesce(F.contains("document_text", "normalized_text"), F.lit(False))).alias("raw_contract_match"),
        F.when(F.col("matched_sentence_id").isNull(), F.when(inside, PARTIAL).otherwise(NOT_FOUND)).alias("reason"),
    )


def eligibility(rows: DataFrame, spans: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """One record per evaluation row: counts, coverages, eligibility, reason, golden sentences in order."""
    matches = match_gold(gold_sentences(rows), spans, documents, text)
    entry = F.struct(
        "answer_pos", "piece_pos", "text", "normalized_text", "matched_sentence_id", "raw_contract_match", "reason"
    )
    counted = matches.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("gold"),
        F.count("matched_sentence_id").alias("matched"),
        F.count_if("raw_contract_match").alias("raw"),
        F.sort_array(F.collect_list(entry)).alias("entries"),  # the answers of one row
    )
    gold = F.coalesce("gold", F.lit(0))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("gold")), F.lit(0.0))
    first_reason = F.get(F.filter(F.transform("entries", lambda e: e["reason"]), lambda r: r.isNotNull()), F.lit(0))
    eligible = (gold > 0) & (F.col("matched") == F.col("gold"))
    return rows.join(counted, "row_id", "left").select(
        "row_id",
        "document_row_id",
        "question_index",
        "category",
        F.coalesce(eligible, F.lit(False)).alias("is_eligible"),
        gold.cast("bigint").alias("gold_sentence_count"),
        F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched_sentence_count"),
        F.coalesce("raw", F.lit(0)).cast("bigint").alias("raw_contract_sentence_match_count"),
        ratio("matched").alias("per_row_gold_sentence_contract_coverage"),
        ratio("raw").alias("per_row_raw_contract_sentence_coverage"),
        F.when(F.coalesce("is_impossible", F.lit(False)), NO_ANSWER_ROW)
        .when(gold == 0, NOT_FOUND)
        .when(~eligible, first_reason)
        .alias("reason"),
        F.coalesce(
            F.filter(F.transform("entries", lambda e: e["matched_sentence_id"]), lambda i: i.isNotNull()),
            F.array().cast("array<string>"),
        ).alias("matched_sentence_ids"),
        F.coalesce(F.transform("entries", lambda e: e.dropFields("answer_pos", "piece_pos")), F.array()).alias("golden_sentences"),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _eligibility_counts() -> list[Column]:
    has_gold = F.col("gold_sentence_count") > 0
    matched, gold = F.col("matched_sentence_count"), F.col("gold_sentence_count")
    return [
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(has_gold).alias("rows_with_gold"),
        F.count_if("is_eligible").alias("eligible_rows"),
        F.count_if(has_gold & (matched == gold)).alias("full_match_rows"),
        F.count_if(has_gold & (matched > 0) & (matched < gold)).alias("partial_match_rows"),
        F.count_if(has_gold & (matched == 0)).alias("no_match_rows"),
        F.sum("gold_sentence_count").alias("gold_count"),
        F.sum("matched_sentence_count").alias("matched_count"),
        F.sum("raw_contract_sentence_match_count").alias("raw_count"),
    ]


def summarize_eligibility(records: DataFrame) -> DataFrame:
    """One row of totals and rates."""
    return records.agg(*_eligibility_counts()).select(
        "rows_total",
        F.col("rows_with_gold").alias("rows_with_gold_sentences"),
        "eligible_rows",
        (F.col("rows_total") - F.col("eligible_rows")).alias("non_eligible_rows"),
        _rate(F.col("eligible_rows"), F.col("rows_with_gold")).alias("eligible_rate"),
        F.coalesce("gold_count", F.lit(0)).alias("gold_sentence_count"),
        F.coalesce("matched_count", F.lit(0)).alias("matched_sentence_count"),
        F.coalesce("raw_count", F.lit(0)).alias("raw_contract_sentence_match_count"),
        _rate(F.col("raw_count"), F.col("gold_count")).alias("raw_contract_sentence_match_rate"),
    )


def suitability(full_match_rate: Column) -> Column:
    """Class of a question by the share of its rows that match completely."""
    return (
        F.when(full_match_rate >= 1.0, "strict_sentence_extraction")
        .when(full_match_rate >= 0.9, "strong_sentence_rag_candidate")
        .when(full_match_rate >= 0.5, "mixed_sentence_rag_candidate")
        .otherwise("not_sentence_rag_suitable")
    )


def _per_question(records: DataFrame) -> DataFrame:
    return records.groupBy("question_index").agg(
        F.min_by("category", "document_row_id").alias("category"), *_eligibility_counts()
    )


def eligibility_by_question(records: DataFrame) -> DataFrame:
    full = _rate(F.col("full_match_rows"), F.col("rows_with_gold"))
    return _per_question(records).select(
        "question_index",
        "category",
        F.col("rows_total").alias("evaluated_contract_rows"),
        F.col("rows_with_gold").alias("rows_with_split_golden_answer_sentences"),
        "full_match_rows",
        F.round(full, 4).alias("full_match_rate"),
        F.col("gold_count").alias("split_golden_sentence_count"),
        F.col("raw_count").alias("raw_contract_matched_split_golden_sentence_count"),
        F.round(_rate(F.col("raw_count"), F.col("gold_count")), 4).alias("raw_contract_sentence_match_rate"),
        F.col("matched_count").alias("matched_split_golden_sentence_count"),
        F.round(_rate(F.col("matched_count"), F.col("gold_count")), 4).alias("split_sentence_match_rate"),
        ((F.col("rows_with_gold") > 0) & (F.col("full_match_rows") == F.col("rows_with_gold"))).alias(
            "strict_sentence_extraction_question"
        ),
        suitability(full).alias("rag_suitability"),
    )


def chunk_matching_by_question(records: DataFrame) -> DataFrame:
    """Full, partial and missing matches per question over rows that have golden sentences."""
    rows = F.col("rows_with_gold")
    return _per_question(records.where(F.col("gold_sentence_count") > 0)).select(
        "question_index",
        "category",
        rows.alias("rows_with_split_golden_answer_sentences"),
        "full_match_rows",
        "partial_match_rows",
        "no_match_rows",
        F.round(_rate(F.col("full_match_rows"), rows), 4).alias("full_match_rate"),
        F.round(_rate(F.col("partial_match_rows"), rows), 4).alias("partial_match_rate"),
        F.round(_rate(F.col("no_match_rows"), rows), 4).alias("no_match_rate"),
        F.col("gold_count").alias("split_golden_sentence_count"),
        F.col("matched_count").alias("matched_split_golden_sentence_count"),
        F.round(_rate(F.col("matched_count"), F.col("gold_count")), 4).alias("split_sentence_match_rate"),
        F.col("raw_count").alias("raw_contract_matched_sentence_count"),
        F.round(_rate(F.col("raw_count"), F.col("gold_count")), 4).alias("raw_contract_match_rate"),
    )


def compare_versions_by_question(baseline: DataFrame, comparison: DataFrame, baseline_name: str, comparison_name: str) -> DataFrame:
    """Full outer comparison of two chunking versions; a missing side counts as zero."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        counts = _per_question(df.where(F.col("gold_sentence_count") > 0))
        return counts.select(
            "question_index",
            F.col("category").alias(f"{prefix}_category"),
            F.col("rows_with_gold").alias(f"{prefix}_rows"),
            F.col("full_match_rows").alias(f"{prefix}_full_match_rows"),
            F.col("partial_match_rows").alias(f"{prefix}_partial_match_rows"),
            F.col("no_match_rows").alias(f"{prefix}_no_match_rows"),
            F.col("matched_count").alias(f"{prefix}_matched_split_golden_sentence_count"),
            _rate(F.col("matched_count"), F.col("gold_count")).alias(f"{prefix}_split_sentence_match_rate"),
        )

    both = side(baseline, "baseline").join(side(comparison, "comparison"), "question_index", "full_outer")
    numbers = [c for c in both.columns if c != "question_index" and not c.endswith("_category")]
    both = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    delta = lambda c: F.col(f"baseline_{c}") - F.col(f"comparison_{c}")
    rates = [c for c in numbers if c.endswith("_rate")]
    return both.select(
        "question_index",
        F.coalesce("baseline_category", "comparison_category", F.lit("")).alias("category"),
        F.lit(baseline_name).alias("baseline_version"),
        F.lit(comparison_name).alias("comparison_version"),
        *[c for c in numbers if c not in rates],
        *[F.round(c, 4).alias(c) for c in rates],
        delta("full_match_rows").alias("full_match_row_delta"),
        F.round(delta("split_sentence_match_rate"), 4).alias("split_sentence_match_rate_delta"),
    )


def review_rows(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Answerable rows with golden sentences and their match status, for manual review."""
    answerable = rows.where(~F.coalesce("is_impossible", F.lit(False))).select("row_id", "question", "answers")
    gold, matched = F.col("gold_sentence_count"), F.col("matched_sentence_count")
    status = F.when(matched == gold, "full_match").when(matched > 0, "partial_match").otherwise("no_match")
    return records.where(gold > 0).join(answerable, "row_id").withColumn("match_status", status)
