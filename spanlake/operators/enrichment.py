"""Query text, offline query enrichment and its evaluation."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import joined_nonblank, normalize_sentence, strip, term_counts, words
from spanlake.operators.vectors import ngram_terms

# Clause keywords and the contract words searched for when a keyword occurs.
KEYWORD_TERMS = {
    "non-compete": [
        "non-compete", "noncompetition", "covenant not to compete", "competing business", "competitive activities",
        "directly or indirectly compete", "restricted business", "restricted territory", "same or similar business",
        "engage in business",
    ],
    "anti-assignment": [
        "assign", "assignment", "transfer", "delegate", "written consent", "prior consent", "without consent",
        "successors and assigns",
    ],
    "governing law": ["governed by", "laws of", "jurisdiction", "venue"],
    "audit rights": ["audit", "inspect", "books", "records", "accountant", "compliance"],
    "exclusivity": ["exclusive", "sole", "only", "not appoint", "not engage"],
    "license": ["license", "licensed", "non-transferable", "sublicense", "scope"],
}
HINT_LABEL = "Contract words to look for:"
FALLBACK_TERMS = 12


def base_query() -> Column:
    return joined_nonblank("category", "category_description", "question")


def offline_terms(category: Column | str, question: Column | str, description: Column | str) -> Column:
    """Terms of all keywords in the text; without any, the first long words of category and description."""
    text = F.lower(F.concat_ws(" ", category, question, description))
    found = F.flatten(
        F.array(
            *[
                F.when(F.contains(text, F.lit(key)), F.array(*[F.lit(t) for t in terms])).otherwise(F.array().cast("array<string>"))
                for key, terms in KEYWORD_TERMS.items()
            ]
        )
    )
    long_words = F.filter(words(normalize_sentence(F.concat_ws(" ", category, description))), lambda w: F.length(w) > 4)
    chosen = F.when(F.size(found) > 0, found).otherwise(F.slice(long_words, 1, FALLBACK_TERMS))
    return F.array_join(F.array_distinct(chosen), "; ")


def enriched_query(question: Column | str, terms: Column | str) -> Column:
    return joined_nonblank(question, F.lit(HINT_LABEL), terms)


@F.pandas_udf(StringType())
def enrichment_key(index: pd.Series, category: pd.Series, question: pd.Series, description: pd.Series) -> pd.Series:
    """sha256 of the canonical JSON of a question (sorted keys, ASCII escapes)."""
    names = ("question_index", "category", "question", "category_description")
    rows = zip(index, category, question, description)
    return pd.Series([
        hashlib.sha256(json.dumps(dict(zip(names, (int(r[0]), *r[1:]))), sort_keys=True).encode()).hexdigest() for r in rows
    ])


def enrich_questions(questions: DataFrame, cache: DataFrame | None = None, provider: str = "offline") -> DataFrame:
    """One enrichment per question: the cached terms if the question is unchanged, otherwise offline terms."""
    from spanlake.operators.incremental import first_by_key

    first = first_by_key(questions, ["question_index"], ["document_row_id"] if "document_row_id" in questions.columns else ["category"])
    keyed = first.select(
        "question_index", "category", "question", F.coalesce("category_description", F.lit("")).alias("category_description")
    ).withColumn("cache_key", enrichment_key("question_index", "category", "question", "category_description"))
    offline = offline_terms("category", "question", "category_description")
    if cache is None:
        rows = keyed.withColumns({"enrichment_terms": offline, "provider": F.lit(provider), "status": F.lit("offline")})
    else:
        known = cache.select(
            "cache_key", F.col("enrichment_terms").alias("cached_terms"), F.col("provider").alias("cached_provider")
        )
        hit = F.col("cached_terms").isNotNull()
        rows = (
            keyed.join(known, "cache_key", "left")
            .withColumns(
                {
                    "enrichment_terms": F.coalesce("cached_terms", offline),
                    "provider": F.coalesce("cached_provider", F.lit(provider)),
                    "status": F.when(hit, "cached").otherwise("offline"),
                }
            )
            .drop("cached_terms", "cached_provider")
        )
    rows = rows.withColumn("enriched_query", enriched_query("question", "enrichment_terms"))
    return rows.select(
        "question_index", "category", "question", "category_description", "enrichment_terms", "enriched_query",
        "provider", "status", "cache_key",
    )


def text_similarity(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Mean and max TF-IDF cosine of ``query`` with the texts in ``golds``, statistics per row.

    The collection of each row is its own query plus its golden texts, so every aggregate is keyed by row.
    """
    golds = F.transform(F.filter("golds", lambda g: g != ""), lambda g: normalize_sentence(g))
    texts = rows.select(key, F.concat(F.array(F.col("query")), golds).alias("texts"))
    texts = explode_rows(texts, F.col("texts"), key, F.size("texts").alias("n"), names=("text_pos", "text"))
    grams = texts.withColumn("tokens", ngram_terms(F.col("text")))
    terms = explode_rows(grams, term_counts(F.col("tokens")), key, "n", "text_pos", names=("i", "p"))
    terms = terms.select(key, "n", "text_pos", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
    df = terms.groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("df"), F.max(F.when(F.col("text_pos") == 0, F.col("tf"))).alias("query_tf")
    )
    weighted = terms.join(df, [key, "term"]).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    square = (F.col("tf") * F.col("idf")) ** 2
    product = F.coalesce(F.col("tf") * F.col("query_tf") * F.col("idf") ** 2, F.lit(0.0))
    per_text = weighted.groupBy(key, "text_pos").agg(F.sqrt(F.sum(square)).alias("norm"), F.sum(product).alias("dot"))
    # The query is text 0, and its product with itself is the square of its norm.
    per_row = per_text.groupBy(key).agg(
        F.max(F.when(F.col("text_pos") == 0, F.col("norm"))).alias("query_norm"),
        F.sum(F.when(F.col("text_pos") > 0, F.col("dot") / F.col("norm"))).alias("total"),
        F.max(F.when(F.col("text_pos") > 0, F.col("dot") / F.col("norm"))).alias("best"),
    )
    counted = rows.select(key, F.size(golds).alias("n_gold"), (strip("query") != "").alias("has_query"))
    usable = F.col("has_query") & (F.col("n_gold") > 0)
    value = lambda c: F.when(usable, F.coalesce(F.try_divide(F.col(c), F.col("query_norm")), F.lit(0.0))).otherwise(0.0)
    return counted.join(per_row, key, "left").select(
        key, (value("total") / F.greatest("n_gold", F.lit(1))).alias("mean_similarity"), value("best").alias("max_similarity")
    )


def enrichment_deltas(covered: DataFrame, cutoffs=(10, 20, 30)) -> DataFrame:
    """Coverage of the base and enriched queries side by side; ``retriever`` holds variant names.

    Expected names: baseline, enriched, baseline_hybrid, enriched_hybrid.
    """
    columns = []
    for k in cutoffs:
        value = lambda name: F.max(F.when(F.col("retriever") == name, F.col(f"gold_sentence_coverage_at_{k}")))  # noqa: B023, E731
        for name in ("baseline", "enriched", "baseline_hybrid", "enriched_hybrid"):
            columns.append(F.coalesce(value(name), F.lit(0.0)).alias(f"{name}_gold_sentence_coverage_at_{k}"))
        columns.append((F.coalesce(value("enriched"), F.lit(0.0)) - F.coalesce(value("baseline"), F.lit(0.0))).alias(f"coverage_delta_at_{k}"))
        columns.append(
            (F.coalesce(value("enriched_hybrid"), F.lit(0.0)) - F.coalesce(value("baseline_hybrid"), F.lit(0.0))).alias(
                f"hybrid_coverage_delta_at_{k}"
            )
        )
    return covered.groupBy("row_id").agg(*columns)


def summarize_deltas(deltas: DataFrame, rows: DataFrame) -> DataFrame:
    """Per question: number of rows and the mean of every coverage column of ``enrichment_deltas``."""
    keyed = deltas.join(rows.select("row_id", "document_row_id", "question_index", "category"), "row_id")
    means = [F.avg(c).alias(c) for c in deltas.columns if c != "row_id"]
    return keyed.groupBy("question_index").agg(
        F.min_by("category", "document_row_id").alias("category"), F.count(F.lit(1)).alias("rows"), *means
    )
