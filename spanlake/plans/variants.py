"""Question and context variants of evaluation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.operators.retrieve import flat_context, retrieve, sectioned_context
from spanlake.operators.scoring import with_token_f1
from spanlake.operators.term_index import TermIndex
from spanlake.plans.answers import dry_run_predictions
from spanlake.session import cut_lineage

# Variant labels.
QUESTION_LABELS = {"raw": "raw_q", "enriched": "enriched_v1"}
CONTEXT_LABELS = {
    "raw": "raw_ctx",
    "rag-dense": "rag_dense",
    "rag-hybrid": "rag_hybrid",
    "rag-hierarchical-bm25": "rag_hier_bm25",
    "rag-hierarchical-dense": "rag_hier_dense",
}
CONTEXT_METHODS = {
    "rag-dense": "dense_sentence",
    "rag-hybrid": "hybrid",
    "rag-hierarchical-bm25": "bm25_hierarchical",
    "rag-hierarchical-dense": "dense_hierarchical",
}


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def variant_grid(rows: DataFrame, question_modes=tuple(QUESTION_LABELS), context_modes=tuple(CONTEXT_LABELS)) -> DataFrame:
    """Each row once per (question mode, context mode); two literal lists, so no join is needed."""
    for mode in question_modes:
        if mode not in QUESTION_LABELS:
            raise ValueError(f"unknown question mode: {mode}")
    for mode in context_modes:
        if mode not in CONTEXT_LABELS:
            raise ValueError(f"unknown context mode: {mode}")
    grid = rows.withColumn("question_mode", F.explode(_names(question_modes))).withColumn("context_mode", F.explode(_names(context_modes)))
    label = lambda labels, c: F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col(c))
    return grid.withColumn(
        "variant_name", F.concat_ws(" / ", label(QUESTION_LABELS, "question_mode"), label(CONTEXT_LABELS, "context_mode"))
    )


def contexts(queries: DataFrame, chunks: DataFrame, documents: DataFrame, mode: str, top_k: int = 30, index: TermIndex | None = None, **options) -> DataFrame:
    """(query_id, context) for one context mode."""
    if mode == "raw":
        texts = documents.select("document_row_id", F.col("text").alias("context"))
        return queries.select("query_id", "document_row_id").join(texts, "document_row_id").select("query_id", "context")
    method = CONTEXT_METHODS[mode]
    hierarchical = method.endswith("_hierarchical")
    ranked = retrieve(chunks, queries, method, top_k, index=index, **(options if hierarchical else {}))
    build = sectioned_context if hierarchical else flat_context
    return build(ranked, chunks).select("query_id", "context")


def run_variants(
    rows: DataFrame, documents: DataFrame, chunks: DataFrame, prompts: DataFrame | None = None, question_modes=tuple(QUESTION_LABELS), context_modes=tuple(CONTEXT_LABELS), top_k: int = 30, predict=dry_run_predictions, index: TermIndex | None = None, **options
) -> DataFrame:
    """Predictions and scores for every variant of the rows.

    ``rows``: row_id, document_row_id, question_index, category, base_query, enriched_query,
    enrichment_terms, golds. A category without a prompt is an error when prompts are given.
    """
    if prompts is not None:
        unknown = rows.join(prompts.select("category"), "category", "left_anti").select("category").distinct().limit(5).collect()
        if unknown:
            raise ValueError(f"no prompt for categories {sorted(r.category for r in unknown)}")
    grid = variant_grid(rows, question_modes, context_modes).withColumns(
        {
            "retrieval_query": F.when(F.col("question_mode") == "raw", F.col("base_query")).otherwise(F.coalesce("enriched_query", "base_query")),
            "hint_used": F.when(
                (F.col("question_mode") == "enriched") & (F.col("context_mode") == "raw"), F.coalesce("enrichment_terms", F.lit(""))
            ).otherwise(""),
            "query_id": F.concat_ws("|", "row_id", "question_mode"),
        }
    )
    grid = cut_lineage(grid)
    found = []
    for mode in context_modes:
        mine = grid.where(F.col("context_mode") == mode)
        queries = mine.select("query_id", "document_row_id", F.col("retrieval_query").alias("query"))
        found.append(mine.join(contexts(queries, chunks, documents, mode, top_k, index, **options), "query_id", "left"))
    answered = predict(reduce(DataFrame.unionByName, found))
    scored = with_token_f1(answered, "predicted_answer", F.col("golds"))
    return scored.select(
        "variant_name", "question_mode", "context_mode", "retrieval_query", "hint_used", "predicted_answer",
        F.to_json("golds").alias("gold_answers"), "token_f1", (F.col("token_f1") >= 0.5).alias("correct_at_0_5"),
        "enrichment_terms", "document_row_id", "question_index", "category",
    )
