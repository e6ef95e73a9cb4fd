"""Retrieval benchmark: eligibility, enrichment, retrieval per method, coverage, summaries, outputs.

Tables that several branches read (queries, eligible rows, ranked lists) are written once to the shared
folder and read back, so a branch neither repeats the work above it nor loses it with an executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import coverage as C
from spanlake.operators import enrichment as E
from spanlake.operators import gold as G
from spanlake.operators.chunk import sentence_chunks
from spanlake.operators.fusion import fuse_ranked
from spanlake.operators.lexical import attach_chunks, of_asked
from spanlake.operators.retrieve import HIERARCHICAL_METHODS, RECURSIVE_METHODS, retrieve
from spanlake.operators.term_index import TermIndex
from spanlake.plans.stores import RECURSIVE_VERSION, stored_index, stored_recursive_chunks, stored_spans
from spanlake.session import cut_lineage
from spanlake.sinks.report import write_report
from spanlake.sinks.tables import output_layout, write_csv, write_document, write_json_lines


def eligible_queries(rows: DataFrame, records: DataFrame, **texts) -> tuple[DataFrame, DataFrame]:
    """(queries, golden ids) of the eligible rows; one query column per keyword argument."""
    eligible = records.where("is_eligible").select("row_id", F.col("matched_sentence_ids").alias("gold_ids"))
    kept = rows.join(eligible, "row_id").select("row_id", "document_row_id", "gold_ids", *[c.alias(n) for n, c in texts.items()])
    stored = cut_lineage(kept)
    return stored, stored.select("row_id", "gold_ids")


def as_queries(stored: DataFrame, column: str) -> DataFrame:
    return stored.select(F.col("row_id").alias("query_id"), "document_row_id", F.col(column).alias("query"))


def _labelled(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.select("query_id", "document_row_id", "chunk_pos", "score", "rank", F.lit(name).alias("retriever"))


def benchmark_methods(
    rows: DataFrame, chunks: DataFrame | dict[str, DataFrame], records: DataFrame, methods: list[str], top_k: int = 30, cutoffs=C.CUTOFFS, index: TermIndex | dict[str, TermIndex] | None = None, **options
) -> DataFrame:
    """Coverage of every eligible row by every method. ``chunks`` and their stored ``index`` may be given per method."""
    stored, golds = eligible_queries(rows, records, query=E.base_query())
    queries = as_queries(stored, "query")
    found = []
    for method in methods:
        own = chunks[method] if isinstance(chunks, dict) else chunks
        terms = index.get(method) if isinstance(index, dict) else index
        ranked = retrieve(own, queries, method, top_k, index=terms, **(options if method in HIERARCHICAL_METHODS else {}))
        found.append(attach_chunks(_labelled(ranked, method), of_asked(own, queries), "sentence_ids"))
    retrieved = reduce(DataFrame.unionByName, found).withColumnRenamed("query_id", "row_id")
    return C.coverage(golds, retrieved, methods, cutoffs)


def compare_queries(rows: DataFrame, chunks: DataFrame, records: DataFrame, cutoffs=(10, 20, 30), index: TermIndex | None = None) -> DataFrame:
    """Base against enriched queries, dense and fused; ``rows`` carry ``enriched_query``."""
    stored, golds = eligible_queries(rows, records, baseline=E.base_query(), enriched=F.col("enriched_query"))
    # Both query variants go through one search: the variant is part of the query id.
    variants = stored.select("row_id", "document_row_id", F.explode(F.create_map(F.lit("baseline"), "baseline", F.lit("enriched"), "enriched")).alias("variant", "query"))
    queries = variants.select(F.concat_ws("|", "variant", "row_id").alias("query_id"), "document_row_id", "query")
    dense = cut_lineage(retrieve(chunks, queries, "dense_sentence", max(cutoffs), index=index))
    lexical = retrieve(chunks, queries, "bm25_sentence", max(cutoffs), index=index)
    variant = F.substring_index("query_id", "|", 1)
    flat = _labelled(dense, "").withColumn("retriever", variant)
    fused = _labelled(fuse_ranked(dense, lexical, max(cutoffs)), "").withColumn("retriever", F.concat(variant, F.lit("_hybrid")))
    retrieved = attach_chunks(flat.unionByName(fused), of_asked(chunks, queries), "sentence_ids")
    retrieved = retrieved.withColumn("row_id", F.substring_index("query_id", "|", -1))
    covered = C.coverage(golds, retrieved, ["baseline", "enriched", "baseline_hybrid", "enriched_hybrid"], cutoffs)
    return E.enrichment_deltas(covered, cutoffs)


def run(
    documents: DataFrame,
    rows: DataFrame,
    output: str,
    run_id: str,
    methods: list[str],
    top_k: int = 30,
    cache: str | None = None,
    preflight_only: bool = False,
    rebuild: bool = False,
    leaf_k: int = 50,
    top_sections: int = 5,
) -> dict:
    """Whole benchmark; returns the summary and writes tables, summary JSON and an HTML report."""
    paths = output_layout(output, run_id)
    cache = cache or f"{output}/rag_cache"
    spans = stored_spans(documents, cache, rebuild)
    chunks = {m: sentence_chunks(spans) for m in methods}
    if set(methods) & set(RECURSIVE_METHODS):
        recursive = stored_recursive_chunks(documents, cache, rebuild)
        chunks.update({m: recursive for m in methods if m in RECURSIVE_METHODS})
    index = {}
    if not preflight_only:
        sentences = stored_index(documents, sentence_chunks(spans), cache, rebuild=rebuild)
        index = {m: stored_index(documents, recursive, cache, RECURSIVE_VERSION, rebuild) if m in RECURSIVE_METHODS else sentences for m in methods}
    records = cut_lineage(G.eligibility(rows, spans, documents))
    write_json_lines(records, paths["eligibility"])
    per_question = G.eligibility_by_question(records).orderBy("question_index")
    matching = G.chunk_matching_by_question(records).orderBy("question_index")
    enrichments = E.enrich_questions(rows)
    summary = {"run_id": run_id, "preflight_only": preflight_only, "enrichment_status": [r.asDict() for r in enrichments.groupBy("status").count().collect()]}
    summary["eligibility"] = G.summarize_eligibility(records).first().asDict()
    tables = {"eligibility by question": per_question, "matching by question": matching, "enrichment": enrichments.orderBy("question_index")}
    if not preflight_only:
        cutoffs = tuple(sorted({*C.CUTOFFS, top_k}))
        covered = cut_lineage(
            benchmark_methods(rows, chunks, records, methods, max(top_k, 30), cutoffs, index, leaf_k=leaf_k, top_sections=top_sections)
        )
        ranking = C.summarize_methods(covered, methods, cutoffs)
        summary["ranking"] = [r.asDict() for r in ranking.collect()]
        enriched = rows.join(enrichments.select("question_index", "enriched_query"), "question_index", "left").withColumn(
            "enriched_query", F.coalesce("enriched_query", E.base_query())
        )
        tables["ranking"] = ranking
        effect = compare_queries(enriched, sentence_chunks(spans), records, index=sentences)
        tables["enrichment effect"] = E.summarize_deltas(effect, rows).orderBy("question_index")
        tables["rows"] = C.summarize_rows(covered, methods, tuple(sorted({10, 20, 30, top_k})))
        write_json_lines(covered, paths["retrieval"])
        write_csv(tables["rows"], paths["rows"])
        write_csv(ranking, paths["ranking"], single_file=True)
    write_document(summary, paths["summary"] + ".json")
    write_report(paths["html"], f"Retrieval benchmark {run_id}", summary["eligibility"], tables)
    return summary
