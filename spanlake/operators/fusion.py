"""Reciprocal-rank fusion and section-expanding retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.operators.lexical import DOC, POS, QUERY, bm25_scores, of_asked, rank_top
from spanlake.operators.term_index import TermIndex, bm25_index_scores, tfidf_index_scores
from spanlake.operators.vectors import tfidf_scores
from spanlake.session import cut_lineage

# Fusion constant, leaf depth, number of sections, name of the missing section.
RRF_K = 60
LEAF_K = 50
TOP_SECTIONS = 5
UNSECTIONED = "_unsectioned"


def fuse_ranked(dense: DataFrame, bm25: DataFrame, k: int = 30, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over both lists; ties follow the dense list, then the lexical list.

    A union and one aggregate replace the full outer join: both lists are already at most k rows per query.
    """
    none = F.lit(None).cast("int")
    both = dense.select(QUERY, DOC, POS, F.col("rank").alias("dense_rank"), none.alias("bm25_rank")).unionByName(
        bm25.select(QUERY, DOC, POS, none.alias("dense_rank"), F.col("rank").alias("bm25_rank"))
    )
    merged = both.groupBy(QUERY, DOC, POS).agg(F.max("dense_rank").alias("dense_rank"), F.max("bm25_rank").alias("bm25_rank"))
    share = lambda rank: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))
    merged = merged.withColumn("score", share("dense_rank") + share("bm25_rank"))
    order = W.partitionBy(QUERY).orderBy(
        F.round("score", 12).desc(), F.col("dense_rank").isNull(), F.col("dense_rank"), F.col("bm25_rank")
    )
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def section_key(path: Column | str = "clause_path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.when(F.size(F.coalesce(path, F.array())) > 0, path).otherwise(F.array(F.lit(UNSECTIONED)))


def section_index(spans: DataFrame) -> DataFrame:
    """Sections of each document in first-seen order with their sentence ids; equal keys merge."""
    keyed = spans.withColumn("section_key", section_key())
    meta = F.struct("sentence_index", "section_number", "section_title")
    grouped = keyed.groupBy(DOC, "section_key").agg(
        F.min(meta).alias("first"), F.sort_array(F.collect_list(F.struct("sentence_index", "sentence_id"))).alias("members")
    )
    return grouped.select(
        DOC,
        "section_key",
        F.col("first.sentence_index").alias("first_index"),
        F.col("first.section_number").alias("section_number"),
        F.col("first.section_title").alias("section_title"),
        F.transform("members", lambda m: m["sentence_id"]).alias("sentence_ids"),
    )


def _expand(scores: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, leaf_k: int, top_sections: int) -> DataFrame:
    """Best leaves -> sections with the largest sums -> all chunks of those sections, ranked again."""
    sections = of_asked(chunks.select(DOC, POS, section_key().alias("section_key")), queries)
    # Read by the leaf ranking and again by the section ranking: scored once, stored, read twice.
    scored = cut_lineage(scores.join(sections, [DOC, POS]))
    leaves = rank_top(scored, leaf_k)
    sums = leaves.groupBy(QUERY, DOC, "section_key").agg(F.sum("score").alias("section_score"), F.min("rank").alias("first_rank"))
    best = W.partitionBy(QUERY).orderBy(F.round("section_score", 9).desc(), F.col("first_rank"))
    top = sums.withColumn("section_rank", F.row_number().over(best)).where(F.col("section_rank") <= top_sections)
    top = top.select(QUERY, DOC, "section_key")

    # Positive scores inside the chosen sections, and enough zero-score chunks of each section to fill a list.
    place = W.partitionBy(DOC, "section_key").orderBy(POS)
    heads = sections.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")
    fill = top.join(heads, [DOC, "section_key"]).select(QUERY, DOC, POS, F.lit(0.0).alias("score"))
    inside = scored.join(top, [QUERY, DOC, "section_key"], "left_semi").select(QUERY, DOC, POS, "score")
    both = inside.unionByName(fill).groupBy(QUERY, DOC, POS).agg(F.sum("score").alias("score"))
    return rank_top(both, k)


def hierarchical_search(
    chunks: DataFrame,
    queries: DataFrame,
    method: str = "bm25_hierarchical",
    k: int = 30,
    leaf_k: int = LEAF_K,
    top_sections: int = TOP_SECTIONS,
    index: TermIndex | None = None,
) -> DataFrame:
    """Section-expanding retrieval on BM25 or TF-IDF leaf scores, from the stored index if there is one."""
    scorers = {"bm25_hierarchical": (bm25_scores, bm25_index_scores), "dense_hierarchical": (tfidf_scores, tfidf_index_scores)}
    if method not in scorers:
        raise ValueError(f"unsupported hierarchical retriever: {method}")
    from_chunks, from_index = scorers[method]
    scores = from_chunks(chunks, queries, leaf_k) if index is None else from_index(index, queries, leaf_k)
    return _expand(scores, chunks, queries, k, leaf_k, top_sections)
