"""BM25 ranking inside each document with statistics of the whole collection.

Shape of the plan: tokenise chunks once per use; term frequencies are counted inside the row; document
frequencies are one aggregate with map-side combine; queries meet postings in an equi-join on (document,
term), so only matching pairs exist. Chunks that match nothing are needed only to fill a list up to k, and
the first k chunks of the document are always enough for that, so they are added as zero scores instead of
pairing every query with every chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import term_counts, tokenize

# BM25 parameters.
K1 = 1.5
B = 0.75

QUERY, DOC, POS = "query_id", "document_row_id", "chunk_pos"


def chunk_terms(chunks: DataFrame, terms=tokenize, text: str = "normalized_text") -> DataFrame:
    """(document, position, token array, length) of each chunk."""
    tokens = chunks.select(DOC, POS, terms(F.col(text)).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """(document, position, dl, term, tf); no shuffle, because repeats are counted inside the row."""
    return explode_rows(tokens, term_counts(F.col("tokens")), DOC, POS, "dl", names=("n", "p")).select(
        DOC, POS, "dl", F.col("p.term").alias("term"), F.col("p.tf").alias("tf")
    )


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """Chunks holding each term; partial counts are combined before the shuffle."""
    terms = tokens.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return tokens.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, terms=tokenize) -> DataFrame:
    """(query, document, term, multiplicity)."""
    counted = queries.select(QUERY, DOC, terms(F.col("query")).alias("tokens"))
    return explode_rows(counted, term_counts(F.col("tokens")), QUERY, DOC, names=("n", "p")).select(
        QUERY, DOC, F.col("p.term").alias("term"), F.col("p.tf").alias("qtf")
    )


def of_asked(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of the documents that queries ask about."""
    return rows.join(queries.select(DOC).distinct(), DOC, "left_semi")


def zero_scores(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k chunks of each query's document with score 0: at most k rows per query."""
    first = chunks.where(F.col(POS) < k).select(DOC, POS)
    return queries.select(QUERY, DOC).join(first, DOC).select(QUERY, DOC, POS, F.lit(0.0).alias("score"))


def sum_scores(*parts: DataFrame) -> DataFrame:
    """Total score per (query, chunk) over partial scores and zero fill."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(QUERY, DOC, POS).agg(F.sum("score").alias("score"))


def _partial_scores(hits: DataFrame, terms: DataFrame, stats: DataFrame, queries: DataFrame, k1: float, b: float) -> DataFrame:
    n, avgdl = stats.select("n_chunks").scalar(), stats.select("avgdl").scalar()
    weighted = (
        query_terms(queries)
        .join(terms, "term")
        .select(QUERY, DOC, "term", (F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    )
    length = F.when(F.col("dl") == 0, 1).otherwise(F.col("dl"))
    mean = F.when(F.coalesce(avgdl, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(avgdl)
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / mean))
    gains = hits.select(DOC, POS, "term", saturation.alias("gain"))
    return weighted.join(gains, [DOC, "term"]).select(QUERY, DOC, POS, (F.col("weight") * F.col("gain")).alias("score"))


def bm25_parts(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Partial score of every (query, term, chunk) that matches."""
    tokens = chunk_terms(chunks)
    # Statistics cover the whole collection; postings are needed only for documents somebody asks about.
    reachable = of_asked(tokens, queries)
    return _partial_scores(postings(reachable), document_frequencies(tokens), collection_stats(tokens), queries, k1, b)


def rank_top(scores: DataFrame, k: int, by: tuple[str, ...] = (QUERY,), score: str = "score") -> DataFrame:
    """Best k chunks per query; equal scores keep collection order.

    Scores are compared after rounding to 9 digits, so that the order of a floating-point sum cannot decide
    a tie. The limit is applied inside each task before the shuffle (WindowGroupLimit), so a query that
    scores many chunks sends at most k rows per task.
    """
    order = W.partitionBy(*by).orderBy(F.round(score, 9).desc(), F.col(POS))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_scores(chunks: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Scores of all matching chunks plus the zero fill needed for lists of k."""
    return sum_scores(bm25_parts(chunks, queries, k1, b), zero_scores(queries, chunks, k))


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 30, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, document_row_id, chunk_pos, score, rank) of the best k chunks of the query's document."""
    return rank_top(bm25_scores(chunks, queries, k, k1, b), k)


def attach_chunks(ranked: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Add chunk columns to ranked rows."""
    return ranked.join(chunks.select(DOC, POS, *columns), [DOC, POS])


def score_of(column: str = "score") -> Column:
    return F.round(F.col(column), 6)
