"""Cosine ranking: sparse TF-IDF vectors and dense embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import unicode_tokens, with_bigrams
from spanlake.operators.lexical import (
    DOC,
    POS,
    QUERY,
    chunk_terms,
    document_frequencies,
    postings,
    query_terms,
    rank_top,
    sum_scores,
    zero_scores,
)

# A term in at least this share of all (chunk, term) entries counts as hot; there can be at most
# 1 / HOT_SHARE such terms, which bounds what is broadcast whatever the size of the collection.
HOT_SHARE = 1e-4


def ngram_terms(text: Column) -> Column:
    return with_bigrams(unicode_tokens(text))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def lookup_by_term(rows: DataFrame, table: DataFrame, entries: Column, value: str) -> DataFrame:
    """Inner join of ``rows`` with a (term, df, value) table that tolerates very frequent terms.

    Frequent terms are few by definition (see HOT_SHARE), so they are looked up by broadcast; all other
    rows go through a shuffled join, and rows already resolved travel under a spread key that matches
    nothing, so no task receives all rows of one frequent term.
    """
    hot = table.where(F.col("df") >= F.greatest(entries * HOT_SHARE, F.lit(1.0))).select("term", F.col(value).alias("hot_value"))
    tagged = rows.join(F.broadcast(hot), "term", "left")
    spread = F.concat(F.lit("\n"), F.xxhash64(DOC, POS).cast("string"))
    tagged = tagged.withColumn("lookup", F.when(F.col("hot_value").isNull(), F.col("term")).otherwise(spread))
    cold = table.select(F.col("term").alias("lookup"), F.col(value).alias("cold_value"))
    found = tagged.join(cold, "lookup", "left").withColumn(value, F.coalesce("hot_value", "cold_value"))
    return found.where(F.col(value).isNotNull()).drop("lookup", "hot_value", "cold_value")


def tfidf_table(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens of the chunks, (term, df, idf) over the whole collection)."""
    tokens = chunk_terms(chunks, ngram_terms)
    n = tokens.agg(F.count(F.lit(1)).alias("n")).scalar()
    return tokens, document_frequencies(tokens).withColumn("idf", smooth_idf(F.col("df"), n))


def tfidf_weights(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unnormalised TF-IDF weights of the chunks the queries can reach, and the idf table."""
    tokens, table = tfidf_table(chunks)
    # Reads the same shuffled counts as the look-up below, so nothing is counted twice.
    entries = document_frequencies(tokens).agg(F.sum("df").alias("entries")).scalar()
    reachable = tokens.join(queries.select(DOC).distinct(), DOC, "left_semi")
    found = lookup_by_term(postings(reachable), table, entries, "idf")
    return found.select(DOC, POS, "term", (F.col("tf") * F.col("idf")).alias("weight")), table


def tfidf_scores(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of the query with every chunk sharing a term, plus the zero fill needed for lists of k."""
    weights, table = tfidf_weights(chunks, queries)
    norms = weights.groupBy(DOC, POS).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    wanted = query_terms(queries, ngram_terms).join(table, "term")
    wanted = wanted.select(QUERY, DOC, "term", (F.col("qtf") * F.col("idf")).alias("query_weight"))
    query_norms = wanted.groupBy(QUERY).agg(F.sqrt(F.sum(F.col("query_weight") ** 2)).alias("query_norm"))
    dots = (
        wanted.join(weights, [DOC, "term"])
        .groupBy(QUERY, DOC, POS)
        .agg(F.sum(F.col("query_weight") * F.col("weight")).alias("dot"))
    )
    cosine = dots.join(norms, [DOC, POS]).join(query_norms, QUERY)
    cosine = cosine.select(QUERY, DOC, POS, (F.col("dot") / (F.col("norm") * F.col("query_norm"))).alias("score"))
    return sum_scores(cosine, zero_scores(queries, chunks, k))


def tfidf_search(chunks: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, document_row_id, chunk_pos, score, rank) by TF-IDF cosine inside the query's document."""
    return rank_top(tfidf_scores(chunks, queries, k), k)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(left: Column, right: Column) -> Column:
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def dense_search(chunks: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """Exact dense search: ``chunks`` carry ``vector``, ``queries`` carry ``query_vector``.

    Exact search has to look at every vector of the query's document. The products are streamed out of the
    equi-join on the document and cut to k per query inside each task before anything is shuffled again.
    """
    pairs = queries.select(QUERY, DOC, "query_vector").join(chunks.select(DOC, POS, "vector"), DOC)
    scored = pairs.select(QUERY, DOC, POS, F.coalesce(cosine(F.col("query_vector"), F.col("vector")), F.lit(0.0)).alias("score"))
    return rank_top(scored, k)


def mean_vectors(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, summed per (group, dimension) with map-side combine."""
    cells = vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))  # one entry per dimension
    return cells.groupBy(group).agg(F.transform(ordered, lambda c: c["x"]).alias("mean_vector"))


def embed_texts(df: DataFrame, encoder, text: str = "normalized_text", output: str = "vector") -> DataFrame:
    """Add vectors from ``encoder(list[str]) -> array-like``, called on Arrow batches; loaded once per task."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def encode(values: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder(values.fillna("").tolist())])

    return df.withColumn(output, encode(F.col(text)))
