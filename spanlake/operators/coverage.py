"""Coverage of golden sentences by ranked chunks, and summaries per method, row and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10, 20, 30)


def coverage(golds: DataFrame, retrieved: DataFrame, retrievers: list[str], cutoffs=CUTOFFS) -> DataFrame:
    """Coverage at every cutoff for each (row, retriever), in one aggregate.

    ``golds``: row_id, gold_ids (array, repeats allowed). ``retrieved``: row_id, retriever, rank, sentence_ids.
    A row without results gets coverage 0 for each retriever of the (short, literal) list.
    """
    wanted = golds.select(
        "row_id",
        F.explode(F.array(*[F.lit(r) for r in retrievers])).alias("retriever"),
        F.array_distinct("gold_ids").alias("gold_ids"),
    )
    wanted = wanted.select("row_id", "retriever", F.posexplode("gold_ids").alias("gold_pos", "sentence_id"))
    hits = (
        retrieved.select("row_id", "retriever", "rank", F.explode("sentence_ids").alias("sentence_id"))
        .groupBy("row_id", "retriever", "sentence_id")
        .agg(F.min("rank").alias("rank"))
    )
    joined = wanted.join(hits, ["row_id", "retriever", "sentence_id"], "left")
    total = F.count(F.lit(1))
    deepest = F.col("rank") <= max(cutoffs)
    columns = [total.alias("gold_sentence_count"), F.min(F.when(deepest, F.col("rank"))).alias("first_covering_rank")]
    for k in cutoffs:
        covered = F.count_if(F.col("rank") <= k)
        columns.append((covered / total).alias(f"gold_sentence_coverage_at_{k}"))
        columns.append((covered == total).alias(f"covered_at_{k}"))
    return joined.groupBy("row_id", "retriever").agg(*columns)


def coverage_of_lists(gold: Column, retrieved: Column, k: int) -> Column:
    """Coverage of one id list by the first k ids of another, inside a row."""
    distinct = F.array_distinct(gold)
    top = F.slice(retrieved, 1, k)
    covered = F.filter(distinct, lambda g: F.array_contains(top, g))
    ranks = F.transform(covered, lambda g: F.array_position(top, g))
    return F.struct(
        F.lit(k).alias("k"),
        F.size(distinct).alias("gold_sentence_count"),
        F.size(covered).alias("covered_sentence_count"),
        F.coalesce(F.try_divide(F.size(covered).cast("double"), F.size(distinct)), F.lit(0.0)).alias("gold_sentence_coverage"),
        ((F.size(distinct) > 0) & (F.size(covered) == F.size(distinct))).alias("all_gold_sentences_covered"),
        covered.alias("covered_sentence_ids"),
        F.array_min(ranks).alias("first_covering_rank"),
    )


def summarize_methods(covered: DataFrame, retrievers: list[str], cutoffs=CUTOFFS) -> DataFrame:
    """Mean coverage and all-covered rate per retriever; a retriever without rows gets zeros."""
    means = [F.count(F.lit(1)).alias("rows")]
    for k in cutoffs:
        means.append(F.avg(f"gold_sentence_coverage_at_{k}").alias(f"gold_sentence_coverage_at_{k}"))
        means.append(F.avg(F.col(f"covered_at_{k}").cast("double")).alias(f"all_gold_covered_rate_at_{k}"))
    summary = covered.groupBy("retriever").agg(*means)
    names = covered.sparkSession.createDataFrame([(r,) for r in retrievers], "retriever string")
    return names.join(summary, "retriever", "left").na.fill(0).na.fill(0.0)


def summarize_rows(covered: DataFrame, retrievers: list[str], cutoffs=(10, 20, 30)) -> DataFrame:
    """One row per evaluation row: best coverage, best retriever (first of the list on ties) and one column set per retriever."""
    order = F.array_position(F.array(*[F.lit(r) for r in retrievers]), F.col("retriever"))
    columns = [F.max("gold_sentence_count").alias("gold_sentence_count"), F.count(F.lit(1)).alias("retriever_count")]
    for k in cutoffs:
        best = F.max(F.struct(F.col(f"gold_sentence_coverage_at_{k}").alias("c"), (-order).alias("o"), F.col("retriever").alias("r")))
        columns += [
            best["c"].alias(f"best_gold_sentence_coverage_at_{k}"),
            F.bool_or(f"covered_at_{k}").alias(f"any_covered_at_{k}"),
            best["r"].alias(f"best_retriever_at_{k}"),
        ]
    columns.append(F.min("first_covering_rank").alias("best_first_covering_rank"))
    for name in sorted(retrievers):
        is_it = F.col("retriever") == name
        prefix = name.replace("-", "_")
        for k in cutoffs:
            columns.append(F.max(F.when(is_it, F.col(f"gold_sentence_coverage_at_{k}"))).alias(f"{prefix}_coverage_at_{k}"))
            columns.append(F.bool_or(F.when(is_it, F.col(f"covered_at_{k}"))).alias(f"{prefix}_covered_at_{k}"))
        columns.append(F.min(F.when(is_it, F.col("first_covering_rank"))).alias(f"{prefix}_first_covering_rank"))
    return covered.groupBy("row_id").agg(*columns)


def macro_means(covered: DataFrame, group: str, cutoffs=(10, 20, 30)) -> DataFrame:
    """Mean over groups of the mean inside each group, per retriever."""
    names = [f"gold_sentence_coverage_at_{k}" for k in cutoffs]
    inner = covered.groupBy("retriever", group).agg(*[F.avg(n).alias(n) for n in names])
    return inner.groupBy("retriever").agg(F.count(F.lit(1)).alias("groups"), *[F.avg(n).alias(n) for n in names])


def against_base(summary: DataFrame, bases: dict[str, str], metric: str, default: str = "bm25_sentence") -> DataFrame:
    """Difference of each retriever to the default and to its own flat counterpart.

    ``summary`` has one row per retriever, so the look-up is two joins on that short table.
    """
    mapping = summary.sparkSession.createDataFrame(list(bases.items()), "retriever string, base string")
    value = summary.select("retriever", F.col(metric).alias("value"))
    base = value.select(F.col("retriever").alias("base"), F.col("value").alias("base_value"))
    default_value = value.where(F.col("retriever") == default).select("value").scalar()
    return (
        value.join(mapping, "retriever", "left")
        .join(base, "base", "left")
        .select(
            "retriever",
            "value",
            (F.col("value") - default_value).alias("delta_to_default"),
            (F.col("value") - F.col("base_value")).alias("delta_to_base"),
        )
    )


def best_per_row(df: DataFrame, key: str, value: str, order: str, label: str) -> DataFrame:
    """Label with the largest value per key; nulls are skipped and the first in order wins ties."""
    ranked = W.partitionBy(key).orderBy(F.col(value).desc(), F.col(order))
    best = df.where(F.col(value).isNotNull()).withColumn("n", F.row_number().over(ranked)).where(F.col("n") == 1)
    return best.select(key, F.col(label).alias(f"best_{label}"), F.col(value).alias(f"best_{value}"))
