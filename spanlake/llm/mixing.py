"""Mixing sources to target weights: every document is emitted floor(rate) times, and once more by a seeded coin.

Only DataFrame operations. Words are counted once per text; per-source totals are aggregated inside tasks first, so a
source with a third of all rows sends one row per task. The table of sources (one row each) is written, and Spark
broadcasts it only if its size allows; otherwise it is joined with skewed sources split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, max_rate: int = 3) -> DataFrame:
    """Adds ``target`` (double) to ``totals`` (source, source_size, weight: integers).

    The weights share the whole size. A target stops at ``max_rate`` times its source's size; what it leaves is shared
    by weight among the others until none is above. In order of size per weight, a source is full exactly if the level
    that remains for it and all later ones is not below its own, so one ordered pass settles all.
    """
    cap = F.col("source_size") * max_rate
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    levels = totals.where("weight > 0").select(
        "*",
        (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("_left"),
        F.sum("weight").over(after).alias("_weights"),
    )
    # size * rate / weight <= left / weights, without a division
    full = cap * F.col("_weights") <= F.col("_left") * F.col("weight")
    first = levels.where(~full).select(F.col("_left").alias("_rest"), F.col("_weights").alias("_shares")).orderBy(F.desc("_shares")).limit(1)
    first = first.unionByName(first.sparkSession.createDataFrame([(None, None)], first.schema)).agg(F.max("_rest").alias("_rest"), F.max("_shares").alias("_shares"))
    targeted = levels.withColumn("_full", full).join(F.broadcast(first))  # one row
    target = F.when(F.col("_full"), cap.cast("double")).otherwise((F.col("_rest") * F.col("weight")).cast("double") / F.col("_shares"))
    return targeted.withColumn("target", target).drop("_left", "_weights", "_full", "_rest", "_shares")


def ranked_weights(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ..., ``cycle``, repeating, over the sources by code point, null last."""
    return totals.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).cast("long"))


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the columns' text, the same on every run: 52 bits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights=ranked_weights, max_rate: int = 3, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies: how often the mix takes each document.

    ``docs`` needs ``key``, text and source. ``weights`` gives the per-source table (source, source_size) an integer
    column weight (a join with a table of weights will do; sources without a positive weight are left out with 0
    copies). The rate is target / source_size; copies are floor(rate) plus one if the coin of the key falls below the
    fraction. Null text has size 0; sources of size 0 have target 0. Null is a source of its own. Rows repeating a key
    share its coin. Columns of ``docs`` named like the new ones are replaced. An empty table stays empty.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    rows = docs.select(*[F.col(c) for c in docs.columns if c not in new]).withColumn("size", word_count("text"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut_lineage(source_targets(weights(cut_lineage(totals)), max_rate))
    plan = plan.select(F.col("source").alias("_source"), F.col("source_size").alias("_total"), F.col("target").alias("_target"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    with_rate = joined.withColumn("source_size", F.col("_total")).withColumn("target", F.col("_target")).withColumn("rate", F.coalesce(rate, F.lit(0.0))).drop("_source", "_total", "_target")
    coin = unit_hash(key, seed=seed) < F.col("rate") - F.floor("rate")
    return with_rate.withColumn("copies", (F.floor("rate") + coin.cast("int")).cast("long"))


def emit_mix(planned: DataFrame, keep: list[str]) -> DataFrame:
    """The mix itself: the columns ``keep`` of each document, once per copy. No shuffle."""
    many = planned.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return many.select(*keep)
