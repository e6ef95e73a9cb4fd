"""Deterministic sampling and selection of evaluation rows."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.functions.text import row_key
from spanlake.operators.scoring import ensure_row_id

QUESTION_COUNT = 41
_BUCKETS = 4096


def with_position(ids: DataFrame, column: str) -> DataFrame:
    """0-based position of each distinct id in sorted order, without sorting everything in one task.

    Ids fall into at most 4096 equal-width ranges; only the range counts are summed in order, ids are
    ranked inside their range.
    """
    distinct = ids.select(column).distinct()
    bounds = distinct.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = F.greatest(F.ceil((hi - lo + 1) / F.lit(_BUCKETS)), F.lit(1))
    ranged = distinct.withColumn("range", F.floor((F.col(column) - lo) / width))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most 4096 rows
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("range").orderBy(column)
    placed = ranged.join(starts, "range").withColumn("position", F.col("start") + F.row_number().over(inside) - 1)
    return placed.select(column, "position")


def position_within(df: DataFrame, key: list[str], order: str, output: str, width: int = 1024) -> DataFrame:
    """0-based position of each row in its group by a whole-number order column that is unique in the group.

    Rows are ranked inside ranges of ``width`` order values, and only the range counts are summed per group,
    so a group with a third of all rows is spread over many tasks.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*key, "_range").orderBy(order)
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(starts, [*key, "_range"])
    return placed.withColumn(output, F.col("_start") + F.col("_place") - 1).drop("_range", "_start", "_place")


def sample_ids(ids: DataFrame, size: int, seed: int, column: str = "document_row_id") -> DataFrame:
    """Seeded sample of ids with their draw order; the same draw as sampling the sorted list of ids.

    Only the count reaches the driver; the drawn positions (``size`` of them) go back as a table.
    """
    total = ids.select(column).distinct().count()
    if size > total:
        raise ValueError(f"sample_size={size} exceeds available documents={total}")
    drawn = list(enumerate(random.Random(seed).sample(range(total), k=size)))
    spark = ids.sparkSession
    chosen = spark.createDataFrame(drawn, "selection_pos int, position bigint")
    return with_position(ids, column).join(chosen, "position").select(column, "selection_pos")


def permuted(position: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """The place of a position from 0 to n - 1 in a permutation of them that the seed determines.

    A Feistel network on pairs (position div b, position mod b) with a * b >= n: each round adds a hash of one half to the
    other, which can be undone, so pairs stay distinct. A result of n or more, of which there are less than a, is put in
    again until it is below n (cycle walking), which keeps the permutation exact.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        start = F.array(F.floor(x / b).cast("bigint"), F.pmod(x, F.lit(b)).cast("bigint"))
        step = lambda v, r: F.when(r % 2 == 0, F.array((v[0] + rounds_of(v[1], r)) % a, v[1])).otherwise(F.array(v[0], (v[1] + rounds_of(v[0], r)) % b))
        return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), start, step, lambda v: v[0] * b + v[1])

    def rounds_of(half: Column, r: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), r.cast("string"), F.lit(":"), half.cast("string"))), 1, 13), 16, 10).cast("bigint")

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(position.cast("bigint")), lambda x, _: F.when(x >= n, once(x)).otherwise(x))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a cycle of more than 64 steps")).cast("bigint"))


def permuted_ids(ids: DataFrame, seed: int, column: str = "document_row_id") -> DataFrame:
    """(id, draw_pos, total): each distinct id's place in a seeded permutation of the sorted ids; no list of ids or draws on the driver."""
    placed = with_position(ids, column)
    n = placed.count()
    return placed.select(column, permuted(F.col("position"), n, seed).alias("draw_pos"), F.lit(n).cast("bigint").alias("total"))


def disjoint_draws(ids: DataFrame, sizes: Sequence[int], seed: int, column: str = "document_row_id") -> DataFrame:
    """(id, draw, selection_pos) of several samples without a common id: consecutive ranges of one permutation."""
    placed = permuted_ids(ids, seed, column)
    total = placed.count()
    if sum(sizes) > total:
        raise ValueError(f"draws of {sum(sizes)} exceed available ids={total}")
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    draw = F.aggregate(F.array(*[F.lit(e).cast("bigint") for e in ends]), F.lit(0), lambda n, end: n + (F.col("draw_pos") >= end).cast("int"))
    start = F.get(F.array(*[F.lit(e - s).cast("bigint") for e, s in zip(ends, sizes, strict=True)]), draw)
    return placed.where(F.col("draw_pos") < sum(sizes)).select(column, draw.alias("draw"), (F.col("draw_pos") - start).alias("selection_pos"))


def share_split(ids: DataFrame, share: float, seed: int, column: str = "document_row_id") -> DataFrame:
    """(id, split): the first ``share`` of a seeded permutation is "train", the rest "test"."""
    placed = permuted_ids(ids, seed, column)
    return placed.select(column, F.when(F.col("draw_pos") < F.floor(F.col("total") * share), "train").otherwise("test").alias("split"))


def select_rows(
    questions: DataFrame,
    selected: DataFrame,
    question_indices: Sequence[int] = (),
    split_ids: DataFrame | None = None,
    question_count: int = QUESTION_COUNT,
) -> DataFrame:
    """Question rows of the selected documents; an empty list of questions means all of them."""
    rows = questions.join(selected.select("document_row_id"), "document_row_id", "left_semi")
    rows = rows.where(F.col("question_index").between(0, question_count - 1))
    if question_indices:
        rows = rows.where(F.col("question_index").isin([int(q) for q in question_indices]))
    rows = ensure_row_id(rows)
    return filter_split(rows, split_ids) if split_ids is not None else rows


def filter_split(rows: DataFrame, split_ids: DataFrame) -> DataFrame:
    """Rows of a split; a split that selects nothing is an error."""
    kept = ensure_row_id(rows).join(split_ids.select("row_id").distinct(), "row_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("evaluation split selects no rows")
    return kept


def evaluation_sample(questions: DataFrame, size: int, seed: int, question_count: int = QUESTION_COUNT) -> DataFrame:
    """Sampled evaluation rows, checked to be complete."""
    rows = select_rows(questions, sample_ids(questions, size, seed), question_count=question_count)
    found = rows.count()
    if found != size * question_count:
        raise ValueError(f"expected {size * question_count} evaluation rows, found {found}")
    return rows


def row_ids(df: DataFrame) -> DataFrame:
    return df.select(row_key("document_row_id", "question_index").alias("row_id")).distinct()


def stratified_split(rows: DataFrame, generator_size: int = 20, evaluator_size: int = 20) -> DataFrame:
    """Split per category by row id: generator rows, evaluator rows, the rest held out.

    Only one row more than ``generator_size + evaluator_size`` of a category decides anything; that limit is
    applied inside each task before the shuffle; a category with a third of all rows is never sorted whole.
    Small categories (count within the limit) give half to the generator and nothing to the holdout.
    """
    cap = generator_size + evaluator_size
    order = W.partitionBy("category").orderBy("row_id")
    head = rows.select("category", "row_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap + 1)
    head = head.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("category")))
    generator = F.when(F.col("n") <= cap, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(F.lit(generator_size))
    split = (
        F.when(F.col("place") > cap, "holdout_eval")
        .when(F.col("place") <= generator, "generator_dev")
        .otherwise("evaluator_dev")
    )
    labels = head.select("category", "row_id", split.alias("split"))
    return rows.join(labels, ["category", "row_id"], "left").withColumn("split", F.coalesce("split", F.lit("holdout_eval")))
