"""Array expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import let

_BLOCK = 256


def _prefix(values: Column) -> Column:
    """Exclusive running sums of one short array."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct((acc["total"] + v).alias("total"), F.concat(acc["sums"], F.array(acc["total"])).alias("sums")),
        lambda acc: acc["sums"],
    )


def running_starts(lengths: Column) -> Column:
    """Exclusive running sums: the start offset of each piece, given the piece lengths.

    Works in blocks, because growing one array element by element copies it every time; the cost is
    O(n * 256 + (n / 256)^2) instead of O(n^2).
    """

    def blocks(values: Column) -> Column:
        count = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
        return F.when(F.size(values) == 0, F.array().cast("array<array<int>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)

    def assemble(parts: Column) -> Column:
        return let(
            _prefix(F.transform(parts, total)),
            lambda base: F.flatten(
                F.transform(parts, lambda block, b: F.transform(_prefix(block), lambda s: s + F.get(base, b)))
            ),
        )

    def sums(values: Column) -> Column:
        return F.when(F.size(values) <= _BLOCK, _prefix(values)).otherwise(let(blocks(values), assemble))

    return let(lengths.cast("array<int>"), sums)


def explode_rows(df: DataFrame, array: Column, *keep, names: tuple[str, str] = ("pos", "item")) -> DataFrame:
    """One row per array element with its position.

    The outer form keeps the optimizer from adding a size filter that would evaluate ``array`` again.
    """
    pos, item = names
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
