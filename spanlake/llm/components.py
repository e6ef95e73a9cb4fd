"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import cut_lineage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("w"))
    return moved.where("m < w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (u, v): component is the smallest id reachable.

    Links stay distributed; each step is written, so a lost executor costs one step. Rounds grow with the logarithm
    of the longest chain. Links of an id with itself are ignored; no links give no rows.
    """
    edges = cut_lineage(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = _state(edges)
    while True:
        edges = cut_lineage(_small(cut_lineage(_large(edges))))
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)
