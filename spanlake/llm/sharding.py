"""Shards by longest-processing-time scheduling: groups that stay together, largest first, each to the least-loaded shard.

Only the order of sizes decides where a group goes, and groups of one size are interchangeable. So the heap is fed with
the histogram of group sizes, not with groups: one row per distinct size, of which a corpus of T bytes has less than
sqrt(2 T) (distinct sizes add up to at most T). Its answer says, for each size, how many groups each shard takes, and
groups find their shard by their rank among the groups of their size. Ranks and slots are prefix sums over hashed
cells, so neither a size nor a shard that holds a third of all rows is numbered by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

CELL_ROWS = 5_000
MAX_CELLS = 4096


class LoadHeap:
    """The shards by load; ties go to the lower shard."""

    def __init__(self, shards: int):
        self.heap = [(0, shard) for shard in range(shards)]

    def place(self, size: int, count: int) -> list[int]:
        """How many of ``count`` groups of ``size`` each shard takes, as if each group went to the least-loaded shard in turn."""
        taken = [0] * len(self.heap)
        if size > 0 and count > 4 * len(taken):
            # What the heap would do is known up to a last round: each shard gets all groups that start below a common level.
            loads = dict((shard, load) for load, shard in self.heap)
            below = lambda level: {s: max(0, -(-(level - load) // size)) for s, load in loads.items()}
            low, high = min(loads.values()), max(loads.values()) + size * (count + 1)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(below(middle).values()) <= count else (low, middle)
            for shard, n in below(low).items():
                taken[shard] = n
            self.heap = [(load + taken[shard] * size, shard) for shard, load in loads.items()]
            heapq.heapify(self.heap)
        for _ in range(count - sum(taken)):
            load, shard = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, shard))
            taken[shard] += 1
        return taken


def _schedule(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(size, ends) for each (size, count), largest first: up to which rank, exclusively, each shard takes the groups of that size."""

    def run(batches):
        heap = LoadHeap(shards)
        for batch in batches:
            sizes, ends = batch.column(0), []
            for size, count in zip(sizes.to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, row = 0, []
                for n in heap.place(size, count):
                    total += n
                    row.append(total)
                ends.append(row)
            yield pa.RecordBatch.from_arrays([sizes, pa.array(ends, pa.list_(pa.int64()))], names=["_size", "_ends"])

    return run


def _numbered(rows: DataFrame, key: str, order: list[Column], cells: int, into: str) -> DataFrame:
    """``rows`` with their gapless number from 0 among those of the same ``key``: the rows in earlier cells plus those before it in its own."""
    placed = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = placed.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_cell").alias("_of"), before.alias("_before"))
    inside = placed.withColumn("_inside", F.row_number().over(W.partitionBy(key, "_cell").orderBy(*order)) - 1)
    joined = inside.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_of")))
    return joined.withColumn(into, F.col("_before") + F.col("_inside")).drop("_cell", "_key", "_of", "_before", "_inside")


def assign_shards(rows: DataFrame, group: Column, size: Column, shards: int = 24, into: tuple[str, str, str] = ("size", "shard", "slot")) -> DataFrame:
    """``rows`` with their size, shard and slot (from 0 without gaps in each shard); rows of one ``group`` share a shard.

    Shards get nearly equal sums of ``size``: no shard exceeds another by more than its last group. A group that is
    larger than a fair share still goes to one shard, alone if it must. Rows with a null group are one group, a null or
    negative size counts as 0, repeated rows are rows of their own, and an empty table gives an empty table. Columns of
    ``rows`` stay, whatever their names; those named in ``into`` are replaced.
    """
    kept = [F.col("_row").getField(c).alias(c) for c in rows.columns if c not in into]
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.sha2(group.cast("string"), 256).alias("_group"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_bytes"))
    sized = cut_lineage(whole.withColumn("_group", F.coalesce("_group", F.lit("null"))))
    groups = cut_lineage(sized.groupBy("_group").agg(F.sum("_bytes").alias("_size"), F.count("*").alias("_rows")))
    total, n_groups = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.count("*")).first()
    cells = lambda n: max(1, min(MAX_CELLS, n // CELL_ROWS))
    histogram = groups.groupBy("_size").agg(F.count("*").alias("_count")).repartition(1).sortWithinPartitions(F.desc("_size"))
    runs = cut_lineage(histogram.mapInArrow(_schedule(shards), "_size long, _ends array<long>"))
    ranked = _numbered(groups.select("_group", "_size"), "_size", [F.col("_group")], cells(n_groups), "_rank")
    shard = F.size(F.filter("_ends", lambda end: end <= F.col("_rank")))
    where = cut_lineage(ranked.join(runs, "_size").select("_group", shard.alias("_shard")))
    placed = cut_lineage(sized.join(where, "_group").select("_row", "_bytes", "_group", "_shard"))
    order = [F.xxhash64(F.to_json("_row"), "_group"), F.col("_group")]
    slots = _numbered(placed, "_shard", order, cells(total), "_slot")
    return slots.select(*kept, F.col("_bytes").alias(into[0]), F.col("_shard").alias(into[1]), F.col("_slot").alias(into[2]))


def write_shards(assigned: DataFrame, path: str, shard: str = "shard", slot: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """Write the rows as Parquet in one folder per shard, each in files of at most ``rows_per_file`` in the order of slots."""
    part = F.floor(F.col(slot) / rows_per_file)
    assigned.withColumn("_part", part).repartition(F.col(shard), F.col("_part")).sortWithinPartitions(shard, slot).drop("_part").write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
