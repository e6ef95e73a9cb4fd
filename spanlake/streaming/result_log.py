"""The append log of results as a stream: tolerant parsing, only missing rows, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanlake.operators.incremental import last_by_key, pending
from spanlake.sources.results import RESULT_SCHEMA, read_table


def read_log(spark: SparkSession, folder: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Stream of well-formed result lines of a folder of JSON files; malformed lines are dropped."""
    lines = spark.readStream.schema(f"{schema}, _corrupt_record STRING").json(folder)
    kept = lines.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    meta = F.col("_metadata")
    return kept.withColumns({"_written": meta["file_modification_time"], "_file": meta["file_name"]})


def apply_log(log: DataFrame, table: str, checkpoint: str, key: str = "row_id", available_now: bool = True) -> StreamingQuery:
    """Keep a results table up to date from the log.

    Each micro-batch keeps its last row per key and replaces its own partition of the table, so a batch
    that is retried after a failure leaves the same result. ``current`` reads the table.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        line = batch.withColumn("_line", F.monotonically_increasing_id())
        latest = last_by_key(line, [key], ["_written", "_file", "_line"]).drop("_line", "_written", "_file")
        latest.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    writer = log.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, table: str, key: str = "row_id") -> DataFrame | None:
    """Latest row per key over all batches, or None before the first batch."""
    rows = read_table(spark, table)
    return None if rows is None else last_by_key(rows, [key], ["batch_id"]).drop("batch_id")


def missing(work: DataFrame, table: str, key: str = "row_id") -> DataFrame:
    """Work items that no batch has answered yet."""
    done = current(work.sparkSession, table, key)
    return work if done is None else pending(work, done, key)
