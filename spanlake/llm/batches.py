"""How much text one Arrow batch may carry to a Python worker."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to BATCH_BYTES (or one row, if that is larger) for the rest of the session.

    By default only rows are counted, 10,000 of them, which can be any number of bytes in both the executor and its
    Python workers. How rows are dealt to batches changes no result.
    """
    spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a task no longer needs to the system; a worker lives on and would keep it beside the next task's own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when it has ended."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def portions(batches: Iterable[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in portions whose column ``text`` has about ``size`` bytes, or one row with more."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
            yield batch.slice(i, j - i)
            i = j
