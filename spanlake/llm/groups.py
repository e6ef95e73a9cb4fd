"""Rows of one key at a time from partitions sorted by that key, without holding a partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys; only the rows of the current run are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            now = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = now
    if held:
        yield pa.Table.from_batches(held)
