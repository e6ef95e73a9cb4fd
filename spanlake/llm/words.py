"""Words of whole UTF-8 texts in Arrow batches, found and hashed with numpy instead of one Python object per word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Texts are
handled in slices of about a megabyte, so memory follows the slice and not the batch; a longer text is a slice of its
own, and its words are hashed a megabyte at a time. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Slice:
    """Some consecutive texts: their bytes, the offsets that cut them, and the row of the first in its batch."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many of the bytes marked in ``mask`` each text has."""
        out = np.zeros(len(self.offsets) - 1, np.int64)
        full = self.offsets[1:] > self.offsets[:-1]
        if full.any():
            out[full] = np.add.reduceat(mask, self.offsets[:-1][full], dtype=np.int64)
        return out

    def word_bounds(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        solid = ~separators[self.data]
        starts, ends = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        starts[cuts] = solid[cuts]
        ends[cuts - 1] = solid[cuts - 1]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hash of each byte range; ranges are in order and may not overlap."""
        values = _LOWER_VALUES if lower else _BYTE_VALUES
        out = np.empty(len(starts), np.uint64)
        done = 0
        while done < len(starts):
            base = int(starts[done])
            stop = max(done + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            limit = int(ends[stop - 1])
            up, down = _powers(limit - base + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.data[base:limit]] * up[: limit - base], dtype=np.uint64)])
            a, b = starts[done:stop] - base, ends[done:stop] - base
            out[done:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            done = stop
        return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + n])
    return out


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """The texts of a string column in slices; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield Slice(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop
