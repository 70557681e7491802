"""Helpers of the tokenisers: numbered strings, pools of id lists, slices of Arrow batches."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text encoded at once


class Numbers(dict):
    """Numbers words as they come; the new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Pool:
    """Lists of ids one after the other, by number."""

    def __init__(self):
        self.ids, self.starts = array("i"), array("q", [0])

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes, dtype=np.int64) + self.starts[-1]
        self.ids.frombytes(np.ascontiguousarray(ids, np.int32).tobytes())
        self.starts.frombytes(ends.tobytes())

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the lists of these numbers, and where each list ends."""
        starts, pool = np.array(self.starts), np.array(self.ids)
        return spread(pool, starts[numbers], starts[numbers + 1])


def spread(pool: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of a pool one after the other, and where each ends then."""
    sizes = ends - starts
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    return pool[np.repeat(starts - (after - sizes), sizes) + np.arange(total)], after


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with about as much text each, and their texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        own = batch.slice(int(start), int(end - start))
        yield own, own.column(column).to_pylist()
