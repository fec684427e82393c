"""Arrow batches inside tasks: bounded slices, whole words, code points.

Everything here works on one Arrow batch at a time with numpy and Arrow's own
kernels; Spark partitions and moves the rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes handled at once inside a task (a longer single text is handled whole).
SLICE_BYTES = 4 << 20


def release_memory() -> None:
    """Freed memory back to the system: Python workers live on after a task, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut, without copying, where their text passes ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    release_memory()


def kept_rows(docs: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text ``judge`` finds worth keeping; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(judge(batch.column(text_col)), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string array without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
    if not len(strings) or strings.buffers()[2] is None:
        return np.zeros(len(strings) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return offsets.astype(np.int64) - offsets[0], data


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split on ASCII white space: (distinct words, index of each word,
    offsets of the texts in that index). Nulls count as empty texts."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        values = values.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), offsets


class Cache:
    """Rows of numbers for the strings seen by this Python worker, at most
    ``limit`` strings: past that all are dropped and computed anew when they
    come back, so results never depend on it. ``compute`` takes an array of
    distinct strings and returns (numbers, offsets of each string's row)."""

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype=np.int32, limit: int = 300_000):
        self.compute, self.dtype, self.limit = compute, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.values, self.offsets = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def rows(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) into ``self.values`` for each of the distinct ``strings``."""
        if len(self.known) > self.limit:
            self.clear()
        at = pc.index_in(strings, value_set=self.known)
        gaps = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if gaps.any():
            new = strings.filter(pa.array(gaps))
            at[gaps] = len(self.known) + np.arange(len(new))
            numbers, offsets = self.compute(new)
            self.known = pa.concat_arrays([self.known, new])
            self.values = np.concatenate([self.values, numbers.astype(self.dtype)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        return self.offsets[at], self.offsets[at + 1]


def gather(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenated ranges, and the offsets of each range in them."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths), offsets
