"""Hashes of all windows of words of many documents at once, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import words_of

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words in one slice of a batch: bounds the memory that hashing takes (a longer document is one slice).
SLICE_WORDS = 250_000


def word_hashes(text: Column) -> Column:
    """array<bigint>: the 64-bit hash of each word of a text."""
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(lists: pa.ListArray, most: int = SLICE_WORDS):
    """(first row, end row, offsets from 0, flat values) of runs of rows with about ``most`` values each."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = np.asarray(lists.values).view(np.uint64)
    n, at = len(lists), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, offsets[at : end + 1] - offsets[at], flat[offsets[at] : offsets[end]]
        at = end


def windows(flat: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` values of flat (across rows too: use only starts that fit their row)."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = MULTIPLIER + np.uint64(2 * seed)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total *= step
            total += flat[k : k + n]
        return mix(total + np.uint64(width))


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within its row) of each flat value."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    return row, np.arange(offsets[-1], dtype=np.int64) - offsets[row] if len(row) else row


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
