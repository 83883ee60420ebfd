"""N-grams of whole batches of texts at once, as arrays of 64-bit numbers.

Spark cuts a text into its units (words, known by their hash, or signs); what the tasks do with the
units of many rows together is array work: hashes of all windows, then what is distinct in each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

SLICE = 1 << 19  # units that are worked on together


def units(text: Column, analyzer: str = "word") -> Column:
    """What n-grams are made of; empty for a null text."""
    if analyzer == "char":
        return F.coalesce(X.flat(text), F.lit(""))
    return F.coalesce(F.transform(X.words(text), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, stop) of the rows that are worked on together, one at least."""
    lengths = pc.utf8_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column)
    upto = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE, "right")))
        yield start, stop
        start = stop


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of all rows one after the other, and how many each row has."""
    if pa.types.is_string(column.type):
        texts = [t or "" for t in column.to_pylist()]
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        return flat.astype(np.uint64), np.array([len(t) for t in texts], dtype=np.int64)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lengths.astype(np.int64)


def within(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``n`` units that lie in one row, and how many each row has."""
    ends, inside = np.cumsum(lengths), np.ones(int(lengths.sum()), dtype=bool)
    for k in range(1, n):
        inside[(ends - k)[lengths >= k]] = False
    return np.flatnonzero(inside), np.maximum(0, lengths - n + 1)


def hashes(flat: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram, row by row, and how many each row has."""
    windows = max(0, len(flat) - n + 1)
    h = np.full(windows, n, dtype=np.uint64)
    for k in range(n):
        h ^= flat[k : k + windows]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    at, per_row = within(lengths, n)
    return h[at].view(np.int64), per_row


def counted(numbers: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times) of what is distinct in each row, by row and number; ``numbers`` is sorted in place."""
    ends = np.cumsum(per_row)
    starts = ends - per_row
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        numbers[lo:hi].sort()
    first = np.ones(len(numbers), dtype=bool)
    first[1:] = numbers[1:] != numbers[:-1]
    first[starts[per_row > 0]] = True
    at = np.flatnonzero(first)
    return np.repeat(np.arange(len(per_row)), per_row)[at], numbers[at], np.diff(np.append(at, len(numbers)))


def row_terms(column: pa.Array, sizes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times, size) of the distinct n-grams of each row, for some rows that are worked on together."""
    flat, lengths = codes(column)
    found = [(*counted(*hashes(flat, lengths, n)), n) for n in sizes]
    row, term, times = (np.concatenate([f[k] for f in found]) for k in range(3))
    return row, term, times, np.concatenate([np.full(len(f[0]), f[3], dtype=np.int8) for f in found])
