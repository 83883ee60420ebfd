"""Running sums over groups of rows that may be longer than one task holds.

``ordered`` brings a table into one order over all its partitions and writes it once.
``running_sums`` then reads each partition on its own: a first pass tells the driver
what each partition starts and ends with (one row a partition), a second one adds up
within the partition, starting from what the partitions before it left over. A group
may span any number of partitions; a task holds one batch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.layout import input_bytes
from ..plans.lookups import settle
from .common import PART_BYTES, in_batches

PART = "_part"


def tasks(df: DataFrame) -> int:
    """Tasks for passes over rows made from ``df``: enough for its bytes, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(df) / PART_BYTES))


def ordered(df: DataFrame, n_parts: int, *order: Column) -> DataFrame:
    """``df`` sorted over all partitions, written once, with each row's partition."""
    return settle(df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def within(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` up to each row, within runs of equal ``keys``; wraps like a bigint."""
    sums = np.cumsum(values, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.append(first, len(keys)))
    return sums - np.repeat(sums[first] - values[first], lengths)


def _edges(df: DataFrame, key: str, values: list[str]) -> list:
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        left = np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            if part is None:
                part, first = batch.column(0)[0].as_py(), int(keys[0])
            here = keys == keys[-1]
            sums = np.array([batch.column(2 + k).to_numpy(zero_copy_only=False)[here].sum(dtype=np.int64) for k in range(len(values))])
            left = sums + (left if last == keys[0] == keys[-1] else 0)
            last = int(keys[-1])
        if part is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([left.tolist()], pa.list_(pa.int64()))],
                ["part", "first", "last", "sums"],
            )

    found = df.select(PART, key, *values).transform(in_batches, edges, "part int, first bigint, last bigint, sums array<bigint>")
    return sorted(found.collect())  # one row a partition


def running_sums(df: DataFrame, key: str, values: list[str], last: str | None = None) -> DataFrame:
    """``df`` (from ``ordered``, rows of a ``key`` together) with its bigint ``values``
    replaced by their sums up to each row of the key, and ``<value>_before`` without the
    row itself. ``last`` names a column that is true for the last row of a key."""
    starts: dict[int, tuple] = {}
    carry, before = np.zeros(len(values), dtype=np.int64), None
    edges = _edges(df, key, values)
    for at, (part, first, end, sums) in enumerate(edges):
        carry = carry if before is not None and before == first else np.zeros(len(values), dtype=np.int64)
        following = edges[at + 1][1] if at + 1 < len(edges) else None
        starts[part] = (carry.tolist(), following)
        carry = np.array(sums, dtype=np.int64) + (carry if first == end else 0)
        before = end
    names = df.columns
    at_key, at_part, at_values = names.index(key), names.index(PART), [names.index(v) for v in values]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = current = following = left = None

        def flagged(arrays, titles, keys, after):
            if last is None:
                return pa.RecordBatch.from_arrays(arrays, titles)
            flags = np.append(keys[1:] != keys[:-1], after is None or after != keys[-1])
            return pa.RecordBatch.from_arrays([*arrays, pa.array(flags)], [*titles, last])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at_key).to_numpy(zero_copy_only=False)
            if left is None:
                left, following = starts[batch.column(at_part)[0].as_py()]
                current = keys[0]
            arrays, prior = list(batch.columns), []
            for k, column in enumerate(at_values):
                value = batch.column(column).to_numpy(zero_copy_only=False)
                sums = within(keys, value) + np.where((keys == current) & (np.cumsum(keys != current) == 0), np.int64(left[k]), 0)
                arrays[column] = pa.array(sums)
                prior.append(pa.array(sums - value))
            left, current = [int(arrays[c][-1].as_py()) for c in at_values], keys[-1]
            done = ([*arrays, *prior], [*names, *(f"{v}_before" for v in values)], keys)
            if held is not None:
                yield flagged(*held, keys[0])
            held = done
        if held is not None:
            yield flagged(*held, following)

    fields = [T.StructField(f"{v}_before", T.LongType()) for v in values] + ([T.StructField(last, T.BooleanType())] if last else [])
    return df.transform(in_batches, summed, T.StructType([*df.schema.fields, *fields]))
