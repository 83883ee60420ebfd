"""How many tasks the records are spread over."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

PARTITION_BYTES = 128 * 1024 * 1024
MAX_PARTITIONS = 200_000
_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables below ``df``, from the planner's statistics (no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN)


def _planned_partitions(df: DataFrame) -> int:
    """Partitions for the tables below ``df``. A stored intermediate result counts as many as it
    was written in: its size is an estimate of the plan that made it, in which joins multiply."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    wanted = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            wanted += leaf.rdd().getNumPartitions()
        elif (size := int(str(leaf.stats().sizeInBytes()))) < _UNKNOWN:
            wanted += math.ceil(size / PARTITION_BYTES)
    return wanted


def by_record(df: DataFrame, key: str) -> DataFrame:
    """Partition by record for work that stays within a record.

    The number of partitions is fixed from the size of the input: such work
    expands a record many times, so shuffled bytes alone would ask for too few.
    """
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _planned_partitions(df))
    return df.repartition(min(wanted, MAX_PARTITIONS), key)


def spread(table: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than task slots one slice per slot, for costly
    work on each row; a scan with enough splits is left as it is."""
    slots = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= slots else table.repartition(slots)
