"""Joins of a large table with a dimension whose size is measured first.

A dimension derived from the corpus (kept labels, vocabulary, language model)
may be tiny or may grow with the data. Each helper writes it once to the shared
folder, measures it, and picks the map-side plan only inside the bound; beyond
it the join is shuffled, with the large side salted so that one hot key does not
land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
LITERAL_BOUND = 5_000
SALTS = 32


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``settle``, as a table of columns: for wide rows of which later passes read some columns."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Measure at most ``rows + 1`` rows of ``df`` against both bounds."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    n, width = (
        df.limit(rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)))
        .first()
    )
    return n <= rows and width <= size


def lookup_join(
    big: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    rows: int | None = None,
    settled: bool = False,
) -> DataFrame:
    """Join ``big`` with ``dim`` on ``keys``; ``dim`` is broadcast only if measured small.

    Beyond the bound both sides are shuffled on ``keys`` plus a salt taken from
    ``spread_by`` (default: all columns of ``big``), with ``dim`` repeated per salt.
    """
    dim = dim if settled else settle(dim)
    if fits_broadcast(dim, rows):
        return big.join(F.broadcast(dim), keys, how)
    spread = spread_by or big.columns
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def bounded_values(df: DataFrame, column: str, bound: int | None = None) -> list | None:
    """The values of ``column`` if there are at most ``bound`` of them, else None."""
    bound = LITERAL_BOUND if bound is None else bound
    values = [r[0] for r in df.select(column).limit(bound + 1).collect()]
    return values if len(values) <= bound else None


def member(column: Column, values: list) -> Column:
    """Set membership that runs as a hashed literal set, false for an empty set."""
    return column.isin(values) if values else F.lit(False)
