"""Positions in a total order without gathering the order in one task.

* ``hash32``: a repeatable pseudo-random value of a key and a seed.
* ``order_cut``: the k-th smallest (value, key) pair, found by counting value
  ranges; each pass brings at most ``CELLS`` counters to the driver.
* ``with_ordinal``: the 0-based position of every row, by one range shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import settle

CELLS = 4096
DIRECT_ROWS = 10_000
STEP = 6  # bytes of a string key that are ordered at a time
HASH_SPAN = 1 << 32


def hash32(seed: object, *keys: Column | str) -> Column:
    """First 32 bits of the md5 of ``key|...|seed`` as a bigint."""
    columns = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def order_value(df: DataFrame, key: str) -> Column:
    """A bigint in the order of ``key``: the key itself, or the first seven bytes of a string."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(key).cast("bigint")
    head = F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("bigint")


def _at_rank(pairs: DataFrame, k: int, span: tuple[int, int] | None = None) -> tuple | None:
    """The row of rank ``k`` (1-based) in the order of ``v`` and ``t``, as (v, t, None); or, if many
    rows share its ``v``, (v, None, (these rows, the rank among them)); None beyond the last row.

    Every pass splits the range that holds the wanted rank into ``CELLS`` equal ranges and
    counts them; once the range holds few rows these alone are sorted."""
    low, high = span or pairs.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None
    inside = pairs
    while True:
        width = max(1, -(-(high - low + 1) // CELLS))
        cell = F.floor((F.col("v") - F.lit(low)) / F.lit(width)).cast("bigint")
        counts = sorted(
            (r["cell"], r["n"]) for r in inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        for at, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return None
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        inside = pairs.where(F.col("v").between(low, high))
        if n <= DIRECT_ROWS:
            row = inside.orderBy("v", "t").limit(k).collect()[-1]
            return row["v"], row["t"], None
        if low == high:
            return low, None, (inside, k)


def _string_at(rows: DataFrame, k: int) -> str:
    """The string of rank ``k`` among the ``t`` of ``rows``: ranges of ``STEP`` bytes and their
    number are counted, and where many agree the next bytes decide."""
    offset = 0
    while True:
        piece = F.substring(F.encode(F.col("t"), "UTF-8"), offset + 1, STEP)
        value = F.conv(F.rpad(F.hex(piece), 2 * STEP, "0"), 16, 10).cast("bigint") * (STEP + 2) + F.length(piece)
        at, key, alike = _at_rank(rows.select(value.alias("v"), "t"), k)
        if alike is None:
            return key
        rows, k = alike
        if at % (STEP + 2) < STEP:  # all end here, so all are one string
            return rows.first()["t"]
        rows, offset = settle(rows.select("t")), offset + STEP


def order_cut(
    df: DataFrame, value: Column, key: Column, k: int, span: tuple[int, int] | None = None
) -> tuple | None:
    """The k-th smallest (value, key) pair of ``df``, 1-based; None for ``k < 1``.

    ``value`` is a bigint column, ``span`` its range if known; ``key`` is of any type
    that can be sorted. Many rows of one value are told apart by their keys: whole numbers and
    strings by counting ranges again, other keys by walking through their sorted counts.
    """
    if k < 1:
        return None
    found = _at_rank(df.select(value.cast("bigint").alias("v"), key.alias("t")), k, span)
    if found is None or found[2] is None:
        return found and found[:2]
    at, _, (inside, k) = found
    kind = inside.schema["t"].dataType
    if isinstance(kind, T.IntegralType):
        return at, order_cut(inside, F.col("t"), F.col("t"), k)[0]
    if isinstance(kind, T.StringType):
        return at, _string_at(inside, k)
    for row in inside.groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy("t").toLocalIterator():
        k -= row["n"]
        if k <= 0:
            return at, row["t"]


def up_to_cut(value: Column, key: Column, cut: tuple | None) -> Column:
    """True for rows whose (value, key) is not above ``cut``."""
    if cut is None:
        return F.lit(False)
    v, t = cut
    return (value < F.lit(v)) | ((value == F.lit(v)) & (key <= F.lit(t)))


def with_ordinal(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (a total order).

    One range shuffle; the sorted rows are written once so that the row index
    inside each range and the range sizes come from the same run.
    """
    spark = df.sparkSession
    ranged = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], 0
    for row in sorted(sizes):  # one row per shuffle partition
        offsets.append((row["_part"], total))
        total += row["n"]
    starts = spark.createDataFrame(offsets, "_part bigint, _start bigint")
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_start")
    )
