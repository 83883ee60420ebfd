"""Repeatable splits, samples and augmented copies."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import each
from ..plans.lookups import lookup_join, settle
from ..plans.ordering import HASH_SPAN, hash32, order_cut, order_value, up_to_cut

CELL_BITS = 16


def _hash_head(df: DataFrame, size: int, seed: object, key: str) -> Column:
    """True for the ``size`` rows that come first in the order of (hash, key)."""
    value = hash32(seed, key)
    cut = order_cut(df, value, F.col(key), size, span=(0, HASH_SPAN - 1))
    return up_to_cut(value, F.col(key), cut)


def random_split(df: DataFrame, test_size: float, seed: object = 42, key: str = "doc_id") -> DataFrame:
    """Add ``split``: 'test' for exactly ``floor(n * test_size)`` rows, else 'train'.

    Membership is a comparison with one cut point, so the rows do not move.
    """
    size = math.floor(df.count() * test_size)
    head = _hash_head(df.select(key), size, seed, key)
    return df.withColumn("split", F.when(head, "test").otherwise("train"))


def head_tail_split(
    df: DataFrame, fraction: float | bool = 0.3, shuffle: bool = True, seed: object = 42, key: str = "doc_id"
) -> DataFrame:
    """First ``floor(n * fraction)`` rows are 'test', the rest 'train'.

    Rows come in shuffled order, or in key order without ``shuffle``; ``True``
    stands for a test share of 0.3.
    """
    share = 0.3 if fraction is True else float(fraction)
    if shuffle:
        return random_split(df, share, seed, key)
    size = math.floor(df.count() * share)
    value = order_value(df, key)
    head = up_to_cut(value, F.col(key), order_cut(df.select(key), value, F.col(key), size))
    return df.withColumn("split", F.when(head, "test").otherwise("train"))


def fraction_sample(df: DataFrame, fraction: float, seed: object = 42, key: str = "doc_id") -> DataFrame:
    """``round(n * fraction)`` rows, the same on every run and partitioning."""
    size = math.floor(df.count() * fraction + 0.5)
    return df.where(_hash_head(df.select(key), size, seed, key))


def sample_window(df: DataFrame, size: int, seed: object = 42, key: str = "doc_id") -> DataFrame:
    """A run of ``size`` neighbours in key order at an offset drawn from ``seed``."""
    n = df.count()
    if n <= size:
        return df
    offset = df.sparkSession.range(1).select(hash32(seed, F.lit("offset"))).first()[0] % (n - size + 1)
    keys = df.select(key)
    value = order_value(df, key)

    def up_to(k: int) -> Column:
        return up_to_cut(value, F.col(key), order_cut(keys, value, F.col(key), k))

    window = df.where(up_to(offset + size))
    return window.where(~up_to(offset)) if offset else window


def stratified_split(
    df: DataFrame, test_size: float = 0.3, seed: object = 42, labels: str = "labels", key: str = "doc_id"
) -> DataFrame:
    """(key, stratum, split): a split that keeps label shares.

    A record's stratum is its rarest label, records without a label are a stratum of
    their own (the empty name); in each stratum the first
    ``round(size * test_size)`` records by (hash, key) are 'test'. A stratum is
    cut into 2**16 hash cells that are counted first, so ranks are taken inside
    single cells and a stratum with a third of all records stays spread out.
    """
    named = F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.array(F.lit("")))
    pairs = each(df, named, "label", key)
    counts = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counted = lookup_join(pairs, counts, ["label"], spread_by=[key])
    rows = counted.groupBy(key).agg(F.min(F.struct("n", "label")).alias("s")).select(key, F.col("s.label").alias("stratum"))
    value = hash32(seed, key)
    rows = settle(
        rows.select(key, "stratum", value.alias("h"), F.shiftright(value, 32 - CELL_BITS).alias("cell"))
    )
    cells = rows.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    up_to = Window.partitionBy("stratum").orderBy("cell")  # at most 2**16 rows per stratum
    whole = Window.partitionBy("stratum")
    cells = cells.select(
        "stratum",
        "cell",
        (F.sum("in_cell").over(up_to) - F.col("in_cell")).alias("before"),
        F.floor(F.sum("in_cell").over(whole) * F.lit(test_size) + F.lit(0.5)).alias("wanted"),
    )
    in_cell = Window.partitionBy("stratum", "cell").orderBy("h", key)
    ranked = rows.withColumn("rank", F.row_number().over(in_cell)).join(cells, ["stratum", "cell"])
    test = F.col("before") + F.col("rank") <= F.col("wanted")
    return ranked.select(key, "stratum", F.when(test, "test").otherwise("train").alias("split"))


def crop_words(text: Column, crop_ratio: float, noise: Column) -> Column:
    """Drop ``off`` words at the head and ``off + 1`` at the tail, with ``off`` drawn
    from ``noise`` between 0 and ``crop_ratio`` of the words."""
    items = F.split(text, " ")
    size = F.size(items)
    off = (noise % (F.floor(size * F.lit(crop_ratio)) + 1)).cast("int")
    return F.array_join(F.slice(items, off + 1, F.greatest(F.lit(0), size - 2 * off - 1)), " ")


def augment_crop(
    df: DataFrame,
    column: str = "description",
    level: int = 0,
    crop_ratio: float = 0.1,
    aug_method: Callable[[Column], Column] | None = None,
    seed: object = 42,
    key: str = "doc_id",
) -> DataFrame:
    """``level`` extra copies of each record, their text cropped; copy 0 is untouched."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(int(level)))))
    text = F.col(column)
    changed = aug_method(text) if aug_method else crop_words(text, crop_ratio, hash32(seed, key, "copy"))
    return copies.withColumn(column, F.when(F.col("copy") == 0, text).otherwise(changed))


def split_then_augment(
    df: DataFrame,
    column: str = "description",
    level: int = 0,
    test_ratio: float = 0.3,
    crop_ratio: float = 0.1,
    seed: object = 42,
    key: str = "doc_id",
) -> tuple[DataFrame, int]:
    """Augmented train rows plus untouched test rows, and the number of test rows."""
    n_test = math.floor(df.count() * test_ratio)
    split = random_split(df, test_ratio, seed, key)
    train = augment_crop(split.where(F.col("split") == "train"), column, level, crop_ratio, None, seed, key)
    test = split.where(F.col("split") == "test").withColumn("copy", F.lit(0))
    return train.unionByName(test), n_test
