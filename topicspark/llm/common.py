"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import input_bytes
from ..session import scratch_path

PART_BYTES = 64 * 1024 * 1024
HOT_SHARE = 256
SALTS = 64


def parts(df: DataFrame) -> int:
    """Tasks for a shuffle of ``df``: enough for its bytes, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(df) / PART_BYTES))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, computed once, whatever reads it later."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_join(rows: DataFrame, groups: DataFrame, key: str, spread_by: list[Column], total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with one row per ``key`` of ``groups``, whose ``n`` counts the rows of the key.

    A key with more than ``1 / HOT_SHARE`` of all rows is hot; there are fewer than
    ``HOT_SHARE`` of them, whatever the size of the data. Their rows are dealt over
    ``SALTS`` tasks by ``spread_by`` and their group is repeated for each; every
    other key is joined as it is. Null keys find no group.
    """
    hot = [r[0] for r in groups.where((F.col("n") > total // HOT_SHARE + 1000) & F.col(key).isNotNull()).select(key).collect()]
    groups = groups.drop("n")
    if not hot:
        return rows.join(groups, key, how)
    one = F.array(F.lit(0))
    many = F.sequence(F.lit(0), F.lit(SALTS - 1))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = groups.withColumn("_salt", F.explode(F.when(is_hot, many).otherwise(one)))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Bring this package to the Python workers, once for each application: they need
    not share the driver's folders or its search path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def in_batches(df: DataFrame, of: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(of, schema)
