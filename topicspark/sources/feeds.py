"""Record feeds: fragments, batches and snapshots as json."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas
from ..plans.ordering import with_ordinal

_CONTENT = ("key", "title", "url", "description", "fulltext", "language", "tags", "creators")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def to_fragments(records: DataFrame, size: int = V.FRAGMENT_SIZE, key: str = "doc_id") -> DataFrame:
    """Pages of ``size`` records in key order: (page, content)."""
    placed = with_ordinal(records.select(key, *_CONTENT), F.col(key))
    page = F.floor(F.col("ordinal") / size).cast("bigint").alias("page")
    item = F.struct("ordinal", F.struct(*_CONTENT).alias("record"))
    return placed.groupBy(page).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x.record).alias("content")  # ``size`` items
    )


def write_batch(fragments: DataFrame, path: str) -> str:
    """One json line per fragment, so that a large batch can be read in splits."""
    fragments.write.json(path)
    return path


def read_batch(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Fragments below ``path``; empty with the same schema if there is no such path.

    ``multi_line`` reads files that hold one json document over several lines.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.BATCH)
    return spark.read.schema(schemas.BATCH).json(path, multiLine=multi_line)


def scan_infos(spark: SparkSession, path: str, fulltext: bool = True, multi_line: bool = False) -> DataFrame:
    """Records of a batch, with or without their full text."""
    records = read_batch(spark, path, multi_line).select(F.explode("content").alias("r")).select("r.*")
    return records if fulltext else records.drop("fulltext")


def combine_fragments(
    fragments: DataFrame, size: int = V.FRAGMENT_SIZE, total_size: int | None = None
) -> DataFrame:
    """Records of all fragments up to the stopping page, with their position.

    Stops after the first page that is short, or at the first page with
    ``total_size <= offset + records on the page``; whole pages are kept.
    """
    n = F.size("content")
    last = n < size
    if total_size:
        last = last | (F.lit(total_size) <= F.col("page") * size + n)
    stop = fragments.where(last).agg(F.min("page").alias("page"))
    kept = fragments.where(F.col("page") <= F.coalesce(stop.scalar(), F.col("page")))
    rows = kept.select("page", F.posexplode("content").alias("pos", "record"))
    return rows.select("page", (F.col("page") * size + F.col("pos")).alias("position"), "record.*")


def snapshot_write(df: DataFrame, home: str, at: datetime | None = None) -> str:
    """Write a batch under a time-stamped name and return its path."""
    stamp = (at or datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
    path = f"{home}/version={stamp}"
    df.write.json(path)
    return path
