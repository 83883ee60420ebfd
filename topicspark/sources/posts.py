"""Question-and-answer posts: csv scan, paged query, paged export."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas
from ..functions import html as H
from ..functions import text as X
from ..operators import labels as L
from ..plans.ordering import with_ordinal

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def write_posts_csv(posts: DataFrame, path: str, files: int | None = None) -> str:
    rows = posts.repartition(files) if files else posts
    rows.select("id", "Title", "Tags", "body", "score").write.options(header=True, escape='"', quoteAll=True).csv(path)
    return path


def scan_posts_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several csv files as one table."""
    return spark.read.schema(schemas.POST).options(**_CSV).csv(paths)


def eligible_posts(posts: DataFrame, least_score: int = 10) -> DataFrame:
    present = F.col("Title").isNotNull() & F.col("body").isNotNull() & F.col("Tags").isNotNull()
    return posts.where((F.col("score") > least_score) & present)


def posts_query(posts: DataFrame, offset: int, per_page: int = 10, least_score: int = 10) -> DataFrame:
    """One page of the best posts (ties by id)."""
    return eligible_posts(posts, least_score).orderBy(F.desc("score"), "id").offset(offset).limit(per_page)


def posts_count(posts: DataFrame, least_score: int) -> DataFrame:
    return eligible_posts(posts, least_score).agg(F.count(F.lit(1)).alias("n"))


def paged_posts(posts: DataFrame, num: int, start: int = 0, per_page: int = 100_000, least_score: int = 10) -> DataFrame:
    """Posts of ``ceil(num / per_page)`` full pages from ``start``, with their ``page``."""
    pages = math.ceil(num / per_page)
    placed = with_ordinal(eligible_posts(posts, least_score), F.desc("score"), F.col("id"))
    wanted = placed.where(F.col("ordinal").between(start, start + pages * per_page - 1))
    return wanted.withColumn("page", F.floor((F.col("ordinal") - start) / per_page).cast("bigint"))


def posts_page_export(posts: DataFrame, path: str, **paging) -> str:
    """Write the pages of :func:`paged_posts`, one folder per page, in one pass."""
    paged_posts(posts, **paging).write.partitionBy("page").options(escape='"', quoteAll=True, header=True).csv(path)
    return path


def stack_dataset(
    posts: DataFrame,
    n_tag: int = V.STACK_LABELS,
    name_text_col: str = "description",
    concat_title: bool = False,
    body_extractor: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per post with its ``n_tag`` most frequent labels and its body text."""
    rows = posts.withColumn("labels", F.array_distinct(X.parse_tag_string(F.col("Tags"))))
    rows = L.semi_join_top_labels(rows, n_tag, key="id")
    rows = rows.withColumn("body", H.extract_text(F.col("body"), body_extractor or H.post_body_text))
    if concat_title:
        rows = rows.withColumn(name_text_col, F.concat_ws(" ", "Title", "body"))
    return rows
