"""Helpers shared by the query families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as P


def family() -> tuple[dict, dict, Callable]:
    """Empty query and check tables, and the decorator that fills them."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, oracle: str | None = None):
        def add(fn):
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return add

    return queries, oracles, query


def joined(column):
    return F.array_join(F.array_sort(column), "|")


def tag_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", P.select_tag_field(F.col("tags")))


def n_long(column):
    return F.length(column).cast("bigint")
