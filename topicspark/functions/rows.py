"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, values: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per value of an array expression, nulls left out.

    A plain explode makes the optimizer add a test of the array below it, which
    computes the expression a second time; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
