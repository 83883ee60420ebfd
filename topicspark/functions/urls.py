"""Url parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without user and port; null for a bad url."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def netloc(url: Column) -> Column:
    """Network location as written."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def url_key(url: Column) -> Column:
    return F.md5(url)
