"""Row filters, projections and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U


def filter_language(df: DataFrame, language: str | None) -> DataFrame:
    return df.where(F.col("language") == language) if language else df


def filter_min_length(df: DataFrame, threshold: int = V.MIN_CONTENT_LENGTH, fulltext: bool = True) -> DataFrame:
    """Drop records whose raw texts are shorter than ``threshold`` characters."""
    keep = F.length("description") >= threshold
    if fulltext:
        keep = (F.length("fulltext") >= threshold) & keep
    return df.where(keep)


def select_tag_field(tags: Column, field: str = "tagID") -> Column:
    """Label list of a record; an unknown field name means ``tagID``."""
    name = field if field in ("tagID", "label") else "tagID"
    return F.transform(tags, lambda t: t[name])


def project_dataset(df: DataFrame, mode: str, partial: bool = False, *extra: str) -> DataFrame:
    """Output columns by mode: full text, partial text, or description only."""
    if mode != "info":
        columns = ["title", "language", "description", "fulltext"]
    elif partial:
        columns = ["title", "language", "partial_text"]
    else:
        columns = ["title", "description", "language"]
    return df.select(*extra, *columns)


def validate_request(df: DataFrame, by_url: bool = False) -> DataFrame:
    """Add ``valid`` and ``reason``; bad requests are marked, not raised."""
    if by_url:
        reason = (
            F.when(F.col("url").isNull(), V.URL_MISSING)
            .when(~F.col("url").rlike(V.SUPPORTED_URL), V.URL_UNSUPPORTED)
            .otherwise("")
        )
    else:
        tokens = F.size(F.split("description", " "))
        reason = (
            F.when(F.col("description").isNull() | (tokens < V.MIN_REQUEST_TOKENS), V.TOO_SHORT)
            .when(tokens > V.MAX_REQUEST_TOKENS, V.TOO_LONG)
            .otherwise("")
        )
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def language_dataset(df: DataFrame, codes: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows for language training; other languages are rejected."""
    code = X.language_code(F.col("language"))
    if codes is not None:
        code = F.lit(None).cast("int")
        for name, number in codes.items():
            code = F.when(F.col("language") == name, F.lit(number)).otherwise(code)
    rows = df.withColumn("data", X.prefix_title(F.col("title"), F.col("description"))).withColumn("target", code)
    rows = rows.withColumnRenamed("language", "target_names")
    accepted = rows.where(F.col("target").isNotNull()).select("doc_id", "data", "target_names", "target")
    rejected = rows.where(F.col("target").isNull()).select("doc_id", "target_names")
    return accepted, rejected


def app_dataset(df: DataFrame) -> DataFrame:
    """Dashboard records: url parts, tag labels and creator labels."""
    return df.select(
        "doc_id",
        "title",
        "language",
        "url",
        U.host(F.col("url")).alias("host"),
        U.netloc(F.col("url")).alias("domain"),
        select_tag_field(F.col("tags"), "label").alias("labels"),
        F.transform("creators", lambda c: c.label).alias("creators"),
    )


def detection_response(df: DataFrame) -> DataFrame:
    """Result rows: tags, language, keywords; other fields only where not empty."""
    echoed = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("title", "description", "fulltext", "url")]
    creators = F.when(F.size("creators") > 0, F.col("creators"))
    return df.select("doc_id", *echoed, creators.alias("creators"), "tags", "keywords", "language")


def publisher_projection(df: DataFrame, payload: str, text_of) -> DataFrame:
    """Records from a publisher's nested article json."""
    from ..schemas import PUBLISHER

    article = F.from_json(F.col(payload), PUBLISHER)
    none = F.array().cast("array<string>")
    rows = df.withColumn("_a", article["data"])
    return rows.select(
        *[c for c in df.columns if c != payload],
        text_of(F.coalesce("_a.content", F.lit(""))).alias("fulltext"),
        F.coalesce("_a.article_title", F.lit("")).alias("title"),
        F.coalesce(F.transform("_a.author", lambda a: a["nickname"]), none).alias("creators"),
        F.coalesce(F.transform("_a.topic", lambda t: t["alias"]), none).alias("tags"),
    )
