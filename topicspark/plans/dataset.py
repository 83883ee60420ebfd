"""Composite plans: the labelled dataset and the dashboard table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import filters as P
from ..operators import labels as L
from .lookups import bounded_values, settle

DENSE_CLASSES = 10_000


def build_dataset(
    records: DataFrame,
    mode: str = "fulltext",
    tag_type: str = "tagID",
    content_length_threshold: int = V.MIN_CONTENT_LENGTH,
    language: str | None = None,
    filter_tags_threshold: int | None = None,
    concat_title: bool = False,
    partial_len: int | None = None,
    use_longer_fulltext_description: bool = False,
    remove_code: bool = True,
    text_transform=None,
    target_transform=None,
) -> DataFrame:
    """Filter, clean, project and label records; one row per ``doc_id``.

    Order of steps: language, raw lengths, cleaning, partial text, title,
    projection, rare labels, longer text. ``remove_code`` is accepted and has no
    effect. ``text_transform`` and ``target_transform`` are functions of a
    DataFrame applied last.
    """
    partial = partial_len is not None and partial_len > 0
    full = mode != "info"
    if partial and not full:
        raise ValueError("partial_len needs records with full text")
    if tag_type not in ("tagID", "label"):
        warnings.warn("tag_type should be either label or tagID, using tagID", stacklevel=2)

    df = P.filter_language(records, language)
    df = P.filter_min_length(df, content_length_threshold, fulltext=full)
    df = df.withColumn("labels", P.select_tag_field(F.col("tags"), tag_type))
    df = df.withColumn("description", X.clean_text(F.col("description")))
    if full:
        df = df.withColumn("fulltext", X.clean_text(F.col("fulltext")))
    if concat_title:
        df = df.withColumn("description", X.prefix_title(F.col("title"), F.col("description")))
        if full:
            df = df.withColumn("fulltext", X.prefix_title(F.col("title"), F.col("fulltext")))
    df = P.project_dataset(df, mode, False, "doc_id", "labels")
    df = L.filter_rare_labels(df, filter_tags_threshold)
    if use_longer_fulltext_description and full:
        df = df.withColumn("fulltext", X.longer_text(F.col("fulltext"), F.col("description")))
    for transform in (text_transform, target_transform):
        if transform is not None:
            df = df.transform(transform)
    return df


def partial_dataset(
    records: DataFrame,
    partial_len: int,
    concat_title: bool = False,
    language: str | None = None,
    filter_tags_threshold: int | None = None,
) -> DataFrame:
    """Title, language and the first ``partial_len`` characters of the cleaned text; with
    ``filter_tags_threshold`` also the labels left after removing rare ones."""
    df = P.filter_min_length(P.filter_language(records, language), fulltext=True)
    if filter_tags_threshold is not None:
        df = L.filter_rare_labels(df.withColumn("labels", P.select_tag_field(F.col("tags"))), filter_tags_threshold)
    text = X.partial_text(X.clean_text(F.col("fulltext")), partial_len)
    if concat_title:
        text = X.prefix_title(F.col("title"), text)
    labels = ["labels"] if filter_tags_threshold is not None else []
    return df.withColumn("partial_text", text).select("doc_id", "title", "language", "partial_text", *labels)


def with_targets(dataset: DataFrame) -> tuple[DataFrame, list[str]]:
    """The dataset with 0/1 targets, and its class list in order.

    Up to ``DENSE_CLASSES`` classes are literals of the plan. Beyond, a record's
    positions come by a join (:func:`operators.labels.binarize_long`) and are spread
    to the same 0/1 array; only the list of names reaches the driver.
    """
    classes = settle(L.class_names(dataset))
    names = bounded_values(classes.orderBy("idx"), "label", DENSE_CLASSES)
    if names is not None:
        return L.binarize_labels(dataset, names), names
    names = [r["label"] for r in classes.orderBy("idx").toLocalIterator()]
    ones = L.binarize_long(dataset, classes).groupBy("doc_id").agg(F.collect_set("idx").alias("ones"))
    places = F.sequence(F.lit(0), F.lit(len(names) - 1))
    bits = F.transform(places, lambda i: F.coalesce(F.array_contains("ones", i), F.lit(False)).cast("int"))
    return dataset.join(ones, "doc_id", "left").withColumn("target", bits).drop("ones"), names
