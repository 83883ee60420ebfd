"""Queries that train and apply models; checked by properties in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import filters as P
from ..operators import labels as L
from ..operators import models as N
from ..operators import split as M
from ..plans import dataset as D
from ..plans.lookups import stored
from ..session import scratch_path
from ..sources import tables as T
from .common import family, joined

QUERIES, _, query = family()
ORACLES: dict = {}


def dataset(spark, sf, threshold=20, columns=("title", "description", "fulltext")):
    """(rows, classes) of the English dataset; labels are cut from the texts and the texts cleaned once,
    those of ``columns`` alone."""
    records = D.build_dataset(T.infos(spark, sf), language="en", concat_title=True)
    kept = stored(records.select("doc_id", *[c for c in columns if c in records.columns], "labels"))
    return D.with_targets(L.filter_rare_labels(kept, threshold))


def tag_model(spark, sf, threshold=20):
    """(model, split rows): trained on the train rows."""
    rows, classes = dataset(spark, sf, threshold, ["fulltext"])
    rows = M.random_split(rows, 0.3)
    train = M.augment_crop(rows.where(F.col("split") == "train"), "fulltext", level=1, crop_ratio=0.2)
    return N.train_tag_model(train, classes, ngrams=(1, 2), penalty="l1"), rows


@query("train_tag_model")
def train_tag_model(spark, sf):
    model, rows = tag_model(spark, sf)
    return model.transform(rows.select("doc_id", "split", "labels", "fulltext")).select(
        "doc_id", "split", joined("labels").alias("labels"), joined("predicted").alias("predicted")
    )


@query("train_embedding_model")
def train_embedding_model(spark, sf):
    points = T.table(spark, sf, "embeddings").withColumn("labels", F.array(F.col("label").cast("string")))
    points = M.random_split(points, 0.3, key="vec_id")
    classes = [r["label"] for r in L.class_names(points).orderBy("idx").collect()]
    path = scratch_path(spark, "embedding-model")
    model = N.run_pipeline(
        lambda: points.where(F.col("split") == "train"), None,
        lambda rows: N.train_embedding_model(rows, classes), path,
    )
    scored = model.transform(points)
    return scored.select("vec_id", "split", joined("labels").alias("labels"), joined("predicted").alias("predicted"))


@query("predict_tags_batch")
def predict_tags_batch(spark, sf):
    model, _ = tag_model(spark, sf)
    path = scratch_path(spark, "tag-model")
    model.save(spark, path)
    loaded = N.LabelModel.load(spark, path)
    return N.predict_tags_batch(T.infos(spark, sf), loaded).select("doc_id", joined("predicted").alias("predicted"))


@query("tag_grid_search")
def tag_grid_search(spark, sf):
    rows, classes = dataset(spark, sf, 30, ["fulltext"])
    return N.tag_grid_search(rows, classes)


def language_rows(spark, sf):
    """Language rows of whole texts."""
    codes = {r["lang"]: i for i, r in enumerate(T.table(spark, sf, "documents").groupBy("lang").count().orderBy("lang").collect())}
    return P.language_dataset(T.infos(spark, sf).withColumn("description", F.col("fulltext")), codes)[0]


@query("train_language_model")
def train_language_model(spark, sf):
    rows = M.random_split(language_rows(spark, sf), 0.5)
    model, languages = N.train_language_model(rows.where(F.col("split") == "train"))
    return N.apply_language_model(rows, model, languages).select("doc_id", "split", F.col("target_names").alias("lang"), "predicted")


@query("language_grid_search")
def language_grid_search(spark, sf):
    return N.language_grid_search(language_rows(spark, sf))


@query("label_scorer")
def label_scorer(spark, sf):
    rows, classes = dataset(spark, sf, 30, ["title"])
    rows = M.head_tail_split(rows, 0.3)
    scorer = N.train_label_scorer(rows.where(F.col("split") == "train"), classes)
    scores = N.label_scores(rows, scorer, 5)
    return L.threshold_labels(scores, 5, 0.2).select("doc_id", "label", F.round("proba", 4).alias("proba"), "rank")


@query("embedding_map")
def embedding_map(spark, sf):
    points = T.table(spark, sf, "embeddings")
    return N.embedding_map(M.fraction_sample(points, V.EMBEDDING_SHARE, key="vec_id"), "vec_id", 10)
