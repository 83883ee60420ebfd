"""Detection of tags, language and keywords, in batch and on arriving records.

Each request type is a function of a DataFrame, used as it is in batch and once
per micro-batch on a stream. Refused requests stay in the result with their
reason. A micro-batch is written under its batch id, so a repeated one replaces
its own output.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas
from ..functions import html as H
from ..functions import text as X
from ..operators import filters as P
from ..operators import language as G
from ..operators import matching as J
from ..operators import mining as K
from ..operators.models import LabelModel, dataset_text
from ..plans.layout import by_record, spread
from ..plans.lookups import settle
from ..sources import pages as Pages
from ..sources import stores
from ..sources.feeds import path_exists


@dataclass
class Resources:
    """What requests are answered with; loaded once per job."""

    language: G.LanguageModel | None = None
    dictionary: J.Dictionary | None = None
    model: LabelModel | None = None
    pages: DataFrame | Pages.PageStore | None = None


def resolve_by_url(requests: DataFrame, pages: DataFrame | Pages.PageStore, key: str = "doc_id") -> DataFrame:
    """Replace title, description and full text by those of the page at the url.

    The description is a summary of the page. A request whose page is missing is
    marked as refused.
    """
    found = by_record(Pages.page_lookup(requests.drop("title", "description", "fulltext"), pages, key), key)
    html = F.col("html")
    present = html != ""
    rows = found.select(
        *[c for c in found.columns if c != "html"],
        F.when(present, H.page_title(html)).alias("title"),
        F.when(present, H.html_to_text(html)).alias("fulltext"),
    )
    rows = settle(rows)  # pages are taken apart once, for the summary and the answer
    summary = K.summarize(rows.where(F.col("valid") & F.col("fulltext").isNotNull()), "fulltext", "title", key=key)
    rows = rows.join(summary.withColumnRenamed("summary", "description"), key, "left")
    missing = F.col("valid") & F.col("fulltext").isNull()
    return rows.withColumn("reason", F.when(missing, F.lit(V.URL_NOT_FETCHABLE)).otherwise(F.col("reason"))).withColumn(
        "valid", F.col("reason") == ""
    )


def checked_requests(requests: DataFrame, by_url: bool, pages: DataFrame | None, validate: bool = True) -> DataFrame:
    """Requests with ``valid``, ``reason`` and the ``text`` they are judged by."""
    rows = P.validate_request(requests, by_url) if validate else requests.withColumn("reason", F.lit("")).withColumn("valid", F.lit(True))
    if by_url:
        if not validate:
            missing = F.when(F.col("url").isNull(), V.URL_MISSING).otherwise("")
            rows = rows.withColumn("reason", missing).withColumn("valid", F.col("reason") == "")
        rows = resolve_by_url(rows, pages)
    rows = rows.withColumn("text", X.record_text(F.col("fulltext"), F.col("description"), F.col("title")))
    missing = F.col("valid") & F.col("text").isNull()
    return rows.withColumn("reason", F.when(missing, V.TEXT_MISSING).otherwise(F.col("reason"))).withColumn(
        "valid", F.col("reason") == ""
    )


def _tagged(rows: DataFrame, r: Resources, only_model: bool) -> DataFrame:
    """(doc_id, tags): the model and the dictionary read the texts side by side."""
    texts = rows.select("doc_id", "text")
    if r.model:
        tagged = r.model.apply(texts.select("doc_id", X.clean_text(F.col("text")).alias("text")), F.col("text"))
        tagged = tagged.select("doc_id", F.col("predicted").alias("tags"))
    else:
        tagged = texts.select("doc_id", F.array().cast("array<string>").alias("tags"))
    if not only_model and r.dictionary:
        tagged = J.with_ids(tagged, J.entity_ids(texts, r.dictionary, F.col("text")))
    return tagged


def each_request(answer: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Answer requests one by one also if several have the same ``doc_id``: they are
    numbered once, in the shared folder, and joined by their numbers."""

    @functools.wraps(answer)
    def numbered(requests: DataFrame, *args, **options) -> DataFrame:
        rows = spread(settle(requests.withColumn("_own_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id())))
        found = answer(rows.drop("_own_id"), *args, **options)
        named = found.join(rows.select("doc_id", "_own_id"), "doc_id").withColumn("doc_id", F.col("_own_id"))
        return named.select(*found.columns)

    return numbered


@each_request
def resolve(requests: DataFrame, pages: DataFrame | Pages.PageStore) -> DataFrame:
    """(doc_id, title, fulltext, description, reason): each request checked and resolved by its url."""
    rows = resolve_by_url(P.validate_request(requests, by_url=True), pages)
    return rows.select("doc_id", "title", "fulltext", "description", "reason")


@each_request
def detect_language(requests: DataFrame, r: Resources, by_url: bool = False) -> DataFrame:
    """(doc_id, valid, reason, language) per request."""
    rows = checked_requests(requests, by_url, r.pages, validate=False)
    predicted = G.predict_language(rows.where("valid"), r.language, F.col("text"))
    answer = rows.select("doc_id", "valid", "reason").join(predicted, "doc_id", "left")
    return answer.withColumnRenamed("predicted", "language")


@each_request
def detect_tags(requests: DataFrame, r: Resources, by_url: bool = False, only_model: bool = False) -> DataFrame:
    """(doc_id, valid, reason, tags) per request; refused requests have null tags."""
    rows = checked_requests(requests, by_url, r.pages)
    tagged = _tagged(rows.where("valid"), r, only_model)
    return rows.select("doc_id", "valid", "reason").join(tagged, "doc_id", "left")


@each_request
def detect(
    requests: DataFrame, r: Resources, by_url: bool = False, only_model: bool = False, num_keywords: int = V.NUM_KEYWORDS
) -> DataFrame:
    """The whole answer: tags, language, keywords and the record's own fields."""
    rows = checked_requests(requests, by_url, r.pages)
    good = rows.where("valid")
    if "creators" not in good.columns:
        good = good.withColumn("creators", F.array().cast("array<string>"))
    tagged = _tagged(good, r, only_model)
    language = G.predict_language(good, r.language, F.col("text")).withColumnRenamed("predicted", "language")
    keywords = K.keywords(good, "text", num_keywords, unique=True)
    answer = good.drop("tags").join(tagged, "doc_id").join(language, "doc_id").join(keywords, "doc_id", "left")
    none = F.array().cast("array<string>")
    answer = P.detection_response(answer.withColumn("keywords", F.coalesce("keywords", none)))
    return rows.select("doc_id", "valid", "reason").join(answer, "doc_id", "left")


# --- streams -------------------------------------------------------------------------------


def document_stream(spark: SparkSession, folder: str, pattern: str = "documents.parquet") -> DataFrame:
    """Arriving documents of a folder: what the pattern names may be a file or a folder of files,
    and may not be there yet (the braces make the path a pattern, which may match nothing)."""
    return spark.readStream.schema(schemas.DOCUMENT).parquet(f"{folder.rstrip('/')}/{{{pattern}}}")


def run_available(
    stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> DataFrame:
    """Answer all records that have arrived, one micro-batch at a time, and return
    the table of answers. Called again, it takes up where it stopped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = spread(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            answer(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            rows.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    if not path_exists(spark, out):  # nothing has arrived yet
        return answer(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(out).drop("batch")


def stream_suggestions(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append suggestions with their arrival time."""
    rows = stores.suggestion_rows(stream).withColumn("postAt", F.current_timestamp())
    query = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    if not path_exists(spark, out):  # nothing has arrived yet
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(out)


def feed_scoring(
    stream: DataFrame, model: LabelModel, out: str, checkpoint: str, pages: DataFrame | Pages.PageStore | None = None,
    key: str = "doc_id", expiry: str = "7 days",
) -> DataFrame:
    """Score newly arrived records: enrich, drop short texts, clean, predict, write back.

    What was scored is kept as keyed state below the checkpoint, by key and a digest of the record:
    a record sent again is left out, also after a restart, until ``expiry`` has passed; one whose
    content has changed is scored anew. Each answer carries ``version``, that digest."""
    content = [c for c in ("url", "title", "description", "fulltext") if c in stream.columns]
    version = F.md5(F.to_json(F.struct(*content)))
    known = stream.withColumn("version", version).withColumn("_arrived", F.current_timestamp())
    fresh = known.withWatermark("_arrived", expiry).dropDuplicatesWithinWatermark([key, "version"]).drop("_arrived")

    def answer(batch: DataFrame) -> DataFrame:
        rows = Pages.enrich_fulltext(batch, pages, key=key) if pages is not None else batch
        rows = P.filter_min_length(rows)
        return model.apply(rows, dataset_text(rows)).select(key, "version", "predicted")

    return run_available(fresh, answer, out, checkpoint)
