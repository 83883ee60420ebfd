"""Record tables built from the test tables.

The given tables hold documents, pages and parts; these functions shape them
into the record types of the library (records, posts, dimensions, requests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rows import each
from ..plans.layout import spread
from ..plans.lookups import lookup_join, settle
from ..plans.ordering import hash32, with_ordinal

PHRASE_TIMES = 20  # counts from which a phrase or word is an entry, at every size
WORD_TIMES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose whole texts are worked on row by row."""
    return spread(table(spark, sf_dir, name))


def repeated_words(text: Column, letters: int = 5) -> Column:
    """Words of at least ``letters`` letters that the whole text has more than once, sorted."""
    long = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: F.length(t) >= letters)
    return X.bind(F.array_sort(long), lambda w: F.array_distinct(F.filter(w, lambda t, i: (i > 0) & (F.get(w, i - 1) == t))))


def shape_infos(docs: DataFrame) -> DataFrame:
    """Records from document rows (batch or streaming), without url."""
    head = F.substring("text", 1, 300)
    tag_ids = repeated_words(F.col("text"))
    names = (
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 5 == 0, F.array("source", F.lit("editor")))
        .otherwise(F.array("source"))
    )
    return docs.select(
        "doc_id",
        F.md5(F.col("doc_id").cast("string")).alias("key"),
        F.substring("text", 1, 60).alias("title"),
        head.alias("description"),
        F.col("text").alias("fulltext"),
        F.col("lang").alias("language"),
        F.transform(tag_ids, lambda t: F.struct(t.alias("tagID"), F.upper(t).alias("label"))).alias("tags"),
        F.transform(names, lambda n: F.struct(n.alias("label"))).alias("creators"),
    )


def infos(spark: SparkSession, sf_dir: str, with_url: bool = False) -> DataFrame:
    records = shape_infos(texts(spark, sf_dir, "documents"))
    if not with_url:
        return records
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return records.join(urls, "doc_id", "left")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    pages = texts(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), "html")

    def bracket(c):
        return F.concat(F.lit("<"), c, F.lit(">"))

    words = F.array_join(F.transform(F.split("p_name", " "), bracket), "")
    return part.join(pages, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("Title"),
        F.concat(bracket(F.lower("p_brand")), bracket(F.lower("p_type")), words).alias("Tags"),
        F.col("html").alias("body"),
        F.col("p_size").cast("int").alias("score"),
    )


def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", "url", F.md5("url").alias("url_md5"), "html")


def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags as a dimension (tagID, label)."""
    return each(infos(spark, sf_dir), F.col("tags"), "t").select("t.tagID", "t.label").distinct()


def frequent_phrases(spark: SparkSession, sf_dir: str, times: int = PHRASE_TIMES) -> DataFrame:
    """Two-word phrases found at least ``times`` times."""
    grams = X.token_ngrams(X.words(F.col("text")), 2, 2)
    counted = each(texts(spark, sf_dir, "documents"), grams, "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= times).select("phrase")


def tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map rows (label, tagID): tag labels plus frequent phrases joined by '-'."""
    phrases = frequent_phrases(spark, sf_dir).select(
        F.col("phrase").alias("label"), F.replace("phrase", F.lit(" "), F.lit("-")).alias("tagID")
    )
    return tag_list(spark, sf_dir).select("label", "tagID").unionByName(phrases)


def word_vocabulary(spark: SparkSession, sf_dir: str, slots: int = 100, times: int = WORD_TIMES) -> DataFrame:
    """A vocabulary (position, term): free slots, then all words found at least ``times``
    times, the most frequent first."""
    counted = each(texts(spark, sf_dir, "documents"), X.words(F.col("text")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_ordinal(counted.where(F.col("n") >= times), F.desc("n"), F.col("term"), name="position")
    free = spark.range(slots).select(
        F.col("id").alias("position"), F.concat(F.lit("[unused"), F.col("id").cast("string"), F.lit("]")).alias("term")
    )
    return free.unionByName(ranked.select((F.col("position") + slots).alias("position"), "term"))


EDGE_REQUESTS = (
    # doc_id, url, title, description, fulltext: one per reason to refuse
    (-1, None, "t", "only four tokens here", None),
    (-2, None, "t", " ".join(["w"] * 2049), None),
    (-3, None, "t", None, "text"),
    (-4, "ftp://host/file", "t", "five tokens are enough here", None),
    (-5, None, None, None, None),
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection requests: every record, plus one row per reason to refuse."""
    columns = ["doc_id", "url", "title", "description", "fulltext"]
    edge = spark.createDataFrame(
        EDGE_REQUESTS, "doc_id bigint, url string, title string, description string, fulltext string"
    )
    return infos(spark, sf_dir, with_url=True).select(*columns).unionByName(edge)


def scores(records: DataFrame, classes: DataFrame, candidates: int = 4, seed: int = 7) -> DataFrame:
    """A score per record and candidate class: truth ``y`` and a repeatable ``proba``.

    A record's candidates are its own classes and ``candidates`` drawn ones, so the
    table grows with the records and not with the number of classes.
    """
    placed = settle(with_ordinal(classes.select("label").distinct(), F.col("label"), name="idx"))
    n = placed.count()
    own = each(records, F.transform("tags", lambda t: t.tagID), "label", "doc_id")
    rows = lookup_join(own, placed.select("label"), ["label"], "left_semi", spread_by=["doc_id"], settled=True).withColumn("y", F.lit(1))
    if n:
        draws = F.array(*[hash32(seed, "doc_id", F.lit(j)) % n for j in range(candidates)])
        drawn = records.select("doc_id", F.explode(draws).alias("idx"))
        picked = lookup_join(drawn, placed, ["idx"], spread_by=["doc_id"], settled=True)
        rows = rows.unionByName(picked.select("doc_id", "label", F.lit(0).alias("y")))
    rows = rows.groupBy("doc_id", "label").agg(F.max("y").alias("y"))
    return rows.withColumn("proba", (hash32(seed, "doc_id", "label") % 1000) / F.lit(1000.0))
