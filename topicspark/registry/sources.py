"""Queries over sources, sinks and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import filters as P
from ..operators import labels as L
from ..operators import split as M
from ..operators import stratify as Y
from ..plans import dataset as D
from ..plans.lookups import stored
from ..session import scratch_path
from ..sources import feeds, stores
from ..sources import pages as G
from ..sources import posts as Q
from ..sources import tables as T
from . import sql as S
from .common import family, joined, n_long, tag_ids
from .joins import _HEAD
from .records import ORACLES as RECORD_SQL
from .texts import _BODY_SQL

QUERIES, ORACLES, query = family()


def _batch(spark, sf) -> str:
    fragments = feeds.to_fragments(T.infos(spark, sf, with_url=True))
    return feeds.write_batch(fragments, scratch_path(spark, "batch"))


@query(
    "scan_infos",
    S.with_(S.INFOS)
    + """SELECT key, title, url, description, CAST(length(fulltext) AS BIGINT) AS n_fulltext, md5(fulltext) AS digest, language,
    array_to_string(list_sort(tag_ids), '|') AS tags, array_to_string(list_sort(creators), '|') AS creators FROM infos""",
)
def scan_infos(spark, sf):
    rows = feeds.scan_infos(spark, _batch(spark, sf))
    return rows.select(
        "key", "title", "url", "description", n_long("fulltext").alias("n_fulltext"), F.md5("fulltext").alias("digest"),
        "language", joined(P.select_tag_field(F.col("tags"))).alias("tags"),
        joined(F.transform("creators", lambda c: c.label)).alias("creators"),
    )


@query(
    "combine_fragments",
    S.with_(S.INFOS) + """SELECT key, CAST(floor(o / 10) AS BIGINT) AS page, o AS position
    FROM (SELECT key, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM infos)""",
)
def combine_fragments(spark, sf):
    fragments = feeds.read_batch(spark, _batch(spark, sf))
    return feeds.combine_fragments(fragments).select("key", "page", "position")


@query(
    "enrich_fulltext",
    S.with_(S.INFOS, f"t AS (SELECT md5(url) AS m, {S.html_text('html')} AS text FROM pages)")
    + "SELECT doc_id, CASE WHEN length(text) >= 100 THEN text ELSE description END AS fulltext FROM infos LEFT JOIN t ON md5(url) = m",
)
def enrich_fulltext(spark, sf):
    return G.enrich_fulltext(T.infos(spark, sf, with_url=True), T.page_store(spark, sf)).select("doc_id", "fulltext")


@query(
    "page_lookup",
    S.with_(S.INFOS) + "SELECT doc_id, coalesce(html, '') AS html FROM infos LEFT JOIN pages USING (url)",
)
def page_lookup(spark, sf):
    records = T.infos(spark, sf, with_url=True).select("doc_id", "url")
    return G.page_lookup(records, T.page_store(spark, sf)).select("doc_id", "html")


@query(
    "snapshot_write",
    S.with_(S.INFOS)
    + "SELECT count(*) AS n, count(DISTINCT key) AS n_keys, CAST(sum(length(fulltext)) AS BIGINT) AS n_chars FROM infos",
)
def snapshot_write(spark, sf):
    path = feeds.snapshot_write(T.infos(spark, sf).drop("doc_id"), scratch_path(spark, "snapshots"))
    rows = spark.read.schema("key string, fulltext string").json(path)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"), F.sum(n_long("fulltext")).alias("n_chars")
    )


@query("scan_posts_csv", S.with_(S.POSTS) + "SELECT id, title, tags, body, score FROM posts")
def scan_posts_csv(spark, sf):
    path = Q.write_posts_csv(T.posts(spark, sf), scratch_path(spark, "posts"), files=4)
    rows = Q.scan_posts_csv(spark, [path])
    return rows.select("id", F.col("Title").alias("title"), F.col("Tags").alias("tags"), "body", "score")


@query(
    "posts_query",
    S.with_(S.POSTS) + "SELECT id, title, score FROM posts WHERE score > 10 AND body IS NOT NULL ORDER BY score DESC, id LIMIT 50 OFFSET 25",
)
def posts_query(spark, sf):
    return Q.posts_query(T.posts(spark, sf), 25, 50).select("id", F.col("Title").alias("title"), "score")


@query(
    "posts_page_export",
    S.with_(S.POSTS)
    + """, o AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS o FROM posts WHERE score > 10 AND body IS NOT NULL)
    SELECT CAST(floor(o / 20) AS INTEGER) AS page, count(*) AS n, max(score) AS max_score, min(score) AS min_score,
    CAST(sum(id) AS BIGINT) AS id_sum FROM o GROUP BY 1""",
)
def posts_page_export(spark, sf):
    posts = T.posts(spark, sf)
    num = Q.posts_count(posts, 10).first()["n"]
    path = Q.posts_page_export(posts, scratch_path(spark, "export"), num=num, per_page=20)
    rows = spark.read.schema("id bigint, Title string, Tags string, body string, score int, ordinal bigint, page int").options(
        header=True, multiLine=True, escape='"'
    ).csv(path)
    return rows.groupBy("page").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.sum("id").alias("id_sum"),
    )


@query("posts_count", S.with_(S.POSTS) + "SELECT count(*) AS n FROM posts WHERE score > 10 AND body IS NOT NULL")
def posts_count(spark, sf):
    return Q.posts_count(T.posts(spark, sf), 10)


@query(
    "stack_dataset",
    S.with_(S.POSTS)
    + f""", p AS (SELECT id, unnest(list_distinct(regexp_extract_all(tags, '<([^>]+)>', 1))) AS label FROM posts),
    top AS (SELECT label FROM p GROUP BY label ORDER BY count(*) DESC, label LIMIT 12),
    k AS (SELECT id, array_to_string(list_sort(list(label)), '|') AS labels FROM p JOIN top USING (label) GROUP BY id)
    SELECT id, labels, concat_ws(' ', title, {_BODY_SQL}) AS description FROM posts JOIN k USING (id)""",
)
def stack_dataset(spark, sf):
    rows = Q.stack_dataset(T.posts(spark, sf), n_tag=12, concat_title=True)
    return rows.select("id", joined("labels").alias("labels"), "description")


@query(
    "dim_with_default",
    S.with_(S.INFOS, S.TAG_LIST)
    + """SELECT 'given' AS dim, tagID AS "tagID", label FROM tag_list
    UNION ALL SELECT 'empty list', 'python', 'Python' UNION ALL SELECT 'empty map', 'machine-learning', 'ML'""",
)
def dim_with_default(spark, sf):
    given = T.tag_list(spark, sf)
    empty = given.where(F.length("tagID") < 0)
    parts = (("given", stores.get_tags_list(given)), ("empty list", stores.get_tags_list(empty)), ("empty map", stores.get_tags_map(empty)))
    a, b, c = (df.select(F.lit(name).alias("dim"), "tagID", "label") for name, df in parts)
    return a.unionByName(b).unionByName(c)


@query(
    "dataset_dump",
    S.with_(S.INFOS, S.base(), S.kept(20))
    + f""", classes AS (SELECT list_sort(list(label)) AS names FROM frequent)
    SELECT doc_id, CASE WHEN {_HEAD} THEN 'test' ELSE 'train' END AS split, array_to_string(labels, '|') AS labels,
    array_to_string(list_transform(names, lambda c: CASE WHEN list_contains(labels, c) THEN 1 ELSE 0 END), '') AS target,
    CAST(len(names) AS BIGINT) AS n_classes FROM kept, classes""",
)
def dataset_dump(spark, sf):
    data, names = D.with_targets(stored(D.build_dataset(T.infos(spark, sf), language="en", filter_tags_threshold=20, concat_title=True)))
    home = scratch_path(spark, "dump")
    stores.dataset_dump(M.random_split(data, 0.3), L.class_names(data), home, "v1")
    rows, classes = stores.read_dump(spark, home, "v1")
    n = classes.agg(F.count(F.lit(1)).alias("n")).scalar()
    target = F.array_join(F.transform("target", lambda b: b.cast("string")), "")
    return rows.select("doc_id", "split", joined("labels").alias("labels"), target.alias("target"), n.alias("n_classes"))


@query(
    "stratified_dump",
    S.with_(S.INFOS, S.base(), S.kept(20))
    + """ SELECT label, count(*) AS n_records, CAST(floor(0.3 * count(*) + 0.5) AS BIGINT) AS n_wanted, TRUE AS balanced
    FROM (SELECT unnest(list_distinct(labels)) AS label FROM kept) GROUP BY label""",
)
def stratified_dump(spark, sf):
    """Classes of a dump split by label quotas; balanced: test records within one and a twentieth of the quota."""
    data = D.build_dataset(T.infos(spark, sf), language="en", filter_tags_threshold=20, concat_title=True)
    home = scratch_path(spark, "dump")
    stores.dataset_dump(Y.with_split(data, 0.3), L.class_names(data), home, "v1")
    rows, _ = stores.read_dump(spark, home, "v1")
    named = rows.select(F.explode(F.array_distinct("labels")).alias("label"), (F.col("split") == "test").cast("bigint").alias("in_test"))
    counted = named.groupBy("label").agg(F.count(F.lit(1)).alias("n_records"), F.sum("in_test").alias("n_test"))
    wanted = F.floor(F.col("n_records") * F.lit(0.3) + F.lit(0.5)).alias("n_wanted")
    return counted.select("label", "n_records", wanted, (F.abs(F.col("n_test") - wanted) * 20 <= F.col("n_records") + 20).alias("balanced"))


def _labelled(spark, sf, *columns):
    """Columns of the English records with a label of more than four; labels are cut from the texts once."""
    records = D.build_dataset(T.infos(spark, sf), language="en", concat_title=True)
    return L.filter_rare_labels(stored(records.select("doc_id", *columns)), 4)


@query("iterative_stratified_split")
def iterative_stratified_split(spark, sf):
    """Every English record by the quotas of its labels, of four records or more."""
    return Y.iterative_split(_labelled(spark, sf, "labels"), 0.3)


@query(
    "fasttext_lines",
    S.with_(S.INFOS, S.base(), S.kept(4))
    + f"""SELECT CASE WHEN {_HEAD} THEN 'test' ELSE 'train' END AS split,
    array_to_string(list_transform(labels, lambda t: '__label__' || t), ' ') || ' ' || replace(title, chr(10), ' ') AS line
    FROM base JOIN kept USING (doc_id)""",
)
def fasttext_lines(spark, sf):
    records = _labelled(spark, sf, "title", "labels")
    one_line = F.replace("title", F.lit("\n"), F.lit(" "))
    rows = records.withColumn("labels", F.array_sort("labels")).withColumn("title", one_line)
    rows = stores.fasttext_lines(M.head_tail_split(rows.select("doc_id", "title", "labels"), 0.3))
    path = stores.write_fasttext(rows, scratch_path(spark, "lines"))
    parts = [spark.read.text(f"{path}/{s}", lineSep="\n").select(F.lit(s).alias("split"), F.col("value").alias("line")) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query("load_or_build", RECORD_SQL["app_dataset"])
def load_or_build(spark, sf):
    path = scratch_path(spark, "app")

    def build():
        return P.app_dataset(T.infos(spark, sf, with_url=True))

    stores.load_or_build(spark, path, build)
    rows = stores.load_or_build(spark, path, build)
    return rows.withColumn("labels", joined("labels")).withColumn("creators", joined("creators"))


@query(
    "suggestion_log",
    S.with_(S.INFOS)
    + """SELECT '' AS title, coalesce(url, '') AS url, coalesce(description, '') AS description, 'info.poster' AS poster,
    array_to_string(list_sort(tag_ids), ', ') AS tags, coalesce(list_sort(tag_ids)[1], '') AS tags_suggest FROM infos""",
)
def suggestion_log(spark, sf):
    return stores.suggestion_rows(suggestions(T.infos(spark, sf, with_url=True)))


def suggestions(records):
    tags = F.array_sort("labels")
    return tag_ids(records).select(
        "url", "description", F.array_join(tags, ", ").alias("tags"), F.coalesce(F.get(tags, F.lit(0)), F.lit("")).alias("tags_suggest")
    )
