"""Queries over filters, projections, label statistics and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U
from ..operators import filters as P
from ..operators import labels as L
from ..plans import dataset as D
from ..sources import tables as T
from . import sql as S
from .common import family, joined, n_long, tag_ids

QUERIES, ORACLES, query = family()

# --- filters and projections ---------------------------------------------------------


@query(
    "filter_language",
    S.with_(S.INFOS) + "SELECT doc_id, title, language FROM infos WHERE language = 'en'",
)
def filter_language(spark, sf):
    return P.filter_language(T.infos(spark, sf), "en").select("doc_id", "title", "language")


@query(
    "filter_min_length",
    S.with_(S.INFOS, S.base(None))
    + "SELECT doc_id, CAST(length(fulltext) AS BIGINT) AS n_fulltext, CAST(length(description) AS BIGINT) AS n_description FROM base",
)
def filter_min_length(spark, sf):
    return P.filter_min_length(T.infos(spark, sf)).select(
        "doc_id", n_long("fulltext").alias("n_fulltext"), n_long("description").alias("n_description")
    )


@query(
    "select_tag_field",
    S.with_(S.INFOS)
    + """SELECT doc_id, array_to_string(list_sort(tag_ids), '|') AS ids,
    array_to_string(list_sort(list_transform(tag_ids, lambda t: upper(t))), '|') AS names,
    array_to_string(list_sort(tag_ids), '|') AS unknown_field FROM infos""",
)
def select_tag_field(spark, sf):
    tags = F.col("tags")
    return T.infos(spark, sf).select(
        "doc_id",
        joined(P.select_tag_field(tags, "tagID")).alias("ids"),
        joined(P.select_tag_field(tags, "label")).alias("names"),
        joined(P.select_tag_field(tags, "other")).alias("unknown_field"),
    )


@query(
    "partial_text",
    S.with_(S.INFOS, S.base(None))
    + f"SELECT doc_id, title, language, title || '. ' || substr({S.clean('fulltext')}, 1, 1000) AS partial_text FROM base",
)
def partial_text(spark, sf):
    return D.partial_dataset(T.infos(spark, sf), 1000, concat_title=True)


@query(
    "partial_labelled",
    S.with_(S.INFOS, S.base(), S.kept(4))
    + f"""SELECT doc_id, title, language, substr({S.clean('fulltext')}, 1, 1000) AS partial_text, array_to_string(labels, '|') AS labels
    FROM base JOIN kept USING (doc_id)""",
)
def partial_labelled(spark, sf):
    rows = D.partial_dataset(T.infos(spark, sf), 1000, language="en", filter_tags_threshold=4)
    return rows.withColumn("labels", joined("labels"))


@query(
    "concat_title",
    S.with_(S.INFOS)
    + "SELECT doc_id, title || '. ' || description AS description, title || '. ' || fulltext AS fulltext FROM infos",
)
def concat_title(spark, sf):
    title = F.col("title")
    return T.infos(spark, sf).select(
        "doc_id",
        X.prefix_title(title, F.col("description")).alias("description"),
        X.prefix_title(title, F.col("fulltext")).alias("fulltext"),
    )


@query(
    "dataset_projection",
    S.with_(S.INFOS, S.base(None, fulltext=False))
    + f"SELECT doc_id, title, {S.clean('description')} AS description, language FROM base",
)
def dataset_projection(spark, sf):
    return D.build_dataset(T.infos(spark, sf), mode="info").select("doc_id", "title", "description", "language")


@query(
    "longer_text",
    S.with_(S.INFOS)
    + "SELECT doc_id, CASE WHEN length(fulltext) < length(d) THEN d ELSE fulltext END AS text "
    "FROM (SELECT *, title || '. ' || description AS d FROM infos)",
)
def longer_text(spark, sf):
    described = X.prefix_title(F.col("title"), F.col("description"))
    return T.infos(spark, sf).select("doc_id", X.longer_text(F.col("fulltext"), described).alias("text"))


def _built(spark, sf, threshold=4):
    return D.build_dataset(
        T.infos(spark, sf), language="en", filter_tags_threshold=threshold, concat_title=True,
        use_longer_fulltext_description=True,
    )


_DATASET_SQL = f"""
cleaned AS (SELECT doc_id, title, language, title || '. ' || {S.clean('description')} AS description,
                   title || '. ' || {S.clean('fulltext')} AS fulltext FROM base),
dataset AS (SELECT doc_id, title, language, description,
                   CASE WHEN length(fulltext) < length(description) THEN description ELSE fulltext END AS fulltext,
                   labels FROM cleaned JOIN kept USING (doc_id))"""


@query(
    "build_dataset",
    S.with_(S.INFOS, S.base(), S.kept(4), _DATASET_SQL)
    + "SELECT doc_id, title, language, description, fulltext, array_to_string(labels, '|') AS labels FROM dataset",
)
def build_dataset(spark, sf):
    return _built(spark, sf).withColumn("labels", joined("labels"))


@query(
    "record_text",
    S.with_(S.INFOS)
    + """SELECT doc_id, CASE WHEN coalesce(title, '') = '' THEN body WHEN body IS NULL THEN title
    ELSE title || '. ' || body END AS text
    FROM (SELECT doc_id, title, coalesce(nullif(fulltext, ''), nullif(description, '')) AS body FROM infos)""",
)
def record_text(spark, sf):
    return T.infos(spark, sf).select(
        "doc_id", X.record_text(F.col("fulltext"), F.col("description"), F.col("title")).alias("text")
    )


REQUESTS_SQL = """
requests AS (
  SELECT doc_id, url, title, description, fulltext FROM infos
  UNION ALL SELECT -1, NULL, 't', 'only four tokens here', NULL
  UNION ALL SELECT -2, NULL, 't', array_to_string(list_transform(range(2049), lambda i: 'w'), ' '), NULL
  UNION ALL SELECT -3, NULL, 't', NULL, 'text'
  UNION ALL SELECT -4, 'ftp://host/file', 't', 'five tokens are enough here', NULL
  UNION ALL SELECT -5, NULL, NULL, NULL, NULL
)"""
REASON_TEXT_SQL = f"""CASE WHEN description IS NULL OR len(string_split(description, ' ')) < 5 THEN '{V.TOO_SHORT}'
  WHEN len(string_split(description, ' ')) > 2048 THEN '{V.TOO_LONG}' ELSE '' END"""
REASON_URL_SQL = f"""CASE WHEN url IS NULL THEN '{V.URL_MISSING}'
  WHEN NOT regexp_matches(url, '^(?:http)s?://') THEN '{V.URL_UNSUPPORTED}' ELSE '' END"""


@query(
    "validate_request",
    S.with_(S.INFOS, REQUESTS_SQL)
    + f"""SELECT doc_id, 'text' AS mode, reason, reason = '' AS valid FROM (SELECT doc_id, {REASON_TEXT_SQL} AS reason FROM requests)
    UNION ALL SELECT doc_id, 'url', reason, reason = '' FROM (SELECT doc_id, {REASON_URL_SQL} AS reason FROM requests)""",
)
def validate_request(spark, sf):
    requests = T.requests(spark, sf)
    by_text = P.validate_request(requests).select("doc_id", F.lit("text").alias("mode"), "reason", "valid")
    by_url = P.validate_request(requests, by_url=True).select("doc_id", F.lit("url").alias("mode"), "reason", "valid")
    return by_text.unionByName(by_url)


@query(
    "language_dataset",
    S.with_(S.INFOS)
    + """SELECT doc_id, title || '. ' || description AS data, language AS target_names, 0 AS target, 'accepted' AS status
    FROM infos WHERE language = 'en'
    UNION ALL SELECT doc_id, NULL, language, NULL, 'rejected' FROM infos WHERE language NOT IN ('en', 'cn')""",
)
def language_dataset(spark, sf):
    accepted, rejected = P.language_dataset(T.infos(spark, sf))
    return accepted.withColumn("status", F.lit("accepted")).unionByName(
        rejected.withColumn("status", F.lit("rejected")), allowMissingColumns=True
    )


@query(
    "app_dataset",
    S.with_(S.INFOS)
    + """SELECT doc_id, title, language, url,
    lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', '')) AS host,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain,
    array_to_string(list_sort(list_transform(tag_ids, lambda t: upper(t))), '|') AS labels,
    array_to_string(list_sort(creators), '|') AS creators FROM infos""",
)
def app_dataset(spark, sf):
    df = P.app_dataset(T.infos(spark, sf, with_url=True))
    return df.withColumn("labels", joined("labels")).withColumn("creators", joined("creators"))


# --- label statistics ----------------------------------------------------------------------


@query(
    "label_counts",
    S.with_(S.INFOS) + "SELECT label, count(*) AS n FROM (SELECT unnest(tag_ids) AS label FROM infos) GROUP BY label",
)
def label_counts(spark, sf):
    return L.label_counts(tag_ids(T.infos(spark, sf)))


@query(
    "filter_rare_labels",
    S.with_(S.INFOS, S.base(), S.kept(4)) + "SELECT doc_id, array_to_string(labels, '|') AS labels FROM kept",
)
def filter_rare_labels(spark, sf):
    records = tag_ids(P.filter_min_length(P.filter_language(T.infos(spark, sf), "en")))
    return L.filter_rare_labels(records, 4).select("doc_id", joined("labels").alias("labels"))


@query(
    "binarize_labels",
    S.with_(S.INFOS, S.base(), S.kept(20))
    + """, classes AS (SELECT list_sort(list(label)) AS names FROM frequent)
    SELECT doc_id, array_to_string(list_transform(names, lambda c: CASE WHEN list_contains(labels, c) THEN 1 ELSE 0 END), '') AS target
    FROM kept, classes""",
)
def binarize_labels(spark, sf):
    df, _ = D.with_targets(_built(spark, sf, 20))
    return df.select("doc_id", F.array_join(F.transform("target", lambda b: b.cast("string")), "").alias("target"))


@query(
    "binarize_long",
    S.with_(S.INFOS, S.base(), S.kept(1))
    + """SELECT doc_id, CAST(idx - 1 AS INTEGER) AS idx
    FROM (SELECT label, row_number() OVER (ORDER BY label) AS idx FROM frequent) JOIN pairs USING (label)""",
)
def binarize_long(spark, sf):
    df = _built(spark, sf, 1)
    return L.binarize_long(df, L.class_names(df))


@query(
    "inverse_binarize",
    S.with_(S.INFOS, S.base(), S.kept(20)) + "SELECT doc_id, array_to_string(labels, '|') AS labels FROM kept",
)
def inverse_binarize(spark, sf):
    df, names = D.with_targets(_built(spark, sf, 20))
    return df.select("doc_id", F.array_join(L.inverse_binarize(F.col("target"), names), "|").alias("labels"))


@query("label_column_counts", S.with_(S.INFOS, S.base(), S.kept(20)) + "SELECT label, n FROM frequent")
def label_column_counts(spark, sf):
    df, names = D.with_targets(_built(spark, sf, 20))
    return L.label_column_counts(df, names)


@query(
    "labels_per_record",
    S.with_(S.INFOS)
    + """SELECT CAST(n_labels AS INTEGER) AS n_labels, n, round(100.0 * n / sum(n) OVER (), 6) AS percent
    FROM (SELECT len(tag_ids) AS n_labels, count(*) AS n FROM infos GROUP BY 1)""",
)
def labels_per_record(spark, sf):
    return L.labels_per_record(tag_ids(T.infos(spark, sf))).withColumn("percent", F.round("percent", 6))


@query(
    "language_share",
    S.with_(S.INFOS)
    + """SELECT language, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (
    SELECT CASE language WHEN 'en' THEN 'English' WHEN 'cn' THEN 'Chinese' ELSE language END AS language, count(*) AS n
    FROM infos GROUP BY 1)""",
)
def language_share(spark, sf):
    return L.language_share(T.infos(spark, sf), X.language_name).withColumn("percent", F.round("percent", 6))


def _rank_sql(values: str, name: str, total: str, top: int) -> str:
    return f"""SELECT {name}, n, CAST(row_number() OVER (ORDER BY n DESC, {name}) AS INTEGER) AS "Rank",
    round(n / {total}::DOUBLE, 6) AS "Portion"
    FROM (SELECT {name}, count(*) AS n FROM ({values}) GROUP BY {name} ORDER BY n DESC, {name} LIMIT {top})"""


def _rounded(df):
    return df.withColumn("Portion", F.round("Portion", 6))


@query(
    "label_rank",
    S.with_(S.INFOS, S.base(), S.kept(4))
    + _rank_sql("SELECT unnest(labels) AS label FROM kept", "label", "(SELECT count(*) FROM kept)", V.DASHBOARD_TOP),
)
def label_rank(spark, sf):
    return _rounded(L.label_rank(_built(spark, sf), V.DASHBOARD_TOP))


@query(
    "creator_rank",
    S.with_(S.INFOS)
    + _rank_sql("SELECT unnest(creators) AS creator FROM infos", "creator", "(SELECT count(*) FROM infos)", V.DASHBOARD_TOP),
)
def creator_rank(spark, sf):
    creators = T.infos(spark, sf).select(F.transform("creators", lambda c: c.label).alias("creators"))
    return _rounded(L.creator_rank(creators, V.DASHBOARD_TOP))


@query(
    "host_rank",
    S.with_(S.INFOS)
    + _rank_sql(
        "SELECT lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', '')) AS host FROM infos WHERE url IS NOT NULL",
        "host", "(SELECT count(*) FROM infos)", V.DASHBOARD_TOP,
    ),
)
def host_rank(spark, sf):
    return _rounded(L.host_rank(P.app_dataset(T.infos(spark, sf, with_url=True)), V.DASHBOARD_TOP))


@query(
    "label_cardinality",
    S.with_(S.INFOS) + "SELECT count(DISTINCT label) AS n_labels FROM (SELECT unnest(tag_ids) AS label FROM infos)",
)
def label_cardinality(spark, sf):
    return L.label_cardinality(tag_ids(T.infos(spark, sf)))


# --- ranks and sets -----------------------------------------------------------------------------


def _scored(spark, sf):
    records = T.infos(spark, sf)
    base = tag_ids(P.filter_min_length(P.filter_language(records, "en")))
    frequent = L.label_counts(base).where(F.col("n") > 20)
    return T.scores(records, frequent)


SCORES_SQL = (S.INFOS, S.base(), S.kept(20), S.scores(20))


@query(
    "topn_labels",
    S.with_(*SCORES_SQL)
    + """SELECT doc_id, label, proba, CAST(r AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY proba DESC, label) AS r FROM scores) WHERE r <= 2""",
)
def topn_labels(spark, sf):
    return L.topn_labels(_scored(spark, sf), 2).select("doc_id", "label", "proba", "rank")


@query(
    "threshold_labels",
    S.with_(*SCORES_SQL)
    + """SELECT doc_id, label, proba, CAST(r AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY proba DESC, label) AS r FROM scores)
    WHERE r <= 4 AND (proba >= 0.8 OR r = 1)""",
)
def threshold_labels(spark, sf):
    return L.threshold_labels(_scored(spark, sf), V.LABEL_CANDIDATES, 0.8).select("doc_id", "label", "proba", "rank")


@query(
    "union_labels",
    S.with_(S.INFOS) + "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(tag_ids, creators))), '|') AS labels FROM infos",
)
def union_labels(spark, sf):
    own = P.select_tag_field(F.col("tags"))
    names = F.transform("creators", lambda c: c.label)
    return T.infos(spark, sf).select("doc_id", F.array_join(L.union_labels(own, names), "|").alias("labels"))


@query(
    "concat_records",
    "SELECT page_id AS id, url AS title FROM pages UNION ALL SELECT p_partkey, p_name FROM part",
)
def concat_records(spark, sf):
    pages = T.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"))
    parts = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return pages.unionByName(parts)


@query(
    "align_labels",
    S.with_(S.INFOS, S.base(), S.kept(4)) + "SELECT doc_id, title, array_to_string(labels, '|') AS labels FROM base JOIN kept USING (doc_id)",
)
def align_labels(spark, sf):
    records = P.filter_min_length(P.filter_language(T.infos(spark, sf), "en"))
    labels = L.filter_rare_labels(tag_ids(records), 4).select("doc_id", joined("labels").alias("labels"))
    return records.select("doc_id", "title").join(labels, "doc_id")


@query(
    "semi_join_top_labels",
    S.with_(S.POSTS)
    + """, pairs AS (SELECT id, unnest(list_distinct(regexp_extract_all(tags, '<([^>]+)>', 1))) AS label FROM posts),
    top AS (SELECT label FROM pairs GROUP BY label ORDER BY count(*) DESC, label LIMIT 10)
    SELECT id, array_to_string(list_sort(list(label)), '|') AS labels FROM pairs JOIN top USING (label) GROUP BY id""",
)
def semi_join_top_labels(spark, sf):
    posts = T.posts(spark, sf).select("id", F.array_distinct(X.parse_tag_string(F.col("Tags"))).alias("labels"))
    return L.semi_join_top_labels(posts, 10, key="id").select("id", joined("labels").alias("labels"))


# --- url and label text -------------------------------------------------------------------------------


@query(
    "url_parts",
    r"""SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', '')) AS host,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages""",
)
def url_parts(spark, sf):
    return T.table(spark, sf, "pages").select(
        "page_id", U.host(F.col("url")).alias("host"), U.netloc(F.col("url")).alias("domain")
    )


@query(
    "language_name",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'cn' THEN 'Chinese' ELSE lang END AS language FROM documents",
)
def language_name(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.language_name(F.col("lang")).alias("language"))
