"""Queries over text, html and n-gram expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import filters as P
from ..operators import labels as L
from ..sources import pages as G
from ..sources import tables as T
from . import sql as S
from .common import family, tag_ids

QUERIES, ORACLES, query = family()


def documents(spark, sf):
    return T.texts(spark, sf, "documents")


def pages(spark, sf):
    return T.texts(spark, sf, "pages")


@query("clean_text", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query("mask_urls", f"SELECT doc_id, {S.mask('text')} AS text FROM documents")
def mask_urls(spark, sf):
    return documents(spark, sf).select("doc_id", X.mask_urls(F.col("text")).alias("text"))


@query(
    "clean_page_text",
    f"SELECT page_id, {S.clean('html')} AS text FROM pages",
)
def clean_page_text(spark, sf):
    return pages(spark, sf).select("page_id", X.clean_text(F.col("html")).alias("text"))


@query("html_to_text", f"SELECT page_id, {S.html_text('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return pages(spark, sf).select("page_id", H.extract_text(F.col("html")).alias("text"))


@query(
    "article_text",
    f"SELECT page_id, {S.element_text(S.article('html'), 'h1')} AS title, {S.article_text('html')} AS text FROM pages",
)
def article_text(spark, sf):
    html = F.col("html")
    return pages(spark, sf).select(
        "page_id", H.article_title(html).alias("title"), H.article_text(html).alias("text")
    )


@query("page_title", f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def page_title(spark, sf):
    return pages(spark, sf).select("page_id", H.page_title(F.col("html")).alias("title"))


@query("truncate_text", f"SELECT page_id, substr({S.html_text('html')}, 1, 3000) AS text FROM pages")
def truncate_text(spark, sf):
    return pages(spark, sf).select("page_id", X.truncate_text(H.html_to_text(F.col("html"))).alias("text"))


@query(
    "lead_sentences",
    """SELECT doc_id, array_to_string(CASE WHEN a[1] = title THEN a[2:6] ELSE a[1:5] END, '|') AS description
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(substr(text, 1, 60), chr(10))[1] AS title FROM documents)""",
)
def lead_sentences(spark, sf):
    title = F.split(F.substring("text", 1, 60), "\n")[0]
    lead = X.lead_sentences(F.col("text"), title)
    return documents(spark, sf).select("doc_id", F.array_join(lead, "|").alias("description"))


@query(
    "host_dispatch",
    f"""SELECT page_id, {S.HOST} AS host,
    CASE WHEN {S.HOST} IN (SELECT host FROM (SELECT {S.HOST} AS host FROM pages) GROUP BY host ORDER BY count(*) DESC, host LIMIT 3)
         THEN 'article' ELSE 'default' END AS rule,
    CASE WHEN {S.HOST} IN (SELECT host FROM (SELECT {S.HOST} AS host FROM pages) GROUP BY host ORDER BY count(*) DESC, host LIMIT 3)
         THEN {S.article_text('html')} ELSE {S.html_text('html')} END AS text FROM pages""",
)
def host_dispatch(spark, sf):
    rows = pages(spark, sf)
    named = [r["host"] for r in L.host_rank(rows.select(G.host_column().alias("host")), 3).collect()]
    rules = {h: ("article", H.article_text) for h in named}
    rule, text = G.dispatch_by_host(F.col("url"), F.col("html"), rules, ("default", H.html_to_text))
    return rows.select("page_id", G.host_column().alias("host"), rule.alias("rule"), text.alias("text"))


@query(
    "publisher_projection",
    f"""SELECT page_id, {S.html_text('html')} AS fulltext, coalesce({S.page_title('html')}, '') AS title,
    {S.HOST} AS creators, CASE WHEN strpos(url, '?') > 0 THEN regexp_extract(html, 'lang="([a-z]+)"', 1) ELSE '' END AS tags
    FROM pages""",
)
def publisher_projection(spark, sf):
    html, url = F.col("html"), F.col("url")
    topic = F.when(F.contains(url, F.lit("?")), F.array(F.struct(F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("alias"))))
    article = F.struct(
        html.alias("content"),
        H.page_title(html).alias("article_title"),
        F.array(F.struct(G.host_column().alias("nickname"))).alias("author"),
        topic.alias("topic"),
    )
    payloads = pages(spark, sf).select("page_id", F.to_json(F.struct(article.alias("data"))).alias("payload"))
    rows = P.publisher_projection(payloads, "payload", H.html_to_text)
    return rows.withColumn("creators", F.array_join("creators", "|")).withColumn("tags", F.array_join("tags", "|"))


# --- posts -----------------------------------------------------------------------------


@query(
    "parse_tag_string",
    S.with_(S.POSTS) + "SELECT id, array_to_string(regexp_extract_all(tags, '<([^>]+)>', 1), '|') AS tags FROM posts",
)
def parse_tag_string(spark, sf):
    return T.posts(spark, sf).select("id", F.array_join(X.parse_tag_string(F.col("Tags")), "|").alias("tags"))


_BODY_SQL = f"replace({S.entities(f'''regexp_replace({S.plain_page('body')}, '<[^>]*>', '', 'g')''')}, chr(10), ' ')"


@query("post_body_text", S.with_(S.POSTS) + f"SELECT id, {_BODY_SQL} AS body FROM posts")
def post_body_text(spark, sf):
    return T.posts(spark, sf).select("id", H.extract_text(F.col("body"), H.post_body_text).alias("body"))


@query("post_text", S.with_(S.POSTS) + f"SELECT id, concat_ws(' ', title, {_BODY_SQL}) AS description FROM posts")
def post_text(spark, sf):
    text = F.concat_ws(" ", "Title", H.post_body_text(F.col("body")))
    return T.posts(spark, sf).select("id", text.alias("description"))


# --- labels and n-grams ------------------------------------------------------------------


@query(
    "label_prefix",
    S.with_(S.INFOS)
    + """SELECT doc_id, array_to_string(list_transform(list_sort(tag_ids), lambda t: '__label__' || t), ' ') AS prefixed,
    array_to_string(list_sort(tag_ids), ' ') AS plain, replace(replace(fulltext, chr(10), ' '), chr(9), ' ') AS line FROM infos""",
)
def label_prefix(spark, sf):
    prefixed = F.transform(F.array_sort("labels"), X.add_label_prefix)
    return tag_ids(T.infos(spark, sf)).select(
        "doc_id",
        F.array_join(prefixed, " ").alias("prefixed"),
        F.array_join(F.transform(prefixed, X.drop_label_prefix), " ").alias("plain"),
        X.one_line(F.col("fulltext")).alias("line"),
    )


# labels with dashes (phrases joined), with dots (host names) and plain ones
_LABELS_SQL = f"""
names AS (SELECT tagID AS label FROM tag_map UNION SELECT DISTINCT {S.HOST} FROM pages UNION SELECT lower(p_brand) FROM part),
terms AS (
  SELECT label, unnest(CASE
    WHEN strpos(label, '-') > 0 THEN string_split(label, '-')
    WHEN strpos(label, '.') > 0 THEN list_append(string_split(label, '.'), replace(label, '.', ''))
    ELSE [label] END) AS term FROM names)"""


@query(
    "tag_terms",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _LABELS_SQL) + "SELECT label, term FROM terms WHERE term <> ''",
)
def tag_terms(spark, sf):
    names = (
        T.tag_map(spark, sf).select(F.col("tagID").alias("label"))
        .union(pages(spark, sf).select(G.host_column()))
        .union(T.table(spark, sf, "part").select(F.lower("p_brand")))
        .distinct()
    )
    return names.select("label", F.explode(X.tag_terms(F.col("label"))).alias("term"))


def _digested(rows, grams):
    """(doc_id, n, digest) of each row's n-grams, in one expression: they are never a column of rows."""
    both = X.bind(grams, lambda g: F.struct(F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("digest")))
    return rows.select("doc_id", both.alias("d")).select("doc_id", "d.n", "d.digest")


@query(
    "word_ngrams",
    f"""WITH t AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
    g AS (SELECT doc_id, list_concat(list_concat(w, {S.ngrams('w', 2)}), {S.ngrams('w', 3)}) AS grams FROM t)
    SELECT doc_id, CAST(len(grams) AS BIGINT) AS n, md5(array_to_string(grams, '|')) AS digest FROM g""",
)
def word_ngrams(spark, sf):
    grams = X.token_ngrams(F.col("w"), 1, 3)
    return _digested(documents(spark, sf).select("doc_id", X.words(F.col("text")).alias("w")), grams)


def _char_sql(n: int) -> str:
    return S.ngrams("c", n).replace(" || ' ' || ", " || ")


@query(
    "char_ngrams",
    f"""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '{S.SPACE}+', ' ', 'g') AS s FROM documents),
    c AS (SELECT doc_id, string_split(s, '') AS c FROM t),
    g AS (SELECT doc_id, list_concat(list_concat(list_concat(c, {_char_sql(2)}), {_char_sql(3)}), {_char_sql(4)}) AS grams FROM c)
    SELECT doc_id, CAST(len(grams) AS BIGINT) AS n, md5(array_to_string(grams, '|')) AS digest FROM g""",
)
def char_ngrams(spark, sf):
    return _digested(documents(spark, sf), X.char_ngrams(F.col("text"), 1, 4))
