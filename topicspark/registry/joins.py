"""Queries over dictionary joins, vocabularies, splits, TF-IDF and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import filters as P
from ..operators import labels as L
from ..operators import matching as J
from ..operators import metrics as A
from ..operators import split as M
from ..operators import tfidf as I
from ..plans import dataset as D
from ..sources import tables as T
from . import sql as S
from .common import family, joined, tag_ids
from .records import SCORES_SQL, _scored

QUERIES, ORACLES, query = family()

# --- dictionaries ---------------------------------------------------------------------

_MATCH_SQL = f"""
forms AS (
  SELECT tagID, {S.tokens('label')} AS t FROM tag_map
  UNION SELECT tagID, {S.tokens('lower(label)')} FROM tag_map
  UNION SELECT tagID, {S.tokens('tagID')} FROM tag_map),
phrase_of AS (SELECT DISTINCT tagID, array_to_string(t, ' ') AS phrase FROM forms),
tok AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(t) AS phrase FROM tok
  UNION ALL SELECT doc_id, unnest({S.ngrams('t', 2)}) FROM tok
  UNION ALL SELECT doc_id, unnest({S.ngrams('t', 3)}) FROM tok),
matches AS (SELECT doc_id, tagID, count(*) AS n FROM grams JOIN phrase_of USING (phrase) GROUP BY doc_id, tagID)"""


@query(
    "phrase_match",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _MATCH_SQL) + 'SELECT doc_id, tagID AS "tagID", n FROM matches',
)
def phrase_match(spark, sf):
    docs = T.texts(spark, sf, "documents").select("doc_id", "text")
    return J.phrase_match(docs, J.prepare_dictionary(T.tag_map(spark, sf)), F.col("text"))


@query(
    "entity_tags",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _MATCH_SQL)
    + """, remap AS (SELECT label, min(tagID) AS other FROM tag_map GROUP BY label),
    found AS (SELECT doc_id, list(DISTINCT coalesce(other, tagID)) AS f FROM matches LEFT JOIN remap ON label = tagID
              WHERE length(tagID) >= 9 GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(tag_ids, coalesce(f, CAST([] AS VARCHAR[]))))), '|') AS tags
    FROM infos LEFT JOIN found USING (doc_id)""",
)
def entity_tags(spark, sf):
    records = tag_ids(T.infos(spark, sf)).select("doc_id", F.col("labels").alias("tags"), "fulltext")
    tagged = J.entity_tags(records, J.prepare_dictionary(T.tag_map(spark, sf)), F.col("fulltext"))
    return tagged.select("doc_id", F.array_join("tags", "|").alias("tags"))


@query(
    "substring_match",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP)
    + """SELECT DISTINCT doc_id, tagID AS "tagID" FROM documents JOIN tag_list
      ON list_contains(string_split(text, ' ,.!?')[1:20], label) OR (length(label) > 9 AND contains(text, label))
    UNION SELECT DISTINCT doc_id, tagID FROM documents JOIN tag_map ON contains(text, label)""",
)
def substring_match(spark, sf):
    docs = T.texts(spark, sf, "documents").select("doc_id", "text")
    return J.substring_match(docs, T.tag_list(spark, sf), T.tag_map(spark, sf), "text")


# --- vocabularies ------------------------------------------------------------------------

_VOCAB_SQL = f"""
word_rank AS (
  SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r
  FROM (SELECT unnest({S.words('text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 3),
vocab AS (
  SELECT range AS position, '[unused' || range || ']' AS term FROM range(100)
  UNION ALL SELECT 99 + r, term FROM word_rank)"""

_TERMS_SQL = """
label_terms AS (
  SELECT unnest(CASE WHEN strpos(tagID, '-') > 0 THEN string_split(tagID, '-') ELSE [tagID] END) AS term FROM tag_map)"""

_TFIDF_SQL = f"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.words('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= 0.8 * (SELECT count(*) FROM documents)),
w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w),
top_terms AS (SELECT term, round(sum(tfidf), 6) AS weight FROM tfidf GROUP BY term ORDER BY weight DESC, term LIMIT 300)"""


def _label_terms(spark, sf):
    return T.tag_map(spark, sf).select(F.explode(X.tag_terms(F.col("tagID"))).alias("term"))


def _tfidf(spark, sf):
    return I.tfidf(T.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("tfidf", "WITH " + _TFIDF_SQL + " SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf(spark, sf):
    return _tfidf(spark, sf).withColumn("tfidf", F.round("tfidf", 6))


@query("top_tfidf_terms", "WITH " + _TFIDF_SQL + " SELECT term, weight FROM top_terms")
def top_tfidf_terms(spark, sf):
    return I.top_tfidf_terms(_tfidf(spark, sf))


@query(
    "union_terms",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _TERMS_SQL, _TFIDF_SQL)
    + "SELECT term FROM label_terms WHERE term <> '' UNION SELECT term FROM top_terms",
)
def union_terms(spark, sf):
    return L.union_terms(_label_terms(spark, sf), I.top_tfidf_terms(_tfidf(spark, sf)))


@query(
    "vocab_anti_join",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _TERMS_SQL, _VOCAB_SQL)
    + "SELECT DISTINCT term FROM label_terms WHERE term <> '' AND term NOT IN (SELECT term FROM vocab)",
)
def vocab_anti_join(spark, sf):
    return L.vocab_anti_join(_label_terms(spark, sf).distinct(), T.word_vocabulary(spark, sf))


@query(
    "vocab_slot_fill",
    S.with_(S.INFOS, S.TAG_LIST, S.TAG_MAP, _TERMS_SQL, _VOCAB_SQL)
    + """, fresh AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS o FROM (
      SELECT DISTINCT term FROM label_terms WHERE term <> '' AND term NOT IN (SELECT term FROM vocab)))
    SELECT position, coalesce(fresh.term, vocab.term) AS term FROM vocab LEFT JOIN fresh ON position = o AND position < 100""",
)
def vocab_slot_fill(spark, sf):
    vocabulary = T.word_vocabulary(spark, sf)
    fresh = L.vocab_anti_join(_label_terms(spark, sf).distinct(), vocabulary)
    return L.vocab_slot_fill(vocabulary, fresh, V.UNUSED_SLOT)


# --- splits and copies ------------------------------------------------------------------------

_HEAD = f"row_number() OVER (ORDER BY {S.hash32(42, 'doc_id')}, doc_id) <= floor(0.3 * count(*) OVER ())"


@query("random_split", f"SELECT doc_id, CASE WHEN {_HEAD} THEN 'test' ELSE 'train' END AS split FROM documents")
def random_split(spark, sf):
    return M.random_split(T.table(spark, sf, "documents"), 0.3).select("doc_id", "split")


@query(
    "head_tail_split",
    f"""SELECT doc_id, CASE WHEN {_HEAD} THEN 'test' ELSE 'train' END AS shuffled,
    CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS ordered
    FROM documents""",
)
def head_tail_split(spark, sf):
    docs = T.texts(spark, sf, "documents").select("doc_id")
    shuffled = M.head_tail_split(docs, True).withColumnRenamed("split", "shuffled")
    return M.head_tail_split(shuffled, 0.3, shuffle=False).withColumnRenamed("split", "ordered")


@query(
    "fraction_sample",
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.hash32(42, 'doc_id')}, doc_id) AS r,
    count(*) OVER () AS n FROM documents) WHERE r <= floor(0.25 * n + 0.5)""",
)
def fraction_sample(spark, sf):
    return M.fraction_sample(T.table(spark, sf, "documents").select("doc_id"), 0.25)


@query(
    "sample_window",
    S.with_(S.INFOS)
    + f"""SELECT doc_id, title FROM (SELECT doc_id, title, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS n FROM infos)
    WHERE o BETWEEN {S.hash32(42, "'offset'")} % (n - 19) AND {S.hash32(42, "'offset'")} % (n - 19) + 19""",
)
def sample_window(spark, sf):
    return M.sample_window(T.infos(spark, sf), V.FEED_SAMPLE_SIZE).select("doc_id", "title")


@query(
    "stratified_multilabel_split",
    S.with_(S.INFOS)
    + f""", p AS (SELECT doc_id, unnest(CASE WHEN len(tag_ids) > 0 THEN tag_ids ELSE [''] END) AS label FROM infos),
    c AS (SELECT label, count(*) AS n FROM p GROUP BY label),
    s AS (SELECT doc_id, label AS stratum FROM p JOIN c USING (label)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, label) = 1)
    SELECT doc_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY {S.hash32(42, 'doc_id')}, doc_id)
      <= floor(0.3 * count(*) OVER (PARTITION BY stratum) + 0.5) THEN 'test' ELSE 'train' END AS split FROM s""",
)
def stratified_multilabel_split(spark, sf):
    return M.stratified_split(tag_ids(T.infos(spark, sf)), 0.3)


def _crop_sql(text: str, ratio: float, copy: str) -> str:
    off = f"({S.hash32(42, 'doc_id', copy)} % (CAST(floor(len(string_split({text}, ' ')) * {ratio}) AS BIGINT) + 1))"
    return (
        f"CASE WHEN {copy} = 0 THEN {text} ELSE array_to_string(string_split({text}, ' ')"
        f"[{off} + 1 : {off} + greatest(0, len(string_split({text}, ' ')) - 2 * {off} - 1)], ' ') END"
    )


@query(
    "augment_crop",
    S.with_(S.INFOS)
    + f"""SELECT doc_id, CAST(copy AS INTEGER) AS copy, {_crop_sql('fulltext', 0.2, 'copy')} AS fulltext,
    array_to_string(list_sort(tag_ids), '|') AS labels FROM infos, (SELECT unnest(range(4)) AS copy)""",
)
def augment_crop(spark, sf):
    records = tag_ids(T.infos(spark, sf)).select("doc_id", "fulltext", joined("labels").alias("labels"))
    return M.augment_crop(records, "fulltext", level=3, crop_ratio=0.2).select("doc_id", "copy", "fulltext", "labels")


@query(
    "split_then_augment",
    S.with_(S.INFOS)
    + f""", s AS (SELECT doc_id, description, CASE WHEN {_HEAD} THEN 'test' ELSE 'train' END AS split FROM infos)
    SELECT doc_id, split, CAST(copy AS INTEGER) AS copy, {_crop_sql('description', 0.1, 'copy')} AS description
    FROM s, (SELECT unnest(range(3)) AS copy) WHERE split = 'train' OR copy = 0""",
)
def split_then_augment(spark, sf):
    records = T.infos(spark, sf).select("doc_id", "description")
    rows, _ = M.split_then_augment(records, "description", level=2)
    return rows.select("doc_id", "split", "copy", "description")


# --- evaluation -------------------------------------------------------------------------------------

_PRED = "pred AS (SELECT doc_id, label, y, CASE WHEN proba > 0.5 THEN 1 ELSE 0 END AS p FROM scores)"
_ROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support"


def _counts_sql(group: str) -> str:
    return f"""SELECT {group}, tp, fp, fn, tp + fn AS support,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1
    FROM (SELECT {group}, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM pred GROUP BY {group})"""


@query(
    "label_report",
    S.with_(*SCORES_SQL, _PRED, f"l AS ({_counts_sql('label')})", f"d AS ({_counts_sql('doc_id')})")
    + f"""SELECT label, {_ROUND} FROM l
    UNION ALL SELECT 'micro avg', round(sum(tp) / sum(tp + fp)::DOUBLE, 6), round(sum(tp) / sum(tp + fn)::DOUBLE, 6),
      round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM l
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM l
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM l
    UNION ALL SELECT 'samples avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM d""",
)
def label_report(spark, sf):
    rows = _scored(spark, sf).withColumn("p", (F.col("proba") > V.DECISION_THRESHOLD).cast("int"))
    report = A.label_report(rows)
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "confusion_matrix",
    S.with_(*SCORES_SQL, _PRED) + "SELECT y, p, count(*) AS n FROM pred GROUP BY y, p",
)
def confusion_matrix(spark, sf):
    return A.confusion_matrix(_scored(spark, sf).withColumn("p", (F.col("proba") > 0.5).cast("int")))


@query("accuracy", S.with_(*SCORES_SQL, _PRED) + "SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred")
def accuracy(spark, sf):
    rows = _scored(spark, sf).withColumn("p", (F.col("proba") > V.DECISION_THRESHOLD).cast("int"))
    return A.accuracy(rows).select(F.round("accuracy", 9).alias("accuracy"))


_AP = """round(tp / pos * CASE WHEN hit = 0 THEN 0 ELSE tp / hit END + (1 - tp / pos) * pos / n, 9)"""
_SUMS = """sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n, sum(CASE WHEN proba > thr THEN y ELSE 0 END)::DOUBLE AS tp,
    sum(CASE WHEN proba > thr THEN 1 ELSE 0 END)::DOUBLE AS hit"""


@query(
    "micro_metrics",
    S.with_(*SCORES_SQL)
    + f"""SELECT {_AP} AS avg_precision, round(tp / pos, 9) AS recall, CAST(tp AS BIGINT) AS tp, CAST(hit - tp AS BIGINT) AS fp,
    CAST(pos - tp AS BIGINT) AS fn FROM (SELECT {_SUMS} FROM scores, (SELECT 0.5 AS thr))""",
)
def micro_metrics(spark, sf):
    m = A.micro_metrics(_scored(spark, sf))
    return m.withColumn("avg_precision", F.round("avg_precision", 9)).withColumn("recall", F.round("recall", 9))


@query(
    "threshold_sweep",
    S.with_(*SCORES_SQL)
    + f"""SELECT thr, score, row_number() OVER (ORDER BY score DESC, thr) = 1 AND score > 0 AS best
    FROM (SELECT thr, {_AP} AS score FROM (SELECT thr, {_SUMS} FROM scores,
      (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS thr) GROUP BY thr))""",
)
def threshold_sweep(spark, sf):
    return A.threshold_sweep(_scored(spark, sf))


# trials derived from the scores: one per class, scored by its accuracy at 0.5
@query(
    "rank_trials",
    S.with_(*SCORES_SQL)
    + """, t AS (SELECT label, round(avg(CASE WHEN (proba > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS mean_test_score,
      round(avg(proba), 6) AS mean_fit_time FROM scores GROUP BY label)
    SELECT mean_test_score, mean_fit_time, label AS param_ngram_range FROM t""",
)
def rank_trials(spark, sf):
    from pyspark.sql import Window

    right = ((F.col("proba") > 0.5).cast("int") == F.col("y")).cast("double")
    trials = (
        _scored(spark, sf).groupBy("label")
        .agg(F.round(F.avg(right), 6).alias("mean_test_score"), F.round(F.avg("proba"), 6).alias("mean_fit_time"))
        .withColumnRenamed("label", "param_ngram_range")
    )
    rank = F.rank().over(Window.orderBy(F.desc("mean_test_score")))  # one row per trial
    return A.rank_trials(trials.withColumn("rank_test_score", rank))
