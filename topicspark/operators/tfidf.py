"""TF-IDF in long form: one row per (record, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions.rows import each
from ..plans import lookups
from ..plans.layout import by_record
from ..plans.lookups import settle


def term_counts(df: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) from an array of terms."""
    return (
        each(df, terms, "term", key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def _frequent(counted: DataFrame) -> int | None:
    """The least power of two for which all terms of at least as many records may be broadcast."""
    size = F.sum(F.octet_length("term") + F.lit(32))
    buckets = counted.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count(F.lit(1)).alias("n"), size.alias("size"))
    rows, width, cut = 0, 0, None
    for bucket in buckets.orderBy(F.desc("bits")).collect():  # 64 rows at most
        rows, width = rows + bucket["n"], width + bucket["size"]
        if rows > lookups.BROADCAST_ROWS or width > lookups.BROADCAST_BYTES:
            break
        cut = 1 << (bucket["bits"] - 1)
    return cut


def tfidf(df: DataFrame, text: str, max_df: float = V.MAX_DF, low: int = 1, high: int = 1, key: str = "doc_id") -> DataFrame:
    """(key, term, tfidf): tf * (ln((1+n)/(1+df)) + 1), each record scaled to length 1.

    The texts are partitioned by record once, before they are cut into terms; the term counts and
    the norms reuse that partitioning. Document frequencies are counted apart. Those of the terms in
    most records are broadcast, as many as fit; those of the other terms go to the records that
    have them together with the texts, so that only these few pairs are shuffled by term.
    """
    terms = X.token_ngrams(X.words(F.col(text)), low, high)
    n = df.count()
    distinct = each(df, F.array_distinct(terms), "term", key)
    counted = settle(distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    idf = F.when(F.col("df") <= F.lit(max_df * n), F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")
    cut = _frequent(counted)
    often = F.lit(False) if cut is None else F.col("df") >= cut
    frequent, rare = counted.where(often).select("term", idf.alias("often")), counted.where(~often).select("term", idf)

    kind = "array<struct<term:string,tf:int,idf:double>>"
    own = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(None).cast("double").alias("idf"))).cast(kind)
    rows = df.select(key, text, F.lit(None).cast(kind).alias("given"))
    if not rare.isEmpty():
        pairs = distinct.join(F.broadcast(frequent), "term", "left_anti").join(rare.where("idf is not null"), "term")
        given = F.array(F.struct("term", F.lit(0).alias("tf"), "idf")).cast(kind).alias("given")
        rows = rows.unionByName(pairs.select(key, F.lit(None).cast(df.schema[text].dataType).alias(text), given))
    found = by_record(rows, key).select(key, F.explode_outer(F.coalesce("given", own)).alias("t"))
    counts = found.where(F.col("t").isNotNull()).groupBy(key, F.col("t.term").alias("term")).agg(F.sum("t.tf").alias("tf"), F.max("t.idf").alias("idf"))
    weighted = counts.join(F.broadcast(frequent), "term", "left").select(key, "term", (F.col("tf") * F.coalesce("often", "idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.where(F.col("w").isNotNull()).select(key, "term", (F.col("w") / norm).alias("tfidf"))


def top_tfidf_terms(weights: DataFrame, n: int = V.TOP_TFIDF_TERMS) -> DataFrame:
    """The ``n`` terms with the largest summed weight (ties by term)."""
    return (
        weights.groupBy("term")
        .agg(F.round(F.sum("tfidf"), 6).alias("weight"))
        .orderBy(F.desc("weight"), "term")
        .limit(n)
    )
