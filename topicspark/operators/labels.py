"""Label sets: counting, pruning, binarising, sets and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import each
from ..functions.text import bind, string_array
from ..plans.lookups import bounded_values, lookup_join, member, settle


def label_counts(df: DataFrame, column: str = "labels") -> DataFrame:
    """Count of each label over all records."""
    return each(df, F.col(column), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def keep_labels(df: DataFrame, kept: DataFrame, column: str = "labels", key: str = "doc_id") -> DataFrame:
    """Keep only the labels listed in ``kept`` and the records that still have one.

    A bounded list is tested in place inside each record's array: no shuffle and
    the text never moves. A longer one is joined pair by pair (salted) and the
    label sets are put back by record key.
    """
    kept = settle(kept.select("label"))
    values = bounded_values(kept, "label")
    if values is not None:
        pruned = df.withColumn(column, F.filter(column, lambda x: member(x, values)))
        return pruned.where(F.size(column) > 0)
    pairs = df.select(key, F.posexplode(column).alias("_pos", "label"))
    pairs = lookup_join(pairs, kept, ["label"], "left_semi", spread_by=[key], settled=True)
    sets = pairs.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "label"))), lambda s: s.label).alias(column)
    )
    return df.drop(column).join(sets, key).select(*df.columns)


def filter_rare_labels(df: DataFrame, threshold: int | None, column: str = "labels", key: str = "doc_id") -> DataFrame:
    """Remove labels seen at most ``threshold`` times, then records left without one."""
    if not threshold or threshold <= 0:
        return df
    frequent = label_counts(df, column).where(F.col("n") > threshold)
    return keep_labels(df, frequent, column, key)


def semi_join_top_labels(df: DataFrame, n: int, column: str = "labels", key: str = "doc_id") -> DataFrame:
    """Keep the ``n`` most frequent labels (ties by label) and records with one of them."""
    top = label_counts(df, column).orderBy(F.desc("n"), "label").limit(n)
    return keep_labels(df, top, column, key)


def class_names(df: DataFrame, column: str = "labels") -> DataFrame:
    """Sorted distinct classes (idx, label)."""
    distinct = settle(each(df, F.col(column), "label").distinct())
    values = bounded_values(distinct, "label", 100_000)
    if values is not None:
        rows = [(i, v) for i, v in enumerate(sorted(values))]
        return df.sparkSession.createDataFrame(rows, "idx int, label string")
    from ..plans.ordering import with_ordinal

    return with_ordinal(distinct, F.col("label"), name="idx").select(F.col("idx").cast("int"), "label")


def binarize_labels(df: DataFrame, classes: list[str], column: str = "labels") -> DataFrame:
    """Add ``target``: one 0/1 per class, in class order (bounded class lists)."""
    names = string_array(classes)
    bits = bind(F.col(column), lambda own: F.transform(names, lambda c: F.array_contains(own, c).cast("int")))
    return df.withColumn("target", bits)


def binarize_long(df: DataFrame, classes: DataFrame, column: str = "labels", key: str = "doc_id") -> DataFrame:
    """The ones of the 0/1 matrix as rows (key, idx): the form for wide vocabularies."""
    pairs = each(df, F.array_distinct(column), "label", key)
    return lookup_join(pairs, classes, ["label"], spread_by=[key]).select(key, "idx")


def inverse_binarize(target: Column, classes: list[str]) -> Column:
    """Labels of a 0/1 array, in class order."""
    names = string_array(classes)
    hits = F.filter(F.arrays_zip(names.alias("label"), target.alias("bit")), lambda z: z.bit == 1)
    return F.transform(hits, lambda z: z.label)


def label_column_counts(df: DataFrame, classes: list[str], column: str = "target") -> DataFrame:
    """Number of ones in each class column."""
    rows = [(i, c) for i, c in enumerate(classes)]
    names = df.sparkSession.createDataFrame(rows, "idx int, label string")
    ones = (
        df.select(F.posexplode(column).alias("idx", "bit"))
        .where(F.col("bit") == 1)
        .groupBy("idx")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ones.join(names, "idx").select("label", "n")


def labels_per_record(df: DataFrame, column: str = "labels") -> DataFrame:
    """Share of records by number of labels, in percent."""
    sizes = df.select(F.size(column).alias("n_labels")).groupBy("n_labels").agg(F.count(F.lit(1)).alias("n"))
    return _percent(sizes)


def language_share(df: DataFrame, name) -> DataFrame:
    """Records per language and percent."""
    counts = df.groupBy(name(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return _percent(counts)


def _percent(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / total.scalar())


def rank_values(values: DataFrame, column: str, total: Column, top: int) -> DataFrame:
    """Most frequent values with Rank and Portion of ``total`` records.

    The limit is taken before numbering, so the window sees ``top`` rows.
    """
    best = (
        values.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(top)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), column))
    return best.select(column, "n", rank.alias("Rank"), (F.col("n") / total).alias("Portion"))


def _records(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def label_rank(df: DataFrame, top: int = 20, column: str = "labels") -> DataFrame:
    return rank_values(each(df, F.col(column), "label"), "label", _records(df), top)


def creator_rank(df: DataFrame, top: int = 20) -> DataFrame:
    return rank_values(each(df, F.col("creators"), "creator"), "creator", _records(df), top)


def host_rank(df: DataFrame, top: int = 20) -> DataFrame:
    return rank_values(df.select("host").where(F.col("host").isNotNull()), "host", _records(df), top)


def label_cardinality(df: DataFrame, column: str = "labels") -> DataFrame:
    return each(df, F.col(column), "label").distinct().agg(F.count(F.lit(1)).alias("n_labels"))


def union_labels(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_union(left, right))


def topn_labels(scored: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The ``n`` most probable labels per record (ties by label)."""
    order = Window.partitionBy(key).orderBy(F.desc("proba"), "label")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def threshold_labels(
    scored: DataFrame, k: int = 4, threshold: float = 0.001, at_least_one: bool = True, key: str = "doc_id"
) -> DataFrame:
    """Of the ``k`` best labels those at or above ``threshold``; the best always if asked."""
    keep = F.col("proba") >= threshold
    if at_least_one:
        keep = keep | (F.col("rank") == 1)
    return topn_labels(scored, k, key).where(keep)


def vocab_anti_join(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms not in the vocabulary."""
    return lookup_join(terms, vocabulary.select("term"), ["term"], "left_anti", spread_by=["term"])


def union_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("term").union(right.select("term")).distinct()


def vocab_slot_fill(vocabulary: DataFrame, terms: DataFrame, slot: str) -> DataFrame:
    """Write new terms, in term order, into the free slots until either runs out."""
    from ..plans.ordering import with_ordinal

    is_slot = F.startswith(F.col("term"), F.lit(slot))
    free = with_ordinal(vocabulary.where(is_slot).select("position", "term"), F.col("position"))
    n_slots = free.count()
    new = terms.select("term").orderBy("term").limit(n_slots)
    new = with_ordinal(new, F.col("term")).withColumnRenamed("term", "new_term")
    filled = free.join(new, "ordinal", "left").select("position", F.coalesce("new_term", "term").alias("term"))
    return vocabulary.where(~is_slot).select("position", "term").unionByName(filled)
