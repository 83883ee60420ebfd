"""Evaluation of label predictions, as conditional sums over long-form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _counts() -> list[Column]:
    y, p = F.col("y"), F.col("p")
    return [
        F.sum(y * p).alias("tp"),
        F.sum((1 - y) * p).alias("fp"),
        F.sum(y * (1 - p)).alias("fn"),
    ]


def _measures(df: DataFrame) -> DataFrame:
    support = (F.col("tp") + F.col("fn")).alias("support")
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.select(
        "*", precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"), support
    )


def label_report(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per-label precision, recall, F1 and support, then the micro, macro, weighted
    and per-sample averages. ``rows`` has (key, label, y, p) with 0/1 values.

    The rows are read once: grouping sets count by label, by record and in all, and each count
    goes to the lines it is averaged into. Of no rows the four averages are null."""
    counted = rows.groupingSets([["label"], [key], []], "label", key).agg(*_counts(), F.grouping_id().alias("by"))
    measured = _measures(counted)

    def line(name: Column, weight: Column) -> Column:
        return F.struct(name.alias("label"), weight.cast("double").alias("weight"))

    one = F.lit(1)
    by_label = F.array(
        F.struct(F.lit(0).alias("own"), line(F.col("label"), one).alias("l")),
        F.struct(F.lit(1).alias("own"), line(F.lit("macro avg"), one).alias("l")),
        F.struct(F.lit(1).alias("own"), line(F.lit("weighted avg"), F.col("support")).alias("l")),
    )
    by_record, whole = (
        F.array(F.struct(F.lit(1).alias("own"), line(F.lit(name), one).alias("l"))) for name in ("samples avg", "micro avg")
    )
    lines = F.when(F.col("by") == 1, by_label).when(F.col("by") == 2, by_record).otherwise(whole)
    weighed = measured.select("precision", "recall", "f1", "support", F.inline(lines)).select("*", "l.label", "l.weight")
    names = F.array(*[F.lit(f"{name} avg") for name in ("micro", "macro", "weighted", "samples")])
    nothing = rows.sparkSession.range(1).select(F.lit(1).alias("own"), F.explode(names).alias("label"))
    weighed = weighed.unionByName(nothing, allowMissingColumns=True)
    total = F.sum("weight")
    means = [_ratio(F.sum(F.col(c) * F.col("weight")), total).alias(c) for c in ("precision", "recall", "f1")]
    return weighed.groupBy("own", "label").agg(*means, F.sum("support").alias("support")).drop("own")


def confusion_matrix(rows: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def _average_precision(tp: Column, fp: Column, fn: Column, n: Column) -> Column:
    """Average precision of 0/1 scores: recall * precision + (1 - recall) * share of ones."""
    positives = tp + fn
    recall = _ratio(tp, positives)
    return recall * _ratio(tp, tp + fp) + (1 - recall) * positives / n


def micro_metrics(rows: DataFrame, threshold: float = V.DECISION_THRESHOLD) -> DataFrame:
    """Micro average precision and recall of ``proba > threshold``, in one pass."""
    hit = (F.col("proba") > threshold).cast("int")
    y = F.col("y")
    sums = rows.agg(
        F.sum(y * hit).alias("tp"),
        F.sum((1 - y) * hit).alias("fp"),
        F.sum(y * (1 - hit)).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return sums.select(
        _average_precision(tp, fp, fn, n).alias("avg_precision"), _ratio(tp, tp + fn).alias("recall"), "tp", "fp", "fn"
    )


def threshold_sweep(rows: DataFrame, thresholds: tuple[float, ...] = V.SWEEP_THRESHOLDS) -> DataFrame:
    """(thr, score, best) for every threshold: micro average precision of
    ``proba > thr``; ``best`` marks the first largest score above zero.

    All thresholds are counted in one pass over the scores.
    """
    y, proba = F.col("y"), F.col("proba")
    sums = [F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")]
    for i, thr in enumerate(thresholds):
        hit = (proba > thr).cast("int")
        sums += [F.sum(y * hit).alias(f"tp{i}"), F.sum(hit).alias(f"hit{i}")]
    one = rows.agg(*sums).where(F.col("n") > 0)
    cells = F.array(
        *[
            F.struct(
                F.lit(float(thr)).alias("thr"),
                F.round(
                    _average_precision(
                        F.col(f"tp{i}"), F.col(f"hit{i}") - F.col(f"tp{i}"), F.col("pos") - F.col(f"tp{i}"), F.col("n")
                    ),
                    9,
                ).alias("score"),
            )
            for i, thr in enumerate(thresholds)
        ]
    )
    swept = one.select(F.inline(cells))
    order = Window.orderBy(F.desc("score"), "thr")  # one row per threshold
    return swept.withColumn("best", (F.row_number().over(order) == 1) & (F.col("score") > 0))


def rank_trials(trials: DataFrame) -> DataFrame:
    """Search trials by rank, with score, fit time and n-gram range."""
    return trials.orderBy("rank_test_score", "param_ngram_range").select(
        "mean_test_score", "mean_fit_time", "param_ngram_range"
    )
