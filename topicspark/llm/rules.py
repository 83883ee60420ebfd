"""Quality rules with a verdict for whole hosts.

Base rules judge a document by itself: too few words, or too many words in passages
that it repeats. The failures of a host's documents are counted, and each host's
rate is shrunk towards the rate of all hosts: the rates are taken for draws from a
beta distribution, whose two parameters are fitted to all hosts by their weighted
mean and spread, and a host's rate is the mean of its posterior. A host of two
documents is thus judged mostly by the prior, one of a million by itself. Hosts
whose shrunk rate exceeds ``HOST_RATE`` are rejected with all their documents.

Words are runs of characters other than ASCII white space; a null text has none. A
null host is a host of its own. Repeated rows count each. An empty table gives no
row. A host may hold any share of the documents: counts are combined before the
shuffle, and verdicts are joined back with the rows of hot hosts dealt over many
tasks. ``kept_documents`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_batches, keyed_join, ship, written

MIN_WORDS, REPEAT_PERCENT, WINDOW, HOST_RATE = 10, 20, 5, 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: list[bytes], window: int = WINDOW) -> int:
    """Words within windows of ``window`` words that occur twice or more."""
    if len(found) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), dtype=np.int64, count=len(found))
    if len(numbers) == len(found):
        return 0
    codes = words[: len(words) - window + 1]
    for step in range(1, window):  # numbers of ever longer runs: equal just if the runs are
        codes = codes * len(numbers) + words[step : len(words) - window + 1 + step]
        codes = np.unique(codes, return_inverse=True)[1]
        if codes.max() + 1 == len(codes):
            return 0
    twice = (np.bincount(codes) > 1)[codes]
    covered = np.zeros(len(words), dtype=bool)
    for step in range(window):
        covered[step : step + len(twice)] |= twice
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """``MEASURES`` of a text."""
    text = text or ""
    found = text.encode().split()
    lines = [line for line in text.split("\n") if line.encode().split()] if "\n" in text else []
    return (
        len(found),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
    )


def _failed(n_words, n_repeat):
    return (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    schema = "doc_id bigint, host string, " + ", ".join(f"{m} bigint" for m in MEASURES)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *MEASURES])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _host(host_col).alias("host"), F.col(text_col).alias("text"))
    return rows.transform(in_batches, of, schema)


def _host(host_col: str) -> Column:
    """The host, with a mark in front so that a missing one is a key too."""
    return F.when(F.col(host_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(host_col).cast("string")))


def host_verdicts(rows: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, n, rate, rejected) from rows (host, failed)."""
    hosts = written(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("bigint")).alias("bad")), "hosts")
    share = F.col("bad") / F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("hosts")).first()
    if not total["n"]:
        return hosts.select("host", "n", F.lit(0.0).alias("rate"), F.lit(False).alias("rejected"))
    mean = total["bad"] / total["n"]
    squares = hosts.agg(F.sum(F.col("n") * (share - mean) ** 2)).first()[0]
    spread = squares / total["n"]  # of the rates around the mean, weighted by documents
    chance = mean * (1 - mean) * total["hosts"] / total["n"]  # what counting alone would give
    between = max(spread - chance, 1e-9)
    strength = max(mean * (1 - mean) / between - 1, 1e-3)  # alpha + beta
    rate = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", rate.alias("rate"), (rate > host_rate).alias("rejected"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """Measures, base verdict, the host's rate and the final verdict of every row."""
    rows = written(_measured(docs, id_col, text_col, host_col), "measures")
    rows = rows.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))
    hosts = written(host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), host_rate), "verdicts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    joined = keyed_join(rows, hosts, "host", [F.monotonically_increasing_id()], total)
    return joined.select("doc_id", *MEASURES, "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    Texts stay where they are: the base verdict is taken once for the counts and once
    for the filter, and only the rejected hosts are joined.
    """

    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def failed(texts):
        import pandas as pd

        found = map(measures, texts)
        return pd.Series([_failed(m[0], m[4]) for m in found], dtype=bool)

    host, bad = fresh(docs, "host_key"), failed(F.col(text_col))
    hosts = host_verdicts(docs.select(_host(host_col).alias("host"), bad.alias("failed")), host_rate)
    rejected = written(hosts.where("rejected").select(F.col("host").alias(host), "n"), "rejected")
    good = docs.where(~bad).withColumn(host, _host(host_col))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    joined = keyed_join(good, rejected, host, [F.monotonically_increasing_id()], total, "left_anti")
    return joined.drop(host)
