"""A corpus made ready for training: quality, near copies, leaks, personal data, packing.

Each stage's docstring says what becomes of null ids, null, empty and very long texts,
ties and repeated rows. All of them take whole texts of any length and an empty table
(no row comes of none); all but the last keep other columns as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicspark.llm import decontaminate, packing, rules, simhash, surrogates
from topicspark.llm.common import table
from topicspark.llm.queries import WORD_TOKENIZER
from topicspark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a rule of their own nor their host's verdict rejects.

    Null, empty and blank texts have too few words and go; a null id is kept; a null
    source is a host like any other; repeated rows are judged alike and all kept.
    """
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The one with the smallest id stays, of equal ids the one with the smallest hash of
    its text, a null id last; of repeated rows one. Texts without a word are one group.
    """
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as do all documents if the benchmark is
    empty; a null id is kept; repeated rows are judged alike.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, ``n_chars`` counted anew.

    Every row stays; null and empty texts as they are (``n_chars`` null and 0); repeated
    rows are changed alike; of surrogates that collide all but one are drawn anew.
    """
    return surrogates.with_lengths(surrogates.replace_entities(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of full sequences, alike documents beside each other.

    Null and empty texts are an end token alone; a null id is kept; repeated rows are
    packed each; documents at one place of the curve are ordered by a hash, then by id.
    """
    return packing.pack(docs, WORD_TOKENIZER, end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private_data", private_data),
    ("packed", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
