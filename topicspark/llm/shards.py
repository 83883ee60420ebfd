"""Documents dealt to shards of near equal bytes, equal texts together.

Longest-processing-time scheduling: groups of equal texts, largest first, each go to the
shard that holds least, which a heap keeps on top. Groups of one size are alike to that
rule, so what runs through the heap is not the groups but their sizes, each with the number
of its groups: Spark counts them, and one task takes them in descending order, a row at a
time, and keeps the heap alone. There are fewer sizes than the square root of twice all bytes.
Of many groups of a size, all that the heap would deal below a level of load are
counted at once; the rest pops one by one; the result is that of single pops. Groups of a
size, in the order of their digests, then fill the shards in turn by these counts.

A size is the UTF-8 bytes of the text and one for its row. Null texts are empty ones; null
and repeated ids are rows like others, and repeated rows get slots of their own; equal
texts share a shard however many, so that a group beyond an equal share fills its shard
alone. Ties go to the lower shard and the lower digest. An empty table gives no row.
Documents' own columns travel in one struct, so their names clash with none.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from ..plans.ordering import with_ordinal
from .common import in_batches, keyed_join, written

LAW = "bytes"
SINGLE_POPS = 64
PLAN = "bytes bigint, first bigint, ends array<bigint>"


def deal(size: int, count: int, heap: list[tuple[int, int]]) -> list[int]:
    """How many of ``count`` groups of one ``size`` each shard gets; ``heap`` holds (load, shard)."""
    given = [0] * len(heap)
    if count > SINGLE_POPS:
        loads = [load for load, _ in heap]

        def below(level: int) -> int:
            """Groups that shards with less than ``level`` take until they reach it."""
            return sum(max(0, -(-(level - load) // size)) for load in loads)

        low = min(loads)
        level = low + bisect_right(range(low, max(loads) + size * count + 2), count, key=below) - 1
        for at, (load, shard) in enumerate(heap):
            given[shard] = max(0, -(-(level - load) // size))
            heap[at] = (load + size * given[shard], shard)
        heapq.heapify(heap)
    for _ in range(count - sum(given)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        given[shard] += 1
    return given


def schedule(classes: DataFrame, shards: int) -> DataFrame:
    """For each ``bytes`` of groups (``n`` of them, the first at place ``first``) the
    places within the size at which each shard's part ends."""

    def scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, shard) for shard in range(shards)]
        for batch in batches:
            ends = []
            for size, count in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                total, row = 0, []
                for given in deal(size, count, heap):
                    total += given
                    row.append(total)
                ends.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64()))], ["bytes", "first", "ends"])

    sizes = classes.select("bytes", "first", "n").repartition(1).sortWithinPartitions(F.desc("bytes"))
    return sizes.transform(in_batches, scheduled, PLAN)


def assign(docs: DataFrame, shards: int = 8, columns: list[str] | None = None) -> DataFrame:
    """Each document's ``size``, ``text_crc32``, ``shard`` and ``slot``, with the given
    ``columns`` (its id) as the struct ``document``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.struct(*(columns or ["doc_id"])).alias("document"),
            F.col("doc_id").alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharded",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    ranked = with_ordinal(groups, F.desc("bytes"), F.col("digest"), name="place")
    classes = ranked.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    plan = written(schedule(classes, shards), "schedule")
    within = F.col("place") - F.col("first")
    placed = lookup_join(ranked, plan, ["bytes"], spread_by=["digest"], settled=True).select(
        "digest", "n", F.size(F.filter("ends", lambda end: end <= within)).alias("shard")
    )
    joined = keyed_join(rows, placed, "digest", [F.col("row")], rows.count(), "inner")
    numbered = with_ordinal(joined, F.col("shard"), F.col("digest"), F.col("id"), F.col("row"), name="at")
    starts = numbered.groupBy("shard").agg(F.min("at").alias("start"))  # a row a shard
    return numbered.join(F.broadcast(starts), "shard").select(
        "document", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Whole documents, a folder for each shard, in order of slots within its files."""
    found = assign(docs, shards, docs.columns)
    found.select("shard", "slot", "document").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
