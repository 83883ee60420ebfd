"""The trie of conversation prefixes, with exact figures for each node.

Every conversation is rebuilt: the first ``h`` turns come from the first conversation of
its hundred, ``h`` from its own id, the others are its own. A node is a distinct
sequence of turns; the root is the empty one.

1. A turn becomes a 128-bit digest of role and text. A prefix is known by the
   sum, over its turns, of two 64-bit hashes of place and digest: sums of a prefix
   follow from running sums, so a conversation may reach over any number of tasks.
2. Count-min screening: all prefixes are counted in a sketch of ``ROWS`` rows of cells that
   count to two. A cell that counts one proves a prefix to be a singleton, and with it
   all longer ones: this tail is put out where it stands. The sketch has ``LOAD`` cells a row
   for each prefix, within ``CELLS``; one bit a cell is broadcast, so at most ``ROWS * CELLS / 8``
   bytes. Beyond that, or by chance, more prefixes than the shared ones count as
   possibly shared; that costs time and changes no result.
3. Only prefixes that may be shared are shuffled, and grouped exactly with partial sums. What a
   subtree adds up (leaves, saved tokens) is put on the path of its smallest
   member, summed from the end of that path, and grouped by node once more.
4. Conversations that end at a node are digested in blocks of ``1 << BLOCK_BITS`` ids, which
   pass through a task in order.

Turns are ordered by turn (null first), then by the digest of role and text; null role or text
is empty, repeated rows are turns each. Rows without a conversation id belong to no conversation.
A conversation without turns is a member of the root; an empty table has no node.
Other columns are not read. Two different prefixes share a node only if 128 bits agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lookups import settle
from .common import in_batches, keyed_join, written
from .scans import ordered, running_sums, tasks

HEADS = 6
FAMILY = 100
ROWS, LOAD, CELLS = 3, 4, 1 << 27
LEAST_CELLS = 1 << 16
SLICE = 1 << 16
CHUNK = 1 << 18
BLOCK_BITS = 12
_NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, phase, turn, digest, size, row, h``: a marker of each conversation
    (phase 0), its first turns from its family's first conversation (1), all its own (2)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = written(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
            F.length(text).cast("bigint").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "turns",
    )
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "row")
    heads = (
        own.where(F.col("conv_id") % FAMILY == 0)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") < HEADS)
        .groupBy(F.col("conv_id").alias("family"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("heads"))
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    convs = own.select("conv_id").distinct().withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    led = convs.join(heads, "family").select("conv_id", F.explode(F.slice("heads", F.lit(1), taken)).alias("t"))
    nothing = F.lit(None).cast("bigint")
    markers = convs.select("conv_id", F.lit(0).alias("phase"), nothing.alias("turn"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("size"), nothing.alias("row"))
    led = led.select("conv_id", F.lit(1).alias("phase"), F.col("t.place").cast("bigint").alias("turn"), "t.digest", "t.size", nothing.alias("row"))
    said = own.select("conv_id", F.lit(2).alias("phase"), "turn", "digest", "size", "row")
    return markers.unionByName(led).unionByName(said).withColumn("h", taken.cast("bigint"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, in order: its depth, its two sums, those
    of the prefix before it, the ``size`` of its last text, and whether the conversation ``ends``."""
    rows = rebuilt(conversations)
    rows = ordered(rows, tasks(conversations), F.col("conv_id"), F.col("phase"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row"))
    counted = rows.withColumn("led", (F.col("phase") == 1).cast("bigint")).withColumn("own", (F.col("phase") == 2).cast("bigint"))
    counted = running_sums(counted, "conv_id", ["led", "own"]).where((F.col("phase") < 2) | (F.col("own") > F.col("h")))
    placed = counted.withColumn("depth", F.col("led") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    root = F.col("phase") == 0
    hashed = placed.select(
        "_part", "conv_id", "depth", "size",
        F.when(root, F.lit(0)).otherwise(F.xxhash64("depth", "digest")).alias("a"),
        F.when(root, F.lit(0)).otherwise(F.xxhash64("digest", F.lit("b"), "depth")).alias("b"),
    )
    return settle(running_sums(hashed, "conv_id", ["a", "b"], last="ends"))  # read several times


def _cells(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each prefix in each row of the sketch, rows behind each other."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    found = [(((a + np.uint64(k) * b) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)) + np.uint64(k << bits) for k in range(ROWS)]
    return np.stack(found).astype(np.int64)


def sketch_bits(n: int) -> int:
    """Bits of a row's cells for ``n`` prefixes."""
    return (max(LEAST_CELLS, min(CELLS, LOAD * n)) - 1).bit_length()


def shared_cells(found: DataFrame, bits: int) -> bytes:
    """One bit a cell: whether two prefixes or more fell there.

    Tasks count chunks of prefixes and put out, for each touched slice of cells, two packed
    bitmaps (seen, seen twice); bitmaps of a slice are merged as they pass."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held):
            a, b = (np.concatenate([h[k] for h in held]) for k in range(2))
            cells, times = np.unique(_cells(a, b, bits), return_counts=True)
            slices = cells // SLICE
            first = np.flatnonzero(np.concatenate([[True], slices[1:] != slices[:-1]]))
            out = []
            for lo, hi in zip(first, np.append(first[1:], len(cells))):
                maps = np.zeros((2, SLICE), dtype=bool)
                at, twice = cells[lo:hi] % SLICE, times[lo:hi] > 1
                maps[0, at] = True
                maps[1, at[twice]] = True
                out.append((int(slices[lo]), zlib.compress(np.packbits(maps, axis=1).tobytes(), 1)))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([m for _, m in out], pa.binary())], ["slice", "maps"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            size += batch.num_rows
            if size >= CHUNK:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["slice", "maps"])

        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                maps = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(2, -1)
                if at != current:
                    if current is not None:
                        yield row()
                    current, once, twice = at, maps[0].copy(), maps[1].copy()
                else:
                    twice |= maps[1] | (once & maps[0])
                    once |= maps[0]
        if current is not None:
            yield row()

    schema = "slice bigint, maps binary"
    partial = found.select("a", "b").transform(in_batches, counted, schema)
    whole = partial.repartition("slice").sortWithinPartitions("slice").transform(in_batches, merged, schema)
    out = np.zeros((ROWS << bits) // 8, dtype=np.uint8)
    for at, packed in whole.collect():  # at most ROWS * CELLS / 8 bytes
        start = at * SLICE // 8
        out[start : start + SLICE // 8] = np.frombuffer(packed, dtype=np.uint8)
    return out.tobytes()


def screened(found: DataFrame) -> DataFrame:
    """The prefixes with ``tail``: 0 for those that may be shared, 1 for a conversation's first
    that is proven its own, 2 for all longer ones."""
    spark = found.sparkSession
    bits = sketch_bits(found.count())
    sent = spark.sparkContext.broadcast(shared_cells(found, bits))
    names = [*found.columns, "single"]
    at_a, at_b = names.index("a"), names.index("b")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            cells = _cells(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (at_a, at_b)), bits)
            maybe = (twice[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
            single = 1 - maybe.min(axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single)], names)

    flagged = found.transform(in_batches, screen, T.StructType([*found.schema.fields, T.StructField("single", T.LongType())]))
    told = running_sums(flagged, "conv_id", ["single"])
    tail = F.when(F.col("single") == 0, 0).when(F.col("single_before") == 0, 1).otherwise(2)
    key, before = (F.concat_ws(".", F.hex(f"a{s}"), F.hex(f"b{s}")) for s in ("", "_before"))
    return told.select("conv_id", "depth", "size", "ends", key.alias("node"), F.when(F.col("depth") > 0, before).alias("parent"), tail.alias("tail"))


def _ends(shared: DataFrame) -> DataFrame:
    """For each node the digest of the ids of the conversations that end there."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["node", "ends_sha256"])

        for batch in batches:
            rows = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != current:
                    if current is not None:
                        rows.append((current, digest.hexdigest()))
                    current, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if rows:
                yield out(rows)
        if current is not None:
            yield out([(current, digest.hexdigest())])

    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_sort(F.collect_list("conv_id"))  # one block: at most 1 << BLOCK_BITS ids, as an id ends once
    blocks = shared.where("ends").groupBy("node", block).agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))
    sorted_ = blocks.repartition("node").sortWithinPartitions("node", "block")
    return sorted_.select("node", "ids").transform(in_batches, digested, "node string, ends_sha256 string")


def _node(n_convs, n_children, n_leaves, saved, ends) -> list[Column]:
    sums = {"n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": saved}
    return [*(c.cast("bigint").alias(name) for name, c in sums.items()), ends.alias("ends_sha256")]


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie, each with the figures of its members and of its subtree."""
    n_parts = tasks(conversations)
    rows = written(screened(prefixes(conversations)), "prefixes")
    shared, tops, tails = (rows.where(F.col("tail") == k).drop("tail") for k in range(3))

    found = shared.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("size").alias("size"),
    )
    found = written(found, "nodes")
    below = tops.select("parent", F.lit(1).alias("top")).unionByName(found.select("parent", F.lit(0).alias("top")))
    below = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("top").alias("tops"))
    nodes = found.join(below, "node", "left").fillna(0, ["n_children", "tops"])
    nodes = written(nodes.withColumn("leaves", F.col("tops") + (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "counted")

    paths = shared.select("conv_id", "depth", "node").join(nodes.select("conv_id", "depth", "leaves", "saved"), ["conv_id", "depth"], "left")
    paths = ordered(paths.fillna(0, ["leaves", "saved"]), n_parts, F.col("conv_id"), F.desc("depth"))
    summed = running_sums(paths, "conv_id", ["leaves", "saved"]).where((F.col("leaves") > 0) | (F.col("saved") > 0))
    totals = summed.groupBy("node").agg(F.sum("leaves").alias("all_leaves"), F.sum("saved").alias("all_saved"))

    top_count, child_count = tops.count(), found.count()
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children", "tops")
    inner = nodes.join(totals, "node", "left").join(_ends(shared), "node", "left")
    inner = keyed_join(inner, parents.select("parent", "parent_conv_id", F.col("n_children").alias("n")), "parent", [F.col("node")], child_count)
    tops = keyed_join(tops, parents.select("parent", "parent_conv_id", F.col("tops").alias("n")), "parent", [F.col("conv_id")], top_count)

    own = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NOTHING))
    alone = _node(F.lit(1), F.when(F.col("ends"), 0).otherwise(1), F.lit(1), F.lit(0), own)
    place = ["conv_id", "depth", "parent_conv_id"]
    return (
        inner.select(*place, *_node(F.col("n_convs"), F.col("n_children"), F.coalesce("all_leaves", F.lit(0)), F.coalesce("all_saved", F.lit(0)), F.coalesce("ends_sha256", F.lit(_NOTHING))))
        .unionByName(tops.select(*place, *alone))
        .unionByName(tails.withColumn("parent_conv_id", F.col("conv_id")).select(*place, *alone))
    )
