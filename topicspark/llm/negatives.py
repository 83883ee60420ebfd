"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Components are ``floor(256 x)``; a score is the integer inner product with the anchor.
For a block of rows each dimension has a list of the rows sorted by component. An anchor
reads the lists from the end its sign favours, to the same depth everywhere; a row
met for the first time is scored in full by random access. The components at the
reached depth give the threshold, the most that any row not met yet can score. Reading
stops once the threshold is strictly below the k-th score of everything asked for (equal
scores could still win by their id), or below the least score asked for. Depths double.

Two searches use it: an anchor's positives (best rows of its label), then, for each score of
a positive, the best rows of other labels within the window of scores it allows.
Rows stay where they are; anchors come in blocks of ``ANCHOR_BYTES``, so a task holds
one block of anchors with their few best rows, and one block of rows. The best of the
tasks are merged by Spark. The number of passes grows with the anchors.

Rows without a label, an id or a vector, or with a null, non-finite or, beyond
``COMPONENT``, unscorable component take no part. Shorter vectors end in zeros, empty ones score
zero. Repeated rows are rows each, and an anchor's copy may be its positive. Ties go to the
smaller id. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layout import spread
from ..plans.ordering import with_ordinal
from ..session import scratch_path
from .common import in_batches, written

SCALE = 256
COMPONENT = 1 << 26
ANCHOR_BYTES = 4 << 20
BLOCK_ROWS = 1 << 14
FIRST_DEPTH = 16
FLOOR_PERCENT, TOP_PERCENT = 30, 90
FOUND = "anchor bigint, asked bigint, score bigint, vec_id bigint, row bigint"
_ALL = (-(1 << 62), 1 << 62)


def quantise(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows that take part, with integer components ``x``, numbered by ``row``."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    fit = F.forall(scaled, lambda v: F.coalesce((v >= -COMPONENT) & (v < COMPONENT), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.transform(scaled, lambda v: F.floor(v).cast("int")).alias("x"),
        F.monotonically_increasing_id().alias("row"),
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; short ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype=np.float64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = places < width
    out[rows[inside], places[inside]] = values[inside]
    return out


class Best:
    """The first ``k`` rows, by score and id, of those within one window."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.vec_id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        inside = (score >= max(self.low, self.kth())) & (score <= self.high)
        if inside.any():
            score, vec_id, row = (np.concatenate([a, b[inside]]) for a, b in zip((self.score, self.vec_id, self.row), (score, vec_id, row)))
            first = np.lexsort((row, vec_id, -score))[: self.k]
            self.score, self.vec_id, self.row = score[first], vec_id[first], row[first]

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else _ALL[0]

    def settled(self, threshold: int) -> bool:
        """Whether no row that scores ``threshold`` at most can enter."""
        return threshold < self.kth() or threshold < self.low


class Lists:
    """A block of rows with its sorted list for each dimension."""

    def __init__(self, x: np.ndarray, label: np.ndarray, vec_id: np.ndarray, row: np.ndarray):
        self.x, self.label, self.vec_id, self.row = x, label, vec_id, row
        self.up = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.down = self.up[::-1]
        self.reach = float(np.abs(x).max(initial=0))

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Random access: whole scores of the rows ``at``."""
        if self.reach * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 1 << 53:
            return (self.x[at] @ anchor).astype(np.int64)  # exact in doubles
        return self.x[at].astype(np.int64) @ anchor.astype(np.int64)

    def search(self, anchor: np.ndarray, wanted, asked: list[Best]) -> int:
        """Fill ``asked`` with rows for which ``wanted(rows)`` holds; the depth that was read."""
        n, width = self.x.shape
        seen = np.zeros(n, dtype=bool)
        favoured, dims = anchor > 0, np.arange(width)
        depth = 0
        while depth < n:
            before, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            if depth == n or width == 0:
                depth, new = n, np.flatnonzero(~seen)
            else:
                met = np.zeros(n, dtype=bool)
                met[self.down[before:depth][:, favoured].ravel()] = True
                met[self.up[before:depth][:, ~favoured].ravel()] = True
                new = np.flatnonzero(met & ~seen)
            seen[new] = True
            fit = new[wanted(new)]
            score = self.scores(anchor, fit)
            for best in asked:
                best.add(score, self.vec_id[fit], self.row[fit])
            if depth == n:
                break
            frontier = np.where(favoured, self.down[depth - 1], self.up[depth - 1])
            reached = self.x[frontier, dims].astype(np.int64) * anchor.astype(np.int64)
            if all(best.settled(int(reached.sum())) for best in asked):
                break
        return depth


def _search(rows: DataFrame, anchors: pa.Table, width: int, windows: dict[int, list] | None, k: int) -> DataFrame:
    """Each task's best rows: of the anchor's label without ``windows``, else, within
    each of the anchor's windows (asked, low, high), of other labels."""
    vectors = _matrix(anchors.column("x"), width)
    labels, numbers = (anchors.column(c).to_numpy() for c in ("label", "row"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [[(a, Best(k, low, high)) for a, low, high in ([(0, *_ALL)] if windows is None else windows.get(int(n), []))] for n in numbers]

        def through(held: list[pa.RecordBatch]) -> None:
            block = pa.Table.from_batches(held)
            label, vec_id, row = (block.column(c).to_numpy() for c in ("label", "vec_id", "row"))
            lists = Lists(_matrix(block.column("x"), width), label, vec_id, row)
            for vector, own, number, wants in zip(vectors, labels, numbers, asked):
                if wants:
                    if windows is None:
                        lists.search(vector, lambda at: (label[at] == own) & (row[at] != number), [b for _, b in wants])
                    else:
                        lists.search(vector, lambda at: label[at] != own, [b for _, b in wants])

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(start, BLOCK_ROWS))
                size += held[-1].num_rows
                if size >= BLOCK_ROWS:
                    through(held)
                    held, size = [], 0
        if size:
            through(held)
        for number, wants in zip(numbers, asked):
            for a, best in wants:
                if len(best.score):
                    n = len(best.score)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, v, dtype=np.int64)) for v in (number, a)] + [pa.array(v) for v in (best.score, best.vec_id, best.row)],
                        ["anchor", "asked", "score", "vec_id", "row"],
                    )

    found = rows.select("label", "vec_id", "row", "x").transform(in_batches, searched, FOUND)
    order = Window.partitionBy("anchor", "asked").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def window(positive: int) -> tuple[int, int] | None:
    """The least and the highest score a negative may have beside a positive's."""
    low, high = -(-FLOOR_PERCENT * positive // 100), TOP_PERCENT * positive // 100
    return (low, high) if low <= high else None


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10) -> DataFrame:
    """Negatives by anchor and positive; ``vectors`` come from ``quantise``."""
    spark = vectors.sparkSession
    rows = written(vectors, "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    anchors = with_ordinal(rows.where(is_anchor), F.col("vec_id"), F.col("row"))
    block = max(1, ANCHOR_BYTES // (8 * max(1, width)))
    near, far = scratch_path(spark, "positives"), scratch_path(spark, "negatives")
    positives = "anchor_id bigint, anchor bigint, positive_id bigint, place int, asked bigint"
    negatives = "anchor bigint, asked bigint, rank int, vec_id bigint, score bigint"
    for path, schema in ((near, positives), (far, negatives)):
        spark.createDataFrame([], schema).write.parquet(path)
    rows = spread(rows)
    for start in range(0, anchors.count(), block):
        some = anchors.where((F.col("ordinal") >= start) & (F.col("ordinal") < start + block))
        held = some.select("row", "label", "x").toArrow()  # one block, bounded in bytes
        mine_ = some.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found = _search(rows, held, width, None, n_positives).join(mine_, "anchor")
        found = written(found.select("anchor_id", "anchor", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("asked")), "block")
        found.write.mode("append").parquet(near)
        windows: dict[int, list] = {}
        for anchor, asked in found.select("anchor", "asked").distinct().collect():
            if window(asked):
                windows.setdefault(anchor, []).append((asked, *window(asked)))
        _search(rows, held, width, windows, n_negatives).select("anchor", "asked", "rank", "vec_id", "score").write.mode("append").parquet(far)
    beside = spark.read.schema(positives).parquet(near).join(spark.read.schema(negatives).parquet(far), ["anchor", "asked"])
    return beside.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("asked").alias("positive_score"), F.col("score").alias("negative_score")
    )
