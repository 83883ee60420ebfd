"""Documents packed along a space-filling curve.

A document's token ids are hashed into a short signed vector, which a fixed
random matrix projects to ``DIMS`` dimensions; each is cut to ``BITS`` bits by the
normal distribution's quantiles. Documents are sorted by the Hilbert index of that
cell, so neighbours in a sequence are alike, and laid end to end; a cut at every
multiple of the sequence length gives sequences without padding but in the last.

The curve's ties (copies share a cell, whatever their number) are ordered by a
checksum of id and place, so a cell with a third of all rows still spreads over
tasks. Ids are encoded once and written with their place on the curve; the bounds
of the ranges and their token counts come from that table's two small columns. A
document has a vote for the bounds for each ``GRAIN`` of its tokens, and for the rest
by chance, so that ranges hold like numbers of tokens; only then are the ids
shuffled, once, straight to their range.

Null and empty texts have the end token alone; rows with equal or null ids are
documents of their own; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, parts, written
from .tokens import encoder, slices, text_list

DIMS, BITS, WIDTH, SEED = 3, 10, 64, 11
TIE_BITS = 32
GRAIN = 512  # tokens behind a vote for the bounds of the ranges
_CODED = "doc_id bigint, place bigint, n bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(inside, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> bit & 1)
    return index


class Curve:
    """Places of documents on the curve, from their token ids."""

    def __init__(self, vocabulary: int):
        rng = np.random.default_rng(SEED)
        self.slot = rng.integers(0, WIDTH, vocabulary)
        self.sign = rng.choice((-1.0, 1.0), vocabulary)
        self.matrix = rng.standard_normal((WIDTH, DIMS))

    def cells(self, documents: list[np.ndarray]) -> np.ndarray:
        vectors = np.array([np.bincount(self.slot[ids], self.sign[ids], WIDTH) for ids in documents]).reshape(-1, WIDTH)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        at = vectors / np.where(length > 0, length, 1) @ self.matrix
        share = np.array([[0.5 + 0.5 * math.erf(v / math.sqrt(2)) for v in row] for row in at]).reshape(-1, DIMS)
        return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and place on the curve of every document, written once."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(tokenizer), 0
        curve = Curve(max(encode.highest, end_id) + 1)
        width = encode.width if end_id < 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in slices(batch):
                got = [np.concatenate([np.frombuffer(raw, dtype="<u4"), end]) for raw in encode(text_list(part.column(1)))]
                some = part.column(0).to_pylist()
                ties = [zlib.crc32(struct.pack("<qQ", doc_id or 0, row + k)) for k, doc_id in enumerate(some)]
                row += len(some)
                place = hilbert(curve.cells(got)) << TIE_BITS | np.array(ties, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()),
                        pa.array(place, pa.int64()),
                        pa.array([len(g) for g in got], pa.int64()),
                        pa.array([g.astype(f"<u{width}").tobytes() for g in got], pa.binary()),
                    ],
                    ["doc_id", "place", "n", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.transform(in_batches, coded, _CODED), "coded")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Pieces of documents with their sequence and the place in it."""
    width = 2 if end_id < 1 << 16 and encoder(tokenizer).width == 2 else 4
    ranges = parts(docs)
    table = encoded(docs, tokenizer, end_id, id_col, text_col)
    share = F.pmod(F.xxhash64("place"), F.lit(1 << 20)) / (1 << 20)
    grains = table.select("place", F.explode(F.array_repeat(F.lit(0), F.floor(F.col("n") / GRAIN + share).cast("int"))))
    bounds = grains.repartitionByRange(ranges, "place").groupBy(F.spark_partition_id()).agg(F.max("place").alias("last")).collect()  # a row per range
    lasts = np.array(sorted(r["last"] for r in bounds), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(place):
        import pandas as pd

        return pd.Series(np.minimum(np.searchsorted(lasts, place.to_numpy(), "left"), max(len(lasts) - 1, 0)).astype(np.int32))

    sums = np.zeros(max(len(lasts), 1) + 1, dtype=np.int64)
    for row in table.groupBy(range_of("place").alias("range")).agg(F.sum("n").alias("n")).collect():
        sums[row["range"] + 1] = row["n"]
    bases = np.cumsum(sums)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            rows = []
            numbers, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, doc_id, raw in zip(numbers, doc_ids, batch.column(2).to_pylist()):
                if number != current:
                    current, at = number, int(bases[number])
                ids, start = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4"), 0
                while start < len(ids):
                    sequence, offset = divmod(at, length)
                    piece = ids[start : start + length - offset]
                    raw_piece = piece.tobytes()
                    rows.append((doc_id, start, len(piece), zlib.crc32(raw_piece), len(ids), sequence, offset, raw_piece if with_ids else None))
                    start += len(piece)
                    at += len(piece)
            if rows:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    dealt = table.withColumn("range", range_of("place")).repartitionById(ranges, F.col("range"))
    return dealt.sortWithinPartitions("range", "place", "doc_id").select("range", "doc_id", "ids").transform(in_batches, cut, PIECES)
