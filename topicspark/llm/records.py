"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A file is a run of records, in ascending order of document id over all files::

    length   u64   bytes of the payload
    check    u32   masked CRC-32 of the eight length bytes
    payload        flag u8 (1: the id is null), id i64, width u8, token ids of that width
    check    u32   masked CRC-32 of the payload
    end      u8    line feed, the terminator that the text sink writes

All numbers are little-endian. A mask (rotate by 15, add a constant) keeps the
checksum of data that holds checksums from being trivial. Token ids take two bytes
if the vocabulary fits, else four.

Files are written and read by Spark's own sink and source, so they lie wherever
Spark can write, commit once per task, and a lost executor costs a retried task.
The index (``index`` beside ``data``) has a row per record: file, offset, size,
id, number of tokens, position of its first token among all tokens, and the CRC-32
of its ids. Ties of the id are ordered by a hash of the text; a null id sorts
first; null and empty texts are records with the end token alone; an empty table
gives an empty index. Other columns of the documents are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, parts
from .tokens import encoder, slices, text_list

MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<BqB")
_TAIL = struct.Struct("<I")
_END = b"\n"
_FLUSH = 4 << 20

INDEX_SCHEMA = "file string, offset bigint, size bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint, before bigint"


class BrokenRecord(ValueError):
    """A record whose length or checksum does not fit its bytes."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _BODY.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def parse(data: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """Id, token ids (u32) and size with terminator of the record at ``offset``."""
    length, check = _HEAD.unpack_from(data, offset)
    if masked(data[offset : offset + 8]) != check:
        raise BrokenRecord(f"length at {offset}")
    start = offset + _HEAD.size
    payload = data[start : start + length]
    if len(payload) != length or masked(payload) != _TAIL.unpack_from(data, start + length)[0]:
        raise BrokenRecord(f"payload at {offset}")
    null, doc_id, width = _BODY.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_BODY.size).astype("<u4")
    return None if null else doc_id, ids, _HEAD.size + length + _TAIL.size + len(_END)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents and write them to ``path/data``."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = encode.width if end_id < 1 << 16 else 4
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out, size = [], 0
            for part in slices(batch):
                for doc_id, raw in zip(part.column(0).to_pylist(), encode(text_list(part.column(1)))):
                    out.append(frame(doc_id, np.concatenate([np.frombuffer(raw, dtype="<u4"), end]), width))
                    size += len(out[-1])
                    if size > _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = keyed.repartitionByRange(parts(docs), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    # the bytes as they are: the text sink writes a string's bytes without looking at them
    ordered.transform(in_batches, framed, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END.decode()).text(f"{path}/data")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def write_index(spark: SparkSession, path: str) -> None:
    """Read every record of ``path/data`` back, check it, and write ``path/index``."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                file, data = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                rows, offset, before = [], 0, 0
                while offset < len(data):
                    doc_id, ids, size = parse(data, offset)
                    rows.append((file, offset, size, doc_id, len(ids), zlib.crc32(ids.tobytes()), before))
                    before += len(ids)
                    offset += size
                if rows:
                    columns = [pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    _files(spark, path).transform(in_batches, scanned, INDEX_SCHEMA).write.parquet(f"{path}/index_in_files")
    local = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index_in_files")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    sizes = local.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(number).alias("at")).collect()  # a row per file
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["at"]):
        starts.append((row["file"], total))
        total += row["n"]
    bases = F.broadcast(spark.createDataFrame(starts, "file string, base bigint"))
    local.join(bases, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before").write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA.replace("before", "start")).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records at the (file, offset) rows of ``wanted``, as (doc_id, ids).

    Each file's offsets are brought to it, and only these places are read from it;
    sort the result by any key for a shuffled epoch.
    """

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(0)[at].as_py()
                got = [parse(data, offset)[:2] for offset in batch.column(1)[at].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in got], pa.int64()), pa.array([ids.tolist() for _, ids in got], pa.list_(pa.int64()))], ["doc_id", "ids"]
                )

    places = wanted.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    return _files(spark, path).join(places, "file").select("content", "offsets").transform(in_batches, picked, "doc_id bigint, ids array<bigint>")
