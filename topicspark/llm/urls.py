"""URL rules in a sorted digest array.

A list of rules (a host and the beginning of a path, with a verdict) is laid out as
one file: sorted 64-bit xxHash keys of the rules' strings, the places of the full
strings, the verdicts, and the strings. Tasks map the file into memory, so its pages
are shared by all workers of a machine and only those that are looked at are read.

For a url the host and each of its parent domains, each with the path's beginnings
of every length that some rule's path has, are hashed, all urls of a batch together;
one binary search finds the places of all, and equal keys count only if the stored
string is the same, so collisions do no harm. The longest rule wins, of equally
long ones that with the longer host, and of repeated ones the blocking.

The list is sorted by Spark and streamed into the file, and Spark's file
distribution brings it to executors, also to new ones. Hosts are from the first
``://`` up to ``/``, ``?``, ``#`` or the end, in lower case (A-Z); the path from there to
``?``, ``#`` or the end; both empty for null or without ``://``. A url without a rule gets
the list's default verdict. Repeated rows are answered each; null rules are left
out; an empty list gives the default everywhere; an empty table gives no row.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

BLOCK, ALLOW = "block", "allow"
_HEAD = struct.Struct("<8sQQ")
_MAGIC = b"urlrule1"
_OPEN: dict[str, RuleFile] = {}


def rule_rows(rules: DataFrame) -> DataFrame:
    """(digest, rule, host_chars, verdict) of a list (host, path, verdict), sorted by digest."""
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin(BLOCK, ALLOW))
    rows = rows.select(F.concat(host, "path").alias("rule"), F.length("host").alias("host_chars"), (F.col("verdict") == BLOCK).alias("block"))
    rows = rows.groupBy("rule", "host_chars").agg(F.max("block").alias("block"))
    digest = F.xxhash64("rule")  # 64-bit xxHash of the string, seed 42
    return rows.select(digest.alias("digest"), "rule", "host_chars", "block").orderBy((digest.bitwiseXOR(F.lit(-1 << 63))), "host_chars")


def write_rules(rules: DataFrame, path: str) -> None:
    """Stream the sorted list into one file."""
    lengths: set[int] = set()
    n, at = 0, 0
    with tempfile.TemporaryFile() as keys, tempfile.TemporaryFile() as places, tempfile.TemporaryFile() as strings:
        for row in rule_rows(rules).toLocalIterator():
            raw = row["rule"].encode()
            keys.write(struct.pack("<q", row["digest"]))
            places.write(struct.pack("<QII", at, len(raw), row["host_chars"] << 1 | row["block"]))
            strings.write(raw)
            lengths.add(len(row["rule"]) - row["host_chars"])
            at += len(raw)
            n += 1
        with open(path, "wb") as out:
            out.write(_HEAD.pack(_MAGIC, n, len(lengths)))
            out.write(np.array(sorted(lengths), dtype="<u8").tobytes())
            for part in (keys, places, strings):
                part.seek(0)
                while block := part.read(1 << 20):
                    out.write(block)


class RuleFile:
    """A rule file, mapped into memory."""

    PLACE = np.dtype([("at", "<u8"), ("size", "<u4"), ("what", "<u4")])

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n, n_lengths = _HEAD.unpack_from(self.data)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no rule file")
        at = _HEAD.size
        self.lengths = np.frombuffer(self.data, "<u8", n_lengths, at).tolist()
        at += 8 * n_lengths
        self.keys = np.frombuffer(self.data, "<u8", n, at)
        at += 8 * n
        self.places = np.frombuffer(self.data, self.PLACE, n, at)
        self.strings = at + self.PLACE.itemsize * n

    def find(self, candidates: list[tuple[str, int]]) -> list[bool | None]:
        """For (string, characters of its host) the rule's verdict (blocks or not), or None."""
        import xxhash

        raw = [c.encode() for c, _ in candidates]
        digests = np.array([xxhash.xxh64_intdigest(r, 42) for r in raw], dtype=np.uint64)
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found: list[bool | None] = [None] * len(raw)
        for k in np.flatnonzero(high > low):
            for place in self.places[low[k] : high[k]]:
                at, size, what = (int(x) for x in place)
                begin = self.strings + at
                if what >> 1 == candidates[k][1] and self.data[begin : begin + size] == raw[k]:
                    found[k] = bool(what & 1)
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """The winning rule of each url and whether it blocks."""
        candidates, owner = [], []
        for k, (host, path) in enumerate(zip(hosts, paths)):
            at = 0
            while host and at >= 0:
                domain = host[at:]
                for length in self.lengths:
                    if length > len(path):
                        break
                    candidates.append((domain + path[:length], len(domain)))
                    owner.append(k)
                at = host.find(".", at) + 1 or -1
        best: list[tuple[tuple[int, int], str, bool] | None] = [None] * len(hosts)
        for (rule, host_chars), k, blocks in zip(candidates, owner, self.find(candidates)):
            if blocks is not None and (best[k] is None or (len(rule), host_chars) > best[k][0]):
                best[k] = ((len(rule), host_chars), rule, blocks)
        return [b and b[1:] for b in best]


def _file(name: str) -> RuleFile:
    if name not in _OPEN:
        _OPEN[name] = RuleFile(SparkFiles.get(name))
    return _OPEN[name]


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Host, path, winning rule and verdict of every row."""
    spark = urls.sparkSession
    name = f"rules-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="rules-"), name)  # on the driver; Spark takes it from there
    write_rules(rules, path)
    spark.sparkContext.addFile(path)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _file(name)
        for batch in batches:
            found = file.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([default if f is None else BLOCK if f[1] else ALLOW for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    rest = F.substring_index(F.col(url_col), "://", 1)
    rest = F.when(F.contains(F.col(url_col), F.lit("://")), F.substr(F.col(url_col), F.length(rest) + 4)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path_of = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    rows = urls.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        path_of.alias("path"),
    )
    return rows.transform(in_batches, judged, "page_id bigint, host string, path string, rule string, verdict string")
