"""Benchmark leaks by spaced seeds.

Texts and benchmark items are cut into words without case and ASCII punctuation; in
scripts that are written without blanks (``ALONE``) each sign is a word of its own.
A seed is a fixed mask over a window of words: the words under a 1 are hashed, the
others may differ. Hashes of the items' windows are kept sorted; a document's
windows are looked up there by binary search, and each hit fixes an alignment of
the document with an item, which is then compared word by word. The longest stretch of
which ``SAME`` of the words agree is a leak if it is at least ``OVERLAP`` words long
(or the whole of a shorter item).

Items go to the tasks in blocks of bounded size (about 250 bytes a word), each block
over all documents, so a benchmark of any size is searched whole. Documents are
neither shuffled nor joined: a block and its hashes fit a task. Hits are gathered in
bounded runs, and an alignment of a document with an item is compared once, however
many seeds hit it. Of an item's stretches in a document the longest is given, of these
the one that agrees most, then the first in the document, then in the item.

Items shorter than the first mask have masks of four words; an item with fewer
than ``shortest`` words is too common a phrase to prove a leak and finds nothing
(of fewer than four words no mask fits, so these have to appear word by word).
Null and empty texts have no leak; repeated documents are answered each, repeated
items (id and text) once; a null id is kept; an empty table on either side gives no
row. Other columns are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, ship

MASKS = (
    "11111111", "110110011011", "101101101101", "111001010111",
    "111111", "1101011001", "1011001101", "110010100011", "11111", "11100101", "10101101",
)
SHORT_MASKS = ("1111", "11011", "10111", "11101")  # of items shorter than the first mask: one of 5 to 7 words may differ
OVERLAP, SAME, SHORTEST = 12, 0.8, 5
_WHOLE, _SHARE = 5, 4  # SAME as a fraction of whole numbers
BLOCK_WORDS = 500_000
# Thai, Lao, Tibetan, Burmese, Khmer; Chinese and Japanese signs with their repeat marks
ALONE = "\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_ALONE, _POINTS = re.compile(f"[{ALONE}]"), re.compile("[\u3000-\u3004\u3008-\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
LEAKS = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_same bigint, identity double"
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TEXTS = 512
_HITS = 1 << 18
_KINDS = [pa.int64()] * 6 + [pa.float64()]
_NAMES = [c.split()[0] for c in LEAKS.split(", ")]


def words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii() and _ALONE.search(text):
        text = _ALONE.sub(r" \g<0> ", _POINTS.sub(" ", text))
    return text.encode().translate(_PLAIN).split()


class Index:
    """The windows of a block of items under every mask."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks: tuple[str, ...] = MASKS, shortest: int = SHORTEST):
        cut = [(item, words(text)) for item, text in items]
        cut = [(item, w) for item, w in cut if len(w) >= max(shortest, 1)]
        self.items = [item for item, _ in cut]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], dtype=np.int64) for _, found in cut]
        rng = np.random.default_rng(5)
        self.value = rng.integers(1, 1 << 63, max(len(self.vocabulary), 1), dtype=np.uint64) | np.uint64(1)
        shapes = {mask: [k for k, w in enumerate(self.words) if len(w) >= len(mask)] for mask in masks}
        for k, found in enumerate(self.words):
            if len(found) < len(masks[0]):
                for mask in SHORT_MASKS if len(found) >= len(SHORT_MASKS[0]) else ("1" * len(found),):
                    shapes.setdefault(mask, []).append(k)
        self.seeds = []
        for mask, own in shapes.items():
            places = np.array([at for at, c in enumerate(mask) if c == "1"])
            turn = rng.integers(1, 1 << 63, len(places), dtype=np.uint64) | np.uint64(1)
            keys, of, at = [], [], []
            for k in own:
                begins = np.arange(len(self.words[k]) - len(mask) + 1)
                keys.append(self._keys(self.words[k], begins, places, turn))
                of.append(np.full(len(begins), k))
                at.append(begins)
            if keys:
                joined = np.concatenate(keys)
                order = np.argsort(joined, kind="stable")
                self.seeds.append((len(mask), places, turn, joined[order], np.concatenate(of)[order], np.concatenate(at)[order]))

    def _keys(self, ids, begins, places, turn):
        found = np.zeros(len(begins), dtype=np.uint64)
        for place, by in zip(places, turn):
            found += self.value[ids[begins + place]] * by
            found ^= found >> np.uint64(31)
        return found

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its leaks: (item, doc_start, item_start, n_words, n_same), the
        longest for each item."""
        get = self.vocabulary.get
        cut = [np.fromiter(map(get, found, repeat(-1)), dtype=np.int64, count=len(found)) for found in map(words, texts)]
        result: list[list[tuple]] = [[] for _ in texts]
        if not self.seeds:
            return result
        gap = np.full(max(s[0] for s in self.seeds), -1)
        ids = np.concatenate([x for found in cut for x in (found, gap)]) if cut else gap
        begins = np.cumsum([0, *(len(found) + len(gap) for found in cut)])
        known = ids >= 0
        seen: set[tuple[int, int, int]] = set()
        best: dict[tuple[int, int], tuple] = {}
        for span, places, turn, keys, of, at in self.seeds:
            if len(ids) < span:
                continue
            whole = np.ones(len(ids) - span + 1, dtype=bool)
            for place in places:
                whole &= known[place : place + len(whole)]
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            wanted = self._keys(ids, starts, places, turn)
            low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            for doc, item, shift in self._alignments(starts, low, high, of, at, begins):
                if (doc, item, shift) in seen:
                    continue
                seen.add((doc, item, shift))
                for leak in self._overlaps(cut[doc], self.words[item], shift):
                    if (doc, item) not in best or self._order(leak) > self._order(best[doc, item]):
                        best[doc, item] = leak
        for (doc, item), leak in sorted(best.items()):
            result[doc].append((self.items[item], *leak))
        return result

    @staticmethod
    def _order(leak: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        return leak[2], leak[3], -leak[0], -leak[1]

    @staticmethod
    def _alignments(starts, low, high, of, at, begins) -> Iterator[tuple[int, int, int]]:
        """The different (document, item, shift) of the hits, ``_HITS`` or few more at a time."""
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        runs = np.flatnonzero(np.diff(np.cumsum(counts) // _HITS)) + 1
        for own, n in zip(np.split(hit, runs), np.split(counts, runs)):
            doc = np.searchsorted(begins, starts[own], "right") - 1
            place = np.arange(n.sum()) + np.repeat(low[own] - (np.cumsum(n) - n), n)
            shift = np.repeat(starts[own] - begins[doc], n) - at[place]
            yield from map(tuple, np.unique(np.stack([np.repeat(doc, n), of[place], shift], axis=1), axis=0).tolist())

    @staticmethod
    def _overlaps(doc: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int, int]]:
        """The longest stretch of the item laid over the document at ``shift`` of which
        ``SAME`` agrees, if it is a leak."""
        first, last = max(0, -shift), min(len(item), len(doc) - shift)
        if last - first < min(OVERLAP, len(item)):
            return []
        same = doc[first + shift : last + shift] == item[first:last]
        hits_to = np.concatenate([[0], np.cumsum(same)])
        total = hits_to * _WHOLE - np.arange(len(hits_to)) * _SHARE  # in whole numbers: no rounding
        # a stretch from s to e is good if total[e] >= total[s]; the longest begins at a new
        # low, and ends at the last place from which the total is as high again
        lows = np.flatnonzero(total < np.concatenate([[total[0] + 1], np.minimum.accumulate(total)[:-1]]))
        highest = np.maximum.accumulate(total[::-1])[::-1]
        ends = np.searchsorted(-highest, -total[lows], "right") - 1
        k = int(np.argmax(ends - lows))
        start, end = int(lows[k]), int(ends[k])
        n, hits = end - start, int(hits_to[end] - hits_to[start])
        if n < min(OVERLAP, len(item)):
            return []
        return [(first + start + shift, first + start, n, hits)]


def _blocks(items: DataFrame, item_col: str, text_col: str, shortest: int) -> Iterator[Index]:
    own = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text")).distinct()
    blanks = F.size(F.split("text", r"\s+"))
    alone = F.length(F.regexp_replace("text", f"[^{ALONE}]+", ""))
    total = own.agg(F.sum(blanks + alone)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_WORDS))
    for block in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block)
        yield Index([(r["item"], r["text"]) for r in part.collect()], shortest=shortest)  # a block of bounded size


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """A row for each document and item, of at least ``shortest`` words, of which it holds a leak."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], LEAKS)
    for index in _blocks(items, item_col, item_text, shortest):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for at in range(0, batch.num_rows, _TEXTS):
                    part = batch.slice(at, _TEXTS)
                    for doc_id, hits in zip(part.column(0).to_pylist(), shared.value.search(part.column(1).to_pylist())):
                        rows += [(doc_id, *hit, hit[-1] / hit[-2]) for hit in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

        found = found.unionByName(own.transform(in_batches, search, LEAKS))
    return found


def without_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = SHORTEST
) -> DataFrame:
    """The documents that hold no leak, as they are."""
    ship(docs.sparkSession)
    for index in _blocks(items, item_col, item_text, shortest):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def leaky(texts, shared=shared):
            import pandas as pd

            rows = texts.tolist()
            return pd.Series([bool(hits) for at in range(0, len(rows), _TEXTS) for hits in shared.value.search(rows[at : at + _TEXTS])], dtype=bool)

        docs = docs.where(~leaky(F.col(text_col)))
    return docs
