"""Toxic passages as maximum-scoring segments of token log-odds.

*Weights.* A word has five keys: itself, and its first three to six bytes, so that
forms of a stem not met in training are known by the stem. Keys are hashed to
``SLOTS`` slots for each kind, which bounds the model whatever the vocabulary. A
slot's weight is the log-odds of its documents among toxic against other labelled
documents, smoothed by a Dirichlet prior in proportion to the slot's count over all
documents. A word has the weight of its most significant key, and none if that is
less than ``MIN_Z`` standard deviations (the signed root of the likelihood ratio);
every word also costs ``DRIFT``.
*Segments.* A linear scan (Ruzzo and Tompa) finds all maximal segments of a text.
*Extreme values.* The best segment of an ordinary text follows an extreme-value
distribution: of n words, the number of segments that score S or more is expected
to be ``K n exp(-lambda S)``. Lambda solves ``E exp(lambda w) = 1`` over the words of
ordinary training texts, K fits their best segments. Segments expected fewer than
``ALPHA`` times are reported as passages. A document's score is a logistic function,
fitted on training rows, of ``lambda S - log(K n)`` of its best segment.

Only rows of ``labels`` that the caller passes are learned from: at most
``FIT_ROWS`` of each class, in the order of a hash of the id. Copies would make every
word of theirs look telling, so a training document counts for one divided by the
number of those that share its smallest hash of four words, under any of
``SKETCHES`` hashes. The prior counts all documents. Words are runs of letters, digits and bytes beyond ASCII, without case.
Null and empty texts have no segment and get a score like any other. Without
positive or negative labels all weights are zero and every score is one half at
most. Labels of unknown ids and null labels are ignored; of contradicting labels of
an id the toxic one holds. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

BITS, STEMS = 18, (3, 4, 5, 6)
SLOTS = 1 << BITS
KINDS = 1 + len(STEMS)
FIT_ROWS = 25_000
SKETCHES = 4
GRID = np.geomspace(0.02, 20, 48)  # values of lambda that are tried
PRIOR, MIN_Z, DRIFT, ALPHA = 2_000.0, 4.0, 0.05, 0.01
_CHUNK = 1 << 20
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[0]
    x ^= x >> np.uint64(32)
    x = x * _MIX[1]
    return x ^ x >> np.uint64(29)


@dataclass
class Words:
    """The words of some texts, laid end to end."""

    doc: np.ndarray  # the text of each word
    start: np.ndarray  # in bytes, within its text
    end: np.ndarray
    slots: np.ndarray  # a row for each kind; -1 where the word is no longer than the stem


def cut(texts: list[bytes]) -> Words:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # a blank after each text
    raw = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
    low = _LOWER[raw]
    upper = (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    upper[1:] &= raw[:-1] == 0xC3  # capital letters of Latin-1
    upper[:1] = False
    low[upper] += 32
    inside = _WORD[low]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    size = end - start
    eights = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=np.ascontiguousarray(low), strides=(1,))
    head = eights[start] & _KEEP[np.minimum(size, 8)]
    second = np.where(size > 8, eights[np.minimum(start + 8, len(eights) - 1)] & _KEEP[np.clip(size - 8, 0, 8)], 0)
    last = np.where(size > 16, eights[np.maximum(end - 8, 0)], 0)
    whole = _mixed(_mixed(head) + second * _MIX[2] + last * _MIX[3] + size.astype(np.uint64))
    slots = np.full((KINDS, len(start)), -1, dtype=np.int64)
    slots[0] = (whole >> np.uint64(64 - BITS)).astype(np.int64)
    for kind, k in enumerate(STEMS, 1):
        stem = (_mixed((head & _KEEP[k]) ^ _MIX[k % 4]) >> np.uint64(64 - BITS)).astype(np.int64)
        slots[kind] = np.where(size > k, stem + kind * SLOTS, -1)
    doc = np.searchsorted(begins, start, "right") - 1
    return Words(doc, start - begins[doc], end - begins[doc], slots)


def chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column as bytes, about ``_CHUNK`` bytes at a time, with the first one's place."""
    texts, size, first = [], 0, 0
    for at, text in enumerate(column.cast(pa.binary())):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size > _CHUNK:
            yield first, texts
            texts, size, first = [], 0, at + 1
    if texts:
        yield first, texts


def segments(weight: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last + 1, score) of a row of weights, in linear time.

    Words are added up to runs of positive ones first: a maximal segment holds whole runs. Each kept
    segment remembers the nearest earlier one that starts at a smaller total; those between
    start no lower than it does, so a search that has passed it skips them all."""
    signs = np.concatenate([[False], weight > 0, [False]])
    turns = np.flatnonzero(signs[1:] != signs[:-1])
    if not len(turns):
        return []
    total = np.concatenate([[0.0], np.cumsum(weight)])
    firsts, ends = turns[::2], turns[1::2]
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, link
    for first, end, before, after in zip(firsts.tolist(), ends.tolist(), total[firsts].tolist(), total[ends].tolist()):
        back = len(kept) - 1
        while True:
            while back >= 0 and kept[back][2] >= before:
                back = kept[back][4]
            if back < 0 or kept[back][3] >= after:
                kept.append((first, end, before, after, back))
                break
            first, _, before, _, link = kept[back]
            del kept[back:]
            back = link
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass
class Model:
    weight: np.ndarray  # by slot
    z: np.ndarray
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = -5.0
    drift: float = field(default=DRIFT)

    def weights(self, words: Words) -> np.ndarray:
        best, found = np.zeros(words.slots.shape[1]), np.zeros(words.slots.shape[1])
        for row in words.slots:
            z = np.where(row >= 0, self.z[row], 0)
            better = np.abs(z) > np.abs(best)
            best = np.where(better, z, best)
            found = np.where(better, self.weight[row], found)
        return found - self.drift

    def level(self, score: float, n: int) -> float:
        """Minus the log of the number of segments expected to score as much."""
        return self.decay * score - self.log_k - math.log(max(n, 1))

    def score(self, level: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * level + self.intercept))))


def _texts_of(weights: np.ndarray, words: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    bounds = np.searchsorted(words.doc, np.arange(n + 1))
    for k in range(n):
        yield bounds[k], weights[bounds[k] : bounds[k + 1]]


def _of_sample(docs: DataFrame, sample: dict) -> DataFrame:
    """The rows of the training documents."""
    ids = docs.sparkSession.createDataFrame([(i,) for i in sample], "doc_id bigint")  # 2 * FIT_ROWS at most
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")


def _weights(docs: DataFrame, sample: dict[int, int]) -> dict[int, float]:
    """One divided by the number of copies among the training documents."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = [_MIX[k] + np.uint64(2 * k) for k in range(SKETCHES)]
        for batch in batches:
            found = np.zeros((SKETCHES, batch.num_rows), dtype=np.uint64)
            for first, texts in chunks(batch.column(1)):
                words = cut(texts)
                codes = words.slots[0].astype(np.uint64)
                runs = codes.copy()
                for step in (1, 2, 3):  # the last words of a text have shorter runs
                    same = words.doc[step:] == words.doc[:-step]
                    runs[:-step] = np.where(same, _mixed(runs[:-step] + codes[step:] * _MIX[3]), runs[:-step])
                for k, turn in enumerate(turns):
                    least = np.full(len(texts), np.iinfo(np.uint64).max, dtype=np.uint64)
                    np.minimum.at(least, words.doc, _mixed(runs ^ turn))
                    found[k, first : first + len(texts)] = least
            names = [f"s{k}" for k in range(SKETCHES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in found)], ["doc_id", *names])

    schema = "doc_id bigint, " + ", ".join(f"s{k} bigint" for k in range(SKETCHES))
    rows = _of_sample(docs, sample).transform(in_batches, sketch, schema).toPandas()
    share = np.ones(len(rows))
    for k in range(SKETCHES):
        share = np.maximum(share, rows.groupby(f"s{k}")["doc_id"].transform("size").to_numpy())
    return dict(zip(rows["doc_id"].tolist(), (1 / share).tolist()))


def _counts(docs: DataFrame, sample: dict[int, int], weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """By slot: words of all documents, toxic and other training documents; and the numbers of documents."""
    ids = np.array(sorted(weights), dtype=np.int64)
    toxic = np.array([sample[i] for i in ids.tolist()], dtype=np.int64)
    weight = np.array([weights[i] for i in ids.tolist()])
    shared = docs.sparkSession.sparkContext.broadcast((ids, toxic, weight))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, weight = shared.value
        got = np.zeros((3, KINDS * SLOTS))
        size = np.zeros(3)
        for batch in batches:
            doc_ids = batch.column(0).fill_null(-1 << 63).to_numpy(zero_copy_only=False)
            kind, counts_for = np.zeros(len(doc_ids), dtype=np.int64), np.ones(len(doc_ids))
            if len(ids):
                at = np.minimum(np.searchsorted(ids, doc_ids), len(ids) - 1)
                known = ids[at] == doc_ids
                kind = np.where(known, 1 + (toxic[at] == 0), 0)
                counts_for = np.where(known, weight[at], 1.0)
            size[0] += len(doc_ids)
            size[1:] += np.bincount(kind, counts_for, minlength=3)[1:]
            for first, texts in chunks(batch.column(1)):
                words = cut(texts)
                got[0] += np.bincount(words.slots[words.slots >= 0], minlength=KINDS * SLOTS)
                own = kind[first : first + len(texts)][words.doc]
                for c in (1, 2):
                    mine = own == c
                    pairs = words.slots[:, mine] + words.doc[mine] * (KINDS * SLOTS)
                    once = np.unique(pairs[words.slots[:, mine] >= 0])
                    got[c] += np.bincount(once % (KINDS * SLOTS), counts_for[first + once // (KINDS * SLOTS)], KINDS * SLOTS)
        slot = np.flatnonzero(got.any(0))
        columns = [np.append(slot, -1), *(np.append(got[k][slot], size[k]) for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "n", "toxic", "other"])

    rows = docs.transform(in_batches, count, "slot bigint, n double, toxic double, other double")
    summed = rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "other"))).toPandas()  # SLOTS rows a kind at most
    total = np.zeros((3, KINDS * SLOTS))
    slot = summed["slot"].to_numpy()
    for k, c in enumerate(("n", "toxic", "other")):
        total[k, slot[slot >= 0]] = summed[c].to_numpy()[slot >= 0]
    sizes = summed[slot < 0]
    return total[0], total[1], total[2], [float(sizes[c].sum()) for c in ("n", "toxic", "other")]


def _levels(docs: DataFrame, model: Model, sample: dict[int, int], weights: dict[int, float]) -> list[tuple]:
    """Label, share, best segment, words and the sums of ``exp(lambda w)`` over ``GRID`` of
    the training documents."""
    shared = docs.sparkSession.sparkContext.broadcast((model, sample, weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sample, weights = shared.value
        for batch in batches:
            rows, ids = [], batch.column(0).to_pylist()
            for first, texts in chunks(batch.column(1)):
                words = cut(texts)
                for k, (_, weight) in enumerate(_texts_of(model.weights(words), words, len(texts)), first):
                    best = max((s for _, _, s in segments(weight)), default=0.0)
                    value, times = np.unique(weight, return_counts=True)
                    sums = np.exp(np.minimum(np.outer(GRID, value), 700)) @ times
                    rows.append((float(sample[ids[k]]), weights[ids[k]], best, float(len(weight)), sums))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["label", "share", "best", "n", "sums"])

    schema = "label double, share double, best double, n double, sums array<double>"
    found = _of_sample(docs, sample).transform(in_batches, of, schema)
    return [tuple(r) for r in found.collect()]  # FIT_ROWS a class at most, unless rows repeat


def _ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Log of the likelihood ratio of two shares ``a / n_a`` and ``b / n_b`` against one for both."""
    share = (a + b) / (n_a + n_b)

    def part(x, n, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(n * expected, 1e-12)), 0)

    own = part(a, n_a, share) + part(n_a - a, n_a, 1 - share) + part(b, n_b, share) + part(n_b - b, n_b, 1 - share)
    return np.maximum(own, 0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weights, extreme-value parameters and calibration from ``labels``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample: dict[int, int] = {}
    for label in (0, 1):
        rows = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id").collect()
        sample |= {r["id"]: label for r in rows}
    weights = _weights(docs, sample)
    seen, toxic, other, (n_docs, n_toxic, n_other) = _counts(docs, sample, weights)
    if not n_toxic or not n_other:
        return Model(np.zeros(KINDS * SLOTS), np.zeros(KINDS * SLOTS))
    words = seen[:SLOTS].sum()
    prior = PRIOR * (seen + 0.01) / (words + 0.01 * SLOTS)
    documents = PRIOR * n_docs / max(words, 1)  # as many as have the prior's words
    odds = np.log((toxic + prior) / (n_toxic + documents)) - np.log((other + prior) / (n_other + documents))
    z = np.sign(odds) * np.sqrt(2 * _ratio(toxic, other, n_toxic, n_other))
    odds[np.abs(z) < MIN_Z] = 0
    z[np.abs(z) < MIN_Z] = 0
    model = Model(odds, z)
    found = _levels(docs, model, sample, weights)
    label, part, best, n = np.array([row[:4] for row in found]).T
    plain = label == 0
    rest = part * plain
    # as if half a word more had the weight of a telling one: training texts can't rule it out
    telling = float(np.median(odds[odds > 0])) if (odds > 0).any() else 1.0
    sums = sum((r * np.array(row[4]) for r, row in zip(rest, found) if r), np.zeros(len(GRID)))
    means = (sums + 0.5 * np.exp(np.minimum(GRID * telling, 700))) / ((n * rest).sum() + 0.5)
    below = np.flatnonzero(means <= 1)
    model.decay = float(GRID[below[-1]]) if len(below) else float(GRID[0])
    level = model.decay * best - np.log(np.maximum(n, 1))
    model.log_k = float((level * rest).sum() / rest.sum() - np.euler_gamma)  # the mean of a Gumbel variable
    level -= model.log_k
    centre, scale = level.mean(), level.std() or 1.0
    x, w = np.stack([(level - centre) / scale, np.ones(len(level))], 1), np.zeros(2)
    for _ in range(50):  # a logistic function by Newton's steps; a small penalty keeps it finite
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (part * (p - label)) + 0.1 * w
        curve = (x * (part * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    model.slope, model.intercept = float(w[0] / scale), float(w[1] - w[0] * centre / scale)
    return model


SCORED = (
    "doc_id bigint, score double, level double, passages array<struct<first_word:bigint,n_words:bigint,start:bigint,end:bigint,score:double,expected:double>>"
)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score and significant passages (places in bytes of the UTF-8 text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            levels, passages = [], []
            for _, texts in chunks(batch.column(1)):
                words = cut(texts)
                for begin, weight in _texts_of(model.weights(words), words, len(texts)):
                    found = segments(weight)
                    levels.append(model.level(max((s for _, _, s in found), default=0.0), len(weight)))
                    rows = []
                    for first, end, gained in found:
                        expected = math.exp(min(-model.level(gained, len(weight)), 700))
                        if expected < ALPHA:
                            place = int(words.start[begin + first]), int(words.end[begin + end - 1])
                            rows.append(dict(zip([k for k, _ in kinds], (first, end - first, *place, gained, expected))))
                    passages.append(rows)
            columns = [batch.column(0), pa.array([model.score(x) for x in levels], pa.float64()), pa.array(levels, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(passages, pa.list_(pa.struct(kinds)))], ["doc_id", "score", "level", "passages"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).transform(in_batches, of, SCORED)
