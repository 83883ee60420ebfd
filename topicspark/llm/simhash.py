"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two documents are linked at ``TAU`` or fewer differing
bits, and a group is whatever links reach.

*Partition.* Bits that go together in a bounded sample of fingerprints are put in
the same part, so that the parts differ in how well they tell fingerprints apart.
*Thresholds.* If the parts' thresholds add up to ``TAU - parts + 1``, each linked
pair is within the threshold in at least one part (-1: the part isn't probed). A
dynamic programme over the parts picks the thresholds with the fewest estimated
candidate pairs and probe keys. The sample decides the cost only, never the result;
fewer than ``PLANNED`` fingerprints are planned for like that many, so that the work
for each stays the same from small inputs to large ones.
*Probe.* Each distinct fingerprint puts out, for each probed part, its value there
and those within half the threshold, rounded up; values that meet share a key.
*Verify.* Members of a key are compared in full. A key with many members is
searched from member to member over those not yet reached, so copies of a text
cost a step each and not a step for each pair; it puts out a tree, not all pairs.
*Hot keys.* What one key can hold has no bound: thousands of near copies agree in
most parts. Keys that a third, or a hundredth, of the sample shares are known
beforehand, and members beyond ``GROUP`` in any other key are put out while
streaming. All these go the exact long way round: two fingerprints are within
``TAU`` bits just if some value lies within half of ``TAU`` of both, so each puts
out all values that near, and those that meet in a value are linked to the first
of them, with nothing left to verify, and no pairs.

Exact copies share a fingerprint and are one member throughout. Links are joined
to groups by ``components`` without leaving the executors.

Texts with no word (null, empty) have fingerprint zero, linked like any other.
Rows with a null id get a fingerprint and the group's smallest id, which is null
only if the whole group has none. Repeated rows are answered each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_batches, keyed_join, written
from .components import components

WORDS, TAU, SEED = 4, 4, 42
SAMPLE = 2048
PLANNED = 1 << 20
GROUP = 4096
_BLOCK = 1 << 15
_ROWS = 1 << 17
_SMALL = 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned fingerprint of a text in UTF-8."""
    import xxhash

    found = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    size = min(words, len(found))
    begins = np.concatenate([[0], ends[:-1] + 1])
    last, count = ends[size - 1 :].tolist(), len(found) - size + 1
    first, ones, of = begins[:count].tolist(), np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, count, _BLOCK):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every row; ``fp`` as a signed number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.transform(in_batches, of, "doc_id bigint, text_key bigint, fp bigint")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near equal width; each grows by the bit most correlated with it."""
    bits = _bits(sample).astype(float)
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).mean(0))
    scale[scale == 0] = 1
    together = np.abs((bits / scale).T @ (bits / scale)) / max(len(bits), 1)
    np.fill_diagonal(together, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        start = max(free, key=lambda b: (together[b, list(free)].sum(), -b))
        group = [start]
        free.discard(start)
        while len(group) < width:
            best = max(free, key=lambda b: (together[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, n: int, tau: int = TAU, cost_key: float = 4.0) -> list[tuple[list[int], int]]:
    """Parts and thresholds with the least estimated work for ``n`` fingerprints."""
    rng = np.random.default_rng(0)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    left, right = (rng.integers(0, max(len(sample), 1), 1 << 18) for _ in range(2))
    for m in range(1, min(tau + 1, 5) + 1):
        groups = bit_groups(sample, m)
        costs = []
        for group in groups:
            mask = np.uint64(sum(1 << b for b in group))
            apart = np.bitwise_count((sample[left] ^ sample[right]) & mask)[left != right] if len(sample) > 1 else np.array([64])
            own = {-1: 0.0}
            for e in range(0, tau + 1):
                near = sum(comb(len(group), k) for k in range(2 * -(-e // 2) + 1)) / 2.0 ** len(group)
                share = max(float((apart <= 2 * -(-e // 2)).mean()), near)
                keys = sum(comb(len(group), k) for k in range(-(-e // 2) + 1))
                own[e] = share * n * n / 2 + cost_key * keys * n
            costs.append(own)
        total = tau - m + 1
        table = {0: (0.0, [])}
        for own in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for e, more in own.items():
                    if cost + more < grown.get(spent + e, (float("inf"), []))[0]:
                        grown[spent + e] = (cost + more, [*chosen, e])
            table = grown
        if total in table and (best is None or table[total][0] < best[0]):
            best = (table[total][0], list(zip(groups, table[total][1])))
    return best[1]


def _near(bits: list[int], radius: int) -> np.ndarray:
    """Masks of all choices of at most ``radius`` of ``bits``."""
    return np.array([sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(bits, k)], dtype=np.uint64)


def _packed(values: np.ndarray, bits: list[int], part: int) -> np.ndarray:
    """Keys of ``values`` in a part: a mix of the masked value and the part's number."""
    x = (values & np.uint64(sum(1 << b for b in bits))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(part)


def _two(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _tree(members: np.ndarray, tau: int) -> tuple[list, list]:
    """Links that connect what is linked among ``members``."""
    a, b, rest = [], [], members
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= tau
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(found)
                b.append(np.full(len(found), x))
                front.extend(found)
    return a, b


def _group_links(keys: np.ndarray, values: np.ndarray, tau: int) -> pa.RecordBatch | None:
    """Links within the runs of equal keys."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begins = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([begins, [len(keys)]]))
    a, b = [], []
    size = np.repeat(sizes, sizes)
    left = np.repeat(begins + sizes, sizes) - np.arange(len(keys)) - 1  # members behind it in its run
    at = np.flatnonzero((size <= _SMALL) & (left > 0))
    step = 1
    while len(at):
        near = np.bitwise_count(values[at] ^ values[at + step]) <= tau
        a.append(values[at + step][near])
        b.append(values[at][near])
        step += 1
        at = at[left[at] >= step]
    for k in np.flatnonzero(sizes > _SMALL):
        more = _tree(np.unique(values[begins[k] : begins[k] + sizes[k]]), tau)
        a += more[0]
        b += more[1]
    if not a:
        return None
    x, y = np.concatenate(a), np.concatenate(b)
    return _two(x[x != y], y[x != y])


def links(values: DataFrame, tau: int = TAU) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``values`` (column fp) that
    connect all that is linked; every one is within ``tau`` bits."""
    n = values.count()
    rows = values.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    if n < 2:
        return values.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    probed = [(part, bits, e) for part, (bits, e) in enumerate(plan(sample, max(n, PLANNED), tau)) if e >= 0]
    hot: dict[int, np.ndarray] = {}
    for part, bits, _ in probed:
        own, count = np.unique(_packed(sample, bits, part), return_counts=True)
        hot[part] = own[(count * (n / len(sample)) > GROUP) & (count > len(sample) // 100)]  # under 100 of them

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(part, bits, _near(bits, -(-e // 2))) for part, bits, e in probed]
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, bits, near in masks:
                for mask in near:
                    keys = _packed(own ^ mask, bits, part)
                    is_hot = np.isin(keys, hot[part])
                    yield _three(keys[~is_hot], own[~is_hot], 0)
                    if is_hot.any():
                        yield _three(keys[is_hot], own[is_hot], 1)

    def _three(keys: np.ndarray, own: np.ndarray, long: int) -> pa.RecordBatch:
        columns = [pa.array(keys.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), long, dtype=np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["key", "fp", "far"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: whole runs in blocks; of a run beyond ``GROUP`` every member
        goes the long way, marked by a pair with itself."""
        held_k, held_v, inside, spilled = np.empty(0, np.uint64), np.empty(0, np.uint64), 0, None

        def out(keys, values):
            nonlocal spilled
            if not len(keys):
                return
            begins = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.diff(np.concatenate([begins, [len(keys)]]))
            big = np.repeat((sizes > GROUP) | (keys[begins] == (spilled if spilled is not None else ~keys[begins])), sizes)
            if big.any():
                yield _two(values[big], values[big])
            if (~big).any():
                found = _group_links(keys[~big], values[~big], tau)
                if found is not None:
                    yield found

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            held_k, held_v = np.concatenate([held_k, keys]), np.concatenate([held_v, own])
            if len(held_k) < _ROWS:
                continue
            begin = int(np.flatnonzero(held_k == held_k[-1])[0])  # of the run that may go on
            if len(held_k) - begin > GROUP:
                yield from out(held_k[:begin], held_v[:begin])
                yield _two(held_v[begin:], held_v[begin:])
                spilled, held_k, held_v = held_k[-1], held_k[:0], held_v[:0]
            else:
                yield from out(held_k[:begin], held_v[:begin])
                held_k, held_v = held_k[begin:], held_v[begin:]
        yield from out(held_k, held_v)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _near(list(range(64)), tau // 2)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 64):
                some = own[at : at + 64]
                yield _two((some[:, None] ^ masks[None, :]).ravel(), np.repeat(some, len(masks)))

    def first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            keys, own = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            heads = np.where(new, own, np.uint64(0))
            at = np.maximum.accumulate(np.where(new, np.arange(len(own)), -1))
            heads = np.where(at >= 0, own[np.maximum(at, 0)], head if head is not None else own[0])
            yield _two(own[heads != own], heads[heads != own])
            key, head = keys[-1], heads[-1]

    keyed = values.select("fp").transform(in_batches, probe, "key bigint, fp bigint, far int")
    if any(len(k) for k in hot.values()):
        keyed = written(keyed, "keys")
    near = keyed.where("far = 0").select("key", "fp")
    met = written(near.repartition("key").sortWithinPartitions("key").transform(in_batches, meet, "a bigint, b bigint"), "met")
    far = met.where("a = b").select(F.col("a").alias("fp"))
    if any(len(k) for k in hot.values()):
        far = far.unionByName(keyed.where("far = 1").select("fp"))
    far = written(far.distinct(), "far")
    found = met.where("a != b")
    if far.limit(1).count():
        if tau % 2:
            raise ValueError("an odd distance has no halfway value")
        halfway = far.transform(in_batches, around, "a bigint, b bigint").repartition("a").sortWithinPartitions("a", "b")
        found = found.unionByName(halfway.transform(in_batches, first_of_run, "a bigint, b bigint"))
    return found.distinct()


def groups(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """``prints`` (doc_id, text_key, fp) with component_id, the group's smallest id,
    and whether the row's (doc_id, text_key) is the group's first."""
    prints = written(prints, "prints")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = written(prints.groupBy("fp").agg(F.min(one).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    label = components(links(distinct, tau))
    own = written(distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "own")
    firsts = own.groupBy("root").agg(F.min("first").alias("best"))
    named = written(own.join(firsts, "root").select("fp", "n", "best"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    joined = keyed_join(prints, named, "fp", [F.monotonically_increasing_id()], total)
    return joined.select(
        "doc_id",
        "text_key",
        "fp",
        F.col("best.doc_id").alias("component_id"),
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key"))).alias("is_first"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tau: int = TAU) -> DataFrame:
    """The documents without near copies: one row of each group, with all its columns.

    Texts are shuffled once, by two hashes of id and text together; the join keeps
    that layout for the removal of repeated rows.
    """
    first = groups(fingerprints(docs, id_col, text_col, words), tau).where("is_first").select("doc_id", "text_key").distinct()

    def keys(doc_id, text_key):
        return F.xxhash64(doc_id, doc_id.isNull(), text_key), F.xxhash64(text_key, F.lit(1), doc_id)

    names = [fresh(docs, "key_a"), fresh(docs, "key_b")]
    mine = keys(F.col(id_col).cast("bigint"), F.xxhash64(text_col))
    first = first.select(*(k.alias(name) for k, name in zip(keys(F.col("doc_id"), F.col("text_key")), names)))
    joined = docs.withColumns(dict(zip(names, mine))).join(first, names, "left_semi")
    return joined.dropDuplicates(names).drop(*names)
