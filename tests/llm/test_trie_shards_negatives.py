"""Prefix trie, shards and hard negatives against plain versions of themselves."""

import collections
import hashlib
import heapq
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.llm import negatives, queries, scans, shards, trie
from topicspark.llm.common import table
from topicspark.session import scratch_path


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for conv in turns:
        family, h = conv - int(np.fmod(conv, 100)), zlib.crc32(str(conv).encode()) % 6
        whole = tuple(turns.get(family, [])[:h] + turns[conv][h:])
        for depth in range(len(whole) + 1):
            members[whole[:depth]].append(conv)
        ends[whole].append(conv)
    out = []
    for node, convs in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        children = [n for n in subtree if len(n) == len(node) + 1]
        leaves = [n for n in subtree if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in subtree)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, sha(",".join(map(str, sorted(ends[node]))))))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(df):
    return sorted((tuple(r) for r in trie.trie(df).select(*COLUMNS).collect()), key=str)


SAID = "conv_id bigint, turn bigint, role string, text string, node string, depth int, a bigint, _part int"


def conversations(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(None, 0, "user", "x"), (-7, 0, "user", "negative"), (-7, 0, "user", "negative"), (500, None, None, None), (501, None, "user", ""), (502, 3, "a", "é😀")]
    for conv in [*range(0, 30), *range(100, 130), *range(205, 215), 4099, 8200, 12300]:
        for turn in range(int(rng.integers(1, 9))):
            same = rng.random() < 0.6
            text = "hello there" if turn == 0 and same else f"text {rng.integers(0, 3 if same else 50)}"
            rows.append((conv, None if rng.random() < 0.05 else turn, ["user", "assistant", None][int(rng.integers(0, 3)) if not same else turn % 2], text))
    rows += [(50, k, "user", "the same long talk") for k in range(700)] + [(60, k, "user", "the same long talk") for k in range(600)]
    return rows


@pytest.mark.parametrize("cells", [None, 8])
def test_trie_against_a_plain_one(spark, monkeypatch, cells):
    if cells:  # a sketch too small to prove anything
        monkeypatch.setattr(trie, "CELLS", 1 << cells)
        monkeypatch.setattr(trie, "LEAST_CELLS", 1 << cells)
        monkeypatch.setattr(trie, "SLICE", 1 << cells)
    rows = conversations(spark, 1)
    df = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], SAID).repartition(3)
    assert found_trie(df) == plain_trie(rows)


def test_trie_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "tasks", lambda df: 23)
    monkeypatch.setattr(trie, "CHUNK", 50)
    rows = conversations(spark, 2)
    assert found_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")) == plain_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert found_trie(spark.createDataFrame([], schema)) == []
    for one in ([(3, 0, "user", "a")], [(3, None, None, None)], [(None, 1, "user", "a"), (5, 1, "user", "b")]):
        assert found_trie(spark.createDataFrame(one, schema)) == plain_trie(one)


def test_most_tails_stay_where_they_are(spark, sf_dir):
    rows = trie.screened(trie.prefixes(table(spark, sf_dir, "conversations")))
    groups = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("tail").alias("tail"))
    assert groups.where("n > 1 and tail > 0").count() == 0
    alone = groups.where("n = 1")
    assert alone.where("tail = 0").count() <= 0.1 * alone.count() + 1


def test_running_sums(spark):
    rng = np.random.default_rng(5)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 500), np.full(400, 17)]))
    values = rng.integers(-(1 << 62), 1 << 62, len(keys))
    df = spark.createDataFrame([(int(k), at, int(v)) for at, (k, v) in enumerate(zip(keys, values))], "k bigint, at bigint, v bigint")
    found = scans.running_sums(scans.ordered(df, 9, F.col("k"), F.col("at")), "k", ["v"], last="ends").orderBy("at").collect()
    assert [r["v"] for r in found] == scans.within(keys, values).tolist()
    assert all(r["v_before"] == np.int64(a) for r, a in zip(found, scans.within(keys, values) - values))
    assert [r["ends"] for r in found] == [*(keys[1:] != keys[:-1]), True]


def plain_schedule(sizes, k):
    heap, loads = [(0, s) for s in range(k)], [0] * k
    for size in sorted(sizes, reverse=True):
        load, shard = heapq.heappop(heap)
        loads[shard] += size
        heapq.heappush(heap, (load + size, shard))
    return loads


def test_dealing_many_is_dealing_one_by_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        k = int(rng.integers(1, 9))
        heap = [(0, s) for s in range(k)]
        sizes = sorted({int(s) for s in rng.integers(1, 3000, 12)}, reverse=True)
        counts = [int(c) for c in rng.choice([1, 2, 63, 65, 900], len(sizes))]
        given = [shards.deal(size, n, heap) for size, n in zip(sizes, counts)]
        assert [sum(g) for g in given] == counts
        loads = [sum(s * g[shard] for s, g in zip(sizes, given)) for shard in range(k)]
        assert loads == plain_schedule([s for s, n in zip(sizes, counts) for _ in range(n)], k)


TEXTS = [None, "", "a", "a", "é", "b" * 400, "b" * 400, "hot", *(f"text {k % 90}" * (k % 7 + 1) for k in range(300)), *["hot"] * 200]


def test_shards(spark):
    docs = spark.createDataFrame([(k if k % 11 else None, t, k, 1, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, size int, shard int, digest string")
    found = shards.assign(docs, 8, docs.columns).collect()
    assert sorted(r["document"]["size"] for r in found) == list(range(len(TEXTS)))
    by_text, loads = collections.defaultdict(set), [0] * 8
    for r in found:
        text = r["document"]["text"] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        by_text[text].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    groups = collections.Counter((t or "") for t in TEXTS)
    assert loads == plain_schedule([(len(t.encode()) + 1) * n for t, n in groups.items()], 8)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.assign(docs.where("false")).collect() == []
    same = spark.createDataFrame([(1, "same")] * 50, "doc_id bigint, text string")
    assert sorted(r["slot"] for r in shards.assign(same).collect()) == list(range(50))


def test_hot_texts_are_dealt_over_tasks(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k}") for k in range(6000)]
    found = shards.assign(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == 6000 and len({r["shard"] for r in found if r["document"]["doc_id"] % 3 == 0}) == 1


def test_written_shards(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    path = scratch_path(spark, "shards")
    shards.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert sorted((r["document"]["doc_id"], r["document"]["text"]) for r in back.collect()) == list(enumerate(TEXTS))
    want = {r["document"]["doc_id"]: (r["shard"], r["slot"]) for r in shards.assign(docs, 4).collect()}
    assert {r["document"]["doc_id"]: (r["shard"], r["slot"]) for r in back.collect()} == want


def plain_negatives(rows, every=100):
    fit = []
    for at, (vec_id, label, x) in enumerate(rows):
        if vec_id is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            label = (label + 1) % 10 if vec_id % 7 == 0 else label
            fit.append((at, vec_id, label, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x]))
    out = []
    for at, vec_id, label, x in fit:
        if vec_id % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, r, other == label) for r, v, other, y in fit if r != at)
        for p, positive, _, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(vec_id, positive, k, s[1], -p, -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, label int, embedding array<float>, row int, anchor string, x array<int>"


def found_negatives(spark, rows):
    df = spark.createDataFrame([(v, label, x, 1, "a", [1]) for v, label, x in rows], VECTORS).repartition(5)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mine(negatives.quantise(df, moved), F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("block", [None, 2])
def test_negatives_against_a_plain_search(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8 * 6 * block)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 70)
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.integers(0, 3)), [float(v) for v in rng.normal(0, 1, 6)]) for k in range(600)]
    rows += [(k, 1, [float(v) for v in np.round(rng.normal(0, 1, 6))]) for k in range(600, 800)]  # ties
    rows += [(100, 2, rows[100][2]), (100, 2, rows[100][2])] + [(900, 1, [0.0] * 6)] + [(1000 + k, 5, [1.0] * 6) for k in range(0, 300, 50)]
    odd = [(None, 1, [1.0] * 6), (5, None, [1.0] * 6), (6, 1, None), (7, 1, [1.0, None, 0.0]), (8, 1, [float("nan")] * 6), (1100, 1, [float("inf")] * 6), (9, 1, []), (1200, 2, []), (10, 4, [2.0, 2.0])]
    assert found_negatives(spark, rows + odd) == plain_negatives(rows + odd)


def test_negatives_of_nothing(spark):
    assert found_negatives(spark, []) == []
    assert found_negatives(spark, [(100, 1, [])]) == []


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(0, 1, (4000, 3)))
    ids = np.arange(4000)
    lists = negatives.Lists(x, ids % 4, ids, ids)
    for anchor in x[:20]:
        best = negatives.Best(5, *negatives._ALL)
        depth = lists.search(anchor, lambda at: at >= 0, [best])
        scores = (x @ anchor).astype(int)
        assert best.vec_id.tolist() == sorted(ids, key=lambda k: (-scores[k], k))[:5]
        assert depth < 4000


def test_contract_columns(spark, sf_dir):
    types = {
        "op11_prefix_trie": {c: "bigint" for c in COLUMNS[:-1]} | {"ends_sha256": "string"},
        "op12_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    }
    for name, want in types.items():
        assert dict(queries.QUERIES[name](spark, sf_dir).dtypes) == want
