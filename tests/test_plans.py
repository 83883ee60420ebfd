"""Ordinals, cut points and the two ways of a dimension join."""

import random

import pytest
from pyspark.sql import functions as F

from topicspark.operators import labels as L
from topicspark.operators import matching as J
from topicspark.operators import split as M
from topicspark.plans import lookups, ordering


def test_order_cut_with_hot_values(spark, monkeypatch):
    monkeypatch.setattr(ordering, "DIRECT_ROWS", 20)
    monkeypatch.setattr(ordering, "CELLS", 8)
    rng = random.Random(3)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(10_000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "v bigint, k bigint").repartition(7)
    want = sorted(rows)
    for k in (1, 2, 150, 300, 599, 600):
        assert ordering.order_cut(df, F.col("v"), F.col("k"), k) == want[k - 1]
    assert ordering.order_cut(df, F.col("v"), F.col("k"), 0) is None


@pytest.mark.parametrize("parts", [1, 5])
def test_with_ordinal(spark, parts):
    rows = [(i * 7 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "v bigint, k bigint").repartition(parts)
    out = ordering.with_ordinal(df, F.desc("v"), F.col("k")).collect()
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert {(r["v"], r["k"]): r["ordinal"] for r in out} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_beyond_bound(spark, monkeypatch, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 5}") for i in range(200)], "i bigint, k string")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, v int")
    columns = ["i", "k"] if how in ("left_semi", "left_anti") else ["i", "k", "v"]

    def run():
        return sorted(map(str, lookups.lookup_join(big, dim, ["k"], how).select(columns).collect()))

    small = run()
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert run() == small


def test_keep_labels_both_ways(spark, monkeypatch):
    rows = [(1, ["a", "b", "c"]), (2, ["c"]), (3, ["b", "a"]), (4, []), (5, ["d", "b"])]
    df = spark.createDataFrame(rows, "doc_id bigint, labels array<string>")
    want = [(1, ["a", "b"]), (3, ["b", "a"]), (5, ["b"])]  # c twice, d once

    def run():
        out = L.filter_rare_labels(df.where("doc_id <> 2"), 1).select("doc_id", "labels").collect()
        return sorted((r["doc_id"], r["labels"]) for r in out)

    assert run() == want
    monkeypatch.setattr(lookups, "LITERAL_BOUND", 1)
    assert run() == want
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert run() == want


def test_filter_rare_threshold_off(spark):
    df = spark.createDataFrame([(1, ["a"])], "doc_id bigint, labels array<string>")
    assert L.filter_rare_labels(df, 0) is df


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, [f"l{i % 3}", "common"]) for i in range(200)], "doc_id bigint, labels array<string>")

    def of(fn, parts):
        return sorted(map(str, fn(df.repartition(parts)).select("doc_id", "split").collect()))

    for fn in (lambda d: M.random_split(d, 0.3), lambda d: M.stratified_split(d, 0.3), lambda d: M.head_tail_split(d, 0.2, False)):
        assert of(fn, 1) == of(fn, 17)
    assert M.random_split(df, 0.3).where("split = 'test'").count() == 60
    strata = M.stratified_split(df, 0.3).groupBy("stratum", "split").count().collect()
    sizes = {(r["stratum"], r["split"]): r["count"] for r in strata}
    assert sizes["l0", "test"] == 20 and sizes["l1", "test"] == 20 and sizes["l2", "test"] == 20


def test_augment_levels_and_custom_method(spark):
    text = " ".join(str(i) for i in range(30))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, description string")
    out = {r["copy"]: r["description"] for r in M.augment_crop(df, level=3, crop_ratio=0.2).collect()}
    assert out[0] == text and len(out) == 4
    for copy in (1, 2, 3):
        words = out[copy].split(" ")
        off = int(words[0])
        assert 0 <= off <= 6 and words == [str(i) for i in range(off, 30 - off - 1)]
    upper = M.augment_crop(df.withColumn("description", F.lit("a")), level=1, aug_method=F.upper).collect()
    assert sorted(r["description"] for r in upper) == ["A", "a"]
    rows, n_test = M.split_then_augment(df, level=2, test_ratio=0.0)
    assert n_test == 0 and rows.count() == 3


def test_phrase_and_entities(spark, monkeypatch):
    tags = spark.createDataFrame(
        [("Machine Learning", "machine-learning"), ("Go", "golang"), ("machine-learning", "ml-canonical")],
        "label string, tagID string",
    )
    docs = spark.createDataFrame(
        [(1, "About Machine Learning, and machine learning."), (2, "Go go"), (3, "")], "doc_id bigint, text string"
    )
    for chars in (2_000_000, 20):  # one shard, several
        monkeypatch.setattr(J, "SHARD_CHARS", chars)
        dictionary = J.prepare_dictionary(tags)
        found = {(r["doc_id"], r["tagID"]): r["n"] for r in J.phrase_match(docs, dictionary, F.col("text")).collect()}
        assert found == {(1, "machine-learning"): 2, (2, "golang"): 2}
        rows = docs.withColumn("tags", F.array(F.lit("x")))
        tagged = {r["doc_id"]: r["tags"] for r in J.entity_tags(rows, dictionary, F.col("text")).collect()}
        assert tagged == {1: ["ml-canonical", "x"], 2: ["x"], 3: ["x"]}


def test_substring_match_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["ab", "abcdefgh", "abcdefghij", "abcdefghijk", "é", "xyz xyz xyz", "😀😀", "Long label name"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(40)] + ["ab ,.!?abcdefgh", "ab"]
    labels = [("ab", "t1"), ("abcdefgh", "t2"), ("abcdefghijk", "t3"), ("Long label name", "t4")]
    mapped = [("é", "m1"), ("😀", "m2"), ("yz x", "m3"), ("abcdefghi", "m4")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tag_list = spark.createDataFrame([(b, a) for a, b in labels], "tagID string, label string")
    tag_map = spark.createDataFrame(mapped, "label string, tagID string")
    want = set()
    for i, text in enumerate(texts):
        segments = text.split(" ,.!?")[:20]
        want |= {(i, t) for label, t in labels if label in segments or (len(label) > 9 and label in text)}
        want |= {(i, t) for label, t in mapped if label in text}

    def run():
        return {(r["doc_id"], r["tagID"]) for r in J.substring_match(docs, tag_list, tag_map, "text").collect()}

    assert run() == want
    monkeypatch.setattr(J, "SHARD_CHARS", 8)
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", 0)
    assert run() == want


def test_search_finds_every_occurrence(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab😀 ", k=rng.randrange(30))) for _ in range(60)] + [None, ""]
    entries = {"".join(rng.choices("ab😀 ", k=rng.randrange(1, 5))) for _ in range(40)}
    docs = spark.createDataFrame([(str(k), t, 1) for k, t in enumerate(texts)], "id string, text string, n int").repartition(3)
    words = spark.createDataFrame([(e,) for e in entries] * 2 + [("",), (None,)], "entry string")
    want = {(str(k), e): n for k, t in enumerate(texts) for e in entries if (n := sum((t or "").startswith(e, i) for i in range(len(t or ""))))}
    for chars in (1_000_000, 11):
        monkeypatch.setattr(J, "SHARD_CHARS", chars)
        found = J.search(docs, "id", F.col("text"), words).collect()
        assert {(r["id"], r["entry"]): r["n"] for r in found} == want and len(found) == len(want)
    assert J.search(docs, "id", F.col("text"), words.where("false")).collect() == []
    whole = J.search(docs, "id", F.col("text"), words, edge="a").collect()
    assert all(f"a{r['entry']}a" in f"a{texts[int(r['id'])]}a" for r in whole)


def test_topn_and_threshold_bounds(spark):
    rows = [(d, f"l{i}", i / 10) for d in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string, proba double")
    assert {r["count"] for r in L.topn_labels(df, 2).groupBy("doc_id").count().collect()} == {2}
    few = L.threshold_labels(df, 5, 0.55).groupBy("doc_id").count().collect()
    assert {r["count"] for r in few} == {2}
    assert L.threshold_labels(df, 5, 0.99).count() == 3
    assert L.threshold_labels(df, 5, 0.99, at_least_one=False).count() == 0


def test_a_large_dictionary_is_one_pass(spark, monkeypatch):
    """Texts are read once for 250,000 entries (2.5 million characters)."""
    monkeypatch.setattr(J, "scratch_path", None)  # there would be a table of hits for each shard
    entries = spark.range(250_000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("entry"))
    docs = spark.createDataFrame([(1, "xw000000007w000249999 w000250000"), (2, None), (1, "w000000007w000000007")], "id bigint, text string")
    found = J.search(docs, "id", F.col("text"), entries)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "w000000007", 1), (1, "w000000007", 2), (1, "w000249999", 1)]


def test_phrases_of_records_with_one_key_are_summed(spark):
    dictionary = J.prepare_dictionary(spark.createDataFrame([("Go", "golang"), ("Rust", "golang")], "label string, tagID string"))
    docs = spark.createDataFrame([(1, "Go Rust x"), (1, "Go"), (2, "go")], "doc_id bigint, text string")
    found = J.phrase_match(docs, dictionary, F.col("text")).collect()
    assert sorted(tuple(r) for r in found) == [(1, "golang", 3), (2, "golang", 1)]


def test_patterns_with_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    from topicspark.operators import patterns as Q

    monkeypatch.setattr(Q, "_mixed", lambda h: h & Q.np.uint64(3))  # nearly all hashes agree
    words = ["abcd", "abce", "bcde", "a", "b", "abcdeabcdeabcde"]
    texts = ["abcdeabcdeabcdeabce", None, "", "zabceb"]
    at, target, n = Q.Patterns(pa.array(words), pa.array(words)).search(texts)
    got = {(a, words[t]): c for a, t, c in zip(at.tolist(), target.tolist(), n.tolist())}
    assert got == {(k, w): c for k, t in enumerate(texts) for w in words if (c := sum((t or "").startswith(w, i) for i in range(len(t or ""))))}
