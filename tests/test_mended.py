"""Cases that once went wrong: keys of other types, repeated keys, nothing to do."""

import math

from pyspark.sql import functions as F

from topicspark.operators import labels as L
from topicspark.operators import language as G
from topicspark.operators import metrics as A
from topicspark.operators import mining as K
from topicspark.operators import split as M
from topicspark.plans import dataset as D
from topicspark.plans import ordering as O
from topicspark.session import scratch_path
from topicspark.sources import stores
from topicspark.sources import tables as T
from topicspark.sources import pages as Pages
from topicspark.streaming import detection as R


def test_string_keys(spark, monkeypatch):
    rows = spark.range(700).select(F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("doc_id"))
    assert M.random_split(rows, 0.3).where("split = 'test'").count() == 210
    assert M.fraction_sample(rows, 0.1).count() == 70
    heads = {r["doc_id"] for r in M.head_tail_split(rows, 0.5, shuffle=False).where("split = 'test'").collect()}
    assert heads == {f"key-{k:05}" for k in range(350)}
    window = sorted(int(r["doc_id"][4:]) for r in M.sample_window(rows, 20).collect())
    assert window == list(range(window[0], window[0] + 20))
    monkeypatch.setattr(O, "DIRECT_ROWS", 3)  # equal first bytes: found by the keys themselves
    cut = O.order_cut(rows, O.order_value(rows, "doc_id"), F.col("doc_id"), 500)
    assert cut[1] == "key-00499"


def test_ranks_of_string_keys_with_one_prefix(spark, monkeypatch):
    keys = [f"https://host.example/{k:05}" for k in range(2000)] + ["same"] * 50 + ["a", "a\0", "a\0\0", "", "é" * 9, "é" * 8]
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id string").repartition(3)
    monkeypatch.setattr(O, "DIRECT_ROWS", 3)
    monkeypatch.setattr(type(rows), "toLocalIterator", None)  # no key is walked through the driver
    order = sorted(keys, key=lambda k: k.encode())
    for k in (1, 2, 3, 4, 5, 700, 1999, 2004, 2006, 2030, 2054, len(keys) - 1, len(keys)):
        assert O.order_cut(rows, O.order_value(rows, "doc_id"), F.col("doc_id"), k)[1] == order[k - 1], k
        assert O.order_cut(rows, F.lit(7), F.col("doc_id"), k)[1] == order[k - 1]
    assert O.order_cut(rows, F.lit(7), F.col("doc_id"), len(keys) + 1) is None


def test_repeated_request_keys(spark, sf_dir):
    train = spark.createDataFrame(
        [(k, text, lang) for k, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 4)],
        "doc_id bigint, text string, lang string",
    )
    model = G.train_language_model(train)
    asked = spark.createDataFrame(
        [(1, None, "t", "the dog and the cat", "the dog and the cat"), (1, None, "t", "le chien et le chat", "le chien et le chat")],
        "doc_id bigint, url string, title string, description string, fulltext string",
    )
    found = R.detect_language(asked, R.Resources(language=model)).collect()
    assert sorted((r["doc_id"], r["language"]) for r in found) == [(1, "en"), (1, "fr")]
    assert R.detect(asked, R.Resources(language=model)).count() == 2


def test_stream_without_records(spark, sf_dir, tmp_path):
    stream = R.document_stream(spark, sf_dir, "no-such-file.parquet")
    got = R.run_available(stream, lambda batch: batch.select("doc_id"), scratch_path(spark, "none"), scratch_path(spark, "none-state"))
    assert got.columns == ["doc_id"] and not got.collect()


def test_version_written_twice(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "doc_id bigint, split string")
    classes = spark.createDataFrame([(0, "a")], "idx int, label string")
    home = scratch_path(spark, "dump")
    for _ in range(2):
        stores.dataset_dump(rows, classes, home, "v1")
    stores.dataset_dump(rows, classes, home, "v2")
    data, names = stores.read_dump(spark, home, "v1")
    assert data.count() == 2 and names.count() == 1


def test_report_without_positives(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 0)], "doc_id bigint, label string, y int, p int")
    report = {r["label"]: r for r in A.label_report(rows).collect()}
    assert report["weighted avg"]["f1"] == 0.0 and report["a"]["support"] == 0


def test_report_reads_its_rows_once(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, 1), (1, "b", 0, 1), (2, "a", 1, 0), (2, "macro avg", 1, 1), (3, None, 1, 1)], "doc_id bigint, label string, y int, p int"
    )
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    report = A.label_report(spark.read.parquet(path))
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    found = sorted(((r["label"], round(r["precision"], 4), round(r["recall"], 4), round(r["f1"], 4), r["support"]) for r in report.collect()), key=str)
    assert found == sorted([
        ("a", 1.0, 0.5, 0.6667, 2), ("b", 0.0, 0.0, 0.0, 0), ("macro avg", 1.0, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 1),
        ("micro avg", 0.75, 0.75, 0.75, 4), ("macro avg", 0.75, 0.625, 0.6667, 4), ("weighted avg", 1.0, 0.75, 0.8333, 4),
        ("samples avg", 0.8333, 0.8333, 0.7778, 4),
    ], key=str)
    empty = A.label_report(rows.where("false")).collect()
    assert sorted(r["label"] for r in empty) == ["macro avg", "micro avg", "samples avg", "weighted avg"] and not any(r["f1"] or r["support"] for r in empty)


def test_wide_targets_equal_narrow_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["c"])], "doc_id bigint, labels array<string>")
    narrow, names = D.with_targets(rows)
    monkeypatch.setattr(D, "DENSE_CLASSES", 1)
    wide, same = D.with_targets(rows)
    assert names == same and wide.columns == narrow.columns
    assert sorted(tuple(r) for r in wide.collect()) == sorted(tuple(r) for r in narrow.collect())


def test_long_label_lists_keep_columns(spark, monkeypatch):
    rows = spark.createDataFrame([("x", ["a", "b"], 1), ("y", ["b"], 2)], "title string, labels array<string>, doc_id bigint")
    kept = spark.createDataFrame([("b",)], "label string")
    narrow = L.keep_labels(rows, kept)
    monkeypatch.setattr("topicspark.plans.lookups.LITERAL_BOUND", 0)
    wide = L.keep_labels(rows, kept)
    assert wide.columns == narrow.columns == rows.columns
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))


def test_every_record_is_answered(spark):
    rows = spark.createDataFrame([(1, "alone"), (2, ""), (3, None), (4, "some words here with some other words")], "doc_id bigint, text string")
    assert {r["doc_id"]: len(r["keywords"]) for r in K.keywords(rows, "text").collect()}.keys() == {1, 2, 3, 4}
    labelled = spark.createDataFrame([(k, ["a"] if k % 2 else []) for k in range(20)], "doc_id bigint, labels array<string>")
    assert M.stratified_split(labelled, 0.3).groupBy("stratum", "split").count().count() == 4
    chinese = spark.createDataFrame([(1, "第一句话。第二句话！第三句话？", "第二")], "doc_id bigint, text string, title string")
    assert chinese.select(F.size(K.sentences(F.col("text"))).alias("n")).first()["n"] == 3


def test_labels_come_from_the_whole_text(spark):
    text = "alpha " + "filler" + " x" * 400 + " omega omega alpha"
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert rows.select(T.repeated_words(F.col("text")).alias("w")).first()["w"] == ["alpha", "omega"]


REQUEST = "doc_id bigint, url string, title string, description string, fulltext string"


def test_page_store_opens_only_what_is_asked(spark):
    html = [(k, f"http://h/{k % 90}", f"<h1>t{k}</h1><p>{'words of page ' * 12}{k}.</p>") for k in range(100)]
    pages = spark.createDataFrame(html, "page_id bigint, url string, html string").withColumn("url_md5", F.md5("url"))
    path = scratch_path(spark, "pages")
    Pages.write_page_store(pages, path, 16)
    store = Pages.PageStore.open(spark, path, 16)
    assert store.pages.count() == 90
    asked = spark.createDataFrame([(1, "http://h/7"), (2, "http://h/7"), (3, "http://none"), (4, None)], "doc_id bigint, url string")
    found = store.asked(asked.where("url is not null").select(F.md5("url").alias("url_md5")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "In(url_md5" in plan.split("PushedFilters")[1] or "EqualTo(url_md5" in plan.split("PushedFilters")[1]
    assert len(found.inputFiles()) <= 16
    for source in (pages, store):
        got = {r["doc_id"]: r["html"] for r in Pages.page_lookup(asked, source).collect()}
        assert got == {1: html[7][2], 2: html[7][2], 3: "", 4: ""}
        records = asked.withColumn("description", F.lit("d"))
        full = {r["doc_id"]: r["fulltext"] for r in Pages.enrich_fulltext(records, source).collect()}
        assert full[1].endswith("7.") and full[3] == full[4] == "d"


def test_repeated_keys_by_url(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<body><h1>title {k}</h1><p>Text number {k} is here.</p>") for k in (1, 2)], "page_id bigint, url string, html string")
    asked = spark.createDataFrame([(5, "http://h/1", None, None, None), (5, "http://h/2", None, None, None)], REQUEST)
    found = R.resolve(asked, pages.withColumn("url_md5", F.md5("url"))).collect()
    assert sorted((r["doc_id"], r["title"], r["description"]) for r in found) == [
        (5, "title 1", "Text number 1 is here."), (5, "title 2", "Text number 2 is here."),
    ]


class _Marker:
    """A model that answers with the first words of what it is given."""

    def apply(self, df, text):
        return df.withColumn("predicted", F.array(F.substring(text, 1, 12)))


def test_feed_scores_a_record_once(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), scratch_path(spark, "scored"), scratch_path(spark, "state")
    schema = "doc_id bigint, url string, title string, description string, fulltext string"
    long = "some text of a record " * 20

    def send(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return sorted((r["doc_id"], r["predicted"][0]) for r in R.feed_scoring(stream, _Marker(), out, state).collect())

    first = send([(1, None, "a", long, long), (2, None, "b", long, long), (3, None, "c", "short", "short")])
    assert first == [(1, "a. some text"), (2, "b. some text")]
    again = send([(1, None, "a", long, long), (2, None, "changed", long, long)])  # a new query on the same state: a restart
    assert again == [(1, "a. some text"), (2, "b. some text"), (2, "changed. som")]


def test_full_detection_has_model_and_dictionary_tags(spark, sf_dir):
    from topicspark.registry import streams

    found = streams.QUERIES["stream_detect_model"](spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all((r["tags"] is None) == (not r["valid"]) for r in found) and any(r["tags"] for r in found)


def test_hits_leave_a_task_in_small_batches(spark, monkeypatch):
    """Memory of a task follows the texts of a slice, not the hits of a whole batch."""
    from topicspark.operators import grams, matching

    ran, seen, searched = [], [], matching.Patterns.search
    monkeypatch.setattr(grams, "SLICE", 100)
    monkeypatch.setattr(matching.Patterns, "search", lambda self, texts: seen.append(len(texts)) or searched(self, texts))
    monkeypatch.setattr(matching, "in_batches", lambda df, of, schema: ran.append(of) or df.mapInArrow(of, schema))
    df = spark.createDataFrame([(k, "abcabc" * 5) for k in range(20)], "doc_id bigint, text string")
    pairs = spark.createDataFrame([("abc", "x"), ("bca", "y"), ("é\U0001f600", "z")], "entry string, target string")
    matching.search_lists(df, "doc_id", df.text, pairs)
    (batch,) = df.toArrow().combine_chunks().to_batches()
    out = list(ran[0](iter([batch])))
    assert max(seen) <= 3 and sum(seen) == 20 and [b.num_rows for b in out] == seen
    assert all(r["found"] == [{"target": "x", "n": 10}, {"target": "y", "n": 9}] for b in out for r in b.to_pylist())


def test_a_dataset_cuts_labels_once_and_stores_the_columns_asked_for(spark, sf_dir, monkeypatch):
    from topicspark.plans import dataset as D
    from topicspark.registry import models
    from topicspark.sources import tables as T

    kept, whole = [], models.stored
    monkeypatch.setattr(models, "stored", lambda df: kept.append(df) or whole(df))
    rows, classes = models.dataset(spark, sf_dir, 5, ["title"])
    (df,) = kept
    assert df.columns == ["doc_id", "title", "labels"] and df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # later passes read the labels stored
    old, names = D.with_targets(D.build_dataset(T.infos(spark, sf_dir), language="en", filter_tags_threshold=5, concat_title=True))
    assert classes == names and sorted(map(str, rows.select("doc_id", "title", "labels").collect())) == sorted(map(str, old.select("doc_id", "title", "labels").collect()))


def test_tfidf_of_rare_terms_moves_few_rows(spark, monkeypatch):
    from topicspark.operators import tfidf as I
    from topicspark.plans import lookups

    rows = [(k, f"all some{k % 3} rare{k // 2} own{k} own{k}") for k in range(30)] + [(30, None), (31, ""), (32, "all"), (0, "rare0 all")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def found():
        return {(r["doc_id"], r["term"]): round(r["tfidf"], 9) for r in I.tfidf(df, "text", 0.8).collect()}

    whole = found()
    assert not any(t == "all" for _, t in whole) and len(whole) == 90
    n, by_key = len(rows), {}
    for k, text in rows:
        by_key[k] = by_key.get(k, []) + (text or "").split()
    seen = [set((text or "").split()) for _, text in rows]
    weight = {(k, t): ws.count(t) * (math.log((1 + n) / (1 + sum(t in s for s in seen))) + 1) for k, ws in by_key.items() for t in set(ws) if t != "all"}
    norm = {k: math.sqrt(sum(w * w for (j, _), w in weight.items() if j == k)) for k in by_key}
    assert whole == {(k, t): round(w / norm[k], 9) for (k, t), w in weight.items()}
    shuffled = []
    for bound in (0, 1, 4, 20):  # some of the terms are broadcast, or none
        monkeypatch.setattr(lookups, "BROADCAST_ROWS", bound)
        assert found() == whole
        shuffled.append(I._frequent(I.each(df, I.F.array_distinct(I.X.words(I.F.col("text"))), "term").groupBy("term").agg(I.F.count("*").alias("df"))))
    assert shuffled == [None, 32, 8, 2]
    assert "_salt" not in I.tfidf(df, "text")._jdf.queryExecution().toString()


def test_keywords_stay_in_their_text(spark):
    rows = spark.createDataFrame([(1, "apple berry apple"), (1, "cherry dates cherry"), (2, "berry"), (None, "apple berry"), (3, "Zebra äpfel zebra apple")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["keywords"] for r in K.keywords(rows, "text").collect()}
    assert found == {1: ["apple", "berry", "cherry", "dates"], 2: [], None: [], 3: ["apple", "zebra", "äpfel"]}
    one = K.keywords(rows.where("doc_id > 1"), "text", unique=True)
    assert {r["doc_id"]: r["keywords"] for r in one.collect()} == {2: [], 3: ["apple", "zebra", "äpfel"]}
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_dictionary_and_model_read_texts_apart(spark):
    from topicspark.operators import matching as J
    from topicspark.streaming import detection as S

    class Model:
        def apply(self, rows, text):
            return rows.mapInArrow(lambda batches: batches, rows.schema).withColumn("predicted", F.array(F.lit("m")))

    texts = spark.createDataFrame([(1, "a long phrase here", "t")], "doc_id bigint, text string, title string")
    entries = J.prepare_dictionary(spark.createDataFrame([("long phrase", "long-phrase")], "label string, tagID string"))
    tagged = S._tagged(texts, S.Resources(model=Model(), dictionary=entries), False)
    assert tagged.first()["tags"] == ["long-phrase", "m"]
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one for the model, one for the dictionary
