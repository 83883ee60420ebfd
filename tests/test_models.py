"""Properties of trained models and of streams."""

import glob
import math
import os
import shutil
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from topicspark.functions import text as X
from topicspark.operators import grams as W
from topicspark.operators import labels as L
from topicspark.operators import language as G
from topicspark.operators import linear as A
from topicspark.operators import models as N
from topicspark.operators import split as M
from topicspark.registry import models as R
from topicspark.session import scratch_path
from topicspark.sources import tables as T
from topicspark.streaming import detection as S


@pytest.mark.parametrize("penalty", ["l1", "l2"])
def test_tag_model_round_trip(spark, sf_dir, penalty):
    rows, classes = R.dataset(spark, sf_dir, 5)
    rows = rows.select("doc_id", "fulltext", "labels")
    model = N.TagEstimator(classes, penalty=penalty, c=10.0).fit(rows)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = N.LabelModel.load(path)
    assert loaded.classes == classes and loaded.text == "fulltext"
    a = {r["doc_id"]: r["predicted"] for r in model.transform(rows).collect()}
    b = {r["doc_id"]: r["predicted"] for r in loaded.transform(rows.repartition(5)).collect()}
    assert a == b and {x for p in a.values() for x in p} <= set(classes)
    truth = {r["doc_id"]: set(r["labels"]) for r in rows.collect()}
    hits = sum(len(truth[d] & set(p)) for d, p in a.items())
    assert hits / max(1, sum(map(len, a.values()))) > 0.9  # fits its own training rows
    odd = spark.createDataFrame([(1, None, None), (2, "", []), (3, "no known term", ["x"])], "doc_id bigint, fulltext string, labels array<string>")
    assert model.transform(odd).count() == 3 and model.transform(odd.where("false")).collect() == []
    table = model.weights(spark)
    assert {r["label"] for r in table.select("label").distinct().collect()} <= set(classes)


def test_scores_follow_the_coefficients(spark, sf_dir):
    """Margins through the fit rows equal those of the table of coefficients."""
    rows, classes = R.dataset(spark, sf_dir, 8)
    model = N.train_tag_model(rows, classes, c=10.0)
    f = model.fitted
    weight = np.zeros((len(f.keys), len(classes)))
    for r in model.weights(spark).collect():
        weight[np.searchsorted(f.keys, r["term"]), classes.index(r["label"])] = r["weight"]
    dense = np.zeros((f.x.n, len(f.keys)))
    dense[f.x.row, f.x.col] = f.x.val
    assert np.allclose(dense @ weight + f.weights.sum(0), f.margins(f.x))


def test_tfidf_weights(spark):
    df = spark.createDataFrame([(1, "aa aa bb", []), (2, "bb cc", []), (3, "dd", []), (4, None, [])], "doc_id bigint, text string, labels array<string>")
    rows = N.corpus(df, [], "text", "labels", (1, 2))
    x = rows.features((1, 1), rows.scale(1.0, None))
    by_row = {tuple(sorted(np.round(x.val[x.row == r], 9))) for r in range(4)}

    def idf(n):
        return math.log(5 / (1 + n)) + 1

    def unit(*values):
        norm = math.hypot(*values)
        return tuple(sorted(round(v / norm, 9) for v in values))

    assert by_row == {unit(2 * idf(1), idf(2)), unit(idf(2), idf(1)), (1.0,), ()}
    kept = rows.features((1, 1), rows.scale(0.25, None))
    assert len(kept.val) == 3 and len(rows.keys) == 4 + 3


def test_counts_cover_all_rows_and_folds_are_subtracted(spark):
    words = [f"w{k % 7} x{k % 3}" for k in range(90)]
    df = spark.createDataFrame([(k, w, ["a"] if k % 2 else []) for k, w in enumerate(words)], "doc_id bigint, text string, labels array<string>")
    rows = N.corpus(df, ["a"], "text", "labels", (1, 1), folds=3, fit_rows=20)
    assert len(rows.fold) <= 21 and rows.rows.sum() == 90
    whole = N.corpus(df, ["a"], "text", "labels", (1, 1), folds=3)
    assert sorted(rows.df.sum(1).tolist())[-3:] == [30, 30, 30] and set(rows.df.sum(1).tolist()) <= {12, 13, 30}
    held = whole.fold == 1
    for at in range(len(whole.keys)):
        assert whole.df[at, 1] == len(set(whole.row[(whole.col == at)].tolist()) & set(np.flatnonzero(held).tolist()))


def _sparse(rng, n=80, terms=400):
    dense = np.where(rng.random((n, terms)) < rng.random(terms) ** 3, rng.random((n, terms)), 0)
    col, row = np.nonzero(dense.T)
    return dense, A.Entries(row, col, dense[row, col], n)


def test_products_and_cross():
    rng = np.random.default_rng(1)
    for _ in range(5):
        a, x = _sparse(rng)
        b, z = _sparse(rng, 30)
        assert np.allclose(A.products(x), a @ a.T + 1) and np.allclose(A.cross(z, x, 400), b @ a.T)


def test_solvers_reach_the_optimum(monkeypatch):
    rng = np.random.default_rng(2)
    dense, x = _sparse(rng)
    y = np.where(dense[:, :3].sum(1, keepdims=True) + rng.normal(0, 0.2, (80, 2)) > 0.3, 1.0, -1.0)
    k = A.products(x)
    for c in (0.5, 10.0):
        a = A.fit_l2(k, y, c)
        assert np.abs(a - 2 * c * y * np.maximum(0, 1 - y * (k @ a))).max() < 1e-6  # the gradient is zero
        a = A.fit_logistic(k, y, c)
        assert np.abs(a - c * y / (1 + np.exp(y * (k @ a)))).max() < 1e-3

    def costs(cs):
        for c, models in zip(cs, A.fit_l1(x, y, cs)):
            lack = np.maximum(0, 1 - y * A.margins_l1(x, models, 400))
            yield sum(np.abs(w).sum() + abs(b) for _, w, b in models) + c * (lack * lack).sum(), np.abs(2 * c * dense.T @ (y * lack)).max(), models

    found = list(costs([0.5, 10.0, 1000.0]))
    assert found[0][1] < 1.1 and all(len(w) < 80 for _, w, _ in found[0][2])  # nothing pulls more than its price
    monkeypatch.setattr(A, "DESCENTS", 20_000)
    monkeypatch.setattr(A, "ROUNDS", 60)
    assert [cost for cost, _, _ in found] == pytest.approx([cost for cost, _, _ in costs([0.5, 10.0, 1000.0])], rel=0.05)


def test_margins_of_many_models_follow_their_weights():
    """A model costs its own weights, not all entries and columns again."""
    rng = np.random.default_rng(4)
    n, width = 100, 50_000
    row, col = np.repeat(np.arange(n), 2_000), rng.integers(0, width, n * 2_000)
    x = A.Entries(row, col, rng.random(len(row)), n)
    models = [(np.sort(rng.choice(width, 3, False)), rng.normal(size=3), float(k)) for k in range(5_000)]
    models[7] = (np.zeros(0, dtype=np.int64), np.zeros(0), -1.0)
    began = time.time()
    found = A.margins_l1(x, models, width)
    assert time.time() - began < 4
    for k in (0, 7, 4_999):
        whole = np.zeros(width)
        whole[models[k][0]] = models[k][1]
        assert np.allclose(found[:, k], np.bincount(row, x.val * whole[col], n) + models[k][2])
    assert A.margins_l1(x, [], width).shape == (n, 0)


def test_few_classes_are_scored_by_term(spark, sf_dir, monkeypatch):
    """Language models score a row by its terms, not by products with every fit row."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, names = N.train_language_model(docs, "text", "lang")
    f = model.fitted
    through_rows = A.cross(f.x, f.x, len(f.keys)) @ f.weights + f.weights.sum(0)
    monkeypatch.setattr(A, "cross", None)
    assert np.allclose(f.margins(f.x), through_rows) and len(names) == through_rows.shape[1]
    assert "by_term" not in f.__getstate__()


def test_only_known_terms_leave_the_counting_tasks(spark, monkeypatch):
    words = [f"w{k % 7} x{k % 3} y{k}" for k in range(90)]
    df = spark.createDataFrame([(k, w, ["a"]) for k, w in enumerate(words)], "doc_id bigint, text string, labels array<string>")
    plans, whole = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or whole(self))
    rows = N.corpus(df, ["a"], "text", "labels", (1, 2), folds=3, fit_rows=20)
    (plan,) = [p for p in plans if "LeftSemi" in p]
    assert plan.rindex("HashAggregate") < plan.index("LeftSemi")  # joined below the sums
    monkeypatch.setattr(N, "KNOWN_ROWS", 0)
    other = N.corpus(df, ["a"], "text", "labels", (1, 2), folds=3, fit_rows=20)
    assert (rows.df == other.df).all() and (rows.keys == other.keys).all() and rows.df.sum() > 0


def test_huffman_tree():
    counts = [50, 1, 1, 20, 8, 8, 0]
    tree = N.Tree.of(counts)
    paths = tree.paths(len(counts))
    assert len(tree.children) == 6 and len(paths[0]) == 1 and max(map(len, paths)) == len(paths[6])
    margin = {k: m for k, m in enumerate([0.3, -1.0, 2.0, 0.1, -0.4, 0.7])}
    p = [math.prod(1 / (1 + math.exp(-side * margin[node])) for node, side in path) for path in paths]
    assert sum(p) == pytest.approx(1)
    best = tree.best(margin.__getitem__, 3)
    assert [c for c, _ in best] == sorted(range(7), key=lambda c: -p[c])[:3] and [q for _, q in best] == pytest.approx(sorted(p)[:-4:-1])
    asked = []
    tree.best(lambda node: asked.append(node) or 50.0 * (1 if node == 5 else -1), 1)
    assert len(asked) <= max(map(len, paths))
    assert N.Tree.of([3]).best(margin.__getitem__, 4) == [(0, 1.0)]


def test_label_scorer_bounds(spark, sf_dir):
    rows, classes = R.dataset(spark, sf_dir, 5)
    scorer = N.train_label_scorer(rows, classes, "title")
    scores = N.label_scores(rows, scorer, 5)
    assert scores.where((F.col("proba") < 0) | (F.col("proba") > 1)).count() == 0
    assert {r["count"] for r in L.topn_labels(scores, 2).groupBy("doc_id").count().collect()} == {2}
    assert max(r["count"] for r in L.threshold_labels(scores, 5, 0.2).groupBy("doc_id").count().collect()) <= 5
    full = N.train_label_scorer(rows, classes, "fulltext")
    best = L.topn_labels(N.label_scores(rows, full, 5), 1).join(rows, "doc_id")
    assert best.where(F.array_contains("labels", F.col("label"))).count() > 0.9 * rows.count()


def test_language_beats_majority(spark, sf_dir):
    rows = M.random_split(T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 0.5)
    test = rows.where("split = 'test'")
    model = G.train_language_model(rows.where("split = 'train'"))
    scored = G.predict_language(test, model, F.col("text")).join(test, "doc_id")
    right = scored.where("predicted = lang").count() / test.count()
    assert scored.count() == test.count() and right > 0.8
    linear, names = N.train_language_model(rows.where("split = 'train'"), "text", "lang")
    out = N.apply_language_model(test, linear, names)
    assert out.where("predicted = lang").count() / test.count() > 0.7


def test_whole_grids(spark, sf_dir):
    rows, classes = R.dataset(spark, sf_dir, 8)
    trials = N.tag_grid_search(rows, classes[:3]).collect()
    assert len(trials) == 96 and len({t["params"] for t in trials}) == 96
    best = max(t["mean_test_score"] for t in trials)
    assert 0 < best <= 1 and all((t["rank_test_score"] == 1) == (t["mean_test_score"] == best) for t in trials)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trials = N.language_grid_search(docs, text="text", language="lang")
    assert trials.count() == 12 and trials.where("rank_test_score = 1 and mean_test_score > 0.8").count() >= 1
    assert N.best_trials(trials).columns == ["mean_test_score", "mean_fit_time", "param_ngram_range"]


def test_fits_use_a_plan_of_one_size(spark, sf_dir):
    rows, classes = R.dataset(spark, sf_dir, 2)
    few, many = (N.train_tag_model(rows, some).transform(rows.select("doc_id", "fulltext")) for some in (classes[:2], classes))
    sizes = [len(df._jdf.queryExecution().executedPlan().toString()) for df in (few, many)]
    assert len(classes) > 20 and sizes[1] < sizes[0] + 100


def test_embedding_models(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.normal(np.eye(3)[k % 3] * 2, 0.3)], [str(k % 3)]) for k in range(200)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, labels array<string>")
    for kind in ("svm", "logistic"):
        model = N.train_embedding_model(df, ["0", "1", "2"], kind=kind, c=10.0)
        path = scratch_path(spark, "embedding")
        model.save(spark, path)
        found = N.EmbeddingModel.load(spark, path).transform(df)
        assert found.where("array_contains(predicted, labels[0])").count() >= 0.95 * 200


def test_stream_takes_up_where_it_stopped(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copyfile(f"{sf_dir}/documents.parquet", src / "documents.parquet")
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")

    def run():
        stream = T.shape_infos(S.document_stream(spark, str(src), "*.parquet")).select("doc_id", "title")
        return S.run_available(stream, lambda b: b, out, state)

    n = run().count()
    assert n == T.table(spark, sf_dir, "documents").count() == run().count()
    more = T.table(spark, sf_dir, "documents").limit(5)
    more.toPandas().to_parquet(src / "more.parquet")
    assert run().count() == n + 5


def test_stream_reads_a_table_of_several_files(spark, sf_dir, tmp_path):
    def run(name):
        rows = S.document_stream(spark, str(tmp_path)).select(F.lit(None).cast("string").alias("url"), F.col("text").alias("description"), F.lit("").alias("tags"), F.lit("").alias("tags_suggest"))
        return S.stream_suggestions(rows, scratch_path(spark, name), scratch_path(spark, f"{name}-state"))

    assert run("none").collect() == [] and "postAt" in run("none").columns  # the table is not there yet
    docs = T.table(spark, sf_dir, "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert run("some").count() == docs.count() > 0
    assert queries()["stream_suggestions"](spark, str(tmp_path)).count() == docs.count()


def test_detect_refuses_and_answers(spark, sf_dir):
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    resources = S.Resources(language=G.train_language_model(documents))
    requests = T.requests(spark, sf_dir).where("doc_id < 3")
    answers = {r["doc_id"]: r for r in S.detect(requests, resources).collect()}
    assert not answers[-1]["valid"] and answers[-1]["tags"] is None and answers[-4]["valid"]
    assert all(len(a["keywords"]) <= 5 and a["language"] for a in answers.values() if a["valid"])


# slow here, or (the dump) empty at this scale; tools/check.py runs all of them
SLOW = {"dataset_dump", "char_ngrams", "keywords", "predict_language", "stream_detect", "stream_language", "by_url_resolution"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _plain(value):
    return f"{value:.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    relation = duck.sql(oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_grams_of_a_batch_are_those_of_each_row(spark):
    texts = ["aa bb aa bb aa", "", None, "bb  aa", "é　ß😀x", "aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for analyzer, cut in (("word", lambda n: X.token_ngrams(X.words(F.col("text")), n, n)), ("char", lambda n: X.char_ngrams(F.col("text"), n, n))):
        units = df.select(W.units(F.col("text"), analyzer).alias("u")).toArrow().column("u").combine_chunks()
        for n in (1, 2, 3, 4):
            row, term, times, size = W.row_terms(units, range(n, n + 1))
            plain = [sorted(Counter(r[0] or []).values()) for r in df.select(cut(n)).collect()]
            assert [sorted(times[row == k].tolist()) for k in range(len(texts))] == plain and set(size.tolist()) <= {n}
            assert len(set(term.tolist())) == len({g for r in df.select(cut(n)).collect() for g in r[0] or []})
    assert [(a, b) for a, b in W.slices(units)] == [(0, 6)] and list(W.slices(units[:0])) == []


def test_texts_reach_the_counting_tasks_uncut(spark, monkeypatch):
    """No n-gram of a row is a row, or an element of an array, of a Spark plan."""
    df = spark.createDataFrame([(k, f"text {k} of some rows", "en" if k % 2 else "fr") for k in range(20)], "doc_id bigint, text string, lang string")
    plans, whole = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: plans.append(self._jdf.queryExecution().toString()) or whole(self))
    N.language_grid_search(df, folds=2, text="text", language="lang", grid={"ngrams": [(1, 2)], "analyzer": ["char"], "use_idf": [True]}).collect()
    assert plans and not any("regexp_extract_all" in p or "Generate" in p for p in plans)


def test_language_sums_stay_in_the_row(spark, sf_dir, monkeypatch):
    """A record is one row in front of the shuffle; a model that is not sent to the tasks scores the same."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").limit(60)
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "fr"), (-3, "ab", "en"), (-3, "\U0001f600 \u3000x\n", "de")], docs.schema)
    rows = docs.unionByName(odd)
    model = G.train_language_model(docs)
    scored = G.language_scores(rows, model, F.col("text"))
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()

    def plain(df):
        return {r["doc_id"]: [round(v, 4) for v in r["scores"]] for r in df.collect()}

    monkeypatch.setattr(G, "MODEL_CELLS", 0)
    few = plain(scored)
    assert few == plain(G.language_scores(rows, model, F.col("text"))) and len(few) == 63
    weights = {r["gram"]: r["w"] for r in model.grams.collect()}
    assert few[-1] == few[-2] == [round(math.log(p), 4) for p in model.priors]
    one = docs.first()
    found = [r for r in rows.where(F.col("doc_id") == one["doc_id"]).select(F.explode(X.char_ngrams(F.col("text"), 3, 3))).collect()]
    numbers = [(ord(r[0][0]) << 42) | (ord(r[0][1]) << 21) | ord(r[0][2]) for r in found]
    for i in range(len(model.languages)):
        want = math.log(model.priors[i]) + sum(weights[g][i] for g in numbers) - len(numbers) * math.log(model.totals[i])
        assert few[one["doc_id"]][i] == pytest.approx(want, abs=1e-3)
