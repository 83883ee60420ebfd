"""Feeds, posts, stores and requests on small literal rows."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from topicspark import fixed_values as V
from topicspark.operators import filters as P
from topicspark.operators import labels as L
from topicspark.plans import dataset as D
from topicspark.session import scratch_path
from topicspark.sources import feeds, pages, stores
from topicspark.sources import posts as Q
from topicspark.sources import tables as T


def fragments(spark, sizes):
    rows = [(p, [(f"{p}-{i}",) for i in range(n)]) for p, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "page bigint, content array<struct<key:string>>")


@pytest.mark.parametrize(
    "sizes, total, kept",
    [
        ([10, 10, 4, 10], None, 24),
        ([10, 10, 10], None, 30),
        ([10, 10, 10, 10], 20, 20),
        ([10, 10, 10, 10], 21, 30),
        ([10, 10, 10], 500, 30),
        ([0, 10], None, 0),
    ],
)
def test_combine_fragments_stop(spark, sizes, total, kept):
    rows = feeds.combine_fragments(fragments(spark, sizes), total_size=total).collect()
    assert sorted(r["position"] for r in rows) == list(range(kept))


def test_scan_missing_and_without_fulltext(spark, sf_dir):
    assert feeds.scan_infos(spark, "/tmp/no-such-folder-here").count() == 0
    records = T.infos(spark, sf_dir, with_url=True)
    path = feeds.write_batch(feeds.to_fragments(records), scratch_path(spark, "batch"))
    plain = feeds.scan_infos(spark, path, fulltext=False)
    assert "fulltext" not in plain.columns and plain.count() == records.count()


def test_multi_line_batch(spark, tmp_path):
    (tmp_path / "b.json").write_text('{\n "content": [\n {"key": "a", "tags": [{"tagID": "t", "label": "T"}]}, {"key": "b"}]\n}')
    rows = feeds.scan_infos(spark, str(tmp_path), multi_line=True).orderBy("key").collect()
    assert [r["key"] for r in rows] == ["a", "b"] and rows[0]["tags"][0]["label"] == "T"


def test_dump_round_trip(spark, sf_dir):
    data, names = D.with_targets(
        D.build_dataset(T.infos(spark, sf_dir), language="en", filter_tags_threshold=5, concat_title=True)
    )
    split = data.withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train"))
    home = scratch_path(spark, "dump")
    for version in ("v1", "v2"):
        stores.dataset_dump(split, L.class_names(data), home, version)
    rows, classes = stores.read_dump(spark, home, "v1")
    assert rows.count() == data.count() and classes.count() == len(names)
    assert rows.select(F.size("target")).distinct().first()[0] == len(names)
    assert stores.dataset_dump(split.limit(1), L.class_names(data), home).startswith("ver_")


def test_load_or_build_builds_once(spark):
    path, calls = scratch_path(spark, "stored"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stores.load_or_build(spark, path, build).count() == 3
    assert stores.load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_posts_paging(spark):
    rows = [(i, f"t{i}", "<a>", "b", i % 7) for i in range(100)] + [(200, None, "<a>", "b", 50)]
    posts = spark.createDataFrame(rows, "id bigint, Title string, Tags string, body string, score int")
    order = sorted((r for r in rows[:100] if r[4] > 2), key=lambda r: (-r[4], r[0]))
    page = [r["id"] for r in Q.posts_query(posts, 5, 4, 2).collect()]
    assert page == [r[0] for r in order[5:9]]
    assert Q.posts_count(posts, 2).first()["n"] == len(order)
    paged = Q.paged_posts(posts, num=21, start=3, per_page=10, least_score=2).collect()
    want = {r[0]: i // 10 for i, r in enumerate(order[3:33])}
    assert {r["id"]: r["page"] for r in paged} == want


def test_stack_dataset_custom_extractor(spark):
    posts = spark.createDataFrame([(1, "T", "<a><b><a>", "<p>x</p>", 1), (2, "U", "<c>", "y", 1)], "id bigint, Title string, Tags string, body string, score int")
    rows = Q.stack_dataset(posts, n_tag=2, concat_title=True, body_extractor=F.upper).collect()
    assert [(r["id"], sorted(r["labels"]), r["description"]) for r in rows] == [(1, ["a", "b"], "T <P>X</P>")]


def test_page_lookup_duplicates_and_missing(spark):
    store = spark.createDataFrame(
        [(2, "http://a", "late"), (1, "http://a", "early")], "page_id bigint, url string, html string"
    ).withColumn("url_md5", F.md5("url"))
    records = spark.createDataFrame([(1, "http://a"), (2, "http://b"), (3, None)], "doc_id bigint, url string")
    assert {r["doc_id"]: r["html"] for r in pages.page_lookup(records, store).collect()} == {1: "early", 2: "", 3: ""}


def test_enrich_falls_back_to_description(spark):
    long_text = "word " * 40
    store = spark.createDataFrame(
        [(1, "http://a", f"<body>{long_text}</body>"), (2, "http://b", "<body>short</body>")],
        "page_id bigint, url string, html string",
    ).withColumn("url_md5", F.md5("url"))
    records = spark.createDataFrame([(1, "http://a", "d1"), (2, "http://b", "d2"), (3, None, "d3")], "doc_id bigint, url string, description string")
    out = {r["doc_id"]: r["fulltext"] for r in pages.enrich_fulltext(records, store).collect()}
    assert out == {1: long_text.strip(), 2: "d2", 3: "d3"}


def test_requests_are_refused_with_reason(spark, sf_dir):
    rows = P.validate_request(T.requests(spark, sf_dir)).where("doc_id < 0").collect()
    assert {r["doc_id"]: r["reason"] for r in rows} == {-1: V.TOO_SHORT, -2: V.TOO_LONG, -3: V.TOO_SHORT, -4: "", -5: V.TOO_SHORT}


def test_dataset_arguments(spark, sf_dir):
    records = T.infos(spark, sf_dir)
    with pytest.raises(ValueError):
        D.build_dataset(records, mode="info", partial_len=10)
    with pytest.warns(UserWarning):
        odd = D.build_dataset(records, tag_type="other")
    assert odd.columns == ["doc_id", "labels", "title", "language", "description", "fulltext"]
    assert D.build_dataset(records, mode="info").columns == ["doc_id", "labels", "title", "description", "language"]
    upper = D.build_dataset(records, text_transform=lambda d: d.withColumn("title", F.upper("title")))
    assert upper.where(F.col("title") != F.upper("title")).count() == 0


def test_publisher_defaults(spark):
    from topicspark.functions import html as H

    rows = spark.createDataFrame([(1, '{"data":{"article_title":"T","author":[{"nickname":"n"}]}}')], "id int, payload string")
    out = P.publisher_projection(rows, "payload", H.html_to_text).first()
    assert (out["fulltext"], out["title"], out["creators"], out["tags"]) == ("", "T", ["n"], [])


@pytest.mark.parametrize("name, passes", [("fasttext_lines", 1), ("iterative_stratified_split", 1), ("dataset_dump", 2)])
def test_labels_are_cut_from_the_texts_once(spark, monkeypatch, name, passes):
    """A dump's labels are counted first and stored with the cleaned texts then: two passes."""
    sf = "/root/testdata/sf0.01"
    seen = spark.sparkContext.accumulator(0)
    met = F.udf(lambda x: seen.add(1) or x, "string")
    whole = T.infos
    monkeypatch.setattr(T, "infos", lambda *a, **b: whole(*a, **b).withColumn("tags", F.when(met("language").isNotNull(), F.col("tags"))))
    assert queries()[name](spark, sf).count() > 0
    assert 0 < seen.value <= passes * T.table(spark, sf, "documents").count()


def test_an_empty_dump_has_its_columns(spark):
    rows = spark.createDataFrame([], "doc_id bigint, labels array<string>, split string")
    classes = spark.createDataFrame([], "label string, idx bigint")
    home = scratch_path(spark, "dump")
    stores.dataset_dump(rows, classes, home, "v1")
    data, names = stores.read_dump(spark, home, "v1")
    assert data.select("doc_id", "labels", "split").collect() == names.select("label", "idx").collect() == []
