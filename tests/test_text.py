"""Text expressions against plain Python on awkward strings."""

import html
import html.entities
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicspark import fixed_values as V
from topicspark.functions import html as H
from topicspark.functions import text as X

URL = re.compile(V.URL_PATTERN)

EDGES = [
    "", " ", "　wide　", "a\rb http://x.com/p\rq r\n", "we use node.js here", "see http://www.a-b.org",
    "HTTP://UP.COM/x y", "emoji 😀 a.com 😀", r"two \n signs \ here", "&amp;&gt;&lt;", "x--y.com z", "http://a--b.com c",
    "foo..bar.io x", "1.2.3.abc d", "a.b.c.d.e.f ", "xhttp://a.com b", "https://www.com ", "a.com:80 b", "a.com:123456 b",
    "a.com/x y z\nnext b.de ", "-foo.com bar", "a.-b.com c", "\x1cmid\x1f a.co\x1d b", "tab\tnew\nline\r", "a.b", "a.bcdefg h",
    "\x85next\xa0a.com\xa0b", "..a.com ", "a_b.com c", "A.b.com c", "www.x.com/?q=1 tail", "http://.com x",
]


def python_clean(text):
    text = text.strip().replace("\\n", "").replace("\\", "")
    text = URL.sub(V.URL_MASK, text)
    for entity, plain in (("&amp;", "and"), ("&gt;", ">"), ("&lt;", "<")):
        text = text.replace(entity, plain)
    return "".join(c for c in text if c not in "\r\t\n")


def column(spark, texts, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", fn(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_text_edges(spark):
    assert column(spark, EDGES, X.clean_text) == [python_clean(t) for t in EDGES]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1A.-_/: \n\t\r\\n&;hτ\x1c\x85　wps", max_size=60), min_size=150, max_size=150))
def test_mask_matches_pattern(spark, texts):
    texts += [t.replace("h", "http://").replace("w", "www.").replace("p", ".com ") for t in texts]
    assert column(spark, texts, X.mask_urls) == [URL.sub(V.URL_MASK, t) for t in texts]
    assert column(spark, texts, X.clean_text) == [python_clean(t) for t in texts]


def test_mask_survives_long_runs(spark):
    texts = ["a." * 200_000, "a-" * 200_000 + "b.com ", "x" * 500_000, "a--" * 100_000 + ".com "]
    out = column(spark, texts, lambda c: F.length(X.mask_urls(c)))
    assert out[0] == 400_000 and out[1] == len(V.URL_MASK) and out[2] == 500_000


def test_tag_terms(spark):
    labels = ["machine-learning", "node.js", "python", "-x-", "a.b-c", "."]
    assert column(spark, labels, X.tag_terms) == [
        ["machine", "learning"], ["node", "js", "nodejs"], ["python"], ["x"], ["a.b", "c"], [],
    ]


def test_parse_tag_string(spark):
    assert column(spark, ["<a><b c>", "", "<>", "<x"], X.parse_tag_string) == [["a", "b c"], [], [], []]


def test_ngrams(spark):
    assert column(spark, ["One two, THREE x"], lambda c: X.token_ngrams(X.words(c), 1, 2)) == [
        ["one", "two", "three", "one two", "two three"]
    ]
    assert column(spark, ["", "x"], lambda c: X.token_ngrams(X.words(c), 1, 3)) == [[], []]
    assert column(spark, ["a \n😀"], lambda c: X.char_ngrams(c, 1, 2)) == [["a", " ", "😀", "a ", " 😀"]]


def test_lead_sentences(spark):
    rows = spark.createDataFrame([("T\na\nb\nc",), ("x\na\nb\nc",)], "t string")
    out = rows.select(X.lead_sentences(F.col("t"), F.lit("T"), 2)).collect()
    assert [r[0] for r in out] == [["a", "b"], ["x", "a"]]


def test_label_prefix(spark):
    assert column(spark, ["a"], X.add_label_prefix) == ["__label__a"]
    assert column(spark, ["__label__a"], X.drop_label_prefix) == ["a"]


def test_record_text(spark):
    rows = spark.createDataFrame(
        [("f", "d", "t"), (None, "d", "t"), ("", "", "t"), (None, None, None), (None, "d", "")],
        "f string, d string, t string",
    )
    out = [r[0] for r in rows.select(X.record_text(F.col("f"), F.col("d"), F.col("t"))).collect()]
    assert out == ["t. f", "t. d", "t", None, "d"]


def test_html_to_text(spark):
    pages = [
        "<p>no body</p><b>x</b>",
        "<html><body><header>h</header><h1>T</h1><p> a <i>b</i></p><script>s()</script><!-- c --><h1>U</h1></body></html>",
        "<body>&lt;x&gt; &amp;lt; &#228;&#xE4; &#0; &copy;</body>",
        "",
    ]
    assert column(spark, pages, H.html_to_text) == ["no body x", "a b U", "<x> &lt; ää � ©", ""]


def test_page_title_and_article(spark):
    page = "<title>t</title><body><article><h1>H</h1><figure>f</figure><p>x</p></article><h1>o</h1></body>"
    assert column(spark, [page, "<title>t</title>", "<p>"], H.page_title) == ["H", "t", None]
    assert column(spark, [page], H.article_text) == ["x"]


def test_post_body_text(spark):
    assert column(spark, ["<p>a</p>\n<p>b</p>"], H.post_body_text) == ["a b"]


RAW = ("script", "style")


def plain_tokens(page):
    """('text', t), ('open', name) and ('close', name), sign by sign."""
    out, text, i, n = [], "", 0, len(page)
    low = page.lower()

    def tag_end(i):
        """Behind the tag whose name ended at ``i``: a quote counts behind an equals sign only."""
        while i < n and page[i] != ">":
            if page[i] == "=":
                i += 1
                while i < n and page[i].isspace():
                    i += 1
                if i < n and page[i] in "\"'":
                    end = page.find(page[i], i + 1)
                    i = n if end < 0 else end + 1
            else:
                i += 1
        return min(n, i + 1)

    def mark(kind, name):
        nonlocal text
        if text:
            out.append(("text", text))
        text = ""
        out.append((kind, name))

    while i < n:
        if low.startswith("<!--", i):
            if page.startswith(">", i + 4) or page.startswith("->", i + 4):
                i = page.index(">", i + 4) + 1
            else:
                ends = [(at, len(e)) for e in ("-->", "--!>") if (at := page.find(e, i + 4)) >= 0]
                i = n if not ends else sum(min(ends))
            mark("other", "")
        elif page[i] == "<" and i + 1 < n and page[i + 1] in "!?" or low.startswith("</", i) and not (i + 2 < n and "a" <= low[i + 2] <= "z"):
            end = page.find(">", i)
            i = n if end < 0 else end + 1
            mark("other", "")
        elif page[i] == "<" and i + 1 < n and (page[i + 1] == "/" or "a" <= low[i + 1] <= "z"):
            close = page[i + 1] == "/"
            at = i + 1 + close
            end = at
            while end < n and not (page[end].isspace() or page[end] in "/>"):
                end += 1
            name = low[at:end]
            i = tag_end(end)
            if not close and name in RAW and end < n:
                while i < n and not (low.startswith(f"</{name}", i) and i + 2 + len(name) < n and (page[i + 2 + len(name)].isspace() or page[i + 2 + len(name)] in "/>")):
                    i += 1
                end = page.find(">", i)
                i = n if end < 0 else end + 1
                mark("other", "")
            else:
                mark("close" if close else "open", name)
        else:
            text += page[i]
            i += 1
    return [*out, ("text", text)] if text else out


def plain_body_text(page):
    tokens = plain_tokens(page)

    def inside(tokens, name):
        at = tokens.index(("open", name))
        rest = tokens[at + 1 :]
        return rest[: rest.index(("close", name))] if ("close", name) in rest else rest

    def without(tokens, name):
        if ("open", name) in tokens:
            at = tokens.index(("open", name))
            if ("close", name) in tokens[at:]:
                return tokens[:at] + [("other", "")] + tokens[tokens.index(("close", name), at) + 1 :]
        return tokens

    if ("open", "body") in tokens:
        tokens = without(without(inside(tokens, "body"), "header"), "h1")
    pieces, run = [], ""
    for kind, value in [*tokens, ("end", "")]:
        if kind == "text":
            run += value
        elif run.strip():
            pieces.append(run.strip())
            run = ""
        else:
            run = ""
    return html.unescape(" ".join(pieces)).strip()


PAGES = [
    '<a title="x > y">z</a> &eacute; 1 < 2 and 3 > 2',
    "<a title='1 > 0' href = \"a>b\">q</a><p don't>it's</p>",
    "<body><p>never closed <b>bold",
    "<body>a<!-- <p>no</p> -->b<!-->c<!--x--!>d<!-- open",
    "<script>if (a < b) { '</p>' }</script>after<style>p > q {}",
    "<SCRIPT src='x>y'>a</script >b<scripts>c</scripts>",
    '<body><header class="a>b">h</header><header-x>k</header-x><h1>t</h1><p>u</p></body>tail',
    "&copy 2020 &notit; &notin; &amp;lt; &#38;lt; &#x41 &#150; &bogus; & &; &#; AT&T &ThickSpace;x",
    '<p title="no end>text<p>more', "<?xml v?><!DOCTYPE html></ bogus>x</>y<3", "<", "<a", "</", "a<b", "",
    "<a " + "b='>' " * 5000 + ">many</a>", "<" * 3000, "<p>" * 3000 + "x" + "&lt;" * 3000,
]


def test_tokenizer_against_a_plain_one(spark):
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<a title='>'>", '<a b="', "<!--", "-->", "<script>", "</script>", "<body>", "</body>", "<h1>", "</h1>", "<header x=y>", "</header>", "'", '"', ">", "<", " ", "w", "&lt;", "&Auml;", "&copy", "&#x4E2D;", "é", "="]
    pages = PAGES + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(1500)]
    for page, found in zip(pages, column(spark, pages, H.html_to_text)):
        assert found == plain_body_text(page), page[:200]


def test_all_named_references(spark):
    names = sorted(html.entities.html5)
    texts = [f"a&{name}" for name in names] + [f"a&{name} z" for name in names] + [f"&#{k};" for k in (9, 65, 0x80, 0x9F, 0x1F600, 0xD800, 0x110000, 10**20)]
    assert column(spark, texts, H.decode_entities) == [html.unescape(t) for t in texts]


def test_ngrams_are_not_columns_of_rows(spark, sf_dir):
    from topicspark.registry import texts

    for name in ("char_ngrams", "word_ngrams"):
        df = texts.QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("md5(") == 1 and "AS g#" not in plan
    assert column(spark, ["", None, "a"], lambda c: X.char_ngrams(c, 1, 2)) == [[], None, ["a"]]
