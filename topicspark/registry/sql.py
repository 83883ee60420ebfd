"""Shared pieces of the check queries (ANSI-style SQL with list functions)."""

from __future__ import annotations

from .. import fixed_values as V

# the references that the given pages hold, and the markup ones ('&amp;' last)
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
URL = V.URL_PATTERN[: -len(r"\s")] + SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def mask(x: str) -> str:
    return f"regexp_replace({x}, '{URL}', '{V.URL_MASK}', 'g')"


def clean(x: str) -> str:
    x = f"replace(replace({strip(x)}, '\\n', ''), '\\', '')"
    x = f"replace(replace(replace({mask(x)}, '&amp;', 'and'), '&gt;', '>'), '&lt;', '<')"
    return f"replace(replace(replace({x}, chr(13), ''), chr(9), ''), chr(10), '')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{V.WORD_PATTERN}')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')"


def ngrams(items: str, n: int) -> str:
    """n-grams of a list column (a name, not an expression)."""
    if n == 1:
        return items
    parts = " || ' ' || ".join(f"{items}[i + {j}]" if j else f"{items}[i]" for j in range(n))
    return (
        f"CASE WHEN len({items}) >= {n} THEN list_transform(range(1, len({items}) - {n - 2}), "
        f"lambda i: {parts}) ELSE CAST([] AS VARCHAR[]) END"
    )


def hash32(seed: object, *keys: str) -> str:
    parts = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5({parts} || '|{seed}'), 1, 8) AS BIGINT)"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


INFOS = """
infos AS (
  SELECT d.doc_id, md5(CAST(d.doc_id AS VARCHAR)) AS key, substr(d.text, 1, 60) AS title,
         substr(d.text, 1, 300) AS description, d.text AS fulltext, d.lang AS language, p.url,
         list_sort(list_distinct(list_filter(d.long_words, lambda x, i: i > 1 AND d.long_words[i - 1] = x))) AS tag_ids,
         CASE WHEN d.doc_id % 7 = 0 THEN CAST([] AS VARCHAR[])
              WHEN d.doc_id % 5 = 0 THEN [d.source, 'editor'] ELSE [d.source] END AS creators
  FROM (SELECT *, list_sort(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 5)) AS long_words
        FROM documents) d LEFT JOIN pages p ON p.page_id = d.doc_id
)"""

POSTS = """
posts AS (
  SELECT p_partkey AS id, p_name AS title, html AS body, p_size AS score,
         '<' || lower(p_brand) || '><' || lower(p_type) || '>' ||
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: '<' || w || '>'), '') AS tags
  FROM part LEFT JOIN pages ON page_id = p_partkey
)"""

TAG_LIST = """
tag_list AS (
  SELECT DISTINCT tag AS tagID, upper(tag) AS label FROM (SELECT unnest(tag_ids) AS tag FROM infos)
)"""

TAG_MAP = f"""
doc_words AS (SELECT doc_id, {words('text')} AS w FROM documents),
phrases AS (
  SELECT phrase FROM (SELECT unnest({ngrams('w', 2)}) AS phrase FROM doc_words)
  GROUP BY phrase HAVING count(*) >= 20
),
tag_map AS (
  SELECT label, tagID FROM tag_list
  UNION ALL SELECT phrase, replace(phrase, ' ', '-') FROM phrases
)"""


def base(language: str | None = "en", fulltext: bool = True) -> str:
    tests = ["length(description) >= 100"]
    if fulltext:
        tests.append("length(fulltext) >= 100")
    if language:
        tests.append(f"language = '{language}'")
    return f"base AS (SELECT * FROM infos WHERE {' AND '.join(tests)})"


def kept(threshold: int, source: str = "base") -> str:
    """kept(doc_id, labels): label sets after removing rare labels."""
    return f"""
pairs AS (SELECT doc_id, unnest(tag_ids) AS label FROM {source}),
frequent AS (SELECT label, count(*) AS n FROM pairs GROUP BY label HAVING count(*) > {threshold}),
kept AS (SELECT doc_id, list_sort(list(label)) AS labels FROM pairs JOIN frequent USING (label) GROUP BY doc_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def scores(threshold: int, seed: int = 7) -> str:
    """scores(doc_id, label, y, proba): every record with its kept classes and four drawn ones."""
    return f"""
classes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM frequent),
drawn AS (SELECT doc_id, {hash32(seed, 'doc_id', 'j')} % (SELECT greatest(count(*), 1) FROM classes) AS idx FROM infos, range(4) r(j)),
owned AS (SELECT doc_id, unnest(tag_ids) AS label FROM infos),
scores AS (
  SELECT doc_id, label, CAST(max(y) AS INTEGER) AS y, ({hash32(seed, 'doc_id', 'label')} % 1000) / 1000.0::DOUBLE AS proba
  FROM (SELECT doc_id, label, 0 AS y FROM drawn JOIN classes USING (idx)
        UNION ALL SELECT doc_id, label, 1 FROM owned JOIN classes USING (label))
  GROUP BY doc_id, label
)"""


# --- html ------------------------------------------------------------------------------

BODY = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)"


def plain_page(x: str) -> str:
    pattern = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    return f"regexp_replace({x}, '{pattern}', '', 'g')"


def drop_first(x: str, element: str) -> str:
    return rf"regexp_replace({x}, '(?is)<{element}\b.*?</{element}\s*>', '')"


def entities(x: str) -> str:
    for name, plain in _ENTITIES:
        plain = plain.replace("'", "''")
        x = f"replace({x}, '{name}', '{plain}')"
    return x


def visible(x: str) -> str:
    inner = SPACE[:-1] + r"\x01]"
    cut = f"regexp_replace({x}, '<[^>]*>', chr(1), 'g')"
    return strip(entities(rf"regexp_replace({cut}, '{inner}*\x01{inner}*', ' ', 'g')"))


def html_text(x: str) -> str:
    page = plain_page(x)
    body = f"regexp_extract({page}, '{BODY}', 1)"
    inner = drop_first(drop_first(body, "header"), "h1")
    return rf"CASE WHEN regexp_matches({page}, '(?i)<body\b') THEN {visible(inner)} ELSE {visible(page)} END"


def element_text(x: str, element: str) -> str:
    return visible(rf"regexp_extract({x}, '(?is)<{element}\b[^>]*>(.*?)</{element}\s*>', 1)")


def page_title(x: str) -> str:
    page = plain_page(x)
    return f"coalesce(nullif({element_text(page, 'h1')}, ''), nullif({element_text(page, 'title')}, ''))"


def article(x: str) -> str:
    return f"regexp_extract({plain_page(x)}, '{ARTICLE}', 1)"


def article_text(x: str) -> str:
    return visible(drop_first(drop_first(article(x), "h1"), "figure"))


HOST = "lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]+$', ''))"
