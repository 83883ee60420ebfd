"""Text of html pages, as expressions over the html column.

A page is read once, from left to right, by one expression with a branch for each state:
comments, scripts and styles (raw up to their end tag, or the end of the page), declarations,
and tags, in which a quote behind an equals sign hides what it encloses. Every tag becomes its bare
name between two control signs, everything else that is no text becomes an empty one; a
``<`` that opens nothing stays text. What is asked for is then cut from that form.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, strip

_OPEN, _CLOSE, _CUT = "\x01", "\x02", "\x03"
_ATTRIBUTES = r"""(?:=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+|[^=>]++)*+"""
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"
    r"|<[!?][^>]*+(?:>|\z)|</(?:[^a-z>][^>]*+)?(?:>|\z)"
    rf"|<(/?[a-z][^\s/>]*+){_ATTRIBUTES}(?:>|\z)"
)
_TAG = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"
_BETWEEN = rf"(?U)(?<![\s{_CUT}])[\s{_CUT}]*{_CUT}[\s{_CUT}]*"

# All named references, from the standard library's table; some of them may lack the semicolon.
# Numbers of the C1 range mean the signs of Windows-1252.
_NAMES = dict(html5) | {
    f"#{n}": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)
}
_BARE = {name: sign for name, sign in html5.items() if not name.endswith(";")}
_BARE_LENGTHS = sorted({len(name) for name in _BARE}, reverse=True)


def _table(entries: dict[str, str]) -> Column:
    return F.str_to_map(F.lit(_CLOSE.join(f"{k}{_OPEN}{v}" for k, v in entries.items())), F.lit(_CLOSE), F.lit(_OPEN))


def _tokens(html: Column) -> Column:
    """The page with every tag as its bare name between control signs."""
    return F.regexp_replace(F.translate(html, _OPEN + _CLOSE + _CUT, ""), _TOKEN, f"{_OPEN}$2{_CLOSE}")


def _element(name: str) -> str:
    """Pattern of an element, up to its end tag or the end of the page; group 1 is inside."""
    return f"(?is){_OPEN}{name}{_CLOSE}(.*?)(?:{_OPEN}/{name}{_CLOSE}|\\z)"


def _drop_first(tokens: Column, element: str) -> Column:
    closed = rf"(?is)\A(.*?){_OPEN}{element}{_CLOSE}.*?{_OPEN}/{element}{_CLOSE}"
    return F.regexp_replace(tokens, closed, f"$1{_OPEN}{_CLOSE}")


def _code_point(number: Column) -> Column:
    """The character of a code point, null outside the valid range."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    packed = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return F.when(valid, F.decode(packed, "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Decode numbered and named references, each once."""

    def number(body: Column) -> Column:
        hexadecimal = F.lower(F.substring(body, 2, 1)) == "x"
        digits = F.when(hexadecimal, F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(F.substr(body, F.lit(2)))
        value = F.when(F.length(body) <= 12, digits.try_cast("bigint"))
        return F.coalesce(F.element_at(_table(_NAMES), F.concat(F.lit("#"), value.cast("string"))), _code_point(value), F.lit("\ufffd"))

    def named(name: Column) -> Column:
        bare = _table(_BARE)
        prefixes = [
            F.when(F.length(name) >= k, F.concat(F.element_at(bare, F.substring(name, 1, k)), F.substr(name, F.lit(k + 1))))
            for k in _BARE_LENGTHS
        ]
        return F.coalesce(F.element_at(_table(_NAMES), name), *prefixes, F.concat(F.lit("&"), name))

    def decoded(part: Column) -> Column:
        whole = F.regexp_extract(part, "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z0-9]{1,32};?)", 1)
        sign = bind(whole, lambda w: F.when(F.startswith(w, F.lit("#")), number(F.rtrim(w, F.lit(";")))).otherwise(named(w)))
        return F.concat(sign, F.substr(part, F.length(whole) + 1))

    def decode(text: Column) -> Column:
        parts = F.split(text, "&(?=#[0-9]|#[xX][0-9a-fA-F]|[a-zA-Z])")
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
        return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)

    return bind(text, decode)


def visible_text(tokens: Column, separator: str = " ") -> Column:
    """Strings between tags, stripped and joined by ``separator``."""
    text = F.regexp_replace(tokens, _TAG, _CUT)
    text = F.regexp_replace(text, _BETWEEN, separator)
    return strip(decode_entities(text))


def html_to_text(html: Column) -> Column:
    """Text of the body without its first header and first h1; of the whole page
    if it has no body."""

    def text(page: Column) -> Column:
        body = F.regexp_extract(page, _element("body"), 1)
        inner = _drop_first(_drop_first(body, "header"), "h1")
        return visible_text(F.when(page.rlike(f"(?i){_OPEN}body{_CLOSE}"), inner).otherwise(page))

    return bind(_tokens(html), text)


def article_title(html: Column) -> Column:
    article = F.regexp_extract(_tokens(html), _element("article"), 1)
    return visible_text(F.regexp_extract(article, _element("h1"), 1))


def article_text(html: Column) -> Column:
    """Text of the article element without its first h1 and first figure."""
    article = F.regexp_extract(_tokens(html), _element("article"), 1)
    return visible_text(_drop_first(_drop_first(article, "h1"), "figure"))


def page_title(html: Column) -> Column:
    """First h1, else the title element, else null."""

    def title(page: Column) -> Column:
        heading = visible_text(F.regexp_extract(page, _element("h1"), 1))
        named = visible_text(F.regexp_extract(page, _element("title"), 1))
        return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(named, F.lit("")))

    return bind(_tokens(html), title)


def post_body_text(html: Column) -> Column:
    """All strings of a post body joined without separator, LF to space."""
    text = F.regexp_replace(_tokens(html), _TAG, "")
    return F.replace(decode_entities(text), F.lit("\n"), F.lit(" "))


def extract_text(html: Column, method: Callable[[Column], Column] = html_to_text) -> Column:
    return method(html)
