"""Text expressions: ``Column -> Column``, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V

# whitespace as Unicode defines it, plus the four information separators
_WS = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)\A{_WS}+|(?<!{_WS}){_WS}+\z"

# Same matches as URL_PATTERN, written so that the JVM's matcher neither recurses
# per label nor retries a run of dotted words from every position: a match begins
# at a scheme or at the first word of a run, and the run may not hold two
# separators in a row.
_URL = (
    r"(?dU)(?:https?://|(?<![a-z0-9])(?<![a-z0-9][.\-]))"
    r"(?=[a-z0-9])(?![a-z0-9.\-]*?[.\-]{2})"
    rf"[a-z0-9][a-z0-9.\-]*\.[a-z]{{2,5}}(?::[0-9]{{1,5}})?(?:/.*)?{_WS}"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it
    (also inside lambdas, where an inlined expression would run per element)."""
    return F.transform(F.array(value), body)[0]


def string_array(values: list[str]) -> Column:
    """A literal array of strings, typed also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def mask_urls(text: Column) -> Column:
    """Replace addresses and bare dotted words that end in whitespace by a mask."""
    return F.regexp_replace(text, _URL, V.URL_MASK)


def clean_text(text: Column) -> Column:
    """Strip, drop escapes, mask addresses, decode three entities, drop CR, TAB, LF."""
    text = strip(text)
    text = F.replace(text, F.lit("\\n"), F.lit(""))
    text = F.replace(text, F.lit("\\"), F.lit(""))
    text = mask_urls(text)
    for entity, plain in (("&amp;", "and"), ("&gt;", ">"), ("&lt;", "<")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.translate(text, "\r\t\n", "")


def prefix_title(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit(". "), text)


def partial_text(fulltext: Column, length: int) -> Column:
    return F.substring(fulltext, 1, length)


def longer_text(fulltext: Column, description: Column) -> Column:
    return F.when(F.length(fulltext) < F.length(description), description).otherwise(fulltext)


def lead_sentences(text: Column, title: Column, n: int = V.SUMMARY_SENTENCES) -> Column:
    """First ``n`` lines, after dropping the first line if it repeats the title."""
    lines = F.split(text, "\n")
    start = F.when(lines[0] == title, F.lit(2)).otherwise(F.lit(1))
    return F.slice(lines, start, F.lit(n))


def truncate_text(text: Column, n: int = V.EXTRACT_LIMIT) -> Column:
    return F.substring(text, 1, n)


def record_text(fulltext: Column, description: Column, title: Column) -> Column:
    """The text a record is judged by; null if it has neither text nor title."""
    empty = F.lit("")
    text = F.coalesce(F.nullif(fulltext, empty), F.nullif(description, empty))
    heading = F.nullif(title, empty)
    return F.when(text.isNull() & heading.isNull(), F.lit(None)).otherwise(F.concat_ws(". ", heading, text))


def words(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({V.WORD_PATTERN})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Case-preserving tokens: runs of word characters, or single other signs."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))


def token_ngrams(items: Column, low: int, high: int, joiner: str = " ") -> Column:
    """All n-grams of an array of strings for n in ``low..high``."""

    def of(items: Column, n: int) -> Column:
        if n == 1:
            return items
        grams = F.transform(
            F.sequence(F.lit(1), F.size(items) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(items, i, F.lit(n)), joiner),
        )
        return F.when(F.size(items) >= n, grams).otherwise(F.array().cast("array<string>"))

    if low == high == 1:
        return items
    return bind(items, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)]))


def flat(text: Column) -> Column:
    """Lower-cased, with each run of whitespace as one blank."""
    return F.regexp_replace(F.lower(text), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " ")


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Lower-cased character n-grams after collapsing whitespace runs."""

    def of(text: Column, n: int) -> Column:
        if n == 1:
            return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
        return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))

    return bind(flat(text), lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)]))


def add_label_prefix(label: Column) -> Column:
    return F.concat(F.lit(V.LABEL_PREFIX), label)


def drop_label_prefix(label: Column) -> Column:
    return F.substr(label, F.lit(len(V.LABEL_PREFIX) + 1))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\t", "  ")


def fasttext_line(labels: Column, title: Column) -> Column:
    prefixed = F.transform(labels, add_label_prefix)
    return F.concat(F.array_join(prefixed, " "), F.lit(" "), title)


def tag_terms(label: Column) -> Column:
    """Words of one label: parts of a dashed label, parts of a dotted label and
    their joined form, or the label itself; empty parts are dropped."""
    dotted = F.split(label, "[.]")
    terms = (
        F.when(F.contains(label, F.lit("-")), F.split(label, "-"))
        .when(F.contains(label, F.lit(".")), F.concat(dotted, F.array(F.array_join(dotted, ""))))
        .otherwise(F.array(label))
    )
    return F.filter(terms, lambda t: t != "")


def parse_tag_string(tags: Column) -> Column:
    return F.regexp_extract_all(tags, F.lit("<([^>]+)>"), F.lit(1))


def language_name(code: Column) -> Column:
    name = code
    for short, full in V.LANGUAGE_NAMES.items():
        name = F.when(code == short, F.lit(full)).otherwise(name)
    return name


def language_code(code: Column) -> Column:
    value = F.lit(None).cast("int")
    for short, number in V.LANGUAGE_CODES.items():
        value = F.when(code == short, F.lit(number)).otherwise(value)
    return value
