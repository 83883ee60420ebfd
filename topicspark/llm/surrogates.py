"""Personal data replaced by keyed surrogates, with DataFrame functions only.

*Detection.* One pattern finds mentions: mail addresses, telephone numbers, network
addresses, payment cards (13 to 19 digits with a right check digit, also beside other
digits), social security numbers, secrets behind a label (``password=``, ``token = "``)
or of a known form, and names behind a title, whose words are then found in the same
text without a title too. Texts without a digit, an ``@`` or a title are not searched.
*Entities.* A mention has a type and a plain form (digits of a number, a mail address
in lower case), which is the same for all its mentions.
*Surrogates.* A keyed SHA-256 of type and plain form picks characters of the same
kind: digits for digits, letters for letters of the same case and script. A card
keeps its first digit and gets a right check digit, a network address becomes one of
the reserved block 240.0.0.0/4, a mail address moves to a reserved domain. A name is
drawn word by word, whatever its title; only what is shown of a given name gets the
ending of the gender that the title tells. The mention's own format
(spaces, brackets, case) is kept.
*Collision check.* A surrogate that two entities share, or that is some entity's own
plain form, is drawn anew for all but the first, until none is left; after the first
attempts it grows by keyed characters, so that a small format is never used up.
Different entities stay different and equal ones equal, over the whole corpus.

Text without mentions is neither shuffled nor changed. Documents with mentions are
rebuilt from the pieces between them; their mentions, not their texts, meet the table
of entities, with the mentions of hot entities dealt over many tasks. Null and empty
texts stay as they are; repeated rows are rebuilt alike; an empty table stays empty;
all other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import fresh, keyed_join, written

KEY = "surrogate-key"
FORMAT_ROUNDS = 3  # attempts that keep the length of a format; each later one adds keyed characters

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_%+\-][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,}+(?![A-Za-z0-9])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w])(?!\.[0-9])"
PHONE = (
    r"(?<![\w+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![\w])"
)
SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
CARD = r"(?<![\w\-.])[0-9](?:[ \-]?[0-9]){12,18}(?![\w])"
LABEL = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = LABEL + r"(?=[A-Za-z_/+\-]{0,64}[0-9])[A-Za-z0-9_/+\-]{8,}+"
KEY_FORM = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
MALE, FEMALE, EITHER = r"Mr\.?|Herr|Monsieur|Señor|Г-н", r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Г-жа", r"Dr\.?|Prof\.?"
TITLE = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{EITHER}) "
NAME = TITLE + r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}"
KINDS = (("email", EMAIL), ("secret", SECRET), ("secret", KEY_FORM), ("ip", IP), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("name", NAME))
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
WITHOUT_MAIL = "|".join(f"(?:{p})" for k, p in KINDS if k != "email")
# Groups of digits in a row, each no part of a word; and texts in which such a row may
# hold a card beside other digits (a row of four times four digits cannot).
RUN = r"(?<![\w\-.])(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?!\w)(?:[ \-][0-9]++(?!\w))*+"
MIXED = r"(?<![\w\-.])(?=[0-9](?:[ \-]?[0-9]){12})(?=[0-9]++[ \-])(?![0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9])(?![ \-][0-9]))[0-9]"
USUAL = r"\A(?:[0-9]+|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})\z"
WORTH = r"[0-9]|(?:" + "|".join((MALE, FEMALE, EITHER)) + r") \p{Lu}"

_LETTERS = {  # of a script: letters and vowels
    r"\p{IsLatin}": ("abcdefghijklmnopqrstuvwxyz", "aeiou"),
    r"\p{IsCyrillic}": ("абвгдежзийклмнопрстуфхцчшщыэюя", "аеиоуыэюя"),
    r"\p{IsGreek}": ("αβγδεζηθικλμνξοπρστυφχψω", "αεηιουω"),
}


def check_digit_right(digits: Column) -> Column:
    """Luhn's test of a string of digits."""
    turned = F.split(F.reverse(digits), "")
    twice = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    numbers = F.transform(turned, lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.element_at(twice, d + 1)).otherwise(d))
    return digits.rlike(r"\A[0-9]+\z") & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def _digits(mention: Column) -> Column:
    return F.regexp_replace(mention, "[^0-9]", "")


def cards_in(text: Column) -> Column:
    """Cards among the digits of ``text``: in each row of groups the windows of whole
    groups with 13 to 19 digits and a right check digit; of windows that overlap the one
    in a usual form, then the one nearest to 16 digits, then the first."""

    def windows(groups: Column) -> Column:
        def window(i: Column, n: Column) -> Column:
            return bind(
                F.regexp_replace(F.array_join(F.slice(groups, i, n), ""), r"\A[ \-]", ""),
                lambda w: F.struct(
                    (~w.rlike(USUAL)).cast("int").alias("odd"), F.abs(F.length(_digits(w)) - 16).alias("off"), i.alias("first"), (i + n).alias("end"), w.alias("text")
                ),
            )

        count = F.size(groups)
        every = F.flatten(F.transform(F.sequence(F.lit(1), count), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), count - i + 1)), lambda n: window(i, n))))
        return F.array_sort(F.filter(every, lambda w: w["text"].rlike(rf"\A{CARD}\z") & check_digit_right(_digits(w["text"]))))

    def apart(found: Column) -> Column:
        meets = lambda a, w: F.exists(a, lambda x: (x["first"] < w["end"]) & (w["first"] < x["end"]))
        return F.aggregate(found, F.slice(found, 1, 0), lambda a, w: F.when(meets(a, w), a).otherwise(F.concat(a, F.array(w))))

    rows = F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))
    groups = lambda r: F.regexp_extract_all(r, F.lit(r"([ \-]?[0-9]+)"), F.lit(1))
    chosen = F.flatten(F.transform(rows, lambda r: bind(bind(groups(r), windows), apart)))
    return F.array_distinct(F.transform(chosen, lambda w: w["text"]))


def _own_pattern(text: Column) -> Column:
    """The pattern for one text: its cards stand in it as they are, so the digits beside
    them are left to the other patterns, and no telephone number reaches into a card.
    The words of its names stand in it too, so they are found without a title."""
    any_of = lambda words: bind(F.array_join(words, "|"), lambda c: F.when(c == "", F.lit("(?!)")).otherwise(c))
    more = r"(?:[ .\-]?[0-9]{2,4})"
    phone = PHONE.replace(more, rf"(?:(?![ .\-]?(?:CARDS)(?!\w)){more[3:]}")
    own = {"card": r"(?<!\w)(?:CARDS)(?!\w)", "phone": phone}
    whole = "|".join(f"(?:{own.get(k, p)})" for k, p in KINDS) + r"|(?<!\p{L})(?:WORDS)(?!\p{L})"
    titled = F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))
    words = F.array_distinct(F.flatten(F.transform(titled, lambda m: F.split(value_of(m, F.lit("name")), " "))))
    return F.replace(F.replace(F.lit(whole), F.lit("CARDS"), any_of(cards_in(text))), F.lit("WORDS"), any_of(words))


def _both(text: Column, of) -> Column:
    """``of(text, pattern)`` with a pattern of its own for a text of mixed digits or with
    names, and the mail pattern only where there is an ``@``."""
    plain = F.when(F.contains(text, F.lit("@")), of(text, F.lit(PATTERN))).otherwise(of(text, F.lit(WITHOUT_MAIL)))
    return F.when(text.rlike(f"{MIXED}|{NAME}"), of(text, _own_pattern(text))).otherwise(plain)


def mentions(text: Column) -> Column:
    return _both(text, lambda t, p: F.regexp_extract_all(t, F.concat(F.lit("("), p, F.lit(")")), F.lit(1)))


def between(text: Column) -> Column:
    return _both(text, lambda t, p: F.split(t, p, -1))


def kind_of(mention: Column) -> Column:
    """Type of a mention; null for a number that is no card."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS):
        test = mention.rlike(rf"\A(?:{pattern})\z")
        if kind == "card":
            test = test & check_digit_right(_digits(mention))
        found = F.when(test, F.lit(kind)).otherwise(found)
    return found


def value_of(mention: Column, kind: Column) -> Column:
    """The part of a mention that is replaced."""
    return (
        F.when(kind == "secret", F.regexp_replace(mention, rf"\A{LABEL}", ""))
        .when(kind == "name", F.regexp_replace(mention, rf"\A{TITLE}", ""))
        .otherwise(mention)
    )


def gender_of(mention: Column) -> Column:
    return F.when(mention.rlike(rf"\A(?:{MALE}) "), "m").when(mention.rlike(rf"\A(?:{FEMALE}) "), "f").otherwise("")


def typed_mentions(found: Column) -> Column:
    """(mention, kind, gender) of the mentions of a text. A word of a name that stands
    alone has the gender of the first whole name in the text that begins with it."""
    typed = F.transform(found, lambda x: F.struct(x.alias("mention"), kind_of(x).alias("kind")))
    titled = lambda t: F.transform(
        F.filter(t, lambda x: x["kind"] == "name"),
        lambda x: F.struct(F.split(value_of(x["mention"], F.lit("name")), " ").alias("words"), gender_of(x["mention"]).alias("gender")),
    )

    def told(t: Column, names: Column) -> Column:
        words = F.flatten(F.transform(names, lambda n: n["words"]))
        first = lambda w: F.get(F.filter(names, lambda n: (F.size(n["words"]) > 1) & (F.element_at(n["words"], 1) == w) & (n["gender"] != "")), F.lit(0))["gender"]

        def one(x: Column) -> Column:
            value = value_of(x["mention"], F.lit("name"))
            is_name = (x["kind"] == "name") | (x["kind"].isNull() & F.array_contains(words, x["mention"]))
            gender = F.when(F.contains(value, F.lit(" ")), gender_of(x["mention"])).otherwise(F.coalesce(first(value), F.lit("")))
            return F.struct(
                x["mention"].alias("mention"), F.when(is_name, "name").otherwise(x["kind"]).alias("kind"), F.when(is_name, gender).otherwise("").alias("gender")
            )

        return F.transform(t, one)

    named = lambda t: bind(titled(t), lambda names: F.when(F.size(names) == 0, F.transform(t, lambda x: x.withField("gender", F.lit("")))).otherwise(told(t, names)))
    return bind(typed, named)


def plain_form(value: Column, kind: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), _digits(value)).when(kind == "email", F.lower(value)).otherwise(value)


def _stream(kind: Column, plain: Column, attempt: Column, key: str) -> Column:
    """128 keyed numbers from 0 to 255."""
    parts = [F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(k)), attempt.cast("string"), kind, plain), 256) for k in range(4)]
    hexes = F.regexp_extract_all(F.concat(*parts), F.lit("(..)"), F.lit(1))
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))


def _longer(attempt: Column, stream: Column, letters: str) -> Column:
    """Keyed characters to add to a surrogate that still collides after ``FORMAT_ROUNDS``:
    two more at each attempt, so the space of a format is never used up."""
    count = F.least(F.greatest((attempt - FORMAT_ROUNDS + 1) * 2, F.lit(0)), F.lit(128))
    return F.array_join(F.transform(F.slice(F.reverse(stream), F.lit(1), count), lambda n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))), "")


def _same_kind(text: Column, stream: Column, spoken: bool = False) -> Column:
    """Each letter and digit replaced by one of its kind; a text of hex digits stays one.
    ``spoken``: vowels for vowels too."""
    hexes = text.rlike(r"\A[0-9a-f]{16,}\z") & text.rlike("[a-f]")

    def swap(c: Column, i: Column) -> Column:
        at = F.element_at(stream, i % 128 + 1) + F.floor(i / 128).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), (at % len(letters) + 1), F.lit(1))
        low = F.lower(c)
        found = F.when(hexes, pick("0123456789abcdef")).when(c.rlike("[0-9]"), (at % 10).cast("string"))
        for script, (letters, vowels) in _LETTERS.items():
            new = pick(letters)
            if spoken:
                others = "".join(x for x in letters if x not in vowels)
                new = F.when(F.contains(F.lit(vowels), low), pick(vowels)).otherwise(pick(others))
            found = found.when(c.rlike(script), F.when(c == low, new).otherwise(F.upper(new)))
        return found.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _more_name(word: Column, attempt: Column, stream: Column) -> Column:
    """Keyed letters of the word's script to add to a name."""
    more = _longer(attempt, stream, _LETTERS[r"\p{IsLatin}"][0])
    for script, (letters, _) in list(_LETTERS.items())[1:]:
        more = F.when(word.rlike(script), _longer(attempt, stream, letters)).otherwise(more)
    return more


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, plain, n, attempt) with ``drawn``, step by step: each
    column is named, so that no expression is repeated inside another."""
    at = lambda k: F.element_at("stream", k)
    stream = F.col("stream")
    rows = entities.withColumn("stream", _stream(F.col("kind"), F.col("plain"), F.col("attempt"), key))
    longer = lambda letters: _longer(F.col("attempt"), stream, letters)
    latin, digits = _LETTERS[r"\p{IsLatin}"][0], "0123456789"
    rows = rows.withColumn("domain", F.substring_index("plain", "@", -1)).withColumn("same", _same_kind(F.col("plain"), stream))
    rows = rows.withColumn("front", F.regexp_replace("domain", r"(?:\A|\.)[^.]+\.[^.]+\z", ""))
    local = F.concat(_same_kind(F.substring_index("plain", "@", 1), stream), longer(latin))
    front = F.when(F.col("front") == "", F.lit("")).otherwise(F.concat(_same_kind(F.col("front"), stream), F.lit(".")))
    ip = F.concat_ws(".", (at(1) % 15 + 240).cast("string"), *(at(k).cast("string") for k in (2, 3, 4)))
    ip = F.concat_ws(".", ip, F.when(F.col("attempt") >= FORMAT_ROUNDS, longer(digits)))
    rows = rows.withColumn("body", F.concat(F.substring("plain", 1, 1), F.expr("substring(same, 2, length(same) - 2)"), longer(digits)))
    card = F.coalesce(*[F.when(check_digit_right(F.concat("body", F.lit(str(d)))), F.concat("body", F.lit(str(d)))) for d in range(10)])
    name = F.concat(_same_kind(F.col("plain"), stream, spoken=True), _more_name(F.col("plain"), F.col("attempt"), stream))
    drawn = (
        F.when(F.col("kind") == "email", F.concat(local, F.lit("@"), front, F.lit("example.org")))
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "phone", F.concat(F.substring("plain", 1, 1), F.expr("substring(same, 2)"), longer(digits)))
        .when(F.col("kind") == "ssn", F.concat(F.col("same"), longer(digits)))
        .when(F.col("kind") == "name", name)
        .otherwise(F.concat(F.col("same"), F.when(F.col("plain").rlike(r"\A[0-9a-f]+\z"), longer("0123456789abcdef")).otherwise(longer(latin))))
    )
    return rows.select("kind", "plain", "n", "attempt", drawn.alias("drawn"))


def _ending(first: Column, gender: Column) -> Column:
    """What the gender adds to a given name."""
    ends = F.when(gender == "f", "a").when(gender == "m", "o").otherwise("")
    return F.when(first.rlike(r"\p{IsCyrillic}"), F.translate(ends, "ao", "ао")).when(first.rlike(r"\p{IsGreek}"), F.translate(ends, "ao", "αο")).otherwise(ends)


def _apart(kind: Column, drawn: Column) -> Column:
    """What has to differ between entities: of a name the part before all endings, so
    that names stay different with any ending."""
    return F.when(kind == "name", F.regexp_replace(drawn, "[aoаоαο]+$", "")).otherwise(drawn)


def surrogate_table(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, plain, n, attempt, drawn) for all entities of ``found`` (kind, plain), a
    name's words being one each: every entity has a surrogate of its own, which is no
    entity itself."""
    counted = found.groupBy("kind", "plain").agg(F.count(F.lit(1)).alias("n"))
    table = written(_drawn(counted.withColumn("attempt", F.lit(0)), key), "entities")
    while True:  # ends: each attempt after the first few draws from a larger space
        table = table.withColumn("apart", _apart(F.col("kind"), F.col("drawn")))
        taken = table.select("kind", _apart(F.col("kind"), F.col("plain")).alias("apart")).distinct().withColumn("taken", F.lit(True))
        order = Window.partitionBy("kind", "apart").orderBy("attempt", "plain")
        checked = table.withColumn("place", F.row_number().over(order)).join(taken, ["kind", "apart"], "left")
        again = (F.col("place") > 1) | F.col("taken").isNotNull()
        checked = written(checked.select("kind", "plain", "n", "attempt", "drawn", again.alias("again")), "checked")
        if not checked.where("again").limit(1).count():
            return table.drop("apart")
        more = _drawn(checked.where("again").withColumn("attempt", F.col("attempt") + 1), key)
        table = written(checked.where("not again").drop("again").unionByName(more), "entities")


def in_format(mention: Column, kind: Column, value: Column, drawn: Column) -> Column:
    """``drawn`` written as the mention writes its value."""
    digits = F.split(drawn, "")
    spread = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["text"], F.element_at(digits, a["at"])).alias("text"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at"))
        ),
    )
    spread = F.concat(spread["text"], F.substr(drawn, spread["at"]))  # and the digits that were added
    written_as = F.when(kind.isin("phone", "card", "ssn"), spread).when((kind == "email") & (value == F.upper(value)), F.upper(drawn)).otherwise(drawn)
    return F.concat(F.substr(mention, F.lit(1), F.length(mention) - F.length(value)), written_as)


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """The documents with surrogates for all entities, all columns kept; ``count_col``
    names a column to add with the number of mentions replaced."""
    text = F.col(text_col)
    key_a, key_b, found, new = (fresh(docs, n) for n in ("key_a", "key_b", "found", "new"))
    worth = F.coalesce(F.contains(text, F.lit("@")) | text.rlike(WORTH), F.lit(False))
    typed = typed_mentions(mentions(text))
    searched = docs.where(worth).withColumns({key_a: F.xxhash64(text), key_b: F.md5(text)})
    with_found = searched.withColumn(found, typed)
    any_of = lambda c: F.exists(c, lambda x: x["kind"].isNotNull())

    # places of the mentions of each different text
    each = with_found.select(key_a, key_b, found).where(any_of(F.col(found))).dropDuplicates([key_a, key_b])
    each = each.select(key_a, key_b, F.posexplode(found).alias("at", "m")).select(key_a, key_b, "at", "m.mention", "m.kind", "m.gender")
    each = each.withColumn("value", value_of(F.col("mention"), F.col("kind")))
    each = each.withColumn("plain", plain_form(F.col("value"), F.col("kind")))
    each = written(each, "mentions")
    known = each.where(F.col("kind").isNotNull())
    # a name's words are entities each, so a surname is the same behind any given name and title
    parts = F.when(F.col("kind") == "name", F.split("plain", " ")).otherwise(F.array("plain"))
    known = known.select("*", F.posexplode(parts).alias("part", "word")).withColumn("entity", F.concat_ws("|", "kind", "word"))
    table = surrogate_table(known.select("kind", F.col("word").alias("plain")), key)
    named = written(table.select(F.concat_ws("|", "kind", "plain").alias("entity"), "n", "drawn"), "named")
    joined = keyed_join(known, named, "entity", [F.monotonically_increasing_id()], known.count(), "inner")
    is_name = F.col("kind") == "name"
    ended = F.when(is_name & (F.col("part") == 0), F.concat("drawn", _ending(F.col("drawn"), F.col("gender")))).otherwise(F.col("drawn"))
    joined = joined.withColumn("drawn", ended)
    in_words = is_name & F.contains(F.col("value"), F.lit(" "))
    names = joined.where(in_words).groupBy(key_a, key_b, "at", "mention", "kind", "value").agg(F.sort_array(F.collect_list(F.struct("part", "drawn"))).alias("words"))
    names = names.withColumn("drawn", F.array_join(F.transform("words", lambda w: w["drawn"]), " ")).drop("words")
    joined = joined.where(~in_words).select(names.columns).unionByName(names)
    shown = joined.select(key_a, key_b, "at", in_format(F.col("mention"), F.col("kind"), F.col("value"), F.col("drawn")).alias("shown"))
    shown = shown.unionByName(each.where(F.col("kind").isNull()).select(key_a, key_b, "at", F.col("mention").alias("shown")))
    lists = shown.groupBy(key_a, key_b).agg(F.sort_array(F.collect_list(F.struct("at", "shown"))).alias(new))
    lists = lists.withColumn(new, F.transform(new, lambda x: x["shown"]))

    pieces = F.zip_with(between(text), F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    real = F.size(F.filter(found, lambda x: x["kind"].isNotNull()))
    rebuilt = with_found.where(any_of(F.col(found))).join(lists, [key_a, key_b]).withColumn(text_col, F.array_join(pieces, ""))
    same = docs.where(~worth | ~F.coalesce(any_of(typed), F.lit(False)))
    extra = []
    if count_col:
        rebuilt, same = rebuilt.withColumn(count_col, real), same.withColumn(count_col, F.lit(0))
        extra = [count_col]
    columns = [F.col(f"`{c}`") for c in [*docs.columns, *extra]]
    return same.select(columns).unionByName(rebuilt.select(columns))


def with_lengths(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``chars_col`` counted from the text, where the table has it; null for a null text."""
    if chars_col not in docs.columns:
        return docs
    return docs.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
