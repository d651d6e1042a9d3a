"""Text functions as Column expressions: built-in functions only, nulls count as ''.

Python's regular expressions read \\s, \\b and \\w as Unicode, Java's do so with (?U), which the patterns here carry
where it matters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content of their own.
STOPWORDS = (
    "a an the and or but if of to in on for with at by from as is are was were be been being it its this that these "
    "those you your we our us they their he she his her i me my not no yes can will just do does did have has had more "
    "most other some such than then so too very all any each how what when where which who why about into over up down "
    "out off again further once here there also"
).split()
# Parts of a firm's name that do not tell it apart.
LEGAL_SUFFIXES = (
    "inc inc. llc l.l.c ltd ltd. limited pvt pvt. private corp corp. corporation gmbh plc co co. company sa s.a bv b.v ag "
    "srl oy ab as group holdings technologies labs"
).split()
# Month names and short forms.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11,
    "nov": 11, "december": 12, "dec": 12,
}
# Phrases that claim currency, and that name things that change.
TIME_SENSITIVE = (
    "latest", "current", "currently", "today", "this week", "this month", "right now", "as of", "up to date", "up-to-date",
    "newest", "just launched", "today's", "updated daily", "last updated", "most recent",
)
VOLATILE = (
    "in stock", "out of stock", "availability", "price", "pricing", "offer", "discount", "delivery", "shipping", "sale",
    "book now", "seats",
)
# Link labels that name no destination.
NONDESCRIPTIVE = (
    "", "here", "click here", "click", "read more", "learn more", "more", "more info", "details", "view", "view more",
    "see more", "link", "this", "continue", "go", "next", "previous", ">", "<", "»", "«", "→", "...", "…", "read",
    "show more", "explore", "discover", "find out more",
)
# Patterns of currency amounts, years, dates and defining sentences.
CURRENCY = (
    r"(?i)(?:₹|rs\.?|inr|\$|usd|us\$|€|eur|£|gbp|¥|jpy|aud|cad)(?U:\s)?"
    r"(\d{1,3}(?:[,\x{202f}\s]\d{2,3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
)
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
ISO_DATE = r"(?U)\b(\d{4}-\d{2}-\d{2})\b"
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
TEXT_DATE = (
    rf"(?iU)\b((?:\d{{1,2}}\s+(?:{_MONTH})\.?\,?\s+\d{{4}})|(?:(?:{_MONTH})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\,?\s+\d{{4}}))\b"
)
NUMERIC_DATE = r"(?U)\b(\d{1,2}/\d{1,2}/\d{4})\b"
DEFINITIONAL = (
    r"(?iU)\b(?:is|are|was|were)\s+(?:a|an|the|one of|india's|the world's|our|your|\w+'s)\b|"
    r"\b(?:provides?|offers?|helps?|enables?|delivers?|specialis[ez]es?|builds?|makes?|sells?|lets you|allows you)\b"
)
WORD = r"([a-z0-9][a-z0-9'\-]*)"


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside another higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_ws(c: Column | str) -> Column:
    """Runs of white space as single blanks, none at the ends. Compatibility forms (NFKC) are folded where text is
    extracted; Spark has no function for them."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\s+", " "), "^ | $", "")


def words(c: Column | str) -> Column:
    """Lower-case ASCII words with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(1))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.lower(_c(c)), F.lit(WORD))


def content_tokens(c: Column | str) -> Column:
    """Distinct words of two letters or more that are no stop words."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def shingles(c: Column | str, size: int = 6) -> Column:
    """Distinct word sequences of the given size; a shorter text is one sequence, an empty one has none."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return (
            F.when(n >= size, F.array_distinct(grams))
            .when(n > 0, F.array(F.array_join(w, " ")))
            .otherwise(F.array().cast("array<string>"))
        )

    return bind(words(c), cut)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct strings: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's elements that b has too; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _accent_table() -> tuple[str, str]:
    """Letters that decompose to one ASCII letter and marks, and those letters; by rule, from the Unicode database."""
    src, dst = [], []
    for a, b in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(a, b):
            plain = "".join(x for x in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(x))
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                src.append(chr(cp))
                dst.append(plain)
    return "".join(src), "".join(dst)


_ACCENTS = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Latin letters without accents, combining marks dropped."""
    return F.regexp_replace(F.translate(_c(c), *_ACCENTS), r"\p{Mn}+", "")


def normalize_entity_name(c: Column | str) -> Column:
    """A brand's name for comparison: no accents, case, marks and legal forms."""
    s = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " ")
    return F.array_join(F.filter(F.split(s, " "), lambda t: (t != "") & ~t.isin(*LEGAL_SUFFIXES)), " ")


def names_compatible(a: Column | str, b: Column | str) -> Column:
    """Whether two normalised names may stand for one entity: one is empty, they are equal, one's words or letters lie
    within the other's, one is the other's acronym, or half their words are shared."""
    a, b = _c(a), _c(b)
    ta, tb = F.split(a, " "), F.split(b, " ")
    da, db = F.array_distinct(ta), F.array_distinct(tb)
    acronym = lambda t: F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), "")
    short = lambda t, other: (F.size(t) == 1) & (F.length(t[0]) >= 2) & (acronym(other) == t[0])
    return (
        (a == "") | (b == "") | (a == b)
        | (F.size(F.array_except(da, db)) == 0) | (F.size(F.array_except(db, da)) == 0)
        | a.contains(b) | b.contains(a) | short(ta, tb) | short(tb, ta)
        | (jaccard(da, db) >= 0.5)
    )


def sentences(c: Column | str) -> Column:
    """Pieces of a text cut after . ! ? before a capital letter or a figure."""
    return F.filter(F.split(normalize_ws(c), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s) != "")


def find_years(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(c), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def _checked(d: Column, as_of: Column) -> Column:
    return F.when((F.year(d) >= 1990) & (F.year(d) <= F.year(as_of) + 2), d)


def _iso(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def find_dates(c: Column | str, as_of: Column) -> Column:
    """Dates of a text in three groups: ISO, with a month's name, in figures with slashes where day and month can't be
    mistaken; only real dates from 1990 to two years after as_of."""
    text = _c(c)
    month = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])

    def named(x: Column) -> Column:
        p = F.split(F.regexp_replace(F.lower(x), r"[.,]", " "), r"(?U)\s+")
        first = F.try_element_at(p, F.lit(1))
        second = F.try_element_at(p, F.lit(2))
        day = F.regexp_extract(F.when(first.rlike(r"^\d"), first).otherwise(second), r"^(\d+)", 1)
        name = F.when(first.rlike(r"^\d"), second).otherwise(first)
        return _iso(F.try_element_at(p, F.lit(3)), F.try_element_at(month, name), day)

    def figures(x: Column) -> Column:
        p = F.transform(F.split(x, "/"), lambda v: v.cast("int"))
        a, b, y = p[0], p[1], p[2]
        return F.when((a > 12) & (b <= 12), _iso(y, b, a)).when((b > 12) & (a <= 12), _iso(y, a, b))

    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd")),
        F.transform(F.regexp_extract_all(text, F.lit(TEXT_DATE), F.lit(1)), named),
        F.transform(F.regexp_extract_all(text, F.lit(NUMERIC_DATE), F.lit(1)), figures),
    )
    return F.filter(F.transform(found, lambda d: _checked(d, as_of)), lambda d: d.isNotNull())


def parse_datetime_attr(c: Column | str, as_of: Column) -> Column:
    """The date of an attribute: its first ISO date, valid or not, else the first date of any form."""
    iso = F.regexp_extract(_c(c), ISO_DATE, 1)
    return F.when(iso != "", _checked(F.try_to_date(iso, "yyyy-MM-dd"), as_of)).otherwise(
        F.try_element_at(find_dates(c, as_of), F.lit(1))
    )


def normalize_number(c: Column | str) -> Column:
    """Digits and point of a number, whole numbers without decimals, others with two at most; null if it is none."""
    s = F.regexp_replace(_c(c), r"[^0-9.]", "")
    v = s.try_cast("double")
    whole = F.format_string("%.0f", v)
    two = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", v), "0+$", ""), r"\.$", "")
    return F.when((s == "") | (F.regexp_count(s, F.lit(r"\.")) > 1) | v.isNull(), F.lit(None)).when(v == F.floor(v), whole).otherwise(two)


def find_prices(c: Column | str) -> Column:
    """Normalised amounts that follow a currency sign or code."""
    raw = F.regexp_extract_all(_c(c), F.lit(CURRENCY), F.lit(1))
    return F.filter(F.transform(raw, normalize_number), lambda x: x.isNotNull())


def has_any(c: Column | str, phrases) -> Column:
    """Those of the phrases, in their order, that the lower-cased text contains."""
    low = F.lower(_c(c))
    return F.filter(_strings(phrases), lambda p: F.contains(low, p))


def is_nondescriptive_anchor(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(normalize_ws(c)), r"^[ .:\-–—>»]+|[ .:\-–—>»]+$", "")
    return t.isin(*NONDESCRIPTIVE) | (F.size(F.filter(words(t), lambda w: ~w.isin(*STOPWORDS))) == 0)


def looks_definitional(c: Column | str) -> Column:
    return _c(c).rlike(DEFINITIONAL)


def truncate(c: Column | str, limit: int = 220) -> Column:
    t = normalize_ws(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))
