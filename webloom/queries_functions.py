"""Queries that exercise the scalar functions over whole tables, each with the SQL that checks it."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entity as E
from .functions import text as T
from .functions import url as U
from .runtime import load, one_delivery
from .sources import robots as RB
from .sources import sitemap as SM

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ONE = "(SELECT page_id, any_value(title) title, any_value(text_main) tm, any_value(text_chrome) tc, any_value(url) url, any_value(final_url) fu, any_value(site_id) site_id, any_value(meta) meta, any_value(headers) headers FROM page GROUP BY page_id)"
_W = r"'[a-z0-9][a-z0-9''\-]*'"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return one_delivery(load(spark, d, "page"), "page_id", *cols)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text")


def literals(spark: SparkSession, values: list, name: str = "s") -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def values_sql(values: list, name: str = "s") -> str:
    q = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join(f'({i}, {q(v)})' for i, v in enumerate(values))}) t(i, {name}))"


@query("t01_normalize_ws", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) AS t FROM documents")
def t01(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_ws("text").alias("t"))


@query("t02_words", f"SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), {_W}), ' ') AS words FROM documents")
def t02(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.words("text"), " ").alias("words"))


@query("t03_word_count", f"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), {_W})) AS n FROM documents")
def t03(spark, d):
    return docs(spark, d).select("doc_id", T.word_count("text").alias("n"))


@query(
    "t04_content_tokens",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), {_W}), lambda w: len(w) > 1 AND w NOT IN ({_STOP})))), ' ') AS toks FROM documents",
)
def t04(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.array_sort(T.content_tokens("text")), " ").alias("toks"))


@query(
    "t05_shingles",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {_W}) ws FROM documents),
    g AS (SELECT doc_id, array_to_string(ws[i:i+5], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 2))) i FROM w WHERE len(ws) > 0))
    SELECT d.doc_id, count(DISTINCT s) AS n, coalesce(min(s), '') AS first FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""",
)
def t05(spark, d):
    s = docs(spark, d).select("doc_id", T.shingles("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_min("s"), F.lit("")).alias("first"))


@query(
    "t06_title_heading_jaccard",
    f"""WITH p AS (SELECT page_id, any_value(title) title, any_value(text_main) tm FROM page GROUP BY page_id),
    t AS (SELECT page_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), {_W})) a, list_distinct(regexp_extract_all(lower(coalesce(tm, '')), {_W})) b FROM p)
    SELECT page_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) END::DOUBLE AS j,
      CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(a), 9) END::DOUBLE AS o FROM t""",
)
def t06(spark, d):
    p = pages(spark, d, "title", "text_main").select("page_id", F.array_distinct(T.words("title")).alias("a"), F.array_distinct(T.words("text_main")).alias("b"))
    return p.select("page_id", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("j"), F.round(T.overlap_ratio(F.col("a"), F.col("b")), 9).alias("o"))


_NAMES = ["Apex Commerce Pvt. Ltd.", "Café Zürich", "BMC™ Group", "", None, "Big  Mountain Corp", "Østerby Labs Inc.", "acme", "Acme Technologies", "Zenith Retail", "x®y"]
_LEGAL = ", ".join(f"'{w}'" for w in T.LEGAL_SUFFIXES)
_NORM = "array_to_string(list_filter(string_split(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + _LEGAL + ")), ' ')"


@query("t08_normalize_entity_name", f"SELECT page_id, {_NORM.format('coalesce(title, chr(32))')} AS n FROM {_ONE} p")
def t08(spark, d):
    return pages(spark, d, "title").select("page_id", T.normalize_entity_name("title").alias("n"))


_PAIRS = [("bmc", "big mountain corp"), ("acme", "acme tools"), ("zenith retail", "apex commerce"), ("", "x"), ("apex", "apexline"), ("a b c", "c d e"), ("north star", "star north"), ("b c", "b c d e"), ("red fox inn", "red fox bar")]


@query(
    "t09_names_compatible",
    "WITH p(i, a, b) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS)) + """),
    t AS (SELECT *, string_split(a, ' ') ta, string_split(b, ' ') tb FROM p), u AS (SELECT *, list_distinct(ta) da, list_distinct(tb) db,
      array_to_string(list_transform(ta, lambda x: left(x, 1)), '') ca, array_to_string(list_transform(tb, lambda x: left(x, 1)), '') cb FROM t)
    SELECT i, a = '' OR b = '' OR a = b OR len(list_intersect(da, db)) IN (len(da), len(db)) OR contains(a, b) OR contains(b, a)
      OR (len(ta) = 1 AND len(a) >= 2 AND cb = a) OR (len(tb) = 1 AND len(b) >= 2 AND ca = b)
      OR len(list_intersect(da, db)) >= 0.5 * (len(da) + len(db) - len(list_intersect(da, db))) AS ok FROM u""",
)
def t09(spark, d):
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_PAIRS)], "i int, a string, b string")
    return p.select("i", T.names_compatible("a", "b").alias("ok"))


@query(
    "t10_sentences",
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) t FROM documents),
    c AS (SELECT doc_id, regexp_replace(t, '([.!?]) ([A-Z0-9])', '\1' || chr(30) || '\2', 'g') t FROM s)
    SELECT doc_id, len(list_filter(string_split(t, chr(30)), lambda x: trim(x) <> '')) AS n, max(len(t)) AS chars FROM (SELECT doc_id, t FROM c) GROUP BY doc_id, t""",
)
def t10(spark, d):
    s = docs(spark, d).select("doc_id", T.sentences("text").alias("s"), F.length(T.normalize_ws("text")).cast("long").alias("chars"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), "chars")


_DATES = [
    "made 2024-03-05 and 2026-02-31", "on 3 March 2021, then March 4th, 2022", "23/04/2026 or 04/23/2025 or 03/04/2026", "Sept. 9 2019", "1 Foo 2020", "1889-01-01 2090-01-01", None, "",
    "12 Dec, 2018 and dec 1st, 2017", "31 April 2020 and 2020-12-31",
]
_DATES_WANT = ["2024-03-05", "2021-03-03 2022-03-04", "2026-04-23 2025-04-23", "2019-09-09", "", "", "", "", "2018-12-12 2017-12-01", "2020-12-31"]


@query("t12_find_dates", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_DATES_WANT)) + ") t(i, dates)")
def t12(spark, d):
    x = literals(spark, _DATES)
    found = T.find_dates("s", F.lit("2026-06-15").cast("date"))
    return x.select("i", F.array_join(F.transform(found, lambda v: v.cast("string")), " ").alias("dates"))


@query("t11_find_years", r"SELECT page_id, array_to_string(regexp_extract_all(coalesce(tm, ''), '\b(?:19|20)\d{2}\b'), ' ') AS years FROM " + _ONE + " p")
def t11(spark, d):
    return pages(spark, d, "text_main").select("page_id", F.array_join(F.transform(T.find_years("text_main"), lambda y: y.cast("string")), " ").alias("years"))


_ATTRS = ["2024-05-06 10:00", " 2024-13-01 and 2024-01-02", "May 5, 2023", "", None, "1985-01-01"]


@query("t15_parse_datetime_attr", "SELECT * FROM (VALUES (0, '2024-05-06'), (1, NULL), (2, '2023-05-05'), (3, NULL), (4, NULL), (5, NULL)) t(i, v)")
def t15(spark, d):
    return literals(spark, _ATTRS).select("i", T.parse_datetime_attr("s", F.lit("2026-06-15").cast("date")).cast("string").alias("v"))


_PRICES = ["costs ₹4,999 or $59.00", "EUR 12.50 and £7", "rs. 1 200", "US$3.999", "no price 12", None, "¥ 10,000 jpy 5", "€1.2.3"]
_PRICES_WANT = ["4999 59", "12.5 7", "1200", "3.99", "", "", "10000 5", "1.2"]


@query("t13_find_prices", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_PRICES_WANT)) + ") t(i, prices)")
def t13(spark, d):
    return literals(spark, _PRICES).select("i", F.array_join(T.find_prices("s"), " ").alias("prices"))


_NUMS = ["1,299.00", "12.345", "abc", "", None, "1.2.3", "007", "0.10", "99", ".5"]
_NUMS_WANT = ["1299", "12.35", None, None, None, None, "7", "0.1", "99", "0.5"]


@query("t14_normalize_number", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {repr(v) if v is not None else 'CAST(NULL AS VARCHAR)'})" for i, v in enumerate(_NUMS_WANT)) + ") t(i, v)")
def t14(spark, d):
    return literals(spark, _NUMS).select("i", T.normalize_number("s").alias("v"))


def json_values(block: str | None, wanted: re.Pattern) -> list[str]:
    """Strings and numbers (as written) below keys that match, in document order; broken JSON has none."""
    try:
        todo = [("", json.loads(block or "", parse_float=str, parse_int=str))]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed(v.items()))
        elif isinstance(v, list):
            todo.extend((key, x) for x in reversed(v))
        elif isinstance(v, str) and wanted.search(key):
            out.append(v)
    return out


def declared(spark: SparkSession, d: str, keys: str) -> DataFrame:
    """(page_id, i, s): the values of JSON-LD members and meta entries whose key matches, numbered by page."""
    wanted = re.compile(keys)

    def run(batches):
        for b in batches:
            rows = []
            for page, blocks, meta in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = [v for x in blocks or () for v in json_values(x, wanted)]
                own += [m["value"] for m in meta or () if wanted.search(m["key"]) and m["value"] is not None]
                rows += [(page, i, v.encode("utf-8", "replace").decode()) for i, v in enumerate(own)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string()))], names=["page_id", "i", "s"])

    one = pages(spark, d, "jsonld", F.array_sort(F.map_entries("meta")).alias("meta"))
    return one.select(F.col("page_id").cast("long"), "jsonld", "meta").mapInArrow(run, "page_id long, i int, s string")


@query("t12_find_dates_pages")
def t12_pages(spark, d):
    found = T.find_dates("text_main", F.lit("2026-06-15").cast("date"))
    return pages(spark, d, "text_main").select("page_id", F.array_join(F.transform(found, lambda v: v.cast("string")), " ").alias("dates"))


_AMOUNT = "CAST(regexp_replace(x, '[^0-9.]', '', 'g') AS DOUBLE)"


@query(
    "t13_find_prices_pages",
    r"""SELECT page_id, array_to_string(list_transform(list_filter(regexp_extract_all(coalesce(tm, ''), '(?i)(?:₹|rs\.?|inr|\$|usd|us\$|€|eur|£|gbp|¥|jpy|aud|cad)\s?(\d{1,3}(?:[,\x{202f}\s]\d{2,3})*(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)', 1), lambda x: len(regexp_extract_all(x, '[.]')) <= 1),
    lambda x: CASE WHEN AMOUNT = floor(AMOUNT) THEN printf('%.0f', AMOUNT) ELSE regexp_replace(printf('%.2f', AMOUNT), '0+$', '') END), ' ') AS prices FROM """.replace("\\\\", "\\").replace("AMOUNT", _AMOUNT) + _ONE + " p",
)
def t13_pages(spark, d):
    return pages(spark, d, "text_main").select("page_id", F.array_join(T.find_prices("text_main"), " ").alias("prices"))


@query("t14_normalize_number_pages")
def t14_pages(spark, d):
    return declared(spark, d, r"(?i)price$|price:amount$").select("page_id", "i", T.normalize_number("s").alias("v"))


@query("t15_parse_datetime_attr_pages")
def t15_pages(spark, d):
    day = T.parse_datetime_attr("s", F.lit("2026-06-15").cast("date"))
    return declared(spark, d, r"(?i)^date|[.:_-]date$|(?:modified|published|updated)_time$|^last-modified$").select("page_id", "i", day.cast("string").alias("v"))


@query(
    "t16_timeliness",
    "SELECT page_id, array_to_string(list_filter([" + ", ".join("'" + p.replace("'", "''") + "'" for p in T.TIME_SENSITIVE) + "], lambda p: contains(lower(coalesce(tm, '')), p)), '|') AS hits FROM " + _ONE + " p",
)
def t16(spark, d):
    return pages(spark, d, "text_main").select("page_id", F.array_join(T.has_any("text_main", T.TIME_SENSITIVE), "|").alias("hits"))


@query(
    "t17_nondescriptive_anchors",
    rf"""WITH l AS (SELECT page_id, unnest(links) l FROM (SELECT page_id, any_value(links) links FROM page GROUP BY page_id)),
    t AS (SELECT page_id, regexp_replace(lower(trim(regexp_replace(coalesce(l.text, ''), '\s+', ' ', 'g'))), '^[ .:\-–—>»]+|[ .:\-–—>»]+$', '', 'g') t FROM l)
    SELECT page_id, count(*) AS n, sum(CASE WHEN t IN ({", ".join("'" + x.replace("'", "''") + "'" for x in T.NONDESCRIPTIVE)}) OR len(list_filter(regexp_extract_all(t, {_W}), lambda w: w NOT IN ({_STOP}))) = 0 THEN 1 ELSE 0 END)::BIGINT AS vague FROM t GROUP BY page_id""",
)
def t17(spark, d):
    l = pages(spark, d, "links").select("page_id", F.explode("links").alias("l"))
    return l.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_nondescriptive_anchor("l.text")).alias("vague"))


@query(
    "t18_definitional",
    r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(?:is|are|was|were)\s+(?:a|an|the|one of|india''s|the world''s|our|your|\w+''s)\b|\b(?:provides?|offers?|helps?|enables?|delivers?|specialis[ez]es?|builds?|makes?|sells?|lets you|allows you)\b') AS d FROM documents WHERE regexp_matches(coalesce(text, ''), '^[\x00-\x7F]*$')",
)
def t18(spark, d):
    return docs(spark, d).where(F.coalesce("text", F.lit("")).rlike(r"^[\x00-\x7F]*$")).select("doc_id", T.looks_definitional("text").alias("d"))


@query("t18_definitional_all")
def t18_all(spark, d):
    """All documents; t18_definitional is the ASCII part, where DuckDB's \\b and \\w agree."""
    return docs(spark, d).select("doc_id", T.looks_definitional("text").alias("d"))


@query("t19_truncate", r"WITH t AS (SELECT page_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) t FROM " + _ONE + " p) SELECT page_id, CASE WHEN len(t) <= 24 THEN t ELSE rtrim(left(t, 23)) || '…' END AS t FROM t")
def t19(spark, d):
    return pages(spark, d, "title").select("page_id", T.truncate("title", 24).alias("t"))


# --- Addresses -----------------------------------------------------------------------------------------------------


def _urls_sql(select: str) -> str:
    from .queries import sql_norm

    return f"SELECT entry_id, {select.replace('NORM', sql_norm('loc'))} FROM (SELECT entry_id, any_value(loc) loc FROM sitemap_entry GROUP BY entry_id)"


def locs(spark, d):
    return one_delivery(load(spark, d, "sitemap_entry"), "entry_id", "loc")


_NET = "regexp_replace(lower(regexp_extract(loc, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '')"
_PATH = "regexp_replace(regexp_extract(loc, '^(?:[A-Za-z]+:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def register_urls() -> None:
    """Queries whose SQL needs the address expression of the core queries."""
    SQL.update(
        {
            "u01_normalize_url": _urls_sql("NORM AS u"),
            "u03_url_template": _urls_sql(
                f"'/' || array_to_string(list_transform(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$|^[0-9a-f]{{8,}}$|^.{{25,}}$|\\d{{3,}}') THEN '{{slug}}' ELSE lower(s) END), '/') AS t"
            ),
            "u04_path_importance": _urls_sql(
                "CASE WHEN lower(PATHX) IN ('', '/') THEN 12 ELSE greatest(0, greatest(0, ".replace("PATHX", _PATH)
                + ", ".join(f"CASE WHEN contains(lower({_PATH}), '{h}') THEN {w} ELSE 0 END" for h, w in U.PATH_HINTS)
                + f") - greatest(0, len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) - 2)) END AS v"
            ),
            "u05_key_and_crawlable": _urls_sql(
                f"regexp_matches({_PATH}, '{U.KEY_PAGE}') AS is_key, NOT regexp_matches({_PATH}, '{U.ASSET}') AND NOT regexp_matches(loc, '{U.UTILITY}') AS crawlable"
            ),
            "u09_hosts": _urls_sql(f"{_NET} AS bare"),
        }
    )


@query("u01_normalize_url")
def u01(spark, d):
    return locs(spark, d).select("entry_id", U.normalize_url("loc").alias("u"))


@query("u03_url_template")
def u03(spark, d):
    return locs(spark, d).select("entry_id", U.url_template("loc").alias("t"))


@query("u04_path_importance")
def u04(spark, d):
    return locs(spark, d).select("entry_id", U.path_importance("loc").alias("v"))


@query("u05_key_and_crawlable")
def u05(spark, d):
    return locs(spark, d).select("entry_id", U.is_key_page("loc").alias("is_key"), U.is_crawlable("loc").alias("crawlable"))


@query("u09_hosts")
def u09(spark, d):
    return locs(spark, d).select("entry_id", U.bare_host("loc").alias("bare"))


_URLS = [
    "http://A.test:80/p//q/?utm_source=x&id=7#f", "https://a.test:443", "ftp://a.test/x", "http://a.test/p;v=1?b=&a=1&&ref=2", "HTTP://a.test/%7Euser/?q=a+b&c=%C3%A9", None, "", "/rel",
    " http://a.test/x/ ", "http://a.test/?k", "http://shop.example.co.uk/en/v2/a", "http://127.0.0.1:8000/", "http://localhost/", "https://www.example.com/fr/a", "http://a.test/a%2Fb?x=%zz",
]
_URLS_WANT = [
    "http://a.test/p/q?id=7", "https://a.test/", "", "http://a.test/p?b=&a=1", "http://a.test/%7Euser?q=a+b&c=%C3%A9", "", "", "", "http://a.test/x", "http://a.test/?k=",
    "http://shop.example.co.uk/en/v2/a", "http://127.0.0.1:8000/", "http://localhost/", "https://www.example.com/fr/a", "http://a.test/a%2Fb?x=%25zz",
]
_LABEL = ["a", "a", "a", "a", "a", "", "", "", "a", "a", "example", "", "localhost", "example", "a"]
_VARIANT = ["http://www.a.test:80/", "https://www.a.test:443/", "ftp://www.a.test/", "http://www.a.test/", "http://www.a.test/", "", "", "", "http://www.a.test/", "http://www.a.test/", "http://www.shop.example.co.uk/", "", "", "https://example.com/", "http://www.a.test/"]


@query("u07_address_vectors", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(zip(_URLS_WANT, _LABEL, _VARIANT))) + ") t(i, norm, label, variant)")
def u07(spark, d):
    u = literals(spark, _URLS)
    return u.select("i", U.normalize_url("s").alias("norm"), U.domain_label("s").alias("label"), F.array_join(U.hostname_variants("s"), " ").alias("variant"))


_SITE_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(root_url, '//([^/?#]*)', 1)), ':.*$', ''), '^www[.]', '')"
_TWO = ", ".join(f"'{x}'" for x in ("co.uk", "org.uk", "co.jp", "com.au", "com.br", "co.in", "co.nz", "co.za"))


@query(
    "u07_site_labels",
    f"""WITH h AS (SELECT site_id, root_url, lower(regexp_extract(root_url, '//([^/?#]*)', 1)) net, string_split({_SITE_HOST}, '.') p FROM site)
    SELECT site_id, CASE WHEN len(p) < 2 THEN p[1] WHEN len(p) >= 3 AND p[-2] || '.' || p[-1] IN ({_TWO}) THEN p[-3] ELSE p[-2] END AS label,
    CASE WHEN starts_with(net, 'www.') THEN regexp_extract(lower(root_url), '^([a-z]+)://', 1) || '://' || net[5:] || '/' WHEN contains(net, '.') THEN regexp_extract(lower(root_url), '^([a-z]+)://', 1) || '://www.' || net || '/' ELSE '' END AS variant FROM h""",
)
def u07_sites(spark, d):
    """The brand label of every site's host, and the other form of the host."""
    return load(spark, d, "site").select("site_id", U.domain_label("root_url").alias("label"), F.array_join(U.hostname_variants("root_url"), " ").alias("variant"))


_VAR = [("http://a.test/v1/x", "http://a.test/v2/x", True), ("http://a.test/en/x", "http://a.test/fr/x", True), ("http://a.test/x", "http://a.test/y", False), ("http://a.test/x", "http://www.a.test/x/", False), ("http://a.test/en/x", "http://a.test/x", True), ("http://a.test/latest/x", "http://a.test/3.1/x", True)]
_TRIV = [False, False, False, True, False, False]


@query("u10_variants", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {v[2]}, {t})" for i, (v, t) in enumerate(zip(_VAR, _TRIV))) + ") t(i, variant, trivial)")
def u10(spark, d):
    p = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_VAR)], "i int, a string, b string")
    return p.select("i", U.variant_pair("a", "b").alias("variant"), U.differs_only_trivially("a", "b").alias("trivial"))


# --- Names, robots, sitemaps ------------------------------------------------------------------------------------------


@query("h21_meta_get", "SELECT page_id, coalesce(nullif(meta['og:site_name'], ''), nullif(meta['application-name'], ''), '') AS v FROM " + _ONE + " p")
def h21(spark, d):
    return pages(spark, d, "meta").select("page_id", E.meta_get("meta", "og:site_name", "application-name").alias("v"))


_PARTS_OF = "CASE WHEN coalesce({0}, '') = '' THEN [] ELSE list_transform(string_split({0}, ','), lambda x: lower(trim(x))) END"


@query(
    "h22_robots_directives",
    "SELECT page_id, array_to_string(list_concat(list_concat(" + _PARTS_OF.format("meta['robots']") + ", " + _PARTS_OF.format("meta['googlebot']") + "), " + _PARTS_OF.format("headers['x-robots-tag']") + "), ' ') AS v FROM " + _ONE + " p",
)
def h22(spark, d):
    return pages(spark, d, "meta", "headers").select("page_id", F.array_join(E.robots_directives("meta", "headers"), " ").alias("v"))


@query("n02_title_parts", r"SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(title, ''), '\s*[|–—·•:]\s*|\s+-\s+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM " + _ONE + " p")
def n02(spark, d):
    return pages(spark, d, "title").select("page_id", F.array_join(E.split_title("title"), "|").alias("parts"))


@query("n03_copyright_holder", r"SELECT page_id, trim(regexp_extract(coalesce(tc, ''), '(?i)(?:©|\(c\)|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*,?\s*([A-Z][A-Za-z0-9&''’.\- ]{1,50})', 1), ' .,') AS holder FROM " + _ONE + " p")
def n03(spark, d):
    return pages(spark, d, "text_chrome").select("page_id", E.copyright_holder("text_chrome").alias("holder"))


_ROBOTS = "User-agent: *\nDisallow: /private/ # not here\nDisallow: /p*\nAllow: /p/ok\n\nUser-agent: Bot\nDisallow: /x$\nCrawl-delay: 2\nSitemap: http://a.test/s.xml"


@query("s05_robots_lines", "SELECT * FROM (VALUES (0, '*', 'user-agent', '*'), (1, '*', 'disallow', '/private/'), (2, '*', 'disallow', '/p*'), (3, '*', 'allow', '/p/ok'), (5, 'bot', 'user-agent', 'Bot'), (6, 'bot', 'disallow', '/x$'), (7, 'bot', 'crawl-delay', '2'), (8, 'bot', 'sitemap', 'http://a.test/s.xml')) t(line_no, agent, field, value)")
def s05(spark, d):
    r = spark.createDataFrame([(1, 200, _ROBOTS)], "site_id long, status int, text string")
    return RB.robots_lines(r).select("line_no", "agent", "field", "value")


@query("s07_blocking_rules", "SELECT * FROM (VALUES ('http://a.test/private/a', '/private/'), ('http://a.test/pq', '/p*'), ('http://a.test/x', '/x$')) t(url, rule)")
def s07(spark, d):
    r = spark.createDataFrame([(1, 200, _ROBOTS)], "site_id long, status int, text string")
    u = spark.createDataFrame([(1, x) for x in ("http://a.test/private/a", "http://a.test/pq", "http://a.test/x", "http://a.test/ok")], "site_id long, url string")
    return RB.blocking_rules(RB.robots_lines(r), u).select("url", "rule")


@query("s06_robots_allowed", "SELECT * FROM (VALUES ('http://a.test/private/a', false), ('http://a.test/ok', true), ('http://b.test/z', true)) t(url, allowed)")
def s06(spark, d):
    r = spark.createDataFrame([(1, 200, _ROBOTS)], "site_id long, status int, text string")
    u = spark.createDataFrame([(1, "http://a.test/private/a"), (1, "http://a.test/ok"), (2, "http://b.test/z")], "site_id long, url string")
    return RB.allowed(r, u).select("url", "allowed")


@query("s04_robots_state", "SELECT status, count(*) AS n, CASE WHEN status BETWEEN 200 AND 299 AND trim(b) <> '' THEN 'present' WHEN status BETWEEN 200 AND 299 OR status IN (404, 410) THEN 'absent' ELSE 'unknown' END AS state FROM (SELECT coalesce(status, 0) status, coalesce(body, '') b FROM capture) GROUP BY ALL")
def s04(spark, d):
    c = load(spark, d, "capture").select(F.coalesce("status", F.lit(0)).alias("status"), "body")
    return c.groupBy("status", RB.robots_state(F.col("status"), F.col("body")).alias("state")).agg(F.count(F.lit(1)).alias("n")).select("status", "n", "state")


_MAPS = ["<urlset><url><loc> http://a.test/1 </loc><lastmod>2024</lastmod></url><url><loc>http://a.test/2?a&amp;b</loc></url></urlset>", "<sitemapindex><sitemap><loc>http://a.test/s2.xml</loc></sitemap></sitemapindex>", "not xml <loc>http://a.test/3</loc>", "<urlset><url><loc>http://a.test/4</loc>", None]


@query("s08_parse_sitemap", "SELECT * FROM (VALUES (0, false, 'http://a.test/1 http://a.test/2?a&b', 1), (1, true, 'http://a.test/s2.xml', 0), (2, false, '', 0), (3, false, 'http://a.test/4', 0), (4, false, '', 0)) t(i, is_index, locs, n_lastmod)")
def s08(spark, d):
    m = literals(spark, _MAPS).withColumn("p", SM.parse_sitemap("s"))
    return m.select("i", F.col("p.is_index").alias("is_index"), F.array_join("p.locs", " ").alias("locs"), SM.count_lastmod("s").alias("n_lastmod"))


@query("n05_ambiguous_names", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false)) t(i, ambiguous)")
def n05(spark, d):
    return literals(spark, ["acme", "blue river", "blue riverton", "", None]).select("i", E.name_is_ambiguous("s").alias("ambiguous"))


@query(
    "h26_rendering",
    "SELECT * FROM (VALUES (0, 'server_rendered'), (1, 'likely_client_rendered'), (2, 'interaction_required'), (3, 'server_rendered_thin'), (4, 'likely_client_rendered'), (5, 'verified_after_render')) t(i, kind)",
)
def h26(spark, d):
    rows = [(0, 150, 0, False, 0, 100, 0, None), (1, 10, 0, True, 0, 100, 0, None), (2, 20, 90, False, 0, 100, 0, None), (3, 20, 10, False, 0, 100, 0, None), (4, 20, 0, False, 50, 100, 3, None), (5, 20, 0, True, 0, 100, 0, 400)]
    x = spark.createDataFrame(rows, "i int, v int, h int, e boolean, s int, b int, t int, r int")
    base = E.rendering_classification(F.col("v"), F.col("h"), F.col("e"), F.col("s"), F.col("b"), F.col("t"))
    return x.select("i", E.rendering_of(base, F.col("v"), F.col("r")).alias("kind"))
