"""Functions against values worked out by hand, and against the standard library where it says the same."""

import re
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import entity as E
from webloom.functions import text as T
from webloom.functions import url as U


def one(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def python_form(u):
    """Comparison form by the standard library: the yardstick for the column expression."""
    if not u:
        return ""
    p = urlparse(u.strip())
    if p.scheme not in ("http", "https"):
        return ""
    net = p.netloc.lower()
    for s, port in (("http", ":80"), ("https", ":443")):
        if p.scheme == s and net.endswith(port):
            net = net[: -len(port)]
    path = re.sub("/{2,}", "/", p.path or "/")
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    q = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not re.match(U.TRACKING, k)]
    return urlunparse((p.scheme, net, path, "", urlencode(q), ""))


PART = st.text("abAB01-_.~%+=&;/é ", max_size=12)


@settings(max_examples=6, deadline=None, derandomize=True, phases=[Phase.generate])
@given(st.lists(st.tuples(st.sampled_from(["http", "https", "HTTP", "ftp"]), PART, PART), min_size=20, max_size=40))
def test_normalize_url_as_standard_library(spark, parts):
    urls = [f"{s}://Host.test{':80' if i % 3 == 0 else ''}/{p}?{q}" for i, (s, p, q) in enumerate(parts)]
    got = one(spark, [(u,) for u in urls], "u string", U.normalize_url("u"))
    again = one(spark, [(g[0],) for g in got], "u string", U.normalize_url("u"))
    for u, (g,), (twice,) in zip(urls, got, again):
        assert g == python_form(u), u
        if ";" not in u and " " not in u:
            assert twice == g  # a comparison form is its own comparison form


def test_null_url_is_empty(spark):
    r = one(spark, [(None,)], "u string", U.normalize_url("u"), U.url_template("u"), U.path_importance("u"), U.is_key_page("u"), U.domain_label("u"))
    assert r == [("", "/", 12, False, "")]


def test_same_site_and_template(spark):
    r = one(
        spark, [("http://www.a.test/Blog/2026-my-long-post-name-here-x", "https://a.test/")], "a string, b string",
        U.same_site("a", "b"), U.url_template("a"), U.differs_only_trivially("a", "b"),
    )
    assert r == [(True, "/blog/{slug}", False)]


def test_text_basics(spark):
    s = "The torque of the wrench"
    r = one(spark, [(s,), (None,), ("",)], "s string", T.content_tokens("s"), T.word_count("s"), F.size(T.shingles("s")), T.truncate("s", 10))
    assert r[0] == (["torque", "wrench"], 5, 1, "The torqu…")
    assert r[1] == r[2] == ([], 0, 0, "")


def test_jaccard_edges(spark):
    r = one(
        spark, [([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>",
        F.round(T.jaccard(F.col("a"), F.col("b")), 4), F.round(T.overlap_ratio(F.col("a"), F.col("b")), 4),
    )
    assert r == [(1.0, 1.0), (0.0, 0.0), (0.3333, 0.5)]


def test_names(spark):
    r = one(spark, [("Apex Commerce Pvt. Ltd.",), ("Café Zürich",), (None,)], "s string", T.normalize_entity_name("s"))
    assert r == [("apex commerce",), ("cafe zurich",), ("",)]


def test_anchor_labels(spark):
    labels = ["Read more »", "here", "Torque wrench guide", "", None, "the", "->"]
    r = one(spark, [(x,) for x in labels], "s string", T.is_nondescriptive_anchor("s"))
    assert [x[0] for x in r] == [True, True, False, True, True, True, True]


def test_mentions(spark):
    rows = [("blue river", "Profile of Blue River Ltd"), ("blue river", "blueriver on x"), ("blue river", "someone else entirely here today"), ("", "x")]
    r = one(spark, rows, "n string, h string", E.mentions_name(F.col("n"), F.col("h")))
    assert [x[0] for x in r] == [True, True, False, False]


def test_very_long_text(spark):
    r = one(spark, [("word " * 200_000,)], "s string", T.word_count("s"), F.size(T.content_tokens("s")))
    assert r == [(200_000, 1)]


def test_definitional_over_all_documents(spark, tmp_path):
    from webloom.queries_functions import QUERIES

    texts = [
        "Résumé – Müller is a baker", "It’s ours: Zoë provides bread", "naïve text without any", "Ärzte's", "the café is\u00a0the best", "éoffers nothing", "東京 is one of many",
        "plain, it sells tea", "plain", "", None, "İzmir’s shop was the world's first", "ünis a", "Łódź is Łukasz's town",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, QUERIES["t18_definitional_all"](spark, str(tmp_path)).collect()))
    form = re.compile(
        r"\b(?:is|are|was|were)\s+(?:a|an|the|one of|india's|the world's|our|your|\w+'s)\b|"
        r"\b(?:provides?|offers?|helps?|enables?|delivers?|specialis[ez]es?|builds?|makes?|sells?|lets you|allows you)\b", re.I,
    )
    assert got == {i: bool(form.search(t or "")) for i, t in enumerate(texts)}


def test_dates_and_prices_of_pages(spark, tmp_path):
    from webloom.queries_functions import QUERIES, _DATES, _DATES_WANT, _PRICES, _PRICES_WANT

    ld = ['{"offers": [{"price": "\\u20ac1,299.00"}, {"lowPrice": 12.345, "priceCurrency": "EUR"}], "datePublished": "2024-05-06 10:00"}', "{", None]
    rows = [(i, x, ld if i == 0 else None, {"article:modified_time": "May 5, 2023"} if i == 0 else None) for i, x in enumerate(_DATES + _PRICES)]
    spark.createDataFrame(rows, "page_id long, text_main string, jsonld array<string>, meta map<string,string>").write.parquet(f"{tmp_path}/page.parquet")
    got = {q: sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) for q in QUERIES if re.match("t1[2-5].*_pages$", q)}
    n = len(_DATES)
    assert [v for _, v in got["t12_find_dates_pages"]][:n] == _DATES_WANT
    assert [v for _, v in got["t13_find_prices_pages"]][n:] == _PRICES_WANT
    assert got["t14_normalize_number_pages"] == [(0, 0, "1299"), (0, 1, "12.35")]
    assert got["t15_parse_datetime_attr_pages"] == [(0, 0, "2024-05-06"), (0, 1, "2023-05-05")]
