"""The catalogue of rules as hits, and hits as findings.

A rule yields hits: rows (site, rule, kind, order, address, observation, measurement, ...). All page-level rules of
all sites are branches of one union over the same derived pages; what a site's hits amount to (does the rule fire, how
severe, how sure) is one CASE over counts of kinds joined to the site's measures. Evidence lists are cut by a window
before they are gathered, so no site's hits are ever collected as a whole.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entity as E
from ..functions import text as T
from ..functions import url as U
from ..operators.similarity import first_unlike, prefix_join
from ..runtime import shared_table
from ..sources.robots import allowed, blocking_rules
from . import evidence as V
from .evidence import Audit

#: Pieces of evidence and addresses a finding lists.
EVIDENCE, URLS = 6, 25
#: Referring pages and untitled pages that evidence names; all of them count.
NAMED = 3
# Phrases that claim to be current, and types of nodes that offer something.
CLAIMS_NOW = ("latest", "current", "currently", "up to date", "up-to-date", "today", "newest", "as of")
PRODUCT = ("Product", "Offer", "AggregateOffer", "Service", "Event", "Course")

HIT = "site_id long, rule string, kind string, ord long, url string, observation string, measurement string, core boolean, x double, urls array<string>"


def hits(df: DataFrame, rule: str, kind: str | Column, observation: str, measurement: Column, ord_="page_ord", url="final_url", core="is_core", x=None, urls=None, shown: Column | None = None) -> DataFrame:
    """df rows as hits; shown: whether a hit is evidence (all by default), others only count."""
    u = F.col(url) if isinstance(url, str) else url
    note = F.lit(observation) if shown is None else F.when(shown, observation)
    return df.select(
        F.col("site_id").cast("long").alias("site_id"), F.lit(rule).alias("rule"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (F.col(ord_) if isinstance(ord_, str) else ord_).cast("long").alias("ord"), u.alias("url"), note.alias("observation"), measurement.alias("measurement"),
        F.coalesce(F.col(core) if isinstance(core, str) else core, F.lit(False)).alias("core"), (F.lit(None) if x is None else x).cast("double").alias("x"),
        (F.array(u) if urls is None else urls).alias("urls"),
    )


def _fmt(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[F.col(c) if isinstance(c, str) else c for c in cols])


# --- Reach and extraction ---------------------------------------------------------------------------------------


def mr001(a: Audit) -> DataFrame:
    """Discovered content addresses that robots.txt disallows."""
    root = a.site.select("site_id", U.normalize_url("root_url").alias("url"), "root_url")
    cand = root.select("site_id", "url", F.lit(0).alias("listed")).unionByName(a.sitemap_urls.select("site_id", F.col("url_norm").alias("url"), F.lit(1).alias("listed")))
    cand = cand.unionByName(a.edges.select("site_id", F.col("dst").alias("url"), F.lit(0).alias("listed")))
    cand = cand.join(a.robots.where("length(text) > 0").select("site_id").distinct(), "site_id", "left_semi")
    cand = cand.groupBy("site_id", "url").agg(F.max("listed").alias("listed")).where("url <> ''")
    own = cand.join(root.withColumnRenamed("url", "root_norm"), "site_id").where(U.same_site("url", "root_url") & U.is_crawlable("url"))
    no = own.join(allowed(a.robots, own.select("site_id", "url")), ["site_id", "url"]).where("NOT allowed")
    from ..sources.robots import robots_lines

    rules = blocking_rules(robots_lines(a.robots), no.select("site_id", "url"))
    no = no.join(rules, ["site_id", "url"], "left")
    at_root = F.col("url") == F.col("root_norm")
    kind = F.when(at_root, "root").when(F.col("listed") == 1, "listed").otherwise("linked")
    rule = F.coalesce(F.concat(F.lit("Disallow: "), F.col("rule")), F.lit("Disallow"))
    # Evidence is listed by address: all hits have one order, and the address breaks the tie.
    return hits(no.withColumn("r", rule), "MR-001", kind, "robots.txt disallows a content address", _fmt("rule: %s", "r"), F.lit(0), "url", at_root, (F.col("listed")))


def mr002(a: Audit) -> DataFrame:
    p = a.content.where(F.arrays_overlap("directives", F.array(F.lit("noindex"), F.lit("none"))))
    m = _fmt("directives: %s", F.array_join("directives", ", "))
    return hits(p, "MR-002", "page", "the page keeps itself out of indexes", m, core=F.col("is_core") | F.col("is_target"))


def broken_targets(a: Audit) -> DataFrame:
    """(site_id, url_norm, status, rk, referrer): destinations that failed with 400 or more but 429, a row for every page
    that refers to them, numbered by address or as a link check tells them; a check's result stands before a fetch's."""
    f = U.with_normalized(a.failure.where("status >= 400 AND status <> 429"), url_norm="url").select("site_id", "url_norm", "status", (F.col("source") == "check").alias("checked"), "referrers")
    f = f.where("url_norm <> ''").groupBy("site_id", "url_norm").agg(F.max(F.struct("checked", "status", "referrers")).alias("f")).select("site_id", "url_norm", "f.*")
    told = f.where("checked").select("site_id", "url_norm", "status", F.posexplode("referrers").alias("at", "referrer"))
    told = told.select("site_id", "url_norm", "status", (F.col("at") + 1).alias("rk"), U.normalize_url("referrer").alias("referrer"))
    bare = f.where("NOT checked").select("site_id", "url_norm", "status")
    e = a.edges.select("site_id", F.col("dst").alias("url_norm"), F.col("src").alias("referrer")).join(bare, ["site_id", "url_norm"])
    e = e.select("site_id", "url_norm", "status", F.row_number().over(Window.partitionBy("site_id", "url_norm").orderBy("referrer")).alias("rk"), "referrer")
    return told.unionByName(e)


def mr003(a: Audit) -> DataFrame:
    """A hit for every destination that fails. It is one of the home page if that is any of its referrers; the text names
    the first of them and counts the rest."""
    b = broken_targets(a).join(a.home.select("site_id", "home_norm"), "site_id", "left")
    b = b.groupBy("site_id", "url_norm", "status").agg(
        F.max(F.coalesce(F.col("referrer") == F.col("home_norm"), F.lit(False))).alias("from_home"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("rk") <= NAMED, F.struct("rk", "referrer")))).alias("named"),
    )
    kind = F.when(F.col("from_home"), "home").otherwise("page")
    rest = F.when(F.col("n") > NAMED, _fmt(" and %d more", F.col("n") - NAMED)).otherwise("")
    m = F.concat(_fmt("status %d, linked from %s", "status", F.array_join(F.col("named.referrer"), ", ")), rest)
    # Evidence is listed by address: all hits have one order, and the address breaks the tie.
    return hits(b, "MR-003", kind, "a linked destination fails", m, F.lit(0), "url_norm", U.path_importance("url_norm") >= 8)


def mr004(a: Audit) -> DataFrame:
    c = a.content.where("canonical_norm <> ''")
    bad = a.failure.where("status >= 400").select("site_id", U.normalize_url("url").alias("canonical_norm")).distinct().withColumn("failed", F.lit(True))
    away = c.where((F.col("canonical_norm") != F.col("url_norm")) & ~F.col("final_url").rlike(V.PAGINATION) & ~U.differs_only_trivially("canonical_norm", "url_norm"))
    away = away.join(bad, ["site_id", "canonical_norm"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    a1 = hits(away.where("failed"), "MR-004", "failed", "the canonical address does not resolve", _fmt("canonical=%s", "canonical"))
    other = away.where(~F.col("failed") & (U.bare_host("canonical_norm") != "") & (U.bare_host("canonical_norm") != U.bare_host("root_url")))
    a2 = hits(other, "MR-004", "host", "the canonical address is on another host", _fmt("canonical=%s", "canonical"))
    # Of pages with one address the last stands for them, at the place of the first.
    w = Window.partitionBy("site_id", "canonical_norm", "url_norm")
    u = c.select("site_id", "canonical_norm", "url_norm", "page_ord", "final_url", "is_core", "words_main", "text_main")
    u = u.withColumn("pos", F.min("page_ord").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.col("page_ord").desc()))).where("rk = 1")
    u = u.withColumn("n_urls", F.count(F.lit(1)).over(Window.partitionBy("site_id", "canonical_norm"))).where("n_urls > 1")
    rows = u.select("site_id", "canonical_norm", "pos", F.col("words_main").alias("n"), T.shingles("text_main").alias("grams"))
    pair = first_unlike(rows, ["site_id", "canonical_norm"], "pos", "grams", 0.6, (F.col("n_a") < 60) & (F.col("n_b") < 60))
    who = u.select("site_id", "canonical_norm", "pos", "final_url", "is_core")
    pair = pair.join(who.withColumnRenamed("pos", "a"), ["site_id", "canonical_norm", "a"])
    pair = pair.join(who.select("site_id", "canonical_norm", F.col("pos").alias("b"), F.col("final_url").alias("other"), F.col("is_core").alias("core_b")), ["site_id", "canonical_norm", "b"])
    m = _fmt("other page=%s; shared canonical=%s; similarity=%.2f", "other", "canonical_norm", "similarity")
    a3 = hits(pair, "MR-004", "shared", "pages with other content share a canonical address", m, "a", core=F.col("is_core") | F.col("core_b"), urls=F.array("final_url", "other"))
    return a1.unionByName(a2).unionByName(a3)


def _script_share() -> Column:
    return F.when(F.col("html_bytes") > 0, F.col("script_bytes") / F.col("html_bytes")).otherwise(F.lit(0.0))


def mr005(a: Audit) -> DataFrame:
    p = a.content.where(~F.col("path").rlike(V.LOW_TEXT_PATH) & (F.col("words_main") < 120))
    p = p.where(F.col("empty_app_root") | ((_script_share() >= 0.4) & (F.col("script_tags") >= 3)))
    sign = F.when(F.col("empty_app_root"), _fmt("empty application root %s", "app_root_id")).otherwise(_fmt("script share %.2f", _script_share()))
    p = p.join(a.home.select("site_id", "home_ord"), "site_id", "left").withColumn("m", F.concat(_fmt("main words=%d; ", "words_main"), sign))
    home = (F.col("page_ord") == F.col("home_ord")) | F.col("is_target")
    fallback = T.word_count("noscript_text") >= 40
    kind = F.when(fallback, "note").when(home, "home").otherwise("page")
    return hits(p, "MR-005", kind, "the served document has almost no main text", F.col("m"), core=home, x=F.col("words_main"))


def mr006(a: Audit) -> DataFrame:
    p = a.content.where(~((F.col("words_main") < 120) & (F.col("empty_app_root") | (_script_share() >= 0.4))))
    chars = F.length("text_main") + F.length("text_chrome")
    main = F.when(F.col("words_all") > 0, F.col("words_main") / F.col("words_all")).otherwise(F.lit(0.0))
    link = F.when(chars > 0, F.col("link_chars") / chars).otherwise(F.lit(0.0))
    p = p.withColumns({"main_share": main, "link_share": link})
    vague = hits(p.where("regions_unreliable"), "MR-006", "note", "content and navigation can't be told apart", _fmt("%d links", "n_links"))
    heavy = p.where("NOT regions_unreliable AND words_all >= 60 AND main_share < 0.25 AND link_share > 0.5 AND n_links > 60")
    m = _fmt("main share %.2f, link text %.2f, %d links", "main_share", "link_share", "n_links")
    return vague.unionByName(hits(heavy, "MR-006", "page", "navigation and link labels make up most of the page", m))


def mr007(a: Audit) -> DataFrame:
    c = a.content
    w = Window.partitionBy("site_id").orderBy("page_ord")
    bare = c.where(F.trim("title") == "").select("site_id", "page_ord", "final_url", "is_core").withColumn("rk", F.row_number().over(w))
    h1 = hits(bare, "MR-007", F.when(F.col("is_core"), "untitled-core").otherwise("untitled"), "the page has no title", F.lit("title length 0"), shown=F.col("rk") <= NAMED)
    t = c.where(F.trim("title") != "").select("site_id", F.lower(T.normalize_ws("title")).alias("t"), "url_norm", "page_ord", "final_url", "is_core", "text_main")
    u = Window.partitionBy("site_id", "t", "url_norm")
    t = t.withColumn("pos", F.min("page_ord").over(u)).withColumn("rk", F.row_number().over(u.orderBy(F.col("page_ord").desc()))).where("rk = 1")
    g = Window.partitionBy("site_id", "t")
    t = t.withColumn("n_urls", F.count(F.lit(1)).over(g)).withColumn("paged", F.max(F.col("final_url").rlike(V.PAGINATION)).over(g)).where("n_urls > 1 AND NOT paged")
    rows = t.select("site_id", "t", "pos", F.lit(0).alias("n"), T.shingles("text_main").alias("grams"))
    pair = first_unlike(rows, ["site_id", "t"], "pos", "grams", 0.8)
    pair = pair.groupBy("site_id", "t").agg(F.min(F.struct("a", "b", "similarity")).alias("p")).select("site_id", "t", "p.*")
    j = t.join(pair, ["site_id", "t"]).withColumn("first", F.col("pos") == F.col("a"))
    kind = F.when(F.col("first") & (F.col("n_urls") >= 3), "shared-many").when(F.col("first"), "shared").otherwise("member")
    m = _fmt('title "%s" on %d addresses; similarity %.2f', T.truncate("t", 90), "n_urls", "similarity")
    h2 = hits(j, "MR-007", kind, "pages with other content carry one title", m, "pos", shown=F.col("first"))
    plain = c.where((F.col("words_main") >= 120) & (F.size("h1s") == 0))
    lead = plain.groupBy("site_id").agg(F.min("page_ord").alias("lead"))
    plain = plain.join(lead, "site_id")
    h3 = hits(plain, "MR-007", "no-h1", "a content page has no first-level heading", F.lit("0 headings of level 1"), shown=F.col("page_ord") == F.col("lead"))
    return h1.unionByName(h2).unionByName(h3)


def home_targets(a: Audit) -> DataFrame:
    """(site_id, url_norm): internal link targets of the home page."""
    h = a.home.select("site_id", F.col("home_ord").alias("page_ord"))
    l = a.pages.join(h, ["site_id", "page_ord"]).select("site_id", F.explode("links").alias("l")).where("l.internal")
    return l.select("site_id", U.normalize_url("l.href").alias("url_norm")).where("url_norm <> ''").distinct()


def buried(a: Audit) -> DataFrame:
    """Key pages at depth 3 or more that the home page doesn't link to."""
    p = a.content.where(U.is_key_page("final_url") & (F.col("depth") >= 3)).join(a.home.select("site_id", "home_ord"), "site_id")
    return p.where("page_ord <> home_ord").join(home_targets(a), ["site_id", "url_norm"], "left_anti")


def mr008(a: Audit) -> DataFrame:
    site = a.site.where("scope = 'site' AND sitemap_status IN ('absent', 'unreachable', 'invalid', 'empty')").select("site_id")
    deep = buried(a).join(site, "site_id", "left_semi")
    h1 = hits(deep, "MR-008", "buried", "a key page is in no sitemap and not linked from the entry page", _fmt("depth %d", "depth"))
    few = a.home.join(site, "site_id", "left_semi").join(a.size, "site_id").join(home_targets(a).groupBy("site_id").agg(F.count(F.lit(1)).alias("n")), "site_id", "left")
    few = few.withColumn("n", F.coalesce("n", F.lit(0))).where("n < 5 AND n_cp >= 5")
    h2 = hits(few, "MR-008", "few", "the entry page leads to very few destinations", _fmt("%d destinations", "n"), F.lit(0), "home_url", F.lit(True))
    rest = a.site.where("scope = 'site' AND sitemap_status IN ('absent', 'unreachable', 'invalid', 'empty')")
    h3 = hits(rest, "MR-008", "note", "no usable sitemap", _fmt("sitemap %s", "sitemap_status"), F.lit(0), F.coalesce("robots_url", "root_url"), F.lit(False))
    return h1.unionByName(h2).unionByName(h3)


def anchor_rows(a: Audit) -> DataFrame:
    """Internal anchors that count: no pagination, no figures; `weak` where nothing describes the destination."""
    return a.once("anchors", lambda: _anchor_rows(a))


def _anchor_rows(a: Audit) -> DataFrame:
    l = a.links.where(F.col("internal") & ~F.col("href").rlike(V.PAGINATION) & ~F.trim("label").rlike("^[0-9]+$"))
    l = l.withColumn("plain", T.is_nondescriptive_anchor("label"))
    told = l.where("NOT plain").select("site_id", "href_norm").distinct().withColumn("told", F.lit(True))
    return l.join(told, ["site_id", "href_norm"], "left").withColumn("weak", F.col("plain") & F.col("told").isNull())


def place(step: int, *at: Column) -> Column:
    """The place of something on a site: its page, then its place there. As a long: orders of pages are ints, and
    their multiples leave an int's range on sites of some ten thousand pages."""
    return sum(at, F.col("page_ord").cast("long") * step)


def mr009(a: Audit) -> DataFrame:
    l = anchor_rows(a).where("weak")
    m = _fmt('"%s" -> %s', T.truncate("label", 60), "href")
    return hits(l, "MR-009", "page", "a link label does not describe its destination", m, place(100000, F.col("link_ord")), core=F.lit(False))


# --- Facts --------------------------------------------------------------------------------------------------------


def recurring_title(a: Audit) -> DataFrame:
    """(site_id, norm, raw, url): the first or last part of titles that recurs most on a site, at least twice."""
    t = a.content.select("site_id", "page_ord", "final_url", E.split_title("title").alias("p")).where(F.size("p") >= 2)
    s = t.select("site_id", "page_ord", "final_url", F.posexplode(F.array(F.element_at("p", 1), F.element_at("p", -1))).alias("i", "raw"))
    s = s.withColumn("norm", T.normalize_entity_name("raw")).where(F.length("norm") >= 2)
    first = F.min(F.struct("page_ord", "i", "raw", "final_url")).alias("f")
    g = s.groupBy("site_id", "norm").agg(F.count(F.lit(1)).alias("n"), first).where("n >= 2")
    best = g.groupBy("site_id").agg(F.max_by(F.struct("norm", "f"), F.struct("n", -F.col("f.page_ord"), -F.col("f.i"))).alias("b"))
    return best.select("site_id", F.col("b.norm").alias("norm"), F.col("b.f.raw").alias("raw"), F.col("b.f.final_url").alias("url"))


def name_candidates(a: Audit) -> DataFrame:
    """(site_id, source, raw, norm, ord, url, core): what a site calls itself, from six kinds of places."""
    return a.once("names", lambda: _name_candidates(a))


def _name_candidates(a: Audit) -> DataFrame:
    c = a.content.select("site_id", "page_ord", "final_url", "is_core", "meta", "images", "text_chrome", "text_main")
    base = ["site_id", "page_ord", "final_url", "is_core"]
    one = lambda src, k, raw, df: df.select("site_id", F.lit(src).alias("source"), raw.alias("raw"), place(8, F.lit(k)).alias("ord"), F.col("final_url").alias("url"), F.col("is_core").alias("core"))
    n = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in E.ENTITY_TYPES]))).join(c.select(*base), ["site_id", "page_ord"])
    logo = F.try_element_at(F.filter("images", lambda i: (i["alt"] != "") & (F.lower(i["src"]).contains("logo") | F.lower(i["alt"]).contains("logo"))), F.lit(1))
    cleaned = F.regexp_replace(F.regexp_replace(logo["alt"], r"(?iU)\blogo\b", ""), r"^[ \-–—|]+|[ \-–—|]+$", "")
    holder = F.coalesce(F.nullif(E.copyright_holder("text_chrome"), F.lit("")), E.copyright_holder("text_main"))
    parts = [
        one("og:site_name", 0, E.meta_get("meta", "og:site_name", "application-name"), c),
        one("entity markup", 1, F.col("name"), n), one("publisher", 2, F.col("publisher_name"), n),
        one("logo", 3, cleaned, c), one("copyright", 4, holder, c),
    ]
    r = recurring_title(a).select("site_id", F.lit("recurring title").alias("source"), "raw", F.lit(2**40).alias("ord"), "url", F.lit(True).alias("core"))
    u = reduce(DataFrame.unionByName, [*parts, r])
    return u.withColumn("norm", T.normalize_entity_name("raw")).where(F.length("norm") >= 2)


def published_names(a: Audit) -> DataFrame:
    """(site_id, norm, raw, n, rk): distinct names of a site, most attested first."""
    g = name_candidates(a).groupBy("site_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "raw")).alias("f"))
    w = Window.partitionBy("site_id").orderBy(F.col("n").desc(), F.col("f.ord"), "norm")
    return g.select("site_id", "norm", F.col("f.raw").alias("raw"), "n", F.row_number().over(w).alias("rk"))


def fi001(a: Audit) -> DataFrame:
    n = name_candidates(a).groupBy("site_id", "source", "norm").agg(F.min(F.struct("ord", "raw", "url", "core")).alias("f")).select("site_id", "source", "norm", "f.*")
    x, y = n.alias("x"), n.alias("y")
    p = x.join(y, F.col("x.site_id") == F.col("y.site_id")).where((F.col("x.source") < F.col("y.source")) & ~T.names_compatible("x.norm", "y.norm"))
    p = p.select(
        F.col("x.site_id").alias("site_id"), F.least("x.ord", "y.ord").alias("page_ord"), F.col("x.url").alias("final_url"), F.col("y.url").alias("other"),
        _fmt('%s "%s" against %s "%s"', "x.source", "x.raw", "y.source", "y.raw").alias("m"), (F.col("x.core") & F.col("y.core")).alias("is_core"),
        F.col("x.source").alias("sx"), F.col("y.source").alias("sy"),
    )
    each = p.select("*", F.posexplode(F.array("sx", "sy")).alias("i", "src"))
    h = hits(p, "FI-001", "pair", "two places give names that can't be one", F.col("m"), urls=F.array("final_url", "other"))
    srcs = each.groupBy("site_id", "src").agg(F.min("page_ord").alias("page_ord"))
    # One counting hit per kind of place involved.
    return h.unionByName(hits(srcs, "FI-001", "source", "", F.lit(None).cast("string"), url=F.lit(None).cast("string"), core=F.lit(False), urls=F.expr("cast(array() as array<string>)"), shown=F.lit(False)))


def fi002(a: Audit) -> DataFrame:
    ent = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in E.ENTITY_TYPES]))).select("site_id")
    micro = a.content.where(F.exists("microdata_types", lambda t: F.lower(t).isin(*E.ENTITY_TYPES))).select("site_id")
    known = a.pages.select("site_id", F.col("url_norm").alias("u")).union(a.sitemap_urls.select("site_id", "url_norm")).union(a.edges.select("site_id", "dst"))
    about = known.where(U.url_path("u").rlike(V.ABOUT_PATH)).select("site_id")
    told = ent.union(micro).union(about).distinct()
    s = a.home.join(a.size.where("n_cp > 0"), "site_id").join(told, "site_id", "left_anti")
    return hits(s, "FI-002", "site", "no entity markup and no page about the publisher", _fmt("%d pages", "n_cp"), F.lit(0), "home_url", F.lit(True))


def fi003(a: Audit) -> DataFrame:
    n = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x.lower()) for x in PRODUCT])))
    p = a.content.select(
        "site_id", "page_ord", "final_url", "is_core", F.array_distinct(T.find_prices("text_main")).alias("seen"),
        T.content_tokens(F.concat_ws(" ", "text_main", "title", F.array_join("h1s", " "))).alias("toks"),
        F.lower(F.concat_ws(" ", "text_main", "title", F.array_join("h1s", " "))).alias("low"),
    )
    j = n.join(p, ["site_id", "page_ord"])
    nums = F.transform("seen", lambda v: v.cast("double"))
    d = F.col("price").cast("double")
    ranged = F.col("ranged") & (d >= F.array_min(nums)) & (d <= F.array_max(nums))
    priced = F.col("price").isNotNull() & (F.size("seen") > 0)
    nt = T.content_tokens("name")
    out_claim = F.col("low").contains("out of stock") | F.col("low").contains("sold out")
    price_bad = priced & ~ranged & ~F.array_contains("seen", F.col("price"))
    skip = priced & (ranged | price_bad)
    name_bad = ~skip & (F.size(nt) >= 2) & (T.overlap_ratio(nt, F.col("toks")) < 0.25)
    av_bad = ~skip & F.coalesce(
        ((F.col("availability") == "instock") & out_claim) | ((F.col("availability") == "outofstock") & F.col("low").contains("in stock") & ~out_claim), F.lit(False)
    )
    core = F.col("is_core")
    parts = [
        hits(j.where(price_bad), "FI-003", "price", "a declared price is not on the page", _fmt("declared %s, visible %s", "price", F.array_join("seen", ", ")), core=core),
        hits(j.where(name_bad), "FI-003", "name", "a declared name is not on the page", _fmt('declared "%s"', T.truncate("name", 70)), core=F.lit(False)),
        hits(j.where(av_bad), "FI-003", "availability", "declared and visible availability contradict", _fmt("declared %s", "availability"), core=core),
    ]
    return reduce(DataFrame.unionByName, parts)


def duplicate_pairs(a: Audit) -> DataFrame:
    """(site_id, a, b, similarity): content pages of 150 words or more, 0.9 alike, page orders a < b."""
    rows = a.content.where("words_main >= 150").select("site_id", F.col("page_ord").cast("long").alias("k"), T.shingles("text_main").alias("g"))
    return prefix_join(rows, ["site_id"], "k", "g", 0.9)


def fi004(a: Audit) -> DataFrame:
    c = a.content.select("site_id", F.col("page_ord").cast("long").alias("k"), "final_url", "url_norm", "is_core", F.when(F.col("canonical_norm") == "", F.col("url_norm")).otherwise(F.col("canonical_norm")).alias("can"))
    x = c.select("site_id", F.col("k").alias("a"), F.col("final_url").alias("final_url"), F.col("url_norm").alias("ua"), F.col("is_core").alias("ca"), F.col("can").alias("cana"))
    y = c.select("site_id", F.col("k").alias("b"), F.col("final_url").alias("other"), F.col("url_norm").alias("ub"), F.col("is_core").alias("cb"), F.col("can").alias("canb"))
    p = duplicate_pairs(a).join(x, ["site_id", "a"]).join(y, ["site_id", "b"])
    paged = F.concat("ua", "ub").rlike(r"([?&]page=|/page/\d+)")
    p = p.where((F.col("ua") != F.col("ub")) & ~paged & ~U.variant_pair("ua", "ub") & (F.col("cana") != F.col("canb")))
    m = _fmt("copy of %s; similarity %.2f; canonicals %s and %s", "other", "similarity", "cana", "canb")
    return hits(p, "FI-004", "pair", "a second address serves nearly the same content", m, "a", core=F.col("ca") | F.col("cb"), urls=F.array("final_url", "other"))


def fi005(a: Audit) -> DataFrame:
    d = V.page_dates(a).where(F.size("dates") > 0).select("site_id", "page_ord")
    c = a.content.withColumn("now", T.has_any("text_main", T.TIME_SENSITIVE)).withColumn("year", F.year("as_of").cast("string"))
    c = c.where((F.size("now") > 0) | F.contains("text_main", F.col("year"))).join(d, ["site_id", "page_ord"], "left_anti")
    c = c.withColumn("volatile", F.size(T.has_any("text_main", T.VOLATILE)) > 0).withColumn("weak", F.coalesce(F.col("headers")["last-modified"], F.lit("")) != "")
    priced = F.col("volatile") & (F.size(T.find_prices("text_main")) > 0)
    kind = F.when(F.col("weak"), "weak").otherwise("undated")
    m = _fmt('"%s" and no date', F.coalesce(F.try_element_at("now", F.lit(1)), F.col("year")))
    # x: 1 volatile, 2 volatile with a price on an undated page
    x = F.when(priced & ~F.col("weak"), 2).when(F.col("volatile"), 1).otherwise(0)
    return hits(c, "FI-005", kind, "the page speaks of now and carries no date", m, core=F.col("is_core") & ~F.col("weak"), x=x)


def fi006(a: Audit) -> DataFrame:
    # The newest date; among equals the first.
    newest = F.aggregate("dates", F.expr("cast(null as struct<d:date,source:string>)"), lambda m, x: F.when(m.isNull() | (x["d"] > m["d"]), x).otherwise(m))
    d = V.page_dates(a).where(F.size("dates") > 0).select("site_id", "page_ord", newest.alias("n"))
    c = a.content.where(~F.col("path").rlike(V.ARCHIVE_PATH) & ~F.col("path").rlike(V.EDITORIAL_PATH)).join(d, ["site_id", "page_ord"])
    age = (F.year("as_of") - F.year("n.d")) * 12 + F.month("as_of") - F.month("n.d")
    c = c.withColumn("age", age).where("age > 24").withColumn("now", T.has_any("text_main", CLAIMS_NOW)).withColumn("newer", F.filter(T.find_years("text_main"), lambda y: y > F.year("n.d")))
    c = c.where((F.size("now") > 0) | (F.size("newer") > 0))
    why = F.coalesce(F.try_element_at("now", F.lit(1)), F.array_max("newer").cast("string"))
    m = _fmt("newest date %s (%s), %d months old; says %s", F.col("n.d").cast("string"), "n.source", "age", why)
    return hits(c, "FI-006", "page", "the page claims to be current and its newest date is old", m, x=F.col("age"))


def fi007(a: Audit) -> DataFrame:
    by = a.nodes.groupBy("site_id", "page_ord").agg(
        F.max("attributed").alias("credited"), F.max(F.arrays_overlap("types", F.array(*[F.lit(x) for x in ("article", "blogposting", "newsarticle", "report")]))).alias("article")
    )
    dated = V.page_dates(a).select("site_id", "page_ord", (F.size("dates") > 0).alias("dated"))
    c = a.content.join(by, ["site_id", "page_ord"], "left").join(dated, ["site_id", "page_ord"], "left")
    editorial = F.coalesce("article", F.lit(False)) | (F.col("path").rlike(V.EDITORIAL_PATH) & (F.col("words_main") >= 150)) | ((F.col("words_main") >= 300) & F.coalesce("dated", F.lit(False)))
    c = c.where(editorial & ~F.coalesce("credited", F.lit(False)) & (E.meta_get("meta", "author", "article:author") == ""))
    c = c.withColumn("byline", F.regexp_extract(F.substring("text_main", 1, 1200), V.BYLINE, 1))
    kind = F.when(F.col("byline") != "", "byline").otherwise("none")
    m = F.when(F.col("byline") != "", _fmt('visible "%s" only', T.truncate("byline", 60))).otherwise(_fmt("main words=%d", "words_main"))
    return hits(c, "FI-007", kind, "an editorial page names no author or publisher a machine can read", m, core=F.lit(False))


# --- Arrival ------------------------------------------------------------------------------------------------------


def ax001(a: Audit) -> DataFrame:
    c = a.content.where((F.col("words_main") >= 80) & (F.trim("title") != "") & (F.size("h1s") > 0)).join(a.home.select("site_id", "home_site_name"), "site_id")
    t = F.array_except(T.content_tokens("title"), E.brand_tokens("root_url", "home_site_name"))
    c = c.withColumn("tt", t).where(F.size("tt") >= 3)
    c = c.withColumns({"ho": T.jaccard(F.col("tt"), T.content_tokens(F.col("h1s")[0])), "bc": T.overlap_ratio(F.col("tt"), T.content_tokens("text_main"))})
    m = _fmt('title "%s", heading "%s"; shared %.2f, in the text %.2f', T.truncate("title", 70), T.truncate(F.col("h1s")[0], 70), "ho", "bc")
    return hits(c.where("ho < 0.2 AND bc < 0.3"), "AX-001", "page", "the title promises what heading and text do not cover", m)


def ax002(a: Audit) -> DataFrame:
    told = a.nodes.where(T.word_count("description") >= 12).groupBy("site_id", "page_ord").agg(F.min(F.struct("node_ord", "description")).alias("f")).select("site_id", "page_ord", F.col("f.description").alias("markup"))
    c = a.content.where(F.col("is_core") & ~F.col("path").rlike(V.LISTING_PATH) & (F.col("words_main") >= 40)).join(told, ["site_id", "page_ord"], "left")
    opening = F.array_join(F.slice(F.filter(F.split("text_main", r"(?U)\s+"), lambda w: w != ""), 1, 120), " ")
    c = c.withColumn("opening", opening).where(~F.exists(T.sentences("opening"), T.looks_definitional))
    foreign = (F.col("lang") != "") & ~F.col("lang").startswith("en") & (E.meta_get("meta", "description") != "")
    c = c.where(~foreign)
    desc = F.coalesce(F.nullif(E.meta_get("meta", "description", "og:description"), F.lit("")), F.col("markup"), F.lit(""))
    kind = F.when(F.exists(T.sentences(desc), T.looks_definitional), "meta").otherwise("gap")
    return hits(c, "AX-002", kind, "the opening does not say what this is", _fmt('opening "%s"', T.truncate("opening", 160)))


def ax003(a: Audit) -> DataFrame:
    c = a.content.where("words_main >= 150")
    main = F.filter("links", lambda l: F.coalesce(l["region"], F.lit("main")) == "main")
    inner = F.size(F.array_distinct(F.transform(F.filter(main, lambda l: F.coalesce(l["internal"], F.lit(False))), lambda l: l["href"])))
    c = c.withColumn("n_in", inner).withColumn("cta", E.has_cta(F.col("buttons"), F.transform(main, lambda l: l["text"])))
    vague = hits(c.where("regions_unreliable"), "AX-003", "note", "links in the text can't be told from navigation", _fmt("%d links", "n_links"))
    dead = c.where("NOT regions_unreliable AND n_in < 3 AND NOT (cta AND n_in >= 1)")
    return vague.unionByName(hits(dead, "AX-003", "page", "a long page offers no way on", _fmt("links in the text=%d; main words=%d", "n_in", "words_main")))


def ax004(a: Audit) -> DataFrame:
    c = a.content.withColumn("gate", E.context_gate_signals(F.col("location_gate_hits"), F.col("selects"), F.col("buttons"))).where(F.size("gate") > 0)
    kind = F.when(F.col("words_main") >= 150, "note").otherwise("page")
    m = _fmt('"%s"; main words=%d', T.truncate(F.col("gate")[0], 90), "words_main")
    return hits(c, "AX-004", kind, "content waits for a choice of place", m)


def ax005(a: Audit) -> DataFrame:
    c = a.content.where((F.col("words_main") >= 120) & ~F.col("regions_unreliable") & ~F.col("path").rlike(V.CAMPAIGN_PATH) & ~F.col("title").rlike(V.CAMPAIGN_TITLE))
    share = F.when(F.length("text_main") > 0, F.length("text_promo") / F.length("text_main")).otherwise(F.lit(0.0))
    own = F.filter(F.array_distinct("blocks"), lambda b: F.size(F.filter(F.col("blocks"), lambda o: o == b)) >= 3)
    c = c.withColumns({"share": share, "again": own}).where((F.col("share") >= 0.25) | (F.size("again") > 0))
    kind = F.when(F.size("again") > 0, "repeated").when(F.col("share") >= 0.4, "promo").otherwise("note")
    m = F.when(F.size("again") > 0, _fmt('repeated "%s"; promotional share %.2f', T.truncate(F.col("again")[0], 90), "share")).otherwise(_fmt("promotional share %.2f", "share"))
    return hits(c, "AX-005", kind, "promotion takes up the page's own text", m, x=F.col("share"))


def ax006(a: Audit) -> DataFrame:
    r = V.rendering(a)
    c = a.content.where((F.col("words_visible") < 120) & (F.col("words_hidden") >= 60) & (F.col("words_hidden") >= 2 * F.greatest(F.lit(1), F.col("words_visible"))))
    c = c.join(r, ["site_id", "page_ord"]).where("rendering <> 'likely_client_rendered'")
    m = _fmt("visible words=%d, hidden words=%d, in %s", "words_visible", "words_hidden", F.array_join(F.slice("hidden_containers", 1, 2), ", "))
    return hits(c, "AX-006", "page", "the substance is only reached by interacting", m, x=F.col("words_hidden"))


def ax007(a: Audit) -> DataFrame:
    b = buried(a).join(a.sitemap_urls.withColumn("listed", F.lit(True)), ["site_id", "url_norm"], "left")
    kind = F.when(F.col("listed"), "listed").otherwise("unlisted")
    return hits(b, "AX-007", kind, "a key page sits deep and the entry page does not link to it", _fmt("depth %d", "depth"))


# --- Outside evidence ----------------------------------------------------------------------------------------------

REFUSED = (401, 403, 405, 406, 429, 451)


def probes(a: Audit) -> DataFrame:
    """Probes with their predicates: resolved, broken, readable."""
    s = F.coalesce("status", F.lit(0))
    ok = F.col("checked") & (s >= 200) & (s < 300)
    said = F.concat_ws("", "title", "site_name", "text_sample") != ""
    w = Window.partitionBy("site_id").orderBy("kind", "url")
    return a.probe.withColumns(
        {"resolved": ok, "broken": F.col("checked") & (s >= 400) & ~s.isin(*REFUSED), "readable": ok & said, "page_ord": F.row_number().over(w)}
    )


def probe_summary(a: Audit) -> DataFrame:
    """Counts of a site's outside references."""
    r = F.col("kind") == "reference"
    return probes(a).groupBy("site_id").agg(
        F.count_if(r).alias("probes_attempted"), F.count_if(r & F.col("checked")).alias("probes_completed"), F.count_if(r & F.col("readable")).alias("references_resolved"),
        F.count_if(r & F.col("readable") & F.col("links_back")).alias("references_linking_back"),
        F.count_if(r & F.col("readable") & (F.coalesce("description", F.lit("")) != "")).alias("independent_descriptions_found"),
        F.count_if(~r).alias("hostname_variants_probed"),
    )


def declared_references(a: Audit) -> DataFrame:
    """(site_id, url, source, ord): outside addresses a site declares itself, in order, without repetition."""
    ent = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in E.ENTITY_TYPES])))
    same = ent.select("site_id", place(1000, F.col("node_ord")).alias("o"), F.explode("same_as").alias("url"), F.lit("sameAs").alias("source"))
    ident = ent.select("site_id", place(1000, F.col("node_ord")).alias("o"), F.col("identifier").alias("url"), F.lit("identifier").alias("source"))
    rel = a.content.select("site_id", "root_url", "page_ord", F.posexplode("link_rels").alias("i", "r"))
    rel = rel.where(F.arrays_overlap(F.split("r.rel", " "), F.array(*[F.lit(x) for x in E.REFERENCE_RELS])) & (U.host_no_port("r.href") != U.host_no_port("root_url")))
    rel = rel.select("site_id", place(1000, F.lit(900), F.col("i")).alias("o"), F.col("r.href").alias("url"), F.lit("link rel").alias("source"))
    u = same.unionByName(ident).unionByName(rel).where(F.col("url").startswith("http"))
    g = u.groupBy("site_id", "url").agg(F.min(F.struct("o", "source")).alias("f"))
    return g.select("site_id", "url", F.col("f.source").alias("source"), F.col("f.o").alias("ord"))


def disambiguating_fields(a: Audit) -> DataFrame:
    """(site_id, fields): what a site publishes that tells its name from others."""
    ent = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in E.ENTITY_TYPES]))).select("site_id", F.explode("fields").alias("f"))
    url = a.nodes.where(F.arrays_overlap("types", F.array(F.lit("organization"), F.lit("localbusiness"))) & (F.coalesce("url", F.lit("")) != "")).select("site_id", F.lit("url").alias("f"))
    d = a.content.where(F.col("is_core") & F.exists(T.sentences(F.substring("text_main", 1, 900)), T.looks_definitional)).select("site_id", F.lit("definitional_sentence").alias("f"))
    return ent.unionByName(url).unionByName(d).groupBy("site_id").agg(F.array_sort(F.collect_set("f")).alias("fields"))


def ex001(a: Audit) -> DataFrame:
    return hits(probes(a).where("kind = 'reference' AND broken"), "EX-001", "probe", "a declared outside reference does not resolve", _fmt("status %d, declared in %s", "status", "source"), url="url", core=F.lit(True))


def ex002(a: Audit) -> DataFrame:
    p = probes(a).where("kind = 'reference' AND readable")
    n = published_names(a).select("site_id", "norm", "rk")
    path = F.regexp_replace(U.url_path("url"), "[^A-Za-z0-9]+", " ")
    j = p.join(n, "site_id").withColumn("named", F.exists(F.array("title", "site_name", "text_sample", path), lambda h: E.mentions_name(F.col("norm"), F.coalesce(h, F.lit("")))))
    g = j.groupBy("site_id", "page_ord", "url", "title").agg(F.max("named").alias("named")).where("NOT named")
    return hits(g, "EX-002", "probe", "an outside reference resolves and does not name the brand", _fmt('title "%s"', T.truncate("title", 90)), url="url", core=F.lit(False))


def ex003(a: Audit) -> DataFrame:
    n = published_names(a).where((F.col("rk") == 1) & E.name_is_ambiguous("norm")).join(disambiguating_fields(a), "site_id", "left").join(a.home, "site_id", "left")
    n = n.join(a.site.select("site_id", "root_url"), "site_id")
    none = F.expr("cast(array() as array<string>)")
    n = n.withColumn("fields", F.coalesce("fields", none)).where(F.size(F.array_except("fields", F.array(F.lit("definitional_sentence")))) == 0)
    kind = F.when(F.array_contains("fields", "definitional_sentence"), "defined").otherwise("bare")
    return hits(n, "EX-003", kind, "the name is made of everyday words and nothing tells it apart", _fmt('name "%s"', "raw"), F.lit(0), F.coalesce("home_url", "root_url"), F.lit(True))


def ex004(a: Audit) -> DataFrame:
    n = published_names(a).where("rk = 1").join(a.site.select("site_id", "root_url"), "site_id").join(disambiguating_fields(a), "site_id", "left")
    label = U.domain_label("root_url")
    squash = F.replace("norm", F.lit(" "), F.lit(""))
    bridge = F.coalesce(F.arrays_overlap("fields", F.array(F.lit("url"), F.lit("sameAs"))), F.lit(False))
    n = n.withColumn("label", label).where((F.col("label") != "") & ~T.names_compatible("norm", T.normalize_entity_name("label")) & ~squash.contains(F.col("label")) & ~bridge)
    return hits(n, "EX-004", "site", "the domain does not resemble the name and nothing connects them", _fmt('domain "%s", name "%s"', "label", "raw"), F.lit(0), "root_url", F.lit(False))


def ex005(a: Audit) -> DataFrame:
    p = probes(a).where("kind = 'hostname' AND resolved").join(a.site.select("site_id", "root_url"), "site_id")
    own = U.exact_host("root_url")
    p = p.where((U.exact_host("final_url") != own) & ~((F.coalesce("canonical", F.lit("")) != "") & (U.exact_host("canonical") == own)))
    kind = F.when(F.coalesce("canonical", F.lit("")) == "", "split").otherwise("elsewhere")
    return hits(p, "EX-005", kind, "the other form of the host serves content of its own", _fmt("status %d, at %s", "status", "final_url"), url="url", core=F.lit(True))


def ex006(a: Audit) -> DataFrame:
    p = probes(a).where("kind = 'reference' AND readable AND NOT links_back")
    return hits(p, "EX-006", "probe", "an outside reference never points back", _fmt("status %d", "status"), url="url", core=F.lit(False))


RULES = {
    "MR-001": mr001, "MR-002": mr002, "MR-003": mr003, "MR-004": mr004, "MR-005": mr005, "MR-006": mr006, "MR-007": mr007, "MR-008": mr008, "MR-009": mr009,
    "FI-001": fi001, "FI-002": fi002, "FI-003": fi003, "FI-004": fi004, "FI-005": fi005, "FI-006": fi006, "FI-007": fi007,
    "AX-001": ax001, "AX-002": ax002, "AX-003": ax003, "AX-004": ax004, "AX-005": ax005, "AX-006": ax006, "AX-007": ax007,
    "EX-001": ex001, "EX-002": ex002, "EX-003": ex003, "EX-004": ex004, "EX-005": ex005, "EX-006": ex006,
}


def site_measures(a: Audit) -> DataFrame:
    """One row per site with the denominators and site-level facts the rules need."""
    c = a.content
    shell = (F.col("words_main") < 120) & (F.col("empty_app_root") | (_script_share() >= 0.4))
    m = c.groupBy("site_id").agg(
        F.count_if(~F.col("path").rlike(V.LOW_TEXT_PATH)).alias("n_textual"), F.count_if(~shell).alias("n_solid"), F.count_if(F.col("words_main") >= 150).alias("n_long")
    )
    prod = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x.lower()) for x in PRODUCT]))).groupBy("site_id").agg(F.countDistinct("page_ord").alias("n_product"))
    anchors = anchor_rows(a).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_anchors"))
    srcs = a.edges.groupBy("site_id").agg(F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))
    maps = a.sitemap_urls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_sitemap"))
    ref = probes(a).where("kind = 'reference'").groupBy("site_id").agg(F.count_if("checked").alias("n_checked"), F.count_if("readable").alias("n_readable_refs"))
    failed = a.failure.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_failures"))
    out = a.site.select("site_id", "root_url", "scope", "as_of", "robots_url", "sitemap_status", "sitemap_lastmod_count", "limitations")
    for d in (a.size, m, prod, anchors, srcs, maps, ref, failed):
        out = out.join(d, "site_id", "left")
    zero = [x for x in out.columns if x.startswith("n_")]
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in zero}).join(a.home, "site_id", "left")


def all_hits(a: Audit, rules=None) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(a) for k, f in RULES.items() if rules is None or k in rules])


#: Rules whose hits are worked out at the same time.
AT_ONCE = 6


def stored_hits(a: Audit, rules=None) -> DataFrame:
    """all_hits() in the shared folder. Each rule is a job of its own, a few at a time: one plan of all of them would be
    planned anew after each of its hundreds of stages."""
    for made in (a.pages, a.home, a.nodes, a.edges, a.sitemap_urls):  # what several rules read is made first
        made.columns  # noqa: B018
    for made in (name_candidates, anchor_rows, V.page_dates):
        made(a)
    wanted = [k for k in RULES if rules is None or k in rules]
    store = inheritable_thread_target(a.spark)(lambda k: shared_table(RULES[k](a), f"hits-{k}"))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(store, wanted))


def _case(branches: dict[str, Column], default) -> Column:
    out = None
    for k, v in branches.items():
        out = F.when(F.col("rule") == k, v) if out is None else out.when(F.col("rule") == k, v)
    return out.otherwise(default)


KINDS = (
    "root listed linked home page failed host shared untitled-core untitled shared-many no-h1 member buried few note pair source price name availability "
    "weak undated byline none gap meta repeated promo unlisted probe bare defined split elsewhere site"
).split()


def _lead() -> Column:
    """Rules whose finding is about one group of kinds list that group only."""
    return F.when((F.col("rule") == "FI-005"), F.col("kind") == "undated").otherwise(F.lit(True))


def judge(h: DataFrame, m: DataFrame) -> DataFrame:
    """(site_id, rule, fires, severity, evidence_level, confidence, core_page_affected, affected_share, n_hits, n_urls):
    what a site's hits of a rule amount to. h: hits, m: site_measures."""
    k = lambda *names: sum((F.coalesce(F.col(f"k_{n}"), F.lit(0)) for n in names), F.lit(0))
    real = F.col("kind") != "note"
    agg = h.groupBy("site_id", "rule").agg(
        *[F.count_if(F.col("kind") == n).alias(f"k_{n}") for n in KINDS], F.count_if(real).alias("n"), F.max(F.when(real, F.col("core"))).alias("core"),
        F.max(F.when(real, F.col("x"))).alias("x_max"), F.min(F.when(real, F.col("x"))).alias("x_min"), F.count_if(F.col("x") < 80).alias("x_80"), F.count_if((F.col("x") >= 1)).alias("x_1"),
    )
    urls = h.where(real & _lead()).select("site_id", "rule", F.explode("urls").alias("u")).distinct().groupBy("site_id", "rule").agg(F.count(F.lit(1)).alias("n_urls"))
    j = agg.join(urls, ["site_id", "rule"], "left").join(m, "site_id").withColumns({"core": F.coalesce("core", F.lit(False)), "n_urls": F.coalesce("n_urls", F.lit(0))})
    cp = F.greatest(F.lit(1), F.col("n_cp"))
    n, nu, core = F.col("n"), F.col("n_urls"), F.col("core")
    per = lambda d: n / F.greatest(F.lit(1), F.col(d))
    lit, when = F.lit, F.when
    high, medium, low, critical = (F.lit(x) for x in ("high", "medium", "low", "critical"))
    home = k("home") > 0
    fires = {
        "MR-005": (n > 0) & ((n > 1) | home), "MR-006": n > 1, "MR-009": (F.col("n_anchors") >= 25) & (per("n_anchors") >= 0.3),
        "FI-001": k("pair") > 0, "FI-005": (k("undated") >= 2) | ((k("undated") >= 1) & core), "FI-007": (k("none") >= 2) | (k("byline") >= 2),
        "AX-003": (F.col("n_long") >= 2) & (n > 0) & (per("n_long") >= 0.3), "AX-006": (n > 1) | core & (n > 0), "EX-006": n >= 2,
    }
    severity = {
        "MR-001": when(k("root") > 0, critical).when(k("listed") > 0, high).otherwise(medium),
        "MR-002": when(core, critical).when(n / cp >= 0.25, high).otherwise(medium),
        "MR-003": when((n >= 3) | home, high).otherwise(medium),
        "MR-004": when(k("failed", "shared") > 0, high).otherwise(low),
        # What is not verified is never critical: a shell on four of five pages counts as high, too.
        "MR-005": when(home | (per("n_textual") >= 0.4), high).otherwise(medium),
        "MR-006": when((per("n_solid") >= 0.4) | (core & (n >= 2)), high).otherwise(medium),
        "MR-007": when(k("untitled-core", "shared-many") > 0, high).when((k("untitled", "shared") > 0) | (k("no-h1") >= 2), medium).otherwise(low),
        "MR-008": when(k("buried") > 0, medium).otherwise(low), "MR-009": when(per("n_anchors") >= 0.45, medium).otherwise(low),
        "FI-001": when(core | (k("source") >= 3), high).otherwise(medium), "FI-002": medium,
        "FI-003": when((nu / F.greatest(lit(1), F.col("n_product")) >= 0.4) | core, high).otherwise(medium),
        "FI-004": when((n >= 3) | core, high).otherwise(medium),
        "FI-005": when((F.col("x_1") / cp >= 0.3) & (F.col("x_max") >= 2), high).otherwise(medium),
        "FI-006": when(core, high).otherwise(medium), "FI-007": when(k("none") >= 2, medium).otherwise(low),
        "AX-001": when(core, high).otherwise(medium), "AX-002": when(k("gap") > 0, medium).otherwise(low), "AX-003": medium,
        "AX-004": when(core, high).otherwise(medium),
        "AX-005": when((n / cp >= 0.3) | (F.col("x_max") >= 0.4), medium).otherwise(low),
        "AX-006": when(core, high).otherwise(medium), "AX-007": when(k("unlisted") > 0, medium).otherwise(low),
        "EX-001": medium, "EX-002": when(n >= 2, medium).otherwise(low), "EX-003": when(k("defined") > 0, low).otherwise(medium),
        "EX-004": low, "EX-005": when(k("split") > 0, medium).otherwise(low), "EX-006": low,
    }
    verified = {"MR-001", "MR-002", "MR-003", "MR-007", "FI-002", "FI-004", "FI-005", "FI-007", "AX-007", "EX-001", "EX-005"}
    level = {r: lit("verified") for r in sorted(verified)} | {"MR-004": when(k("failed", "shared") > 0, "verified").otherwise("corroborated")}
    # Confidence of each rule.
    confidence = {
        "MR-001": 0.98, "MR-002": 0.99, "MR-003": 0.97, "MR-004": 0.9, "MR-005": 0.86, "MR-006": 0.82, "MR-007": 0.94, "MR-008": 0.82, "MR-009": 0.8,
        "FI-001": 0.85, "FI-002": 0.9, "FI-003": 0.88, "FI-004": 0.93, "FI-005": 0.91, "FI-006": 0.87, "FI-007": 0.92,
        "AX-001": 0.8, "AX-002": 0.78, "AX-003": 0.79, "AX-004": 0.81, "AX-005": 0.76, "AX-006": 0.8, "AX-007": 0.9,
        "EX-001": 0.95, "EX-002": 0.78, "EX-003": 0.75, "EX-004": 0.74, "EX-005": 0.93, "EX-006": 0.74,
    }
    conf = {r: lit(v) for r, v in confidence.items()} | {"FI-007": when(k("none") >= 2, 0.92).otherwise(0.9)}
    share = {
        "MR-001": when(k("root") > 0, 1.0).otherwise(F.least(lit(1.0), n / F.greatest(lit(1), F.col("n_targets") + F.col("n_sitemap") + 1))),
        "MR-003": F.least(lit(1.0), per("n_sources")), "MR-004": nu / cp, "MR-005": per("n_textual"), "MR-006": per("n_solid"), "MR-007": nu / cp,
        "MR-008": when(k("buried") > 0, k("buried") / cp).otherwise(lit(0.4)), "MR-009": per("n_anchors"), "FI-001": lit(0.6), "FI-002": lit(1.0),
        "FI-003": nu / F.greatest(lit(1), F.col("n_product")), "FI-004": nu / cp, "FI-005": k("undated") / cp,
        "FI-007": when(k("none") >= 2, k("none")).otherwise(k("byline")) / cp, "AX-002": when(k("gap") > 0, k("gap")).otherwise(k("meta")) / cp,
        "AX-003": per("n_long"), "EX-001": per("n_checked"), "EX-002": per("n_readable_refs"), "EX-003": lit(0.5), "EX-004": lit(0.3), "EX-005": lit(1.0),
        "EX-006": per("n_readable_refs"),
    }
    always = {"MR-008", "AX-002", "EX-001", "EX-003", "EX-005", "FI-002"}
    never = {"MR-009", "FI-007", "EX-002", "EX-004", "EX-006"}
    core_case = when(F.col("rule").isin(*sorted(always)), True).when(F.col("rule").isin(*sorted(never)), False).when(F.col("rule") == "MR-001", k("root") > 0).otherwise(core)
    return j.select(
        "site_id", "rule", (F.col("n") > 0).alias("some"), (_case(fires, n > 0)).alias("fires"), _case(severity, medium).alias("severity"),
        _case(level, lit("corroborated")).alias("evidence_level"), _case(conf, lit(0.8)).alias("confidence"), core_case.alias("core_page_affected"),
        _case(share, n / cp).alias("affected_share"), n.alias("n_hits"), "n_urls",
    )


def findings(a: Audit, rules=None) -> tuple[DataFrame, DataFrame]:
    """(findings, withheld) of all sites.

    findings: site_id, rule, severity, evidence_level, confidence, core_page_affected, affected_share, n_hits, n_urls
    (all hits and addresses), evidence (the first EVIDENCE hits), affected_urls (the first URLS addresses). withheld:
    hits that are signals only, or whose rule stays below its threshold on the site.
    """
    h = shared_table(stored_hits(a, rules), "hits")
    j = judge(h, site_measures(a))
    yes = j.where("fires AND some")
    w = Window.partitionBy("site_id", "rule").orderBy("ord", "url")
    lead = _lead()
    shown = h.where((F.col("kind") != "note") & F.col("observation").isNotNull() & lead)
    top = shown.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= EVIDENCE)
    ev = top.groupBy("site_id", "rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "url", "observation", "measurement"))), lambda e: F.struct(e["url"].alias("url"), e["observation"].alias("observation"), e["measurement"].alias("measurement"))).alias("evidence")
    )
    u = h.where((F.col("kind") != "note") & lead).select("site_id", "rule", "ord", F.posexplode("urls").alias("i", "u")).groupBy("site_id", "rule", "u").agg(F.min(F.struct("ord", "i")).alias("o"))
    u = u.withColumn("rk", F.row_number().over(Window.partitionBy("site_id", "rule").orderBy("o", "u"))).where(F.col("rk") <= URLS)
    u = u.groupBy("site_id", "rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "u"))), lambda x: x["u"]).alias("affected_urls"))
    found = yes.join(ev, ["site_id", "rule"]).join(u, ["site_id", "rule"], "left").drop("fires", "some")
    held = h.where(F.col("observation").isNotNull()).join(yes.select("site_id", "rule", F.lit(True).alias("fired")), ["site_id", "rule"], "left")
    held = held.where((F.col("kind") == "note") | F.col("fired").isNull()).select(
        "site_id", "rule", "url", "observation", "measurement",
        F.when(F.col("kind") == "note", "a signal only").otherwise("below the threshold of the rule").alias("why_withheld"),
    )
    return found, held
