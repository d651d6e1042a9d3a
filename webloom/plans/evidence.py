"""Page evidence of many sites: the tables the rules read, derived once.

Everything is keyed by site_id. Page-level measures are Column expressions over one narrow pass; the only Python stage
opens JSON-LD blocks. Page sets: html (2xx and HTML), content (html and no utility or asset address).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from threading import RLock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entity as E
from ..functions import text as T
from ..functions import url as U
from ..runtime import load, one_delivery, shared_table, width
from ..sources.html import extract_pages, graph_nodes

# Paths and addresses with a role of their own.
PAGINATION = r"(?i)([?&]page=|/page/\d+|[?&]p=\d+|[?&]offset=)"
LOW_TEXT_PATH = (
    r"(?i)/(contact|locations?|gallery|media|press-kit|downloads?|thank-you|subscribe|unsubscribe|legal|terms|privacy|cookies?)(/|$)"
)
EDITORIAL_PATH = r"(?i)/(blog|news|articles?|insights?|stories|press|resources|guides?)(/|$)"
ARCHIVE_PATH = r"(?i)/(archive|changelog|releases?|history|20\d{2})(/|$)"
ABOUT_PATH = r"(?i)/(about|about-us|company|who-we-are|our-story|corporate|overview)(/|$|\.)"
LISTING_PATH = r"(?i)/(blog|news|articles?|category|categories|collections?|tag|tags|search|shop|products?)(/|$)"
CAMPAIGN_PATH = r"(?i)/(offers?|deals?|sale|promo|campaign|lp|landing)(/|$)"
CAMPAIGN_TITLE = r"(?i)\b(sale|offer|deal|discount|% off|coupon)\b"
BYLINE = r"(?U)\b(by\s+[A-Z][a-z]+(?:\s+[A-Z][a-z\.]+){0,2})\b"

#: Columns only an extraction of the document gives, with what stands for them where there is none.
_EXTRA = {
    "link_rels": "cast(array() as array<struct<rel:string,href:string>>)",
    "images": "cast(array() as array<struct<src:string,alt:string>>)",
    "time_elements": "cast(array() as array<struct<datetime:string,text:string>>)",
    "microdata_types": "cast(array() as array<string>)", "text_promo": "''", "text_hidden": "''",
    "hidden_containers": "cast(array() as array<string>)", "blocks": "cast(array() as array<string>)", "noscript_text": "''",
    "script_bytes": "0L", "script_tags": "0", "empty_app_root": "false", "app_root_id": "''",
    "selects": "cast(array() as array<struct<name:string,n_options:int>>)", "buttons": "cast(array() as array<string>)",
    "location_gate_hits": "cast(array() as array<string>)",
}

_NODE = (
    "site_id long, page_ord long, node_ord int, types array<string>, name string, publisher_name string, description string, "
    "same_as array<string>, identifier string, url string, price string, ranged boolean, availability string, attributed boolean, "
    "dates array<string>, fields array<string>"
)


def _number(v) -> str | None:
    s = "".join(c for c in str(v) if c in "0123456789.")
    if not s or s.count(".") > 1 or s == ".":
        return None
    x = float(s)
    return str(int(x)) if x.is_integer() else f"{x:.2f}".rstrip("0").rstrip(".")


def _node_row(n: dict) -> tuple:
    """What the rules ask of a JSON-LD node."""
    t = n.get("@type")
    types = [str(x).lower() for x in t] if isinstance(t, list) else [str(t).lower()] if t else []
    offers = n.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers
    offer = offer if isinstance(offer, dict) else None
    priced = offer if offer and (offer.get("price", offer.get("lowPrice")) is not None) else n
    price = priced.get("price", priced.get("lowPrice"))
    src = offer or n
    av = src.get("availability")
    av = av.rsplit("/", 1)[-1].lower() if isinstance(av, str) else ""
    state = "instock" if "instock" in av else "outofstock" if "outofstock" in av or "soldout" in av else None
    pub = n.get("publisher")
    same = n.get("sameAs")
    same = [same] if isinstance(same, str) else same if isinstance(same, list) else []

    def credited(v) -> bool:
        return bool(v.get("name")) if isinstance(v, dict) else bool(v.strip()) if isinstance(v, str) else isinstance(v, list) and bool(v)

    text = lambda v: v if isinstance(v, str) else None
    return (
        types, text(n.get("name")), text(pub.get("name")) if isinstance(pub, dict) else None, text(n.get("description")),
        [x.strip() for x in same if isinstance(x, str)], text(n.get("identifier")), text(n.get("url")),
        _number(price) if price is not None else None, bool(src.get("lowPrice") or src.get("highPrice")), state,
        any(credited(n.get(k)) for k in ("author", "publisher", "creator")),
        [n[k] for k in ("dateModified", "datePublished", "uploadDate", "dateCreated") if isinstance(n.get(k), str)],
        [k for k in E.DISAMBIGUATORS if n.get(k)],
    )


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in _NODE.split(", ")]
    for pdf in batches:
        rows = []
        for site, page, blocks in zip(pdf["site_id"], pdf["page_ord"], pdf["jsonld"]):
            at = 0
            for b in blocks if blocks is not None else ():
                try:
                    found = graph_nodes(json.loads(b))
                except (ValueError, RecursionError, TypeError):
                    continue
                for n in found:
                    rows.append((site, page, at, *_node_row(n)))
                    at += 1
        yield pd.DataFrame(rows, columns=cols)


def derive(page: DataFrame, site: DataFrame) -> DataFrame:
    """page rows with the measures the rules use; site gives root_url and as_of."""
    p = page.join(site.select("site_id", "root_url", "as_of"), "site_id")
    p = p.withColumns(
        {
            "final_url": F.coalesce(F.nullif("final_url", F.lit("")), "url"),
            "title": F.coalesce("title", F.lit("")), "lang": F.lower(F.coalesce("lang", F.lit(""))),
            "text_main": F.coalesce("text_main", F.lit("")), "text_chrome": F.coalesce("text_chrome", F.lit("")),
            "canonical": F.coalesce("canonical", F.lit("")), "depth": F.coalesce("depth", F.lit(1)),
            "links": F.coalesce("links", F.expr("cast(array() as array<struct<href:string,text:string,rel:string,region:string,internal:boolean,has_img:boolean,img_alt:string>>)")),
            "headings": F.coalesce("headings", F.expr("cast(array() as array<struct<level:int,heading:string>>)")),
            "meta": F.coalesce("meta", F.expr("cast(map() as map<string,string>)")),
            "headers": F.coalesce("headers", F.expr("cast(map() as map<string,string>)")),
            "html_bytes": F.coalesce("html_bytes", F.lit(0)),
        }
    )
    p = U.with_normalized(p, url_norm="final_url", canonical_norm="canonical", root_norm="root_url")
    kind = F.lower(F.coalesce(F.col("headers")["content-type"], F.lit("")))
    p = p.withColumns(
        {
            "path": F.when(U.url_path("final_url") == "", F.lit("/")).otherwise(U.url_path("final_url")),
            "words_main": T.word_count("text_main"), "words_chrome": T.word_count("text_chrome"), "words_hidden": T.word_count("text_hidden"),
            "n_links": F.size("links"),
            "link_chars": F.aggregate("links", F.lit(0), lambda a, x: a + F.length(F.coalesce(x["text"], F.lit("")))),
            "h1s": F.transform(F.filter("headings", lambda h: (h["level"] == 1) & (F.trim(h["heading"]) != "")), lambda h: h["heading"]),
            "is_html": kind.contains("html") | ((kind == "") & ((F.col("title") != "") | (F.col("text_main") != ""))),
            "directives": E.robots_directives("meta", "headers"),
        }
    )
    p = p.withColumns(
        {
            "words_visible": F.greatest(F.lit(0), F.col("words_main") - F.col("words_hidden")),
            "words_all": F.col("words_main") + F.col("words_chrome"),
            "regions_unreliable": (F.trim("text_chrome") == "") & (F.col("n_links") > 25),
            "readable": F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False)) & F.col("is_html"),
            "is_core": (F.col("depth") == 0) | (F.col("path") == "/") | (U.path_importance("final_url") >= 8),
            "is_target": F.col("url_norm") == F.col("root_norm"),
        }
    )
    return p.withColumn("is_content", F.col("readable") & U.is_crawlable("final_url"))


@dataclass
class Audit:
    """The tables of one run. With keep, derived pages and JSON-LD nodes are written to the shared folder the first
    time a rule asks for them; a run over all rules reads them dozens of times."""

    site: DataFrame
    page: DataFrame
    edge: DataFrame
    sitemap: DataFrame
    failure: DataFrame
    robots: DataFrame
    probe: DataFrame
    rendered: DataFrame
    keep: bool = False
    _made: dict = field(default_factory=dict, repr=False)
    _lock: RLock = field(default_factory=RLock, repr=False)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return shared_table(df, name) if self.keep else df

    def once(self, name: str, build) -> DataFrame:
        """build() the first time it is asked for under this name, kept like the derived pages; rules may ask at once."""
        with self._lock:
            if name not in self._made:
                self._made[name] = self._kept(build(), name)
            return self._made[name]

    @property
    def spark(self) -> SparkSession:
        return self.site.sparkSession

    @cached_property
    def pages(self) -> DataFrame:
        """All pages with their measures."""
        return self._kept(derive(self.page, self.site), "pages")

    @cached_property
    def content(self) -> DataFrame:
        return self.pages.where("is_content")

    @cached_property
    def home(self) -> DataFrame:
        """(site_id, home_ord, home_url, home_norm, home_site_name): the first page of depth 0 or path '/', else the first."""
        first = F.min_by(
            F.struct("page_ord", "final_url", "url_norm", E.meta_get("meta", "og:site_name", "application-name").alias("name")),
            F.struct(~((F.col("depth") == 0) | (F.col("path") == "/")), F.col("page_ord")),
        )
        home = self.pages.groupBy("site_id").agg(first.alias("h")).select(
            "site_id", F.col("h.page_ord").alias("home_ord"), F.col("h.final_url").alias("home_url"), F.col("h.url_norm").alias("home_norm"),
            F.col("h.name").alias("home_site_name"),
        )
        return self._kept(home, "home")

    @cached_property
    def nodes(self) -> DataFrame:
        """JSON-LD nodes of content pages."""
        c = self.content.select("site_id", F.col("page_ord").cast("long").alias("page_ord"), "jsonld").where(F.size("jsonld") > 0)
        return self._kept(c.mapInPandas(_nodes, _NODE), "nodes")

    @cached_property
    def links(self) -> DataFrame:
        """One row per link of a content page, in document order."""
        rows = self.content.select("site_id", "page_ord", "final_url", F.posexplode("links").alias("link_ord", "l"))
        return U.with_normalized(rows, href_norm="l.href").select(
            "site_id", "page_ord", "final_url", "link_ord", F.col("l.href").alias("href"), "href_norm",
            F.coalesce("l.text", F.lit("")).alias("text"), F.coalesce(F.nullif("l.text", F.lit("")), F.col("l.img_alt"), F.lit("")).alias("label"),
            F.coalesce("l.region", F.lit("main")).alias("region"), F.coalesce("l.internal", F.lit(False)).alias("internal"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """(site_id, src, dst): distinct internal links in comparison form."""
        e = U.with_normalized(self.edge.select("site_id", "src", "dst").distinct(), src="src", dst="dst")
        return self._kept(e.where("src <> '' AND dst <> ''").distinct(), "edges")

    @cached_property
    def sitemap_urls(self) -> DataFrame:
        """(site_id, url_norm)."""
        m = U.with_normalized(self.sitemap.select("site_id", "loc").distinct(), url_norm="loc").select("site_id", "url_norm")
        return self._kept(m.where("url_norm <> ''").distinct(), "sitemap")

    @cached_property
    def size(self) -> DataFrame:
        """(site_id, n_cp, n_pages, n_readable)."""
        return self.pages.groupBy("site_id").agg(
            F.count_if("is_content").alias("n_cp"), F.count(F.lit(1)).alias("n_pages"), F.count_if("readable").alias("n_readable")
        )


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


ROBOTS = "site_id long, status int, text string"
PROBE = (
    "site_id long, url string, source string, kind string, status int, checked boolean, title string, text_sample string, "
    "site_name string, links_back boolean, description string, final_url string, canonical string"
)
RENDERED = "site_id long, url string, html string"


def from_tables(spark: SparkSession, d: str, with_capture: bool = True, keep: bool = True) -> Audit:
    """An audit of the page, site, link, sitemap and failure tables in a folder; with_capture adds what only an
    extraction of the captured documents gives."""
    raw = load(spark, d, "page")
    cols = [c for c in raw.columns if c not in ("page_id", "captured_at", "ingested_at")]
    page = one_delivery(raw.where("deleted_at IS NULL AND site_id IS NOT NULL"), "page_id", *cols).drop("deleted_at")
    if with_capture:
        cap = load(spark, d, "capture").where("length(body) > 0 AND page_id IS NOT NULL")
        cap = cap.select("page_id", "url", "final_url", "body", "fetched_at").repartition(width(spark), "page_id")
        latest = cap.groupBy("page_id").agg(F.max_by(F.struct("url", "final_url", "body"), F.struct("fetched_at", "body")).alias("c")).select("page_id", "c.*")
        more = extract_pages(latest).select("page_id", *_EXTRA)
        page = page.join(more, "page_id", "left")
        page = page.withColumns({k: F.coalesce(k, F.expr(v)) for k, v in _EXTRA.items()})
    else:
        page = page.withColumns({k: F.expr(v) for k, v in _EXTRA.items()})
    site = load(spark, d, "site").select(
        "site_id", "root_url", F.coalesce("crawl_scope", F.lit("site")).alias("scope"), F.to_date("as_of").alias("as_of"), "robots_url",
        F.coalesce("sitemap_status", F.lit("not-checked")).alias("sitemap_status"), F.coalesce("sitemap_lastmod_count", F.lit(0)).alias("sitemap_lastmod_count"),
        F.coalesce("limitations", F.expr("cast(array() as array<string>)")).alias("limitations"),
    )
    return Audit(
        site=site, page=page, edge=load(spark, d, "link_edge").select("site_id", "src", "dst"), sitemap=load(spark, d, "sitemap_entry").select("site_id", "loc"),
        failure=load(spark, d, "fetch_failure").select("failure_id", "site_id", "url", "status", "error", "source", "referrers").distinct(),
        robots=_empty(spark, ROBOTS), probe=_empty(spark, PROBE), rendered=_empty(spark, RENDERED), keep=keep,
    )


def from_html(spark: SparkSession, sites: dict[int, dict], as_of: str = "2026-06-15") -> Audit:
    """An audit of documents given as text, for tests and small runs.

    sites: site_id -> {pages: {url or path: html}, root, robots_text, sitemap: [url], scope, headers: {path: {..}},
    statuses: {path: int}, sitemap_status, failures: [..], link_checks: [..], lastmod_count, probes: [..], rendered:
    {url: html}, depths: {path: int}}. The first page has depth 0, the others depth 1.
    """
    rows, site_rows, sm, fl, rb, pr, rd = [], [], [], [], [], [], []
    for sid, s in sites.items():
        root = s.get("root", "http://example.test/")
        full = lambda u: u if u.startswith("http") else root.rstrip("/") + ("/" + u.lstrip("/"))  # noqa: B023, E731
        for i, (u, h) in enumerate(s.get("pages", {}).items()):
            rows.append(
                (len(rows), sid, i, full(u), full(u), s.get("statuses", {}).get(u, 200), {k.lower(): v for k, v in s.get("headers", {}).get(u, {"content-type": "text/html"}).items()},
                 s.get("depths", {}).get(u, 0 if i == 0 else 1), "seed" if i == 0 else "link", h)
            )
        maps = s.get("sitemap")
        status = s.get("sitemap_status") or ("absent" if maps is None else "ok" if maps else "empty")
        site_rows.append((sid, root, s.get("scope", "site"), as_of, full("/robots.txt"), status, s.get("lastmod_count", 0), s.get("limitations", [])))
        sm += [(sid, full(u)) for u in maps or []]
        fl += [(len(fl) + k, sid, full(f["url"]), f.get("status", 0), f.get("error", ""), f.get("source", "link"), f.get("referrers", [])) for k, f in enumerate(s.get("failures", []))]
        fl += [(len(fl) + k, sid, full(f["url"]), f.get("status", 0), f.get("error", ""), "check", f.get("referrers", [])) for k, f in enumerate(s.get("link_checks", []))]
        if s.get("robots_text") is not None:
            rb.append((sid, 200, s["robots_text"]))
        for q in s.get("probes", []):
            d = {"source": "sameAs", "kind": "reference", "status": 200, "checked": True, "title": "", "text_sample": "", "site_name": "", "links_back": False, "description": "", "final_url": "", "canonical": ""} | q
            pr.append((sid, *(d[k.split()[0]] for k in PROBE.split(", ")[1:])))
        rd += [(sid, u, h) for u, h in s.get("rendered", {}).items()]
    cap = spark.createDataFrame(
        rows, "page_id long, site_id long, page_ord int, url string, final_url string, status int, headers map<string,string>, depth int, source string, body string"
    )
    ext = extract_pages(cap)
    page = cap.drop("body").join(ext, "page_id")
    edge = page.select("site_id", F.col("final_url").alias("src"), F.explode("links").alias("l")).where("l.internal").select("site_id", "src", F.col("l.href").alias("dst"))
    site = spark.createDataFrame(
        site_rows, "site_id long, root_url string, scope string, as_of string, robots_url string, sitemap_status string, sitemap_lastmod_count int, limitations array<string>"
    ).withColumn("as_of", F.to_date("as_of"))
    return Audit(
        site=site, page=page, edge=edge, sitemap=spark.createDataFrame(sm, "site_id long, loc string"),
        failure=spark.createDataFrame(fl, "failure_id long, site_id long, url string, status int, error string, source string, referrers array<string>"),
        robots=spark.createDataFrame(rb, ROBOTS), probe=spark.createDataFrame(pr, PROBE), rendered=spark.createDataFrame(rd, RENDERED), keep=True,
    )


def page_dates(a: Audit) -> DataFrame:
    """(site_id, page_ord, dates): array of (d, source) in the order JSON-LD, time elements, meta, visible text."""
    return a.once("dates", lambda: _page_dates(a))


def _page_dates(a: Audit) -> DataFrame:
    ld = a.nodes.groupBy("site_id", "page_ord").agg(F.flatten(F.array_sort(F.collect_list(F.struct("node_ord", "dates"))).getField("dates")).alias("ld"))
    keys = ("article:modified_time", "article:published_time", "date", "dc.date", "last-modified")
    c = a.content.select("site_id", "page_ord", "as_of", "time_elements", "meta", "text_main").join(ld, ["site_id", "page_ord"], "left")
    dated = lambda arr, f, src: F.filter(F.transform(arr, lambda x: F.struct(f(x).alias("d"), F.lit(src).alias("source"))), lambda s: s["d"].isNotNull())
    none = F.expr("cast(array() as array<string>)")
    as_of = F.col("as_of")
    first = lambda x: F.try_element_at(T.find_dates(x, as_of), F.lit(1))
    all_dates = F.concat(
        dated(F.coalesce("ld", none), lambda x: T.parse_datetime_attr(x, as_of), "JSON-LD"),
        dated("time_elements", lambda x: F.coalesce(T.parse_datetime_attr(x["datetime"], as_of), first(x["text"])), "time element"),
        dated(F.array(*[F.coalesce(F.col("meta")[k], F.lit("")) for k in keys]), lambda x: T.parse_datetime_attr(x, as_of), "meta"),
        F.transform(T.find_dates("text_main", as_of), lambda d: F.struct(d.alias("d"), F.lit("visible text").alias("source"))),
    )
    return c.select("site_id", "page_ord", all_dates.alias("dates"))


def rendering(a: Audit) -> DataFrame:
    """(site_id, page_ord, rendering): classification of every page, raised by rendered snapshots."""
    snap = a.rendered.select(F.monotonically_increasing_id().alias("page_id"), "site_id", "url", F.col("url").alias("final_url"), F.col("html").alias("body"))
    shown = extract_pages(snap).select("page_id", T.word_count("text_main").alias("rendered_words"))
    shown = snap.select("page_id", "site_id", U.normalize_url("url").alias("url_norm")).join(shown, "page_id").groupBy("site_id", "url_norm").agg(F.max("rendered_words").alias("rendered_words"))
    base = E.rendering_classification(
        F.col("words_visible"), F.col("words_hidden"), F.col("empty_app_root"), F.col("script_bytes"), F.col("html_bytes"), F.col("script_tags")
    )
    return a.pages.join(shown, ["site_id", "url_norm"], "left").select(
        "site_id", "page_ord", E.rendering_of(base, F.col("words_main"), F.col("rendered_words")).alias("rendering")
    )


