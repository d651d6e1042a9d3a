"""Queries over relational operators, rules and whole runs, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import url as U
from .operators import similarity
from .plans import evidence as V
from .plans import registry as R
from .plans import report, rules, score
from .queries import sql_norm
from .queries_functions import _NORM, _STOP, _W, pages, query
from .queries_functions import QUERIES as QUERIES
from .queries_functions import SQL as SQL
from .runtime import load, one_delivery, ranked, shared_dir, shared_table, width
from .sources import sitemap as SM
from .streaming import captures as S

_ONE = """(SELECT page_id, any_value(site_id) site_id, any_value(page_ord) page_ord, any_value(url) url, any_value(coalesce(nullif(final_url, ''), url)) fu, any_value(status) status,
  any_value(coalesce(title, '')) title, any_value(coalesce(text_main, '')) tm, any_value(coalesce(text_chrome, '')) tc, any_value(depth) depth, any_value(headers) headers, any_value(meta) meta,
  any_value(links) links, any_value(headings) headings, any_value(coalesce(canonical, '')) canonical FROM page WHERE deleted_at IS NULL AND site_id IS NOT NULL GROUP BY page_id)"""
_PATH = "regexp_replace(regexp_extract(fu, '^(?:[A-Za-z]+:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
_CT = "lower(coalesce(headers['content-type'], ''))"
_CONTENT = f"""(SELECT p.*, {sql_norm("fu")} AS url_norm, {_PATH} AS path, len(regexp_extract_all(lower(tm), {_W})) AS wm, len(regexp_extract_all(lower(tc), {_W})) AS wc FROM {_ONE} p
  JOIN (SELECT DISTINCT site_id FROM site) USING (site_id)
  WHERE status BETWEEN 200 AND 299 AND (contains({_CT}, 'html') OR ({_CT} = '' AND (title <> '' OR tm <> ''))) AND NOT regexp_matches({_PATH}, '{U.ASSET}') AND NOT regexp_matches(fu, '{U.UTILITY}'))"""


def audit(spark: SparkSession, d: str, capture: bool = False) -> V.Audit:
    return V.from_tables(spark, d, with_capture=capture, keep=capture)


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Captured documents, spread over all cores: parsing them costs far more than reading them."""
    c = load(spark, d, "capture").where("page_id IS NOT NULL").select("page_id", "url", "final_url", "body")
    return c.repartition(width(spark))


# --- Relational operators ----------------------------------------------------------------------------------------------


@query("s13_link_edges", f"SELECT DISTINCT site_id, src, dst FROM (SELECT site_id, {sql_norm('src')} src, {sql_norm('dst')} dst FROM link_edge) WHERE src <> '' AND dst <> ''")
def s13(spark, d):
    return audit(spark, d).edges


_SLUG = "list_transform(list_filter(string_split(PATH, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$|^[0-9a-f]{8,}$|^.{25,}$|\\d{3,}') THEN '{slug}' ELSE lower(s) END)"
_NPATH = "regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_IMP = (
    f"CASE WHEN lower({_NPATH}) IN ('', '/') THEN 12 ELSE greatest(0, greatest(0, " + ", ".join(f"CASE WHEN contains(lower({_NPATH}), '{h}') THEN {w} ELSE 0 END" for h, w in U.PATH_HINTS)
    + f") - greatest(0, len(list_filter(string_split({_NPATH}, '/'), lambda s: s <> '')) - 2)) END"
)
_HOST = "regexp_replace(regexp_extract({}, '^[a-z]+://([^/?#]*)', 1), '^www[.]', '')"
# Words of utility addresses and endings of assets, as SQL of its own.
_NO_CRAWL = (
    "(regexp_matches(u, '(?i)/(cart|checkout|basket|login|signin|sign-in|signup|register|account|my-?account|admin|wp-admin|wp-login|search|api|graphql|cdn-cgi|logout|password|order|orders|payment|wishlist|preferences|settings|session|auth)(/|$|[?])')"
    f" OR regexp_matches({_NPATH}, '(?i)[.](jpg|jpeg|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|gz|mp4|mp3|webm|woff2?|ttf|eot|dmg|exe|csv|xlsx?|docx?|pptx?)$'))"
)

_S14 = f"""WITH e AS (SELECT DISTINCT site_id, {sql_norm('src')} src, {sql_norm('dst')} u FROM link_edge),
p AS (SELECT DISTINCT site_id, u FROM (SELECT site_id, {sql_norm('url')} u FROM page UNION ALL SELECT site_id, {sql_norm('final_url')} FROM page)),
t AS (SELECT e.site_id, e.u, count(DISTINCT src) n, list_sort(list_distinct(list(src)))[1:3] refs FROM e ANTI JOIN p ON p.site_id = e.site_id AND p.u = e.u WHERE e.u <> '' AND src <> '' AND NOT {_NO_CRAWL.replace('(u,', '(e.u,').replace('regexp_extract(u,', 'regexp_extract(e.u,')} GROUP BY ALL),
f AS (SELECT site_id, u, max(status) status FROM (SELECT site_id, {sql_norm('url')} u, coalesce(status, 0) status FROM fetch_failure) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, {_IMP} DESC, u) rk FROM t)
SELECT r.site_id, r.u AS dst, n AS referrers, array_to_string(refs, ' ') AS first_referrers, rk, coalesce(f.status, -1) AS status, coalesce(f.status >= 400 OR f.status = 0, false) AS failed
FROM r LEFT JOIN f ON f.site_id = r.site_id AND f.u = r.u WHERE rk <= 10"""


@query("s14_unfetched_targets", _S14)
def s14(spark, d):
    """The ten content targets of a site that were not fetched, most referring pages first, then by importance; three
    referrers of each, and what a fetch of it came to where one is on record."""
    p = load(spark, d, "page").select("site_id", F.explode(F.array("url", "final_url")).alias("a")).distinct()
    known = U.with_normalized(p, dst="a").select("site_id", "dst").distinct()
    t = shared_table(audit(spark, d).edges.join(known, ["site_id", "dst"], "left_anti").where(U.is_crawlable("dst")), "targets")
    # The referrers of a target may be very many: counted, and the first three by a running minimum.
    first = t.groupBy("site_id", "dst").agg(F.count(F.lit(1)).alias("referrers"))
    w = Window.partitionBy("site_id").orderBy(F.col("referrers").desc(), F.col("importance").desc(), "dst")
    top = first.withColumn("importance", U.path_importance("dst")).withColumn("rk", F.row_number().over(w)).where("rk <= 10")
    refs = ranked(t.join(top.select("site_id", "dst"), ["site_id", "dst"], "left_semi"), ["site_id", "dst"], ["src"], 3)
    refs = refs.groupBy("site_id", "dst").agg(F.array_join(F.array_sort(F.collect_list("src")), " ").alias("first_referrers"))
    f = U.with_normalized(load(spark, d, "fetch_failure").select("site_id", "url", F.coalesce("status", F.lit(0)).alias("status")), dst="url")
    f = f.groupBy("site_id", "dst").agg(F.max("status").alias("status"))
    j = top.join(refs, ["site_id", "dst"]).join(f, ["site_id", "dst"], "left")
    return j.select("site_id", "dst", "referrers", "first_referrers", "rk", F.coalesce("status", F.lit(-1)).alias("status"), F.coalesce((F.col("status") >= 400) | (F.col("status") == 0), F.lit(False)).alias("failed"))


def _candidates(spark, d):
    """What a crawl may look at next: links of the entry page first, then the sitemap, without the target itself."""
    a = audit(spark, d)
    h = a.pages.join(a.home.select("site_id", F.col("home_ord").alias("page_ord")), ["site_id", "page_ord"])
    links = h.select("site_id", F.posexplode("links").alias("o", "l")).where("l.internal").select("site_id", F.col("o").cast("long").alias("o"), F.col("l.href").alias("u"))
    maps = load(spark, d, "sitemap_entry").select("site_id", (F.col("entry_id") + F.lit(10**6)).alias("o"), F.col("loc").alias("u"))
    c = U.with_normalized(links.unionByName(maps), url_norm="u").groupBy("site_id", "url_norm").agg(F.min("o").alias("ord")).where("url_norm <> ''")
    root = U.with_normalized(a.site.select("site_id", "root_url"), root_norm="root_url")
    return c.join(root, "site_id").where((F.col("url_norm") != F.col("root_norm")) & U.same_site("url_norm", "root_norm")).select("site_id", "url_norm", "ord")


#: Pages a crawl reads of a site, the entry page included.
MAX_PAGES = 20
_HOMEPAGE = f"""(SELECT site_id, arg_min(links, (CASE WHEN depth = 0 OR {_PATH} IN ('', '/') THEN 0 ELSE 1 END) * 1000000 + page_ord) links FROM {_ONE} p JOIN (SELECT DISTINCT site_id FROM site) USING (site_id) GROUP BY site_id)"""
_S11 = f"""WITH x AS (SELECT site_id, l.o - 1 o, l.l.href h FROM (SELECT site_id, unnest(list_transform(links, lambda l, i: {{'o': i, 'l': l}})) l FROM {_HOMEPAGE} hp) WHERE l.l.internal
  UNION ALL SELECT site_id, entry_id + 1000000, loc FROM sitemap_entry),
c AS (SELECT site_id, u, min(o) o FROM (SELECT site_id, o, {sql_norm('h')} u FROM x) WHERE u <> '' GROUP BY ALL),
s AS (SELECT site_id, {sql_norm('root_url')} root FROM site),
k AS (SELECT c.*, '/' || array_to_string({_SLUG.replace('PATH', _NPATH)}, '/') t, {_IMP} v FROM c JOIN s USING (site_id) WHERE u <> root AND {_HOST.format('u')} = {_HOST.format('root')} AND NOT {_NO_CRAWL}),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id, t ORDER BY v DESC, o) rnd, max(v) OVER (PARTITION BY site_id, t) top FROM k),
b AS (SELECT *, dense_rank() OVER (PARTITION BY site_id ORDER BY top DESC, t) b FROM r),
n AS (SELECT *, max(b) OVER (PARTITION BY site_id) nb FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rnd, b) pos FROM n WHERE rnd <= CASE WHEN nb <= 4 THEN 6 ELSE 3 END)
SELECT site_id, u AS url_norm, t AS template, rnd AS round, pos AS position FROM q WHERE pos <= {MAX_PAGES - 1}"""


@query("s11_stratified_queue", _S11)
def s11(spark, d):
    return SM.stratified_queue(_candidates(spark, d), MAX_PAGES - 1)


@query("s10_sitemap_first_seen", f"SELECT site_id, u AS url_norm, min(o) AS ord FROM (SELECT site_id, {sql_norm('loc')} u, row_number() OVER (PARTITION BY site_id ORDER BY entry_id, loc, seen_at) o FROM sitemap_entry) WHERE u <> '' GROUP BY ALL")
def s10(spark, d):
    return SM.first_seen(load(spark, d, "sitemap_entry"), "site_id", "loc", ["entry_id", "loc", "seen_at"])


_R03 = f"""SELECT site_id, t, count(DISTINCT url_norm) AS n_urls FROM (SELECT site_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) t, url_norm FROM {_CONTENT} c) WHERE t <> '' GROUP BY ALL HAVING count(DISTINCT url_norm) > 1"""


@query("r03_shared_titles", _R03)
def r03(spark, d):
    c = audit(spark, d).content.select("site_id", F.lower(T.normalize_ws("title")).alias("t"), "url_norm").where("t <> ''")
    return c.groupBy("site_id", "t").agg(F.countDistinct("url_norm").alias("n_urls")).where("n_urls > 1")


_R05 = f"""SELECT site_id, url_norm, min(page_ord) AS pos, max(page_ord) AS member FROM {_CONTENT} c WHERE page_ord IS NOT NULL GROUP BY ALL"""


@query("r05_last_member_first_place", _R05)
def r05(spark, d):
    c = audit(spark, d).content.where("page_ord IS NOT NULL")
    return c.groupBy("site_id", "url_norm").agg(F.min("page_ord").alias("pos"), F.max("page_ord").alias("member"))


_GRAMS = f"""g AS (SELECT k, b, ws, len(ws) n, CASE WHEN len(ws) >= 6 THEN list_distinct(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+5], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END s FROM w)"""
_JAC = "CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1.0 WHEN len(x.s) = 0 OR len(y.s) = 0 THEN 0.0 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END"
_R07 = f"""WITH w AS (SELECT page_id k, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) b, regexp_extract_all(lower(tm), {_W}) ws FROM {_ONE} p WHERE trim(title) <> ''), {_GRAMS},
j AS (SELECT x.b, x.k a, y.k o, {_JAC} sim FROM g x JOIN g y ON x.b = y.b AND x.k < y.k)
SELECT b AS title, a, min(o) AS b FROM j WHERE sim < 0.8 GROUP BY ALL"""


@query("r07_first_unlike_page_of_title", _R07)
def r07(spark, d):
    """For every page the first later page with its title whose text is less than 0.8 alike."""
    p = pages(spark, d, "title", "text_main", "deleted_at", "site_id").where("deleted_at IS NULL AND site_id IS NOT NULL AND trim(title) <> ''")
    rows = p.select(F.lower(T.normalize_ws("title")).alias("title"), "page_id", F.lit(0).alias("n"), T.shingles("text_main").alias("g"))
    return similarity.first_unlike(rows, ["title"], "page_id", "g", 0.8).select("title", "a", "b")


_R08 = f"""WITH w AS (SELECT page_id k, site_id b, regexp_extract_all(lower(tm), {_W}) ws FROM {_ONE} p WHERE tm <> ''), {_GRAMS}
SELECT x.b AS site_id, x.k AS a, y.k AS b, round({_JAC}, 6)::DOUBLE AS similarity FROM g x JOIN g y ON x.b = y.b AND x.k < y.k WHERE {_JAC} >= 0.8"""


@query("r08_similar_pages_of_site", _R08)
def r08(spark, d):
    p = pages(spark, d, "site_id", "text_main", "deleted_at").where("deleted_at IS NULL AND text_main <> ''")
    rows = p.select("site_id", "page_id", T.shingles("text_main").alias("g"))
    j = similarity.prefix_join(rows, ["site_id"], "page_id", "g", 0.8)
    return j.select("site_id", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("r15_median_words", f"SELECT site_id, CAST(floor(median(wm)) AS BIGINT) AS median_words FROM {_CONTENT} c GROUP BY site_id")
def r15(spark, d):
    c = audit(spark, d).content
    return c.groupBy("site_id").agg(F.floor(F.median("words_main")).alias("median_words"))


_F = [
    (1, "MR-001", "critical", "verified", 0.98, True, 1.0), (1, "FI-004", "high", "verified", 0.93, False, 0.3), (1, "AX-005", "low", "corroborated", 0.76, False, 0.9),
    (1, "AX-002", "medium", "corroborated", 0.5, True, 0.2), (2, "MR-002", "medium", "verified", 0.99, True, 1.0), (2, "EX-004", "low", "corroborated", 0.74, False, 0.3), (2, "FI-005", "high", "verified", 1.2, False, -1.0),
]
_STAGE = {r["rule"]: r["stage"] for r in R.REGISTRY}
_FSQL = "(VALUES " + ", ".join(f"({a}, '{b}', '{c}', '{e}', {f}, {str(g).lower()}, {h}, '{_STAGE[b]}')" for a, b, c, e, f, g, h in _F) + ") f(site_id, rule, severity, level, conf, core, share, stage)"
_case = lambda col, m: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"
_P = f"""WITH a AS (SELECT *, round(least(greatest(conf, {_case('level', {k: v[0] for k, v in R.LEVEL_BAND.items()})}), {_case('level', {k: v[1] for k, v in R.LEVEL_BAND.items()})}), 2) c,
  round(CASE WHEN core THEN greatest(0.4 + 0.6 * least(1.0, greatest(0.0, share)), 0.85) ELSE 0.4 + 0.6 * least(1.0, greatest(0.0, share)) END, 3) sf FROM {_FSQL}),
s AS (SELECT *, round({_case('severity', R.SEVERITY_WEIGHT)} * c * sf * {_case('stage', R.STAGE_WEIGHT)}, 4) sc FROM a),
b AS (SELECT *, CASE WHEN sc >= 0.52 THEN 'P0' WHEN sc >= 0.34 THEN 'P1' WHEN sc >= 0.12 THEN 'P2' ELSE 'P3' END band FROM s),
p AS (SELECT *, CASE WHEN severity = 'critical' AND level = 'verified' THEN 'P0' WHEN severity = 'medium' AND band = 'P0' THEN 'P1' WHEN severity = 'low' AND band IN ('P0', 'P1') THEN 'P2' ELSE band END pr FROM b)
SELECT site_id, rule, c::DOUBLE AS confidence, sf::DOUBLE AS surface, sc::DOUBLE AS score, pr AS priority, printf('F-%03d', row_number() OVER (PARTITION BY site_id ORDER BY pr, sc DESC, rule)) AS report_id FROM p"""


def _scored(spark):
    f = spark.createDataFrame([(*r, _STAGE[r[1]]) for r in _F], "site_id int, rule string, severity string, level string, conf double, core boolean, share double, stage string")
    f = f.withColumn("confidence", score.clamp_confidence("level", "conf")).withColumn("surface", score.affected_surface("share", "core"))
    f = f.withColumn("score", score.score("severity", "confidence", "surface", "stage")).withColumn("priority", score.priority("score", "severity", "level"))
    w = Window.partitionBy("site_id").orderBy("priority", F.col("score").desc(), "rule")
    return f.withColumn("report_id", F.format_string("F-%03d", F.row_number().over(w)))


@query("p09_p12_score_and_rank", _P)
def p09(spark, d):
    return _scored(spark).select("site_id", "rule", "confidence", "surface", "score", "priority", "report_id")


QUERIES["score_and_rank"] = QUERIES.pop("p09_p12_score_and_rank")
SQL["score_and_rank"] = SQL.pop("p09_p12_score_and_rank")


@query("r23_severity_counts", f"SELECT site_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM {_FSQL} GROUP BY site_id")
def r23(spark, d):
    return score.summary(_scored(spark))


@query(
    "r22_stage_rollup",
    f"""WITH st AS (SELECT unnest({list(R.STAGES)}) stage), g AS (SELECT DISTINCT site_id FROM {_FSQL}), r AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END k FROM {_FSQL})
    SELECT g.site_id, st.stage, CASE max(k) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS worst, count(k) AS n FROM g CROSS JOIN st LEFT JOIN r ON r.site_id = g.site_id AND r.stage = st.stage GROUP BY ALL""",
)
def r22(spark, d):
    f = _scored(spark)
    return score.stage_rollup(f, f.select("site_id").distinct()).select("site_id", "stage", F.col("worst_severity").alias("worst"), F.size("report_ids").cast("long").alias("n"))


# --- Rules ---------------------------------------------------------------------------------------------------------------


@query("rule_mr002_noindex", f"SELECT site_id, fu AS url FROM {_CONTENT} c WHERE len(list_filter(list_concat(string_split(lower(coalesce(meta['robots'], '')), ','), list_concat(string_split(lower(coalesce(meta['googlebot'], '')), ','), string_split(lower(coalesce(headers['x-robots-tag'], '')), ','))), lambda x: trim(x) IN ('noindex', 'none'))) > 0")
def rule_mr002(spark, d):
    return rules.mr002(audit(spark, d)).select("site_id", "url")


@query(
    "rule_mr006_heavy_navigation",
    f"""SELECT site_id, fu AS url FROM (SELECT *, list_sum(list_transform(links, lambda l: len(coalesce(l.text, '')))) lc, len(links) nl FROM {_CONTENT} c)
    WHERE NOT (trim(tc) = '' AND nl > 25) AND wm + wc >= 60 AND wm < 0.25 * (wm + wc) AND lc > 0.5 * (len(tm) + len(tc)) AND nl > 60""",
)
def rule_mr006(spark, d):
    return rules.mr006(audit(spark, d)).where("kind = 'page'").select("site_id", "url")


@query("rule_mr007_no_heading", f"SELECT site_id, fu AS url FROM {_CONTENT} c WHERE wm >= 120 AND len(list_filter(coalesce(headings, []), lambda h: h.level = 1 AND trim(h.heading) <> '')) = 0")
def rule_mr007(spark, d):
    return rules.mr007(audit(spark, d)).where("kind = 'no-h1'").select("site_id", "url")


_ANCHOR = f"""a AS (SELECT site_id, page_id, l, {sql_norm('l.href')} h, coalesce(nullif(l.text, ''), l.img_alt, '') lab FROM (SELECT site_id, page_id, unnest(links) l FROM {_CONTENT} c) WHERE l.internal AND NOT regexp_matches(l.href, '{V.PAGINATION}')),
b AS (SELECT *, regexp_replace(lower(trim(regexp_replace(lab, '\\s+', ' ', 'g'))), '^[ .:\\-–—>»]+|[ .:\\-–—>»]+$', '', 'g') t FROM a WHERE NOT regexp_matches(trim(lab), '^[0-9]+$')),
v AS (SELECT *, t IN ({", ".join("'" + x.replace("'", "''") + "'" for x in T.NONDESCRIPTIVE)}) OR len(list_filter(regexp_extract_all(t, {_W}), lambda w: w NOT IN ({_STOP}))) = 0 plain FROM b)"""


@query("rule_mr009_weak_anchors", f"WITH {_ANCHOR} SELECT site_id, count(*) AS n, count(*) FILTER (plain AND NOT EXISTS (SELECT 1 FROM v o WHERE o.site_id = v.site_id AND o.h = v.h AND NOT o.plain)) AS weak FROM v GROUP BY site_id")
def rule_mr009(spark, d):
    a = rules.anchor_rows(audit(spark, d))
    return a.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("weak").alias("weak"))


@query(
    "rule_ax003_dead_ends",
    f"""SELECT site_id, fu AS url, n_in FROM (SELECT *, len(list_distinct(list_transform(list_filter(links, lambda l: coalesce(l.region, 'main') = 'main' AND l.internal), lambda l: l.href))) n_in,
      len(list_filter(links, lambda l: coalesce(l.region, 'main') = 'main' AND regexp_matches(coalesce(l.text, ''), '(?i)\\b(buy|shop|order|book|start|get started|sign ?up|subscribe|try|download|contact|request|demo|add to cart|apply|register|enrol|enroll|checkout|donate|join)\\b'))) > 0 cta,
      trim(tc) = '' AND len(links) > 25 vague FROM {_CONTENT} c WHERE wm >= 150) WHERE NOT vague AND n_in < 3 AND NOT (cta AND n_in >= 1)""",
)
def rule_ax003(spark, d):
    h = rules.ax003(audit(spark, d)).where("kind = 'page'")
    return h.select("site_id", "url", F.regexp_extract("measurement", r"text=(\d+)", 1).cast("int").alias("n_in"))


_AX1 = f"""WITH h AS (SELECT site_id, arg_min(coalesce(nullif(meta['og:site_name'], ''), nullif(meta['application-name'], ''), ''), (CASE WHEN depth = 0 OR {_PATH} IN ('', '/') THEN 0 ELSE 1 END) * 1000000 + page_ord) nm FROM {_ONE} p GROUP BY site_id),
c AS (SELECT c.*, s.root_url, coalesce(h.nm, '') nm, list_filter(coalesce(headings, []), lambda x: x.level = 1 AND trim(x.heading) <> '')[1].heading h1 FROM {_CONTENT} c JOIN site s USING (site_id) LEFT JOIN h USING (site_id)),
t AS (SELECT site_id, fu, list_filter(list_distinct(list_filter(regexp_extract_all(lower(title), {_W}), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))), lambda w: NOT list_contains(list_concat([split_part(regexp_replace(regexp_replace(lower(regexp_extract(root_url, '//([^/?#]*)', 1)), ':.*$', ''), '^www[.]', ''), '.', 1)], regexp_extract_all(lower(nm), {_W})), w)) tt,
  list_distinct(list_filter(regexp_extract_all(lower(h1), {_W}), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))) ht, list_distinct(list_filter(regexp_extract_all(lower(tm), {_W}), lambda w: len(w) > 1 AND w NOT IN ({_STOP}))) bt FROM c WHERE wm >= 80 AND trim(title) <> '' AND h1 IS NOT NULL)
SELECT site_id, count(*) AS measured, count(*) FILTER (len(list_intersect(tt, bt)) < 0.3 * len(tt)) AS uncovered FROM t WHERE len(tt) >= 3 GROUP BY site_id"""


@query("rule_ax001_title_cover", _AX1)
def rule_ax001(spark, d):
    """Pages whose title can be measured, and those whose text covers less than 0.3 of it."""
    from .functions import entity as E

    a = audit(spark, d)
    c = a.content.where((F.col("words_main") >= 80) & (F.trim("title") != "") & (F.size("h1s") > 0)).join(a.home.select("site_id", "home_site_name"), "site_id")
    c = c.withColumn("tt", F.array_except(T.content_tokens("title"), E.brand_tokens("root_url", "home_site_name"))).where(F.size("tt") >= 3)
    low = T.overlap_ratio(F.col("tt"), T.content_tokens("text_main")) < 0.3
    return c.groupBy("site_id").agg(F.count(F.lit(1)).alias("measured"), F.count_if(low).alias("uncovered"))


# Nodes of a page's JSON-LD: objects that lists and @graph alone lead to; a typed wrapper of a graph counts, too.
_NODES = f"""raw AS (SELECT site_id, page_id, page_ord, fu, tm, title, headings, status, i, CASE WHEN json_valid(jsonld[i]) THEN jsonld[i] ELSE 'null' END j
    FROM (SELECT c.*, p.jsonld, unnest(range(1, len(p.jsonld) + 1)) i FROM {_CONTENT} c JOIN (SELECT page_id, any_value(jsonld) jsonld FROM page GROUP BY page_id) p USING (page_id))),
nodes AS (SELECT site_id, page_id, page_ord, fu, tm, title, headings, n.value v, n.fullkey fk, i, n.id FROM raw, json_tree(raw.j) n
    WHERE n.type = 'OBJECT' AND regexp_matches(n.fullkey, '^\\$(\\[[0-9]+\\]|\\."@graph"\\[[0-9]+\\])*$') AND (json_type(n.value, '$."@graph"') IS DISTINCT FROM 'ARRAY' OR n.value->>'$."@type"' IS NOT NULL)),
typed AS (SELECT *, lower(CASE json_type(v, '$."@type"') WHEN 'ARRAY' THEN array_to_string(v->>'$."@type"[*]', ' ') ELSE v->>'$."@type"' END) ty FROM nodes)"""
_ENTITY_TYPE = "regexp_matches(ty, '(^| )(" + "|".join(("organization", "localbusiness", "corporation", "website", "onlinestore", "store", "ngo", "educationalorganization", "governmentorganization", "restaurant", "medicalorganization", "sportsorganization", "performinggroup", "airline")) + ")( |$)')"


@query("n01_entity_nodes", f"WITH {_NODES} SELECT site_id, count(*) AS n, count(DISTINCT page_id) AS pages FROM typed WHERE {_ENTITY_TYPE} GROUP BY site_id")
def n01(spark, d):
    """Nodes of entity types, and pages with one."""
    from .functions import entity as E

    n = audit(spark, d).nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in E.ENTITY_TYPES])))
    return n.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_ord").alias("pages"))


@query("h23_node_types", f"WITH {_NODES} SELECT ty AS types, count(*) AS n, count(v->>'$.name') FILTER (json_type(v, '$.name') = 'VARCHAR') AS named FROM typed GROUP BY ty")
def h23(spark, d):
    n = audit(spark, d).nodes
    return n.groupBy(F.when(F.size("types") > 0, F.array_join("types", " ")).alias("types")).agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"))


_BROKEN = f"""f AS (SELECT site_id, u, max(c) c, arg_max(referrers, (c, status, referrers)) told FROM (SELECT DISTINCT site_id, {sql_norm('url')} u, status, CASE WHEN source = 'check' THEN 1 ELSE 0 END c, referrers FROM fetch_failure WHERE status >= 400 AND status <> 429) WHERE u <> '' GROUP BY ALL),
e AS (SELECT DISTINCT site_id, src, dst FROM (SELECT site_id, {sql_norm('src')} src, {sql_norm('dst')} dst FROM link_edge) WHERE src <> '' AND dst <> ''),
hp AS (SELECT site_id, {sql_norm('fu')} hn FROM (SELECT site_id, arg_min(fu, (CASE WHEN depth = 0 OR {_PATH} IN ('', '/') THEN 0 ELSE 1 END) * 1000000 + page_ord) fu FROM {_ONE} p JOIN (SELECT DISTINCT site_id FROM site) USING (site_id) GROUP BY site_id))"""


@query("rule_mr003_broken_destinations", f"""WITH {_BROKEN}, g AS (SELECT f.site_id, f.u, list_sort(list_distinct(list(e.src)))[1:3] refs FROM f JOIN e ON e.site_id = f.site_id AND e.dst = f.u WHERE c = 0 GROUP BY f.site_id, f.u
  UNION ALL SELECT site_id, u, list(r ORDER BY k) FROM (SELECT site_id, u, k, {sql_norm('r')} r FROM (SELECT site_id, u, unnest(told[1:3]) r, generate_subscripts(told[1:3], 1) k FROM f WHERE c = 1)) GROUP BY site_id, u) SELECT g.site_id, g.u AS url, array_to_string(refs, ' ') AS referrers, CASE WHEN list_contains(refs, hn) THEN 'home' ELSE 'page' END AS kind FROM g LEFT JOIN hp ON hp.site_id = g.site_id""")
def rule_mr003(spark, d):
    """Linked destinations that fail, with three pages that link to them; as the SQL, of the home page if it is one of
    the three."""
    a = audit(spark, d)
    b = rules.broken_targets(a).where("rk <= 3").groupBy("site_id", F.col("url_norm").alias("url")).agg(F.array_sort(F.collect_list(F.struct("rk", "referrer"))).getField("referrer").alias("refs"))
    kind = F.when(F.array_contains("refs", F.col("home_norm")), "home").otherwise("page")
    return b.join(a.home.select("site_id", "home_norm"), "site_id", "left").select("site_id", "url", F.array_join("refs", " ").alias("referrers"), kind.alias("kind"))


@query("rule_mr007_untitled", f"SELECT site_id, count(*) AS n FROM (SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY page_ord) rk FROM {_CONTENT} c WHERE trim(title) = '') WHERE rk <= 3 GROUP BY site_id")
def rule_mr007_untitled(spark, d):
    """Untitled pages that are evidence: three a site at most, as in the SQL."""
    return rules.mr007(audit(spark, d)).where("kind IN ('untitled', 'untitled-core') AND observation IS NOT NULL").groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


@query("rule_mr008_no_sitemap", "SELECT site_id, 'sitemap ' || sitemap_status AS measurement FROM site WHERE coalesce(crawl_scope, 'site') = 'site' AND sitemap_status IN ('absent', 'unreachable', 'invalid', 'empty')")
def rule_mr008(spark, d):
    return rules.mr008(audit(spark, d)).where("kind = 'note'").select("site_id", "measurement")


_CAN = f"(SELECT c.*, {sql_norm('canonical')} cn FROM {_CONTENT} c)"


@query("rule_mr004_foreign_canonical", f"""SELECT c.site_id, c.fu AS url, 'canonical=' || canonical AS measurement FROM {_CAN} c JOIN site s USING (site_id)
WHERE cn <> '' AND cn <> url_norm AND NOT regexp_matches(fu, '{V.PAGINATION}') AND {_HOST.format('cn')} <> '' AND {_HOST.format('cn')} <> regexp_replace(lower(regexp_extract(root_url, '//([^/?#]*)', 1)), '^www[.]', '')
AND NOT EXISTS (SELECT 1 FROM (SELECT site_id, {sql_norm('url')} u FROM fetch_failure WHERE status >= 400) f WHERE f.site_id = c.site_id AND f.u = c.cn)""")
def rule_mr004(spark, d):
    return rules.mr004(audit(spark, d)).where("kind = 'host'").select("site_id", "url", "measurement")


_PRODUCT_TYPE = "regexp_matches(ty, '(^| )(product|offer|aggregateoffer|service|event|course)( |$)')"
_CTOK = "list_distinct(list_filter(regexp_extract_all(lower({}), " + _W + "), lambda w: len(w) > 1 AND w NOT IN (" + _STOP + ")))"


@query("rule_fi007_unattributed", f"""WITH {_NODES},
cr AS (SELECT DISTINCT page_id FROM nodes WHERE {" OR ".join(f"(json_type(v, '$.{k}') = 'VARCHAR' AND trim(v->>'$.{k}') <> '') OR (json_type(v, '$.{k}') = 'ARRAY' AND json_array_length(v, '$.{k}') > 0) OR (json_type(v, '$.{k}') = 'OBJECT' AND coalesce(v->>'$.{k}.name', '') <> '')" for k in ("author", "publisher", "creator"))}),
ar AS (SELECT DISTINCT page_id FROM typed WHERE regexp_matches(ty, '(^| )(article|blogposting|newsarticle|report)( |$)'))
SELECT c.site_id, c.fu AS url FROM {_CONTENT} c WHERE (page_id IN (SELECT page_id FROM ar) OR (regexp_matches(path, '{V.EDITORIAL_PATH}') AND wm >= 150)) AND page_id NOT IN (SELECT page_id FROM cr) AND coalesce(nullif(meta['author'], ''), nullif(meta['article:author'], ''), '') = ''""")
def rule_fi007(spark, d):
    """Editorial pages by type or address without an author or publisher in markup."""
    a = audit(spark, d)
    h = rules.fi007(a).select("site_id", "url")
    art = a.nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in ("article", "blogposting", "newsarticle", "report")]))).select("site_id", "page_ord").distinct().withColumn("art", F.lit(True))
    c = a.content.join(art, ["site_id", "page_ord"], "left").where(F.coalesce("art", F.lit(False)) | (F.col("path").rlike(V.EDITORIAL_PATH) & (F.col("words_main") >= 150)))
    return h.join(c.select("site_id", F.col("final_url").alias("url")).distinct(), ["site_id", "url"], "left_semi")


_SEEN = "regexp_extract_all(tm, '(?i)(?:₹|rs\\\\.?|inr|\\\\$|usd|us\\\\$|€|eur|£|gbp|¥|jpy|aud|cad)\\\\s?(?:\\\\d)')".replace("\\\\", "\\")


@query("rule_fi003_declared_names", f"""WITH {_NODES}, n AS (SELECT site_id, page_ord, fu, CASE json_type(v, '$.name') WHEN 'VARCHAR' THEN v->>'$.name' END nm, lower(tm || ' ' || title || ' ' || array_to_string(list_transform(list_filter(coalesce(headings, []), lambda h: h.level = 1 AND trim(h.heading) <> ''), lambda h: h.heading), ' ')) low, {_SEEN} seen FROM typed WHERE {_PRODUCT_TYPE}),
t AS (SELECT *, {_CTOK.format("coalesce(nm, '')")} nt, {_CTOK.format('low')} bt FROM n)
SELECT site_id, fu AS url, count(*) AS n FROM t WHERE len(seen) = 0 AND len(nt) >= 2 AND len(list_intersect(nt, bt)) < 0.25 * len(nt) GROUP BY site_id, fu""")
def rule_fi003_names(spark, d):
    """Declared names that pages without any price do not show."""
    a = audit(spark, d)
    h = rules.fi003(a).where("kind = 'name'")
    c = a.content.where(F.size(F.regexp_extract_all("text_main", F.lit(T.CURRENCY), F.lit(1))) == 0).select("site_id", F.col("final_url").alias("url")).distinct()
    return h.join(c, ["site_id", "url"], "left_semi").groupBy("site_id", "url").agg(F.count(F.lit(1)).alias("n"))


def _typed(*names: str) -> str:
    return f"regexp_matches(ty, '(^| )({'|'.join(names)})( |$)')"


_OWN_IMP = _IMP.replace(_NPATH, _PATH)
_DEF = r"(?i)\b(?:is|are|was|were)\s+(?:a|an|the|one of|india''s|the world''s|our|your|\w+''s)\b|\b(?:provides?|offers?|helps?|enables?|delivers?|specialis[ez]es?|builds?|makes?|sells?|lets you|allows you)\b"
_TEXT_DATE = "((january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec))"
_DATED = f"""regexp_matches(tm, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b') OR regexp_matches(lower(tm), '\\b[0-9]{{1,2}}\\s+{_TEXT_DATE}[.]?,?\\s+[0-9]{{4}}\\b|\\b{_TEXT_DATE}[.]?\\s+[0-9]{{1,2}}(st|nd|rd|th)?,?\\s+[0-9]{{4}}\\b')
  OR regexp_matches(tm, '\\b((1[3-9]|2[0-9]|3[01])/[01]?[0-9]|[01]?[0-9]/(1[3-9]|2[0-9]|3[01]))/[0-9]{{4}}\\b')"""
_NOW = ("latest", "current", "currently", "today", "this week", "this month", "right now", "as of", "up to date", "up-to-date", "newest", "just launched", "today''s", "updated daily", "last updated", "most recent")


@query("rule_fi005_undated_claims", f"""WITH {_NODES},
d AS (SELECT DISTINCT page_id FROM nodes WHERE {" OR ".join(f"(json_type(v, '$.{k}') = 'VARCHAR' AND regexp_matches(v->>'$.{k}', '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))" for k in ("dateModified", "datePublished", "uploadDate", "dateCreated"))})
SELECT c.site_id, c.fu AS url, CASE WHEN coalesce(headers['last-modified'], '') <> '' THEN 'weak' ELSE 'undated' END AS kind FROM {_CONTENT} c JOIN site s USING (site_id)
WHERE (contains(tm, strftime(s.as_of, '%Y')) OR {" OR ".join(f"contains(lower(tm), '{x}')" for x in _NOW)}) AND page_id NOT IN (SELECT page_id FROM d)
  AND NOT ({" OR ".join(f"regexp_matches(coalesce(meta['{k}'], ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')" for k in ("article:modified_time", "article:published_time", "date", "dc.date", "last-modified"))}) AND NOT ({_DATED})""")
def rule_fi005(spark, d):
    return rules.fi005(audit(spark, d)).select("site_id", "url", "kind")


@query("rule_ax002_orientation", f"""WITH {_NODES},
told AS (SELECT page_id, arg_min(v->>'$.description', (i, id)) de FROM nodes WHERE json_type(v, '$.description') = 'VARCHAR' AND len(regexp_extract_all(lower(v->>'$.description'), {_W})) >= 12 GROUP BY page_id),
o AS (SELECT c.*, coalesce(nullif(meta['description'], ''), nullif(meta['og:description'], ''), de, '') des, array_to_string(list_filter(string_split_regex(tm, '\\s+'), lambda w: w <> '')[1:120], ' ') opening, p.lang FROM {_CONTENT} c LEFT JOIN told USING (page_id) JOIN (SELECT page_id, any_value(lower(coalesce(lang, ''))) lang FROM page GROUP BY page_id) p USING (page_id))
SELECT site_id, fu AS url, CASE WHEN regexp_matches(des, '{_DEF}') THEN 'meta' ELSE 'gap' END AS kind FROM o
WHERE wm >= 40 AND (coalesce(depth, 1) = 0 OR path IN ('', '/') OR {_OWN_IMP} >= 8) AND NOT regexp_matches(path, '{V.LISTING_PATH}') AND NOT regexp_matches(opening, '{_DEF}') AND NOT (lang <> '' AND NOT starts_with(lang, 'en') AND coalesce(meta['description'], '') <> '')""")
def rule_ax002(spark, d):
    return rules.ax002(audit(spark, d)).select("site_id", "url", "kind")


_O_ENTITY = _typed("organization", "localbusiness", "corporation", "website", "onlinestore", "store")
_O_HOME = f"(SELECT site_id, arg_min(page_id, (CASE WHEN depth = 0 OR {_PATH} IN ('', '/') THEN 0 ELSE 1 END) * 1000000 + page_ord) home FROM {_ONE} p JOIN (SELECT DISTINCT site_id FROM site) USING (site_id) GROUP BY site_id)"
_ASKS = ("faq", "frequently asked", "how do i", "how to", "what is", "can i ", "do you ", "?")


@query("opportunities_by_kind", f"""WITH {_NODES}, ent AS (SELECT DISTINCT site_id FROM typed WHERE {_O_ENTITY}), hp AS (SELECT site_id, home FROM {_O_HOME} h),
same AS (SELECT DISTINCT site_id FROM typed WHERE {_O_ENTITY} AND (json_type(v, '$.sameAs') = 'VARCHAR' OR (json_type(v, '$.sameAs') = 'ARRAY' AND json_array_length(v, '$.sameAs') > 0))),
decl AS (SELECT DISTINCT site_id FROM typed WHERE {_ENTITY_TYPE} AND ((json_type(v, '$.sameAs') = 'VARCHAR' AND starts_with(trim(v->>'$.sameAs'), 'http')) OR (json_type(v, '$.sameAs') = 'ARRAY' AND len(list_filter(v->>'$.sameAs[*]', lambda x: starts_with(trim(x), 'http'))) > 0) OR starts_with(v->>'$.identifier', 'http'))),
c AS (SELECT * FROM {_CONTENT} c), maps AS (SELECT site_id, count(DISTINCT u) n FROM (SELECT site_id, {sql_norm('loc')} u FROM sitemap_entry) WHERE u <> '' GROUP BY site_id)
SELECT site_id, 'external_identifiers' AS kind FROM hp WHERE site_id IN (FROM ent) AND site_id NOT IN (FROM decl)
UNION ALL SELECT site_id, 'same_as' FROM hp WHERE site_id IN (FROM ent) AND site_id NOT IN (FROM same)
UNION ALL SELECT site_id, 'sitemap_absent' FROM site WHERE coalesce(crawl_scope, 'site') = 'site' AND sitemap_status IN ('absent', 'unreachable', 'invalid', 'empty')
UNION ALL SELECT DISTINCT site_id, 'faq_markup' FROM c WHERE {" + ".join(f"contains(lower(tm), '{x}')::INT" for x in _ASKS)} >= 2 AND len(regexp_extract_all(tm, '[?]')) >= 3 AND site_id NOT IN (SELECT site_id FROM typed WHERE {_typed('faqpage', 'qapage', 'howto')})
UNION ALL SELECT site_id, 'breadcrumbs' FROM c WHERE depth >= 2 AND site_id NOT IN (SELECT site_id FROM typed WHERE {_typed('breadcrumblist')}) GROUP BY site_id HAVING count(*) >= 2
UNION ALL SELECT site_id, 'passage_structure' FROM c WHERE wm >= 400 AND len(list_filter(coalesce(headings, []), lambda h: h.level IN (2, 3))) < 2 GROUP BY site_id HAVING count(*) >= 2
UNION ALL SELECT site_id, 'entity_summary' FROM hp WHERE home NOT IN (SELECT page_id FROM typed WHERE {_O_ENTITY} AND json_type(v, '$.description') = 'VARCHAR' AND len(regexp_extract_all(lower(v->>'$.description'), {_W})) >= 12)
UNION ALL SELECT s.site_id, 'sitemap_lastmod' FROM site s LEFT JOIN maps ON maps.site_id = s.site_id WHERE sitemap_status = 'ok' AND coalesce(sitemap_lastmod_count, 0) < greatest(1, floor(coalesce(n, 0) / 2))
UNION ALL SELECT site_id, 'product_markup' FROM c WHERE len({_SEEN}) > 0 AND page_id NOT IN (SELECT page_id FROM typed WHERE {_typed('product', 'offer', 'aggregateoffer', 'service')}) GROUP BY site_id HAVING count(*) >= 2""")
def opportunities_by_kind(spark, d):
    """Opportunities as if no rule had fired."""
    from .plans.opportunities import opportunities

    none = spark.createDataFrame([], "site_id long, rule string")
    return opportunities(audit(spark, d), none).select("site_id", "kind")


@query("rule_mr005_empty_documents", f"""WITH b AS (SELECT page_id, arg_max(body, (fetched_at, body)) b FROM capture WHERE length(body) > 0 AND page_id IS NOT NULL GROUP BY page_id)
SELECT site_id, fu AS url, wm AS words FROM {_CONTENT} c JOIN b USING (page_id) WHERE wm < 120 AND NOT regexp_matches(path, '{V.LOW_TEXT_PATH}')
  AND (regexp_matches(b, '<div id="(root|app|__next|__nuxt|svelte|main-app)"></div>'))
  AND len(regexp_extract_all(lower(array_to_string(regexp_extract_all(b, '(?s)<noscript>(.*?)</noscript>', 1), ' ')), {_W})) < 40""")
def rule_mr005(spark, d):
    """Documents with an empty application root and almost no text."""
    h = rules.mr005(audit(spark, d, True)).where("kind <> 'note'")
    return h.select("site_id", "url", F.col("x").cast("int").alias("words"))


@query("audit_scope_and_status", f"""WITH n AS (SELECT p.site_id, count(*) FILTER (status BETWEEN 200 AND 299 AND (contains({_CT}, 'html') OR ({_CT} = '' AND (title <> '' OR tm <> '')))) readable FROM {_ONE} p JOIN (SELECT DISTINCT site_id FROM site) USING (site_id) GROUP BY p.site_id),
f AS (SELECT DISTINCT site_id FROM fetch_failure)
SELECT s.site_id, CASE WHEN coalesce(readable, 0) = 0 THEN 'inconclusive' WHEN coalesce(crawl_scope, 'site') = 'page' THEN 'complete' WHEN coalesce(readable, 0) < 3 OR len(coalesce(limitations, [])) > 0 OR f.site_id IS NOT NULL THEN 'partial' ELSE 'complete' END AS status
FROM site s LEFT JOIN n ON n.site_id = s.site_id LEFT JOIN f ON f.site_id = s.site_id""")
def audit_scope(spark, d):
    return score.audit_status(rules.site_measures(audit(spark, d)))


@query("rule_fi002_no_identity")
def rule_fi002(spark, d):
    return rules.fi002(audit(spark, d)).select("site_id", "url")


@query("rule_fi004_duplicates")
def rule_fi004(spark, d):
    return rules.fi004(audit(spark, d)).select("site_id", "url", "measurement")


@query("rule_hits_all")
def rule_hits(spark, d):
    """Hits of every rule on every site, by kind."""
    h = rules.stored_hits(audit(spark, d, True))
    return h.groupBy("site_id", "rule", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- Runs ------------------------------------------------------------------------------------------------------------------


@query("extract_evidence")
def extract_evidence(spark, d):
    """The HTML stage over every captured document."""
    from .sources.html import extract_pages

    e = extract_pages(captures(spark, d))
    return e.select("page_id", "title", "lang", F.size("links").alias("n_links"), T.word_count("text_main").alias("words_main"), F.size("jsonld").alias("n_jsonld"), "script_tags")


@query("extract_titles", r"SELECT page_id, count(*) AS n, count(DISTINCT trim(regexp_replace(regexp_extract(coalesce(body, ''), '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS titles FROM capture WHERE page_id IS NOT NULL GROUP BY page_id")
def extract_titles(spark, d):
    """Titles by the HTML stage against a regular expression: as many distinct ones per page."""
    from .sources.html import extract_pages

    e = extract_pages(captures(spark, d))
    return e.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"))


def _markup(select: str) -> str:
    """SQL over captured documents, one row a page: sums over its fetches."""
    return f"WITH b AS (SELECT page_id, coalesce(body, '') b FROM capture WHERE page_id IS NOT NULL) {select}"


def extracted(spark: SparkSession, d: str) -> DataFrame:
    from .sources.html import extract_pages

    return extract_pages(captures(spark, d))


_DROPPED = r"regexp_replace(regexp_replace(b, '(?s)<head>.*?(</head>|<body>|$)', ' '), '(?s)<(script|noscript|style)[^>]*>.*?(</(script|noscript|style)>|$)', ' ', 'g')"
_AREA = r"'(?s)<(nav|footer)[^>]*>.*?(</(nav|footer)>|$)'"
_UNTAG = r"regexp_replace(regexp_replace({}, '<[^>]*(>|$)', ' ', 'g'), '&[a-z]+;|&#[x0-9a-f]+;', ' ', 'g')"
_WORDS = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"


@query("h03_text_regions", _markup(f"SELECT page_id, count(*) AS n, min(md5({_WORDS.format(_UNTAG.format(f'regexp_replace({_DROPPED}, {_AREA}, chr(32), chr(103))'))})) AS main, min(md5({_WORDS.format(_UNTAG.format(f'array_to_string(regexp_extract_all({_DROPPED}, {_AREA}), chr(32))'))})) AS chrome FROM b GROUP BY page_id"))
def h03(spark, d):
    """Words of content and of navigation elements, in order."""
    w = lambda c: F.md5(F.array_join(F.regexp_extract_all(F.lower(F.regexp_replace(c, "&[a-z]+;", " ")), F.lit("([a-z0-9]+)"), F.lit(1)), " "))
    return extracted(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min(w("text_main")).alias("main"), F.min(w("text_chrome")).alias("chrome"))


@query("h06_lang_and_bytes", _markup("SELECT page_id, max(lower(regexp_extract(b, '<html[^>]*lang=\"([^\"]*)\"', 1))) AS lang, sum(length(b)) AS html_bytes FROM b GROUP BY page_id"))
def h06(spark, d):
    return extracted(spark, d).groupBy("page_id").agg(F.max("lang").alias("lang"), F.sum("html_bytes").alias("html_bytes"))


@query("h07_meta", _markup("SELECT page_id, max(lower(array_to_string(list_sort(list_distinct(regexp_extract_all(b, '<meta name=\"([^\"]*)\" content=\"[^\"]*\">', 1))), ' '))) AS names FROM b GROUP BY page_id"))
def h07(spark, d):
    return extracted(spark, d).groupBy("page_id").agg(F.max(F.array_join(F.array_sort(F.map_keys("meta")), " ")).alias("names"))


@query("h09_headings", _markup("SELECT page_id, sum(len(regexp_extract_all(b, '<h[1-6][^>]*>[^<]*[^<\\s][^<]*</h[1-6]>'))) AS n, max(trim(regexp_replace(replace(replace(regexp_extract(b, '<h2>([^<]*)</h2>', 1), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS first FROM b GROUP BY page_id"))
def h09(spark, d):
    e = extracted(spark, d)
    h2 = F.coalesce(F.try_element_at(F.filter("headings", lambda h: h["level"] == 2), F.lit(1))["heading"], F.lit(""))
    return e.groupBy("page_id").agg(F.sum(F.size("headings")).alias("n"), F.max(h2).alias("first"))


@query("h10_h11_links_and_images", _markup("SELECT page_id, sum(len(regexp_extract_all(b, '<a [^>]*href=\"[^\"]+\"'))) AS links, sum(len(regexp_extract_all(b, '<img [^>]*>'))) AS images, sum(len(regexp_extract_all(b, '<img [^>]*alt=\"[^\"]+\"'))) AS described FROM b GROUP BY page_id"))
def h11(spark, d):
    e = extracted(spark, d)
    return e.groupBy("page_id").agg(F.sum(F.size("links")).alias("links"), F.sum(F.size("images")).alias("images"), F.sum(F.size(F.filter("images", lambda i: i["alt"] != ""))).alias("described"))


@query("h12_jsonld_errors", _markup("SELECT page_id, sum(len(list_filter(regexp_extract_all(b, '(?s)<script type=\"application/ld\\+json\">(.*?)</script>', 1), lambda x: trim(x) <> '' AND NOT json_valid(x)))) AS broken FROM b GROUP BY page_id"))
def h12(spark, d):
    """JSON-LD blocks that can't be read."""
    return extracted(spark, d).groupBy("page_id").agg(F.sum(F.size("jsonld_errors")).alias("broken"))


@query("h13_h18_scripts_and_roots", _markup("SELECT page_id, sum(len(regexp_extract_all(b, '<script[ >]')))::BIGINT AS scripts, bool_or(regexp_matches(b, '<div id=\"(root|app|__next|__nuxt|svelte|main-app)\"></div>')) AS empty_root FROM b GROUP BY page_id"))
def h13(spark, d):
    return extracted(spark, d).groupBy("page_id").agg(F.sum("script_tags").alias("scripts"), F.max("empty_app_root").alias("empty_root"))


@query("h14_noscript", _markup("SELECT page_id, max(trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(b, '(?s)<noscript>(.*?)</noscript>', 1), ' '), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM b GROUP BY page_id"))
def h14(spark, d):
    return extracted(spark, d).groupBy("page_id").agg(F.max("noscript_text").alias("text"))


@query("audit_findings")
def audit_findings(spark, d):
    f = report.run(audit(spark, d, True)).findings
    return f.select("site_id", "report_id", "rule", "severity", "evidence_level", "confidence", "priority", "priority_score", "n_hits", F.col("n_urls").cast("int").alias("n_urls"))


@query("audit_withheld")
def audit_withheld(spark, d):
    return report.run(audit(spark, d, True)).withheld.groupBy("site_id", "rule", "why_withheld").agg(F.count(F.lit(1)).alias("n"))


@query("audit_opportunities")
def audit_opportunities(spark, d):
    return report.run(audit(spark, d, True)).opportunities


@query("audit_reports")
def audit_reports(spark, d):
    return report.reports(report.run(audit(spark, d, True)))


@query("audit_agent_brief", f"""SELECT site_id, page_ord, fu AS url, status, coalesce(depth, 1) AS depth, title, coalesce(list_filter(coalesce(headings, []), lambda h: h.level = 1 AND trim(h.heading) <> '')[1].heading, '') AS h1, canonical,
  len(regexp_extract_all(lower(tm), {_W})) AS main_words, len(list_filter(coalesce(links, []), lambda l: l.internal)) AS internal_links, len(list_filter(coalesce(links, []), lambda l: l.internal AND l.region = 'main')) AS main_region_links
  FROM {_ONE} p JOIN (SELECT DISTINCT site_id FROM site) USING (site_id)""")
def audit_brief(spark, d):
    return report.agent_brief(report.Result(None, None, None, None, None, audit(spark, d))).drop("robots_directives")


_TITLE_PARTS = r"list_filter(list_transform(string_split_regex(title, '\s*[|–—·•:]\s*|\s+-\s+'), lambda x: trim(x)), lambda x: x <> '')"
_HOLDER = r"trim(regexp_extract({}, '(?i)(?:©|\(c\)|copyright)\s*(?:\d{{4}}(?:\s*[-–]\s*\d{{4}})?)?\s*,?\s*([A-Z][A-Za-z0-9&''’.\- ]{{1,50}})', 1), ' .,')"
_RECURRING = f"""parts AS (SELECT site_id, page_ord, fu, {_TITLE_PARTS} p FROM {_CONTENT} c),
ends AS (SELECT site_id, page_ord, 0 AS i, p[1] raw FROM parts WHERE len(p) >= 2 UNION ALL SELECT site_id, page_ord, 1, p[len(p)] FROM parts WHERE len(p) >= 2),
many AS (SELECT site_id, norm, count(*) n, min((page_ord, i)) f, arg_min(raw, (page_ord, i)) raw FROM (SELECT *, {_NORM.format('raw')} norm FROM ends) WHERE length(norm) >= 2 GROUP BY site_id, norm HAVING count(*) >= 2),
recur AS (SELECT site_id, arg_max(norm, (n, -f[1], -f[2])) norm, arg_max(raw, (n, -f[1], -f[2])) raw FROM many GROUP BY site_id)"""
_NAMES = f"""{_NODES}, {_RECURRING},
said AS (SELECT site_id, 'og:site_name' source, coalesce(nullif(meta['og:site_name'], ''), nullif(meta['application-name'], ''), '') raw, page_ord * 8 o FROM {_CONTENT} c
  UNION ALL SELECT site_id, 'entity markup', CASE json_type(v, '$.name') WHEN 'VARCHAR' THEN v->>'$.name' END, page_ord * 8 + 1 FROM typed WHERE {_ENTITY_TYPE}
  UNION ALL SELECT site_id, 'publisher', CASE json_type(v, '$.publisher.name') WHEN 'VARCHAR' THEN v->>'$.publisher.name' END, page_ord * 8 + 2 FROM typed WHERE {_ENTITY_TYPE} AND json_type(v, '$.publisher') = 'OBJECT'
  UNION ALL SELECT site_id, 'copyright', coalesce(nullif({_HOLDER.format('tc')}, ''), {_HOLDER.format('tm')}), page_ord * 8 + 4 FROM {_CONTENT} c
  UNION ALL SELECT site_id, 'recurring title', raw, 1099511627776 FROM recur),
named AS (SELECT * FROM (SELECT *, {_NORM.format("coalesce(raw, '')")} norm FROM said) WHERE length(norm) >= 2)"""


@query("n02_recurring_title", f"WITH {_RECURRING} SELECT site_id, norm, raw FROM recur")
def n02_recurring(spark, d):
    return rules.recurring_title(audit(spark, d)).select("site_id", "norm", "raw")


@query("n03_name_candidates", f"WITH {_NAMES} SELECT site_id, source, norm, count(*) AS n FROM named GROUP BY site_id, source, norm")
def n03_candidates(spark, d):
    return rules.name_candidates(audit(spark, d)).groupBy("site_id", "source", "norm").agg(F.count(F.lit(1)).alias("n"))


@query("names_published", f"WITH {_NAMES}, g AS (SELECT site_id, norm, count(*) n, min(o) f FROM named GROUP BY site_id, norm) SELECT site_id, norm, n FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, f, norm) rk FROM g) WHERE rk = 1")
def names_published(spark, d):
    return rules.published_names(audit(spark, d)).where("rk = 1").select("site_id", "norm", "n")


def _sql_compatible(a: str, b: str) -> str:
    ta, tb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    both = f"len(list_intersect(list_distinct({ta}), list_distinct({tb})))"
    da, db = f"len(list_distinct({ta}))", f"len(list_distinct({tb}))"
    short = lambda x, tx, ty: f"(len({tx}) = 1 AND length({x}) >= 2 AND array_to_string(list_transform({ty}, lambda q: left(q, 1)), '') = {x})"
    return f"({a} = {b} OR {both} IN ({da}, {db}) OR contains({a}, {b}) OR contains({b}, {a}) OR {short(a, ta, tb)} OR {short(b, tb, ta)} OR {both} >= 0.5 * ({da} + {db} - {both}))"


@query("rule_fi001_names_in_conflict", f"WITH {_NAMES}, u AS (SELECT DISTINCT site_id, source, norm FROM named) SELECT x.site_id, x.source || ' / ' || y.source AS sources, count(*) AS pairs FROM u x JOIN u y ON x.site_id = y.site_id AND x.source < y.source AND NOT {_sql_compatible('x.norm', 'y.norm')} GROUP BY ALL")
def rule_fi001(spark, d):
    h = rules.fi001(audit(spark, d)).where("kind = 'pair'")
    # "SOURCE "RAW" against SOURCE "RAW"" holds both kinds of places.
    src = F.concat(F.regexp_extract("measurement", '^([a-z:_ ]+) "', 1), F.lit(" / "), F.regexp_extract("measurement", '" against ([a-z:_ ]+) "', 1))
    return h.groupBy("site_id", src.alias("sources")).agg(F.count(F.lit(1)).alias("pairs"))


@query("rule_ex004_domain_and_name", f"""WITH {_NAMES}, g AS (SELECT site_id, norm, count(*) n, min(o) f FROM named GROUP BY site_id, norm), top AS (SELECT site_id, norm FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, f, norm) rk FROM g) WHERE rk = 1),
bridge AS (SELECT DISTINCT site_id FROM typed WHERE ({_typed('organization', 'localbusiness')} AND json_type(v, '$.url') = 'VARCHAR' AND v->>'$.url' <> '') OR ({_ENTITY_TYPE} AND json_type(v, '$.sameAs') IS NOT NULL AND v->>'$.sameAs' NOT IN ('', '[]', 'null'))),
l AS (SELECT site_id, string_split(regexp_replace(regexp_replace(lower(regexp_extract(root_url, '//([^/?#]*)', 1)), ':.*$', ''), '^www[.]', ''), '.') p FROM site), k AS (SELECT site_id, CASE WHEN len(p) < 2 THEN p[1] ELSE p[-2] END label, {_NORM.format('CASE WHEN len(p) < 2 THEN p[1] ELSE p[-2] END')} ln FROM l)
SELECT k.site_id, label, norm AS name FROM top JOIN k ON k.site_id = top.site_id WHERE label <> '' AND NOT {_sql_compatible('norm', 'ln')} AND NOT contains(replace(norm, ' ', ''), label) AND k.site_id NOT IN (FROM bridge)""")
def rule_ex004(spark, d):
    a = audit(spark, d)
    n = rules.published_names(a).where("rk = 1").select("site_id", F.col("norm").alias("name"))
    return rules.ex004(a).join(n, "site_id").select("site_id", F.regexp_extract("measurement", '^domain "([^"]*)"', 1).alias("label"), "name")


@query("references_declared")
def references_declared(spark, d):
    return rules.declared_references(audit(spark, d, True)).select("site_id", "url", "source")


@query("stream_first_fetches", "SELECT count(DISTINCT page_id) AS pages FROM capture WHERE page_id IS NOT NULL AND fetched_at IS NOT NULL")
def stream_first(spark, d):
    """The stream of captures worked off once: fetches of one page within the watermark count once."""
    at = f"{shared_dir(spark)}/webloom-stream-{uuid.uuid4().hex}"
    S.run_once(S.first_fetches(S.read_captures(spark, f"{d}/capture.parquet"), "400 days").select("page_id", "site_id", "at"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").agg(F.countDistinct("page_id").alias("pages"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """One row per site: findings by severity, the highest score and the first finding."""
    r = report.run(V.from_tables(spark, d))
    top = r.findings.groupBy("site_id").agg(F.max("priority_score").alias("top_score"), F.min_by("rule", "report_id").alias("first_rule"))
    return r.status.join(score.summary(r.findings), "site_id", "left").join(top, "site_id", "left").na.fill(0)


QUERIES["flagship"] = flagship


_R24 = f"""WITH RECURSIVE e AS (SELECT DISTINCT site_id, {sql_norm('src')} src, {sql_norm('dst')} dst FROM link_edge),
s AS (SELECT site_id, {sql_norm('root_url')} u FROM site),
b AS (SELECT site_id, u, 0 AS depth FROM s UNION SELECT e.site_id, e.dst, b.depth + 1 FROM b JOIN e ON e.site_id = b.site_id AND e.src = b.u WHERE b.depth < 6)
SELECT site_id, u AS url, min(depth) AS depth FROM b WHERE u <> '' GROUP BY ALL"""


@query("r24_link_depth", _R24)
def r24(spark, d):
    """All pages that links lead to from the root address, and how many it takes. The SQL looks six links far."""
    from .operators.graph import depths

    a = audit(spark, d)
    return depths(a.edges, a.site.select("site_id", U.normalize_url("root_url").alias("url")).where("url <> ''"))


@query("s15_probe_plan")
def s15(spark, d):
    from .sources.capture import probe_plan

    a = audit(spark, d, True)
    return probe_plan(rules.declared_references(a), a.site)


# A robots text for every site that names one, made of the same two rules by both sides.
ROBOTS = "User-agent: *\nDisallow: /blog/\nDisallow: /products/ # not yet\nAllow: /\n\nUser-agent: other\nDisallow: /guides/\nCrawl-delay: 3\nSitemap: https://maps.example/s.xml"


def robots(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "site").where("robots_url IS NOT NULL").select("site_id", F.lit(200).alias("status"), F.lit(ROBOTS).alias("text"))


_BLOCKED = f"(r.site_id IS NOT NULL AND regexp_matches({_NPATH}, '^/(blog|products)/'))"
_ROBOT_SITES = "(SELECT DISTINCT site_id FROM site WHERE robots_url IS NOT NULL)"
_S12 = f"""WITH q AS ({_S11}), k AS (SELECT DISTINCT site_id, u FROM (SELECT site_id, {sql_norm('url')} u FROM page))
SELECT q.site_id, q.url_norm, position, CASE WHEN k.u IS NOT NULL THEN 'known' WHEN {_BLOCKED.replace(_NPATH, _NPATH.replace('(u,', '(q.url_norm,'))} THEN 'blocked' ELSE 'fetch' END AS state
FROM q LEFT JOIN k ON k.site_id = q.site_id AND k.u = q.url_norm LEFT JOIN {_ROBOT_SITES} r ON r.site_id = q.site_id"""


@query("s12_fetch_plan", _S12)
def s12(spark, d):
    """The queue with what is captured already and what robots texts (robots()) disallow."""
    from .sources.capture import fetch_plan
    from .sources.robots import allowed

    q = SM.stratified_queue(_candidates(spark, d), MAX_PAGES - 1)
    may = allowed(robots(spark, d), q.select("site_id", F.col("url_norm").alias("url")))
    return fetch_plan(q, load(spark, d, "page"), may)


_PAGE_URLS = f"(SELECT DISTINCT site_id, u FROM (SELECT site_id, {sql_norm('url')} u FROM page) WHERE u <> '' AND site_id IS NOT NULL)"


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return U.with_normalized(load(spark, d, "page").where("site_id IS NOT NULL").select("site_id", "url").distinct(), u="url").where("u <> ''").select("site_id", F.col("u").alias("url")).distinct()


@query("s03_robots_allowed_pages", f"SELECT p.site_id, p.u AS url, NOT {_BLOCKED.replace('(u,', '(p.u,')} AS allowed FROM {_PAGE_URLS} p LEFT JOIN {_ROBOT_SITES} r ON r.site_id = p.site_id")
def s03(spark, d):
    """Every page address under the robots text of its own site."""
    from .sources.robots import allowed

    return allowed(robots(spark, d), page_urls(spark, d))


@query(
    "s07_blocking_rules_pages",
    f"SELECT p.site_id, p.u AS url, '/' || regexp_extract({_NPATH.replace('(u,', '(p.u,')}, '^/(blog|products|guides)/', 1) || '/' AS rule FROM {_PAGE_URLS} p JOIN {_ROBOT_SITES} r ON r.site_id = p.site_id WHERE regexp_matches({_NPATH.replace('(u,', '(p.u,')}, '^/(blog|products|guides)/')",
)
def s07_pages(spark, d):
    """The rule, of any agent, that blocks an address."""
    from .sources.robots import blocking_rules, robots_lines

    return blocking_rules(robots_lines(robots(spark, d)), page_urls(spark, d)).select("site_id", "url", "rule")


@query("s05_robots_lines_sites", f"SELECT site_id, a AS agent, f AS field, v AS value FROM {_ROBOT_SITES} r, (VALUES ('*', 'user-agent', '*'), ('*', 'disallow', '/blog/'), ('*', 'disallow', '/products/'), ('*', 'allow', '/'), ('other', 'user-agent', 'other'), ('other', 'disallow', '/guides/'), ('other', 'crawl-delay', '3'), ('other', 'sitemap', 'https://maps.example/s.xml')) t(a, f, v)")
def s05_sites(spark, d):
    from .sources.robots import robots_lines

    return robots_lines(robots(spark, d)).select("site_id", "agent", "field", "value")


_MAP_ROWS = "(SELECT site_id, entry_id, any_value(loc) loc, any_value(lastmod) lastmod FROM sitemap_entry WHERE site_id IS NOT NULL GROUP BY site_id, entry_id)"


@query("s08_sitemap_documents", f"SELECT site_id, count(*) FILTER (loc IS NOT NULL) AS n_locs, min(loc) AS first, max(loc) AS last, count(lastmod) AS n_lastmod FROM {_MAP_ROWS} m GROUP BY site_id")
def s08_documents(spark, d):
    """Sitemaps written as documents, a hundred entries each, and read back."""
    one = one_delivery(load(spark, d, "sitemap_entry").where("site_id IS NOT NULL"), "entry_id", "site_id", "loc", "lastmod")
    esc = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url>"), F.coalesce(F.concat(F.lit("<loc> "), esc("loc"), F.lit(" </loc>")), F.lit("")), F.coalesce(F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    docs = one.groupBy("site_id", F.floor(F.col("entry_id") / 100).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    read = docs.select("site_id", SM.parse_sitemap("xml")["locs"].alias("locs"), SM.count_lastmod("xml").alias("n"))
    return read.groupBy("site_id").agg(F.sum(F.size("locs")).alias("n_locs"), F.min(F.array_min("locs")).alias("first"), F.max(F.array_max("locs")).alias("last"), F.sum("n").alias("n_lastmod"))


@query(
    "s10_sitemap_status",
    """WITH a AS (SELECT site_id, coalesce(status, 0) status, coalesce(body, '') b FROM capture WHERE site_id IS NOT NULL),
    k AS (SELECT site_id, CASE WHEN status NOT BETWEEN 200 AND 299 OR trim(b) = '' THEN 'unreachable' ELSE 'invalid' END s FROM a)
    SELECT site_id, CASE WHEN bool_or(s = 'invalid') THEN 'invalid' ELSE 'unreachable' END AS sitemap_status FROM k GROUP BY site_id
    UNION ALL SELECT DISTINCT site_id, 'absent' FROM site WHERE site_id NOT IN (SELECT site_id FROM a)""",
)
def s10_status(spark, d):
    """The precedence of outcomes, over captured pages taken for sitemaps (none of them is one)."""
    tries = load(spark, d, "capture").where("site_id IS NOT NULL").select("site_id", "status", F.col("body").alias("xml"))
    return SM.sitemap_status(tries, load(spark, d, "site").select("site_id"))


@query("mr001_blocked_content", f"""WITH s AS (SELECT site_id, {sql_norm('root_url')} root FROM site WHERE robots_url IS NOT NULL),
c AS (SELECT site_id, u, max(listed) listed FROM (SELECT site_id, {sql_norm('loc')} u, 1 listed FROM sitemap_entry UNION ALL SELECT site_id, dst, 0 FROM (SELECT site_id, {sql_norm('src')} src, {sql_norm('dst')} dst FROM link_edge) WHERE src <> '') WHERE u <> '' GROUP BY ALL),
k AS (SELECT c.* FROM c JOIN s USING (site_id) WHERE {_HOST.format('u')} = {_HOST.format('root')} AND NOT {_NO_CRAWL} AND regexp_matches({_NPATH}, '^/(blog|products)/'))
SELECT site_id, u AS url, CASE listed WHEN 1 THEN 'listed' ELSE 'linked' END AS kind, 'rule: Disallow: /' || regexp_extract({_NPATH}, '^/(blog|products)/', 1) || '/' AS measurement
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY u) rk FROM k) WHERE rk <= 40""")
def rule_mr001(spark, d):
    a = audit(spark, d)
    a.robots = robots(spark, d)
    return ranked(rules.mr001(a), ["site_id"], ["url"], 40).select("site_id", "url", "kind", "measurement")  # as the SQL


QUERIES["rule_mr001_blocked_content"], SQL["rule_mr001_blocked_content"] = QUERIES.pop("mr001_blocked_content"), SQL.pop("mr001_blocked_content")
