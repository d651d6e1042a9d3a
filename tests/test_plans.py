"""Rules on small sites: a healthy one, a broken one, isolation of sites, order of input, score rails."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.plans import evidence as V
from webloom.plans import report, rules, score

FILL = " ".join(f"Paragraph {i} tells how the torque wrench number {i} is set, held and stored by the fitters of the yard." for i in range(12))
NAV = '<nav><a href="/">Home</a> <a href="/about">About us</a> <a href="/pricing">Pricing</a> <a href="/guide">Setting guide</a> <a href="/contact-us">Contact us</a></nav>'
ORG = '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Torque Yard","url":"http://ok.test/","description":"Torque Yard is a maker of wrenches that sells tools to fitters in every town.","sameAs":["http://ref.test/ty"]}</script>'


def page(title, h1, body, root="http://ok.test", head="", path="/"):
    return (
        f'<html lang="en"><head><title>{title}</title><link rel="canonical" href="{root}{path}"><meta property="og:site_name" content="Torque Yard">{ORG}{head}</head>'
        f'<body>{NAV}<main><h1>{h1}</h1><p>{body}</p><a href="/pricing">See pricing</a> <a href="/guide">Setting guide</a> <a href="/about">About the yard</a></main><footer>© 2024 Torque Yard</footer></body></html>'
    )


def healthy(root="http://ok.test"):
    body = lambda x: f"Torque Yard is a maker of {x}. " + FILL.replace("torque wrench", x)
    return {
        "root": root + "/", "sitemap": ["/", "/about", "/pricing", "/guide", "/contact-us"], "lastmod_count": 5, "robots_text": "User-agent: *\nDisallow: /cart",
        "pages": {
            "/": page("Torque wrench maker", "Torque wrench maker", body("torque wrench"), root), "/about": page("About the maker of wrenches", "About the maker", body("about page"), root, path="/about"),
            "/pricing": page("Pricing of wrenches", "Pricing of wrenches", body("pricing list"), root, path="/pricing"),
            "/guide": page("Setting guide for wrenches", "Setting guide", body("setting guide"), root, '<meta name="author" content="A. Fitter">', "/guide"),
            "/contact-us": page("Contact the yard", "Contact the yard", body("contact desk"), root, path="/contact-us"),
        },
    }


def broken(root="http://bad.test"):
    dup = "<p>" + FILL + "</p>"
    shell = '<html><head><title>App</title></head><body><div id="root"></div><script>' + "x" * 500 + "</script></body></html>"
    mark = '<script type="application/ld+json">{"@type":"Product","name":"Blender","offers":{"price":"999","availability":"InStock"}}</script>'
    ad = "<div class='promo'><p>Buy the great big red blender today at once</p></div>" * 3
    return {
        "root": root + "/", "robots_text": "User-agent: *\nDisallow: /guides/", "sitemap": ["/guides/torque.html", "/copy-a"], "lastmod_count": 0,
        "pages": {
            "/": f'<html><head><title>Shop</title><link rel="canonical" href="{root}/"><meta property="og:site_name" content="Blue Kite"></head><body><main><h1>Shop</h1><p>{FILL}</p><a href="/gone">here</a><a href="/copy-a">more</a></main><footer>© 2024 Zenith Retail</footer></body></html>',
            "/product-blender": f"<html><head><title>Blender</title>{mark}</head><body><main><h1>Blender</h1><p>Now $1,299 only. {FILL}</p></main></body></html>",
            "/offers-archive": f'<html><head><title>Old</title><meta name="robots" content="noindex, follow"></head><body><p>{FILL} a b c</p></body></html>',
            "/app-shell": shell, "/catalog": shell.replace("App", "Cat"),
            "/mismatch": f'<html><head><title>Promo</title><link rel="canonical" href="{root}/"></head><body><h1>x</h1><p>{FILL.replace("wrench", "spanner").replace("fitters", "smiths")}</p></body></html>',
            "/promo-heavy": f"<html><head><title>Promo</title></head><body><h1>y</h1><p>{FILL.replace('yard', 'hall')}</p>{ad}</body></html>",
            "/copy-a": f"<html><head><title>Copy one</title></head><body><h1>c</h1>{dup} and a tail of words that is long</body></html>",
            "/copy-b": f"<html><head><title>Copy two</title></head><body><h1>c</h1>{dup} and a tail of words that is long</body></html>",
            "/news-one": f"<html><head><title>News 1</title></head><body><h1>n</h1><p>The latest news. {FILL.replace('tells', 'says')}</p></body></html>",
            "/news-two": f"<html><head><title>News 2</title></head><body><h1>n</h1><p>Our current news. {FILL.replace('tells', 'shows')}</p></body></html>",
            "/city-picker": '<html><head><title>City</title></head><body><h1>City</h1><p>Select your city to go on</p><select name="city"><option>A<option>B</select></body></html>',
        },
        "link_checks": [{"url": "/gone", "status": 404, "referrers": [root + "/"]}],
        "probes": [{"url": "http://ref.test/404", "status": 404, "checked": True}, {"url": "http://ref.test/other", "title": "Someone else"}],
    }


@pytest.fixture(scope="module")
def result(spark):
    return report.run(V.from_html(spark, {1: healthy(), 2: broken()}))


def codes(r, site):
    return {x.rule for x in r.findings.where(F.col("site_id") == site).collect()}


def test_healthy_site_has_no_findings(result):
    assert codes(result, 1) == set()


def test_broken_site(result):
    got = codes(result, 2)
    want = {"MR-001", "MR-002", "MR-003", "MR-004", "MR-005", "MR-007", "FI-001", "FI-003", "FI-004", "FI-005", "AX-004", "AX-005", "EX-001", "EX-002"}
    assert want <= got, want - got


def test_reports_are_valid(result):
    assert result.findings.count() > 0 and report.violations(result).count() == 0
    docs = {r.site_id: json.loads(r.report) for r in report.reports(result).collect()}
    assert set(docs) == {1, 2}
    for d in docs.values():
        d.setdefault("findings", [])
        assert report.validate_document(d) == []
        assert len(d["evidence_path"]) == 7
    assert "Blender" in report.render_text(json.dumps(docs[2])) or docs[2]["summary"]["total_findings"] > 5


def test_sites_do_not_touch_each_other(spark, result):
    alone = report.run(V.from_html(spark, {2: broken()}))
    key = lambda r, s: {(x.rule, x.severity, x.n_hits, round(x.priority_score, 4)) for x in r.findings.where(F.col("site_id") == s).collect()}
    assert key(alone, 2) == key(result, 2)


def test_unreadable_site_is_inconclusive(spark):
    r = report.run(V.from_html(spark, {1: {"root": "http://x.test/", "pages": {"/": "<p>no</p>"}, "statuses": {"/": 503}}}))
    assert r.findings.count() == 0 and r.status.first().status == "inconclusive"


def test_orders_of_large_sites(spark):
    """Places on a site are multiples of a page's order, which leave an int's range on large sites."""
    a, b = (V.from_html(spark, {1: healthy(), 2: broken()}) for _ in range(2))
    b.page = b.page.withColumn("page_ord", F.col("page_ord") + 300_000_000)
    for f, step in ((lambda x: rules.mr009(x).withColumnRenamed("ord", "o"), 100_000), (lambda x: rules.name_candidates(x).withColumnRenamed("ord", "o"), 8), (lambda x: rules.declared_references(x).withColumnRenamed("ord", "o"), 1000)):
        first, later = ([(r.site_id, r.url, r.o) for r in f(x).where("o < 1099511627776 OR o > 10000000000000").orderBy("o", "site_id", "url").collect()] for x in (a, b))
        assert first and later == [(s, u, o + 300_000_000 * step) for s, u, o in first]


def test_nothing_is_cut_before_it_is_judged(spark):
    """The home page among later referrers, untitled core pages after three others, more disallowed addresses than 40."""
    root, bare = "http://many.test", "<html><head><title></title></head><body><h1>x</h1><p>A few words.</p><a href='/gone'>The old list</a></body></html>"
    titled = bare.replace("<title>", "<title>Start of all")
    site = {
        "root": root + "/", "robots_text": "User-agent: *\nDisallow: /shut/", "sitemap": [f"/shut/{i:02}" for i in range(45)],
        "pages": {"/start": titled, "/a": bare, "/b": bare, "/c": bare, "/pricing": bare},
        "failures": [{"url": "/gone", "status": 404}], "link_checks": [{"url": "/dead", "status": 410, "referrers": [root + x for x in ("/a", "/b", "/c", "/start", "/pricing")]}],
    }
    a = V.from_html(spark, {1: site})
    assert {(r.url_norm[len(root) :], r.rk, r.referrer[len(root) :]) for r in rules.broken_targets(a).collect()} == {
        (u, i + 1, x) for u, refs in (("/gone", ("/a", "/b", "/c", "/pricing", "/start")), ("/dead", ("/a", "/b", "/c", "/start", "/pricing"))) for i, x in enumerate(refs)
    }
    told = f"linked from {root}/a, {root}/b, {root}/c and 2 more"
    assert {(r.url, r.kind, r.measurement) for r in rules.mr003(a).collect()} == {(root + "/gone", "home", "status 404, " + told), (root + "/dead", "home", "status 410, " + told)}
    f = {r.rule: r for r in rules.findings(a, ["MR-001", "MR-003", "MR-007"])[0].collect()}
    assert (f["MR-003"].severity, f["MR-003"].n_hits) == ("high", 2)
    assert (f["MR-001"].severity, f["MR-001"].n_hits, f["MR-001"].n_urls, len(f["MR-001"].affected_urls)) == ("high", 45, 45, 25)
    assert (f["MR-007"].severity, f["MR-007"].core_page_affected, f["MR-007"].n_hits, len(f["MR-007"].evidence)) == ("high", True, 4, 3)


def test_skill_runs_only_its_rules(spark):
    f = report.run_skill(V.from_html(spark, {2: broken()}), "external-evidence")
    assert {r.rule for r in f.collect()} <= {r for r in rules.RULES if r.startswith("EX")}


def test_floor_and_rails(spark):
    rows = [("critical", "verified", 0.01), ("medium", "verified", 0.9), ("low", "corroborated", 0.9), ("high", "verified", 0.34), ("high", "verified", 0.05)]
    d = spark.createDataFrame(rows, "s string, l string, v double").select(score.priority("v", "s", "l").alias("p"))
    assert [r.p for r in d.collect()] == ["P0", "P1", "P2", "P1", "P3"]


def test_invariants_are_enforced(spark):
    d = spark.createDataFrame([("X", "critical", "indicative", [("u", "o", "m")]), ], "rule string, severity string, evidence_level string, evidence array<struct<url:string,observation:string,measurement:string>>")
    assert score.check_findings(d).first().severity == "medium"
    with pytest.raises(Exception, match="not a finding"):
        score.check_findings(d.withColumn("severity", F.lit("awful"))).collect()


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": "integer", "minimum": 2}}, "b": {"enum": ["x"]}}, "additionalProperties": {"type": "string"}}
    assert report.validate_document({"a": [2, 3], "b": "x", "c": "s"}, schema) == []
    assert len(report.validate_document({"a": [1, True], "b": "y", "c": 1}, schema)) == 4
    assert report.validate_document({}, schema) == ["$: a is missing"]


def test_stream(spark, tmp_path):
    from webloom.streaming import captures as S

    src = str(tmp_path / "in")
    c = spark.sql("SELECT * FROM VALUES (1L, 1L, 200, TIMESTAMP '2025-01-01'), (1L, 1L, 500, TIMESTAMP '2025-01-01 01:00:00'), (2L, 1L, 404, TIMESTAMP '2025-03-01'), (null, 1L, 200, null) t(page_id, site_id, status, fetched_at)")
    c.write.parquet(src)
    S.run_once(S.first_fetches(S.read_captures(spark, src)), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 2
    S.run_once(S.failures_by_window(S.read_captures(spark, src)), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sum(r.failures for r in spark.read.parquet(str(tmp_path / "o2")).collect()) <= 2
