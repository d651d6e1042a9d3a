"""Captures, robots, sitemaps and the link graph."""

import json

from pyspark.sql import functions as F

from webloom.operators.graph import depths
from webloom.sources import capture as C
from webloom.sources import robots as RB
from webloom.sources import sitemap as SM


def test_decode_bodies(spark):
    rows = [(1, "é".encode(), "text/html"), (2, "é".encode("latin-1"), "text/html; charset=ISO-8859-1"), (3, b"\xff\xfe", "text/plain"), (4, b"x", "image/png"), (5, None, "text/html"), (6, b"y", None), (7, b"z", "text/html; charset=none-such")]
    d = spark.createDataFrame(rows, "i int, body binary, content_type string")
    assert {r.i: r.text for r in C.decode_bodies(d).collect()} == {1: "é", 2: "é", 3: "��", 4: None, 5: None, 6: "y", 7: "z"}


def test_fetch_plan(spark):
    q = spark.createDataFrame([(1, "http://a.test/x", 1), (1, "http://a.test/y", 2), (1, "http://a.test/z", 3)], "site_id long, url_norm string, position int")
    have = spark.createDataFrame([(1, "http://A.test/x/")], "site_id long, url string")
    ok = spark.createDataFrame([(1, "http://a.test/y", False)], "site_id long, url string, allowed boolean")
    assert {(r.position, r.state) for r in C.fetch_plan(q, have, ok).collect()} == {(1, "known"), (2, "blocked"), (3, "fetch")}


def test_probe_plan_is_bounded(spark):
    d = spark.createDataFrame([(1, f"http://r.test/{i}", "sameAs", i) for i in range(20)], "site_id long, url string, source string, ord long")
    s = spark.createDataFrame([(1, "http://a.test/"), (2, "http://127.0.0.1/")], "site_id long, root_url string")
    got = C.probe_plan(d, s).collect()
    assert len([r for r in got if r.kind == "reference"]) == 6 and [r.url for r in got if r.kind == "hostname"] == ["http://www.a.test/"]


def test_rendered_snapshots(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"http://a.test/": "<p>x</p>", "bad": 3}))
    assert [tuple(r) for r in C.load_rendered(spark, str(tmp_path / "r.json"), 1).collect()] == [(1, "http://a.test/", "<p>x</p>")]
    (tmp_path / "b.json").write_text("{")
    assert C.load_rendered(spark, str(tmp_path / "b.json"), 1).count() == C.load_rendered(spark, str(tmp_path / "none"), 1).count() == 0


def test_depths(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "a", "a"), (2, "a", "z"), (1, "x", "y"), (1, None, "b")], "site_id long, src string, dst string")
    s = spark.createDataFrame([(1, "a"), (3, "q")], "site_id long, url string")
    assert {tuple(r) for r in depths(e, s).collect()} == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (3, "q", 0)}


def test_depths_to_the_end_of_a_long_chain(spark):
    e = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(53)], "site_id long, src string, dst string")
    s = spark.createDataFrame([(1, "0")], "site_id long, url string")
    assert {tuple(r) for r in depths(e, s).collect()} == {(1, str(i), i) for i in range(54)}
    assert depths(e, s, 2).count() == 3


def test_robots_details(spark):
    r = spark.createDataFrame([(1, 200, "Crawl-delay: x\nCrawl-delay: 3\nDisallow:\nSitemap: s1\n# no\nbad line"), (2, 200, None), (3, 200, "")], "site_id long, status int, text string")
    lines = RB.robots_lines(r)
    assert [tuple(x) for x in RB.robots_crawl_delay(lines).collect()] == [(1, 3.0)]
    assert [x.sitemap for x in RB.robots_sitemaps(lines).collect()] == ["s1"]
    u = spark.createDataFrame([(1, "http://a.test/"), (2, "http://a.test/x"), (9, None)], "site_id long, url string")
    assert RB.blocking_rules(lines, u).count() == 0
    assert all(x.allowed for x in RB.allowed(r, u).collect())


def test_sitemap_status(spark):
    x = "<urlset><url><loc>http://a.test/</loc></url></urlset>"
    a = spark.createDataFrame([(1, 404, ""), (1, 200, x), (2, 200, "<urlset/>"), (3, 200, "text"), (4, 500, None), (5, 404, None), (6, None, None)], "site_id int, status int, xml string")
    a = a.union(spark.createDataFrame([(8, 200, "<urlset><url><loc>ftp://a.test/</loc></url></urlset>")], a.schema))
    sites = spark.createDataFrame([(1,), (7,)], "site_id int")
    got = {r.site_id: r.sitemap_status for r in SM.sitemap_status(a, sites).collect()}
    # A document without locations is invalid, one not served unreachable; only a site never asked has none.
    assert got == {1: "ok", 2: "invalid", 3: "invalid", 4: "unreachable", 5: "unreachable", 6: "unreachable", 7: "absent", 8: "empty"}


def test_queue_takes_turns(spark):
    rows = [(1, f"http://a.test/blog/{i:04d}", i) for i in range(50)] + [(1, "http://a.test/about", 90), (1, "http://a.test/pricing", 91), (1, "http://a.test/cart", 1), (1, "http://a.test/x.pdf", 2)]
    q = SM.stratified_queue(spark.createDataFrame(rows, "site_id long, url_norm string, ord long"), budget=6)
    got = [r.url_norm for r in q.orderBy("position").collect()]
    assert got == ["http://a.test/about", "http://a.test/pricing", "http://a.test/blog/0000", "http://a.test/blog/0001", "http://a.test/blog/0002", "http://a.test/blog/0003"]
    assert SM.stratified_queue(spark.createDataFrame([], "site_id long, url_norm string, ord long")).count() == 0
    assert q.where(F.col("position") > 6).count() == 0
