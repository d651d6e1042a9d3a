"""Orphan references, nested JSON and similarity joins against brute force on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import nested, orphans, similarity
from webloom.runtime import drop_shared, one_delivery, shared_table

T0 = dt.datetime(2025, 1, 1)
PAGE = "page_id long, site_id long, url string, final_url string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"
REF = "id long, site_id long, u string, t timestamp_ntz"


def day(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def make(spark, pages, refs):
    p = spark.createDataFrame([(a, s, u, f, day(i), day(x)) for a, s, u, f, i, x in pages], PAGE)
    r = spark.createDataFrame([(a, s, u, day(t)) for a, s, u, t in refs], REF)
    empty = lambda i, u, t: spark.createDataFrame([], f"{i} long, site_id long, {u} string, {t} timestamp_ntz")
    links = r.select(F.col("id").alias("edge_id"), "site_id", F.col("u").alias("dst"), F.col("t").alias("seen_at"), F.lit("x").alias("k"))
    return orphans.orphan_references(p, links, empty("entry_id", "loc", "seen_at"), empty("failure_id", "url", "failed_at"))


def test_states_of_references(spark):
    pages = [(1, 1, "http://a.test/x", None, 10, 50), (1, 1, "http://a.test/x", None, 12, 50), (2, 1, "http://a.test/x", "", 60, None), (3, 1, "http://a.test/y", "http://a.test/z", 5, 4)]
    refs = [
        (1, 1, "http://a.test/x/", 5), (2, 1, "HTTP://a.test/x#q", 10), (3, 1, "http://a.test/x", 50), (4, 1, "http://a.test/x", 60), (5, 1, "http://a.test/none", 7),
        (6, 2, "http://a.test/x", 20), (7, 1, None, 20), (8, 1, "http://a.test/z", 20), (9, 1, "http://a.test/x", None), (5, 1, "http://a.test/none", 7),
    ]
    got = {(r.ref_id, r.state) for r in make(spark, pages, refs).collect()}
    assert got == {(1, "late"), (3, "deleted"), (5, "missing"), (6, "missing"), (7, "missing"), (8, "missing")}


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    pages = []
    for i in range(60):
        o = rnd.randrange(200)
        pages.append((i, rnd.randrange(2), f"http://a.test/{rnd.randrange(8)}", f"http://a.test/{rnd.randrange(8)}", o, rnd.choice([None, o + rnd.randrange(-20, 90)])))
    # One address has a third of all references.
    refs = [(i, rnd.randrange(2), f"http://a.test/{rnd.choice([0, 0, 0, *range(10)])}", rnd.randrange(220)) for i in range(400)]
    want = set()
    for i, s, u, t in refs:
        if not any(p[1] == s and u in p[2:4] and p[4] <= t and (p[5] is None or p[5] > t) for p in pages):
            want.add(i)
    assert {r.ref_id for r in make(spark, pages, refs).collect()} == want


def test_hot_slices_are_cut_into_parts(spark):
    rnd = random.Random(4)
    parents = [(bytes([k]), day(o), day(None if k == 2 else o + rnd.randrange(1, 9))) for k, o in ((rnd.randrange(3), rnd.randrange(80)) for _ in range(12))]
    refs = [("x", i, rnd.choice([bytes([rnd.randrange(4)]), bytes([0]), None]), day(rnd.choice([12, rnd.randrange(90), None]))) for i in range(300)]
    pp = spark.createDataFrame(parents, "k binary, opened timestamp_ntz, closed timestamp_ntz")
    rr = spark.createDataFrame(refs, "src string, id long, k binary, t timestamp_ntz")
    whole = sorted((r.id, r.state) for r in orphans.classify(rr, pp).collect())
    cut = sorted((r.id, r.state) for r in orphans.classify(rr, pp, part=7).collect())
    assert cut == whole and {s for _, s in whole} == {"ok", "missing", "deleted", "late", "undated"}


def test_orphans_of_empty_tables(spark):
    assert make(spark, [], []).count() == 0
    assert make(spark, [], [(1, 1, "http://a.test/", 1)]).count() == 1


def flat(spark, ld, meta=None):
    rows = [(1, ld, meta), (1, ld, meta)]
    p = spark.createDataFrame(rows, "page_id long, jsonld array<string>, meta map<string,string>").withColumn("text", F.lit("clash"))
    return {tuple(r)[1:5] for r in nested.flatten_json(p, canonical=False).where("kind = 'object'").collect()}


def test_paths(spark):
    ld = ['{"a": {"b": [1, {"c": {}}]}, "@graph": [[{}]]}', "[1, [{}]]", '"text"', "{bad", "", None, '{"x": NaN}', '{"a":{},"a":{}}']
    got = flat(spark, ld, {"m": '{"k.1": {}}', "n": "[]", "o": "plain"})
    assert got == {
        ("jsonld", "0", "$", ""), ("jsonld", "0", "$.a", "$"), ("jsonld", "0", "$.a.b[1]", "$.a"), ("jsonld", "0", "$.a.b[1].c", "$.a.b[1]"), ("jsonld", "0", "$.@graph[0][0]", "$"),
        ("jsonld", "1", "$[1][0]", ""), ("jsonld", "7", "$", ""), ("jsonld", "7", "$.a", "$"), ("meta", "m", "$", ""), ("meta", "m", "$.k.1", "$"),
    }
    assert flat(spark, None) == set()


def test_depth_beyond_the_recursion_limit():
    n = 5000
    for text, count in (("[" * n + "{}" + "]" * n, 1), ('{"a":' * n + "1" + "}" * n, n)):
        assert sum(k == "object" for _, _, k, *_ in nested.occurrences(nested.parse(text))) == count
    with pytest.raises(ValueError):
        nested.parse("[" * n)


def test_deep_parser_agrees_with_the_fast_one():
    rnd = random.Random(5)

    def value(d):
        k = rnd.randrange(6 if d else 4)
        if k == 4:
            return {f"k{i}": value(d - 1) for i in range(rnd.randrange(3))}
        if k == 5:
            return [value(d - 1) for _ in range(rnd.randrange(3))]
        return [1, 'x"}{', None, {}][k]

    for _ in range(300):
        text = json.dumps(value(5), indent=rnd.choice([None, 1]))
        assert nested._deep(text) == json.loads(text, object_pairs_hook=nested.Members, parse_int=nested.Number)
    for bad in ("{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "]", '{"a":1}x', "nul", ""):
        with pytest.raises((ValueError, StopIteration, IndexError)):
            nested._deep(bad)


def test_merkle_identities():
    a = nested.occurrences(nested.parse('{"x": {"p": 1, "q": [2, {"r": 3}]}, "y": {"q": [2, {"r": 3}], "p": 1}, "z": {"p": 1.5}}'))
    ident = {path: h for path, _, _, h, *_ in a}
    assert ident["$.x"] == ident["$.y"] != ident["$.z"]
    assert ident["$.x.q[1]"] == ident["$.y.q[1]"] and ident["$.x.q"] == ident["$.y.q"]
    assert [(path, o) for path, *_, o, _ in a][:4] == [("$", 0), ("$.x", 0), ("$.x.q", 1), ("$.x.q[1]", 1)]


def test_found_objects_are_stored_ones(spark, tmp_path, monkeypatch):
    """p7_found works out identities and lists the occurrences of the objects stored under them, each place once."""
    from webloom import queries

    rows = [(1, ['{"a": {"x": 1}, "b": [{"x": 1}, {"y": []}], "c": {"x": 1}, "c": {"x": 2}}', "{broken"], {"m": '[{"x": 1}]'}), (2, ['{"x": 1}'], None), (2, ['{"x": 1}'], None)]
    spark.createDataFrame(rows, "page_id long, jsonld array<string>, meta map<string,string>").write.parquet(str(tmp_path / "page.parquet"))
    made, objects = [], nested.objects
    monkeypatch.setattr(nested, "objects", lambda bridge: made.append(objects(bridge)) or made[-1])
    got = sorted(tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect())
    here = [("$", ""), ("$.a", "$"), ("$.b[0]", "$"), ("$.b[1]", "$"), ("$.c", "$")]
    assert got == [(1, "jsonld", "0", *x) for x in here] + [(1, "meta", "m", "$[0]", ""), (2, "jsonld", "0", "$", "")]
    (stored,) = made
    n = {r.canon: r.n_occurrences for r in stored.where("kind = 'object'").collect()}
    assert n['{"object":[["x","n","1"]]}'] == 5 and len(n) == 4 and stored.where("node_hash IS NULL").count() == 0


def tables(p):
    bridge = nested.flatten_json(p)
    stored = nested.objects(bridge)
    return bridge.collect(), {r.node_hash: r.canon for r in stored.collect()}, nested.attributes(stored).collect()


def test_round_trip_from_bridge_objects_and_attributes(spark):
    texts = [
        '{"n": 1, "kids": [{"n": 2}, {"n": 2, "kids": []}], "one": {"n": null, "deep": [[{"n": 2}]]}}', '{"sameAs": ["https://a", "https://b"], "t": true}',
        '{"s": "{\\"node\\":1}", "x": "r", "big": 1e400, "exact": 1.50, "k": 1, "k": "2"}', '[1, "1", null, false, [], {}, "", {"": 0}]', '[[{"a": [0.1]}], "\\ud83d\\ude00", "é"]', "{broken",
    ]
    p = spark.createDataFrame([(1, texts, {"m": '{"a": ["x", {"b": null}]}'})], "page_id long, jsonld array<string>, meta map<string,string>")
    bridge, canon, flat = tables(p)
    by_key = lambda v: nested.Members(sorted(((k, by_key(x)) for k, x in v), key=lambda m: m[0])) if isinstance(v, nested.Members) else [by_key(x) for x in v] if isinstance(v, list) else v
    roots = {(r.field_name, r.item_key): r.node_hash for r in bridge if r.node_path == "$"}
    for (field, item), h in roots.items():
        text = texts[int(item)] if field == "jsonld" else '{"a": ["x", {"b": null}]}'
        want = by_key(nested.parse(text))
        got = nested.rebuild(h, canon)
        assert got == want and type(got) is type(want)
    assert len(roots) == 6
    # The attributes hold every scalar with its type, none twice.
    assert {(r.key, r.type, r.value) for r in flat} >= {(None, "string", "https://a"), ("big", "number", "1e400"), ("exact", "number", "1.50"), ("s", "string", '{"node":1}'), (None, "null", None), ("t", "boolean", "true")}
    scalars = sum(len([m for m in next(iter(s.values())) if m[-2] != "r"]) for s in map(json.loads, canon.values()))
    assert len(flat) == scalars and len({(r.node_hash, r.ordinal) for r in flat}) == len(flat)


def test_prefix_join_against_brute_force(spark):
    rnd = random.Random(7)
    base = [{f"w{rnd.randrange(30)}" for _ in range(12)} for _ in range(25)]
    sets = [b if rnd.random() < 0.3 else {w if rnd.random() > 0.1 else f"w{rnd.randrange(30)}" for w in b} for b in base + base] + [set()]
    rows = spark.createDataFrame([(i % 2, i, sorted(s), "extra") for i, s in enumerate(sets)], "site_id int, k int, g array<string>, k2 string")
    for t in (0.5, 0.8, 1.0):
        want = {
            (i % 2, i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if i % 2 == j % 2 and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])
        }
        got = {(r.site_id, r.a, r.b) for r in similarity.prefix_join(rows, ["site_id"], "k", "g", t).collect()}
        assert got == want


def test_first_unlike_beyond_the_window(spark):
    alike, other = ["a", "b"], ["x", "y"]
    rows = [("p", i, 0, alike, 1, 2) for i in range(9)] + [("p", 9, 0, other, 1, 2), ("q", 1, 0, alike, 1, 2)]
    d = spark.createDataFrame(rows, "blk string, o int, n int, g array<string>, pos int, size int")
    got = {(r.blk, r.a, r.b) for r in similarity.first_unlike(d, ["blk"], "o", "g", 0.5).collect()}
    assert got == {("p", i, 9) for i in range(9)}
    assert similarity.first_unlike(d.limit(0), ["blk"], "o", "g", 0.5).count() == 0


def test_one_delivery_and_shared_table(spark):
    d = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, "y", 1)], "page_id long, t string, v int")
    assert [tuple(r) for r in one_delivery(d, "page_id", "t", "v").collect()] == [(1, "x", None)]
    s = shared_table(d, "test")
    assert s.count() == 3
    drop_shared(spark)
