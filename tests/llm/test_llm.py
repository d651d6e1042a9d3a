"""Training-data operators against brute force, round trips and hand-labelled cases on small fixtures."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from webloom.llm import boilerplate, boosting, leakage, mixing, names, neardup, residue, sentences, stuffing

rnd = random.Random(11)
VOCAB = [f"{a}{b}" for a in "ba ke lo mi nu pra ste vol".split() for b in "da fen gur lim mok ra sil tan".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


PAGE = (
    "page_id long, text_main string, text_chrome string, title string, meta map<string,string>, jsonld array<string>, links array<struct<href:string,text:string,region:string>>, "
    "headings array<struct<level:int,heading:string>>, ingested_at timestamp, a string, b string, text string, v long"
)


def pages(spark, rows):
    """rows: page_id -> dict; columns named like the operators' own are there to clash."""
    cols = [c.split(" ")[0] for c in "page_id text_main text_chrome title meta jsonld links headings".split()]
    data = [(i, *(d.get(c) for c in cols[1:]), dt.datetime(2025, 1, 1), "x", "y", "clash", 1) for i, d in rows]
    return spark.createDataFrame(data, PAGE)


# --- 1 names -----------------------------------------------------------------------------------------------------------


def person(name, place=None, job=None, firm=None, title=None, alt=None):
    import json

    node = {"@type": "Person", "name": name}
    if place:
        node["address"] = {"addressLocality": place}
    if job:
        node |= {"jobTitle": job, "worksFor": {"name": firm}}
    return {"title": f"{title or name} – Team", "meta": {"og:type": "profile", "author": alt or name}, "jsonld": [json.dumps([node])]}


def firm(name, place=None, alt=None):
    import json

    node = {"@type": "Organization", "name": name}
    if place:
        node["address"] = {"addressLocality": place}
    return {"title": f"{alt or name}: about", "meta": {"og:type": "profile", "og:title": name}, "jsonld": [json.dumps({"@graph": [node]})]}


def test_lcs_against_dynamic_programming():
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert names.lcs(a, b) == t[-1][-1]


def test_name_variants(spark):
    rows = [
        (1, person("Gregory Donbrebarn", "Tammoor", "teacher", "Marine Pumps")), (2, person("Donbrebarn, Gregory", "TAMMOOR", "teacher", "Marine Pumps", "Greg Donbrebarn")),
        (3, person("Gregory Donbrébarn", "Tamoor", title="G. Donbrebrn")), (4, person("Gregory Donbrebarn", "Pimminster", "cook", "Freight Services")),
        (5, person("Susanna Donbrebarn", "Tammoor", "teacher", "Marine Pumps")), (6, firm("Bolkipoth Seed Merchants Company LLC", "Sehaven")),
        (7, firm("Bolkipoth Seed Mchts Co.", "Sehaven", "Seed Merchants by Bolkipoth")), (8, firm("Bolkipoth Book Bindery Company LLC", "Sehaven")),
        (9, {"title": None, "meta": {"og:type": "profile"}, "jsonld": ["{bad", None]}), (10, person("Gregory Donbrebarn", "Tammoor") | {"meta": {"og:type": "article"}}),
        (1, person("Gregory Donbrebarn", "Tammoor", "teacher", "Marine Pumps")),
    ]
    got = {(r.page_id_a, r.page_id_b) for r in names.same_entity_pairs(pages(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (6, 7)}


def test_names_of_an_empty_table(spark):
    assert names.same_entity_pairs(pages(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    v = spark.range(40).withColumnRenamed("id", "v")
    e = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 19")
    got = {r.v: r.c for r in names.components(v, e, "chain").collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(40)}


def test_a_name_typed_alike_by_a_third_of_all(spark):
    rows = [(i, person("Ulrich Bargrapost", "Larburn")) for i in range(60)] + [(60 + i, person(f"Anna {VOCAB[i]}{VOCAB[63 - i]}".title(), "Relmere")) for i in range(40)]
    assert names.same_entity_pairs(pages(spark, rows)).count() == 60 * 59 // 2


def test_crowded_names_against_brute_force(spark):
    places = ["Larburn", "Alrburn", None, "Pimminster", "Relmere"]
    rows = [(i, person(f"U{VOCAB[i % 64]}{VOCAB[(i * 7 + 3) % 61]} Bargrapost".title(), places[i % 5], "teacher", "Marine Pumps")) for i in range(330)]
    rows += [(400 + i, firm(f"{VOCAB[i]}{VOCAB[63 - i]} Pumps".title(), places[i % 5])) for i in range(40)]
    rows += [(500, person("Ulrich Bargrapost", "Larburn", "cook", "Sea Freight")), (501, person("Ulrich Bargrapost", None, "cook", "Sea Freight"))]
    rows += [(502, person("Ulrich Bargarpost", "Alrburn", "cook", "Sea Freight")), (503, person("Bargrapost", "Larburn", "cook", "Sea Freight"))]
    one = names.profiles(pages(spark, rows)).withColumn("node", F.col("page_id"))
    got = {(r.a, r.b): r.strong for r in names.links(one, names.block_keys(one)).collect()}
    want = {}
    all_ = sorted(one.collect(), key=lambda r: r.node)
    for n, x in enumerate(all_):
        for y in all_[n + 1 :]:
            met = [(t, u) for t in x.spelled for u in y.spelled if x.kind == y.kind and len(t) > 2 and t[-3:] == u[-3:]]
            says = [names.compare(x.kind, x.parts, y.parts, t, u, (x.place, x.job, x.employer), (y.place, y.job, y.employer)) for t, u in met]
            if any(v is not None for v in says):
                want[x.node, y.node] = any(says)
    assert got == want
    assert got[500, 501] and got[500, 502] and got[501, 502] and (0, 5) not in got


# --- 2 residue ---------------------------------------------------------------------------------------------------------


def caps(spark, rows):
    return spark.createDataFrame([(i, b, dt.datetime(2025, 1, 1 + k)) for k, (i, b) in enumerate(rows)], "page_id long, body string, fetched_at timestamp")


def test_residue(spark):
    text = "The fitters of the yard set the wrench by hand. It holds for a year in dry air."
    cases = {
        1: "Page not found\nReturn to the home page", 2: "Lorem ipsum dolor sit amet. Consectetur adipiscing elit sed do eiusmod.", 3: f"{text} Dear {{{{first_name}}}}, thank you. {text}",
        4: "Please enable JavaScript to view this page.", 5: f"{text}\nOnly undefined left in stock.", 6: "Seite nicht gefunden",
    }
    clean = {
        20: text, 21: f'{text} Our guide shows why "${{name}}" must be quoted in templates.', 22: f"{text} The field [name] in the printed form is explained on sheet 4.",
        23: f'{text} A good error page says more than "Page not found": it names what is missing and offers a search. {text}', 24: None, 25: "   ", 26: "undefined behaviour is described in chapter 3 of the manual",
        27: "Home · [Prices] · Contact\n" + text,
    }
    rows = [(i, {"text_main": t}) for i, t in {**cases, **clean}.items()] + [(30, {"text_main": ""}), (31, {"text_main": None}), (32, {"text_main": None})]
    bodies = [(30, "<html><head><title>T</title></head><body><noscript>Please enable JavaScript to view this page.</noscript><script>x</script></body>"), (31, "<main><img src=x></main>"), (32, None), (1, "<p>fine</p>")]
    got = {r.page_id for r in residue.residue_pages(pages(spark, rows), caps(spark, bodies)).collect()}
    assert got == {*cases, 30}
    assert residue.residue_pages(pages(spark, []), caps(spark, [])).count() == 0


# --- 3 stuffing --------------------------------------------------------------------------------------------------------


def test_stuffing(spark):
    r = random.Random(2)
    soup = " ".join(r.choice(["cheap boot rack", "boot rack sale", "buy boot rack", "top boot rack Hemmoor"]) for _ in range(60))
    talk = " ".join(f"Our {r.choice(['best', 'cheap', 'new'])} boot rack shop sells {r.choice(['top', 'sale'])} boot rack and every boot rack buyer wants boot rack." for _ in range(14))
    labels = [f"{a} {b}" for a in VOCAB[:12] for b in ("casino", "loans", "store")]
    real = (
        "In spring the museum moved its oldest loom to a dry hall near the river. Nobody had used it for forty years, and two of the beams were split. A carpenter from the next town "
        "glued them over a weekend, while the director wrote letters to every weaver in the county. Three answered. The first brought wool, the second her late uncle's notebook, which "
        "turned out to hold the missing pattern. By June visitors could hear the shuttle from the bridge. School classes came on Tuesdays; each child was allowed to throw it once. "
        "When the summer ended, a strip of grey cloth as long as the hall lay folded in a box that was meant for hats."
    )
    rows = [
        (1, {"text_main": soup}), (2, {"text_main": talk}), (3, {"text_main": "\n".join(labels), "links": [("h", x, "main") for x in labels]}), (4, {"text_main": real}),
        (5, {"text_main": real + "\nTags: boot rack, lamp\nSizes: 8 mm | 9 mm"}), (6, {"text_main": None}), (7, {"text_main": ""}), (8, {"text_main": "boot rack boot rack"}),
        (9, {"text_main": " ".join(f"#{w} tag:{w} SKU-{1000 + i}" for i, w in enumerate(VOCAB[:20]))}), (1, {"text_main": soup}), (10, {"text_main": soup * 400}),
    ]
    # Keyword lists cut up by short sentences, a short tag list, a list of Han labels of under 60 characters.
    mixed = "\n".join(x for k in range(0, 240, 20) for x in (", ".join(soup.split(" ")[k : k + 20]), "Buy a rack now!"))
    han = ["木桌商店", "木椅商店", "铁锅商店", "茶壶商店", "雨衣商店", "台灯商店", "书架商店", "木梯商店"]
    rows += [(11, {"text_main": mixed}), (12, {"text_main": " ".join(f"#{w} tag:{v}" for w, v in zip(VOCAB[:11], VOCAB[20:31]))}),
             (13, {"text_main": " · ".join(han), "links": [("h", x, "main") for x in han]})]
    assert {x.page_id for x in stuffing.stuffed_pages(pages(spark, rows)).collect()} == {1, 2, 3, 9, 10, 11, 12, 13}
    assert stuffing.stuffed_pages(pages(spark, [])).count() == 0


# --- 4 near-duplicates ---------------------------------------------------------------------------------------------------


def brute(texts, t=0.6):
    sh = {}
    for i, x in texts.items():
        w = neardup.words(x or "")
        if len(w) >= 40:
            sh[i] = set(zip(*[w[k:] for k in range(6)]))
    ids = sorted(sh)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sh[a] & sh[b]) >= t * len(sh[a] | sh[b])}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    texts = {}
    for i in range(40):
        texts[i] = prose(120, i)
    for i in range(40, 110):
        w = texts[r.randrange(40)].split()
        for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        k = r.randrange(len(w))
        texts[i] = " ".join(w[k:] + w[:k] if r.random() < 0.3 else w)
    texts |= {200: None, 201: "", 202: prose(39, 1), 203: texts[0], 204: texts[0], 205: texts[0].upper()}
    rows = [(i, {"text_main": t}) for i, t in texts.items()] + [(3, {"text_main": texts[3]})]
    got = {(x.page_id_a, x.page_id_b) for x in neardup.expand(*neardup.near_duplicates(pages(spark, rows))).collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.97 * len(want) > 60


def test_sketches_tell_far_pairs_from_near_ones(spark):
    r = np.random.default_rng(5)
    with np.errstate(over="ignore"):
        for s, low, high in ((0.6, 0.99, 1.0), (0.3, 0.0, 0.1), (0.0, 0.0, 0.0)):
            pairs = []
            for _ in range(100):
                k = int(400 * s / (1 + s))
                both = r.integers(0, 2**63, k, dtype=np.uint64)
                a, b = (neardup.sketch(neardup._mix(np.concatenate([both, r.integers(0, 2**63, 200 - k, dtype=np.uint64)]))) for _ in "ab")
                pairs.append((a, b))
            d = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(neardup.agreement(F.col("a"), F.col("b")).alias("n"))
            share = sum(x.n >= neardup.least_agreement(0.6) for x in d.collect()) / 100
            assert low <= share <= high


def test_half_radius_balls_meet():
    from itertools import combinations

    keep, n = neardup.KEEP, neardup.SYMBOLS
    r = random.Random(1)
    for _ in range(50):
        a = [r.randrange(9) for _ in range(n)]
        b = [x if r.random() < 0.5 else r.randrange(9) + 9 for x in a]
        ball = lambda w: {(c, tuple(w[i] for i in c)) for c in combinations(range(n), keep)}
        assert bool(ball(a) & ball(b)) == (sum(x == y for x, y in zip(a, b)) >= keep)


# --- 5 boilerplate -------------------------------------------------------------------------------------------------------


def test_boosted_trees_learn_and_repeat():
    g = np.random.default_rng(0)
    x = g.normal(size=(4000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert ((m.decision(x[3000:]) > 0) == (y[3000:] > 0.5)).mean() > 0.95
    again = boosting.BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert (m.decision(x) == again.decision(x)).all() and m.decision(x[:0]).shape == (0,)


def test_boilerplate_on_held_out_composed_pages():
    m = boilerplate.fit()
    hit = total = 0
    for lines, labels, links, chrome, heads, body in boilerplate.composed_pages(200, seed=99):
        x, _ = boilerplate.page_features(lines, links, boilerplate.chrome_sets(chrome), frozenset(h.lower() for h in heads), body)
        hit += int(((m.decision(x) > 0) == (np.array(labels) > 0)).sum())
        total += len(labels)
    assert hit / total > 0.97
    # What the document shows counts: the same line in the content and in a navigation element.
    line = "Garden tools and other wares of the yard"
    inside, outside = (
        boilerplate.page_features([line], [], frozenset(), frozenset(), f"<body><main><p>x y z</p><p>{line}</p></main></body>".replace("<p>" + line, f"</main><{t} class='navbar'>" + line) if t else f"<body><main><p>x y z</p><p>{line}</p></main></body>")[0]
        for t in ("", "nav")
    )
    assert m.decision(outside)[0] > m.decision(inside)[0]


def test_nodes_of_documents():
    body = "<html><head><title>no</title></head><body><nav class=top>A &amp; B <a href=x>C</a></nav><!-- <p>gone</p> --><main><div id='story'><p>One <b>two</b> three<p>Four<br>five</div><script>if (a < b) {}</script></main><footer>F</body>"
    got = boilerplate.dom_blocks(body)
    assert [t for t, _ in got] == ["A & B C", "One two three", "Four five", "F"]
    assert [n.role for _, n in got] == [1, -1, -1, 1]
    feats, box = boilerplate.line_nodes(["F", "One two three", "absent", "A & B C"], body)
    assert box == [0, -1, -1, 1] and feats[2] == [-1.0] * boilerplate.DOM and all(len(f) == boilerplate.DOM for f in feats)
    for odd in ("", "<", "<p", "</p></div>", "<p>a" * 3000, "a < b > c", "<a href='\"'>x"):
        boilerplate.dom_blocks(odd)


def test_boilerplate_lines(spark):
    para = "The fitters of the yard set the wrench by hand in the morning, and it holds for a year in dry air. The guide explains how a baker stored its lamp, so nobody has to guess."
    notice = (
        "We and our 12 partners store cookies on your device. Some cookies are necessary, others help us to measure visits and show adverts that fit. You may accept all of them or reject those that are not needed. "
        "Your consent can be taken back at any time in the settings. Partners keep data for a year at most, and some of them process it abroad. Manage your privacy choices here: statistics, adverts, necessary. Save and close."
    )
    text = "\n".join(["Home · Products · News · Contact", para, "Related: desk lamp; wall clock; tea pot", "Desk lamp and handle", para, "Store cookies and dry cakes beside the lamp, never in tin boxes.", "", "© 2024 Yard Tools. All rights reserved.", notice])
    p = pages(spark, [(1, {"text_main": text}), (1, {"text_main": text}), (2, {"text_main": None}), (3, {"text_main": para}), (4, {"text_main": "Page not found\nHome · News · Contact"}), (5, {"text_main": text})])
    body = "<body><main>" + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</main></body>"
    cap = caps(spark, [(5, "<p>older</p>"), (5, body), (3, None), (77, body)])
    want = {(i, k) for i in (1, 5) for k in (0, 2, 7, 8)}
    lines = boilerplate.boilerplate_lines(p, cap)
    assert {(r.page_id, r.line_no) for r in lines.collect()} == want
    model = boilerplate.fit()
    assert {(r.page_id, r.line_no) for r in boilerplate.boilerplate_lines(p, model=model).collect()} == want
    body = {r.page_id: r.body for r in boilerplate.main_body(p, lines).collect()}
    assert body[3] == para and body[1].split("\n")[0] == para and "©" not in body[1]
    assert boilerplate.boilerplate_lines(pages(spark, []), caps(spark, [])).count() == 0


def test_decoding_has_no_contradictions():
    assert boilerplate.decode([2.0, 0.1, -6.0, -3.0], [-1] * 4) == [0, 1]
    assert boilerplate.decode([-1.0, 3.0, None], [-1] * 3) == [1]
    # A chrome element goes or stays as a whole where its evidence is clear.
    assert boilerplate.decode([3.0, -5.0, -0.1, -2.0], [0, -1, 0, -1]) == [0, 2]


# --- 8 leakage -----------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(r.choice([10, 13, 30]), 500 + i)) for i in range(12)] + [(50, None), (51, ""), (52, prose(30, 500))]
    docs = []
    for i in range(80):
        w = prose(40, i).split()
        src = r.choice(items)[1] or ""
        k = r.randrange(0, 31)
        s = src.split()
        w[5:5] = s[:k] if r.random() < 0.7 else s[-k:]
        t = " ".join(w)
        docs.append((i, r.choice([t, t.upper(), t.replace(" ", ",\n"), t.replace("a", "á")])))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    g = lambda t: {tuple(w[k : k + 13]) for w in [leakage.words(t or "")] for k in range(len(w) - 12)}
    want = {(d, i) for d, t in docs for i, x in items if g(t) & g(x)}
    dd = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(x.doc_id, x.item_id) for x in leakage.matches(dd, ii).collect()}
    assert got == want and len(want) > 10
    clean = spark.createDataFrame([(x.doc_id, x.clean) for x in leakage.decontaminate(dd, ii).collect() if x.clean is not None], "doc_id long, text string")
    assert leakage.matches(clean, ii).count() == 0
    assert leakage.matches(dd, ii.limit(0)).count() == 0


def test_leaks_do_not_depend_on_chunks(spark, monkeypatch):
    long = prose(60, 9)
    w = long.split()
    # Items that overlap in the document, one whose words meet only once another's are gone, one id with two texts.
    items = [(1, " ".join(w[:30])), (2, " ".join(w[20:50])), (3, " ".join(w[:7] + w[50:57])), (4, prose(20, 77)), (4, " ".join(w[30:45]))]
    docs = [(1, long), (2, f"{prose(90, 3)}. {' '.join(w[20:50])}. {prose(80, 4)}"), (3, prose(50, 5)), (4, None)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    one = [sorted(map(tuple, f(dd, ii).collect())) for f in (leakage.matches, leakage.decontaminate)]
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 10)
    assert len(leakage._chunks(ii, "item_id", "item_text")) == len(items)
    assert [sorted(map(tuple, f(dd, ii).collect())) for f in (leakage.matches, leakage.decontaminate)] == one
    assert [x[:3] for x in one[0]] == [(1, 1, 30), (1, 2, 30), (1, 4, 15), (2, 2, 30), (2, 4, 15)] and one[0][0][3] == 50 / 60


def test_cut_keeps_the_rest():
    t = "One, two (three) four; five. Six?"
    assert leakage.cut(t, [(1, 3)]) == "One, ) four; five. Six?"


# --- 9 mixing ------------------------------------------------------------------------------------------------------------


def mixed(spark, rows, targets, **kw):
    d = spark.createDataFrame([(i, t, s, "k") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, key string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, rep = mixing.mix(d, t, **kw)
    return {r.source: r for r in rep.collect()}, [tuple(r) for r in chosen.collect()]


def test_mix_reaches_shares(spark):
    rows = [(prose(20 + i % 30, i), ["Big", " big", "BIG "][i % 3]) for i in range(400)] + [(prose(25, i), "small-one") for i in range(40)] + [(None, "big"), ("", "small_one"), ("x", None), ("x", "other")]
    rep, chosen = mixed(spark, rows, [("big", 0.6, 1), ("small_one", 0.4, 3), ("none_there", 0.0, 2)])
    assert abs(rep["big"].actual_share - 0.6) < 0.02 and abs(rep["small_one"].actual_share - 0.4) < 0.02
    assert rep["small_one"].repeats_used == 3 and rep["none_there"].tokens_taken == 0
    assert all(n <= {"big": 1, "small_one": 3}[s] for _, s, _, n in chosen) and len({d for d, *_ in chosen}) == len(chosen)
    again, same = mixed(spark, rows, [("big", 0.6, 1), ("small_one", 0.4, 3), ("none_there", 0.0, 2)])
    assert sorted(same) == sorted(chosen)
    by = {d: (s, t, n) for d, s, t, n in chosen}
    assert rep["big"].tokens_taken == sum(t * n for s, t, n in by.values() if s == "big")


def test_selection_is_the_prefix_in_key_order(spark):
    n = 300
    c = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("tokens"), F.lit(0.5).alias("quality"))
    plan = spark.createDataFrame([("s", 1, 333.0)], "source string, epochs long, rest double")
    got = {r.doc_id for r in mixing.select(c, plan, seed=3).where("times = 2").collect()}
    rows = sorted((r.k, r.doc_id, r.tokens) for r in c.withColumn("k", mixing.sampling_key(3)).collect())
    want, total = set(), 0
    for _, d, t in rows:
        total += t
        if total > 333:
            break
        want.add(d)
    assert got == want
    # However coarse the slices and however few records may be sorted.
    for slices, most in ((2, 1), (4, 3), (256, 1)):
        assert {r.doc_id for r in mixing.select(c, plan, seed=3, slices=slices, most=most).where("times = 2").collect()} == want


def test_mix_of_nothing(spark):
    rep, chosen = mixed(spark, [(None, "a")], [("a", 1.0, 2)])
    assert rep["a"].tokens_taken == 0 and chosen == []


def test_long_texts_count_the_same_in_pieces():
    enc = mixing._encoder(mixing.VOCAB)
    t = (prose(200, 1) + ". 12 Ärzte!\n") * 200
    assert len(t) > mixing.PIECE and mixing.n_tokens(t, enc) == len(enc.encode_ordinary(t))


# --- 10 sentences ----------------------------------------------------------------------------------------------------------

TEXTS = [
    ["Dr. Zachary left at 7.30 a.m. and came back.", "The shop shuts at 5 p.m.", "Two men left."], ["It looked finished... but the bolt was short.", "Who said so?!", "Nobody."],
    ['The clerk wrote "We mended it. Twice. It leaks."', "The mill (see the note. It is short.) costs 4 crowns."], ['"Stop!" Michael shouted across the yard.', "J. K. Low and St. Pol Lane are both on the list."],
    ["The lease went to Moss Bros. Inc.", "iForm labels were tidy, said Prof. Tell."], ["Version 2.60.1 went live on 3. May at noon.", "The price fell by .5 percent!"], ["Frau Dr. Low schrieb: „Das passt nicht. Bitte prüfen.“ und wartete 96 Tage.", "Im Lager stehen 4 Stück, z. B. die Walze."],
    ["M. Low a écrit : « La pièce ne tient pas. Merci. » puis il est parti.", "Quelle surprise !"], ["La Dra. Low guarda 4 piezas.", "¿Por qué la página es tan rara?", "¡Nadie había visto una tolva!"],
    ["На складе 91 шт. из материала лён, и т. д. по списку.", "Г-н Low написал: «Не подходит. Проверьте.» и ждал 4 дня."], ["店主写道：“零件不合适。请再检查。”然后等了61天。", "“灯笼很安静。但是太贵。”", "为什么？"],
    ["店主は「合わない。確認してください。」と書きました。", "「静か。でも高い。」", "なぜですか？"], ['डॉ. Low ने लिखा: "ठीक नहीं है। जाँच करें।" और 56 दिन रुके।', "ऐसा क्यों है?"], ["كتب د. Low: «القطعة لا تناسب. يرجى الفحص.» ثم انتظر 59 يوما.", "لماذا؟"],
]


def test_sentences_in_many_scripts():
    for parts in TEXTS:
        sep = "" if any("぀" <= c <= "鿿" for c in parts[0]) else " "
        for joint in {sep, sep or "\n"}:
            t = joint.join(parts)
            ends = sentences.sentence_ends(t)
            at, want = 0, []
            for p in parts:
                at += len(p)
                want.append(at)
                at += len(joint)
            assert ends == want, (t, [t[a:b] for a, b in zip([0, *ends], ends)])


def test_units_blanks_and_missing_blanks():
    assert sentences.sentence_ends("A heading\n \nOne is here.Two is there.\n\n- slate\n\n\n8. Saddle notes") == [9, 24, 37, 46, 64]
    assert sentences.sentence_ends("  \n\n ") == [] and sentences.sentence_ends("") == []
    assert sentences.sentence_ends('He said "no.') == [12] and sentences.sentence_ends("((( [ a. B is. ") == [8, 14]
    t = "ราคาประมาณ 27 คราวน์ต่อชิ้น กุญแจจากNonwickได้รับการตรวจ"
    assert sentences.sentence_ends(t) == [t.index(" กุญแจ"), len(t)]


def test_span_weights_are_fitted_and_matter():
    w = sentences.fitted()
    assert w == sentences.fit() and w["pairs cut"] < -1
    # The labelled units are held by the fitted weights, and not without what a span says as a whole.
    t = 'The clerk wrote "We mended it. Twice. It leaks." Then he left.'
    whole = [t.index(" Then"), len(t)]
    assert sentences.split_unit(t) == whole
    assert len(sentences.split_unit(t, w | {"pairs cut": 0.0})) > 2
    # Opening words and lengths decide where marks alone do not.
    t = "it was late... but nobody went. so we stayed"
    assert sentences.split_unit(t, w | {"open small": 8.0}) != sentences.split_unit(t, w | {"open small": -8.0})
    long = "A word and more. " * 60
    assert len(sentences.split_unit(long.strip(), w | {"spans": -3.5, "over long": 0.0})) < len(sentences.split_unit(long.strip(), w | {"spans": -3.5, "over long": -4.0}))


def test_long_runs_of_weak_candidates_stay_whole():
    w = sentences.fitted()

    def span(t, a, b, cand):
        n, cut, say = b - a, {e: c for e, _, c in cand}, {e: s for e, s, _ in cand}
        length = w["short"] if n < sentences.LEAST_SPAN else w["over long"] / 100 * max(0, n - sentences.LONG_SPAN)
        return w[sentences._opening(t, a)] + w["spans"] + length + w["pairs cut"] * (cut.get(a, 0) + cut.get(b, 0)) + say.get(b, 0.0)

    def brute(t, cand):
        ends, best = [0, *(e for e, s, _ in cand if s > sentences.IMPOSSIBLE), len(t)], [0.0]
        for j in range(1, len(ends)):
            best.append(max(best[i] + span(t, ends[i], ends[j], cand) for i in range(j)))
        return best[-1]

    def worth(t, cand):
        ends = sentences.split_unit(t)
        total = sum(span(t, a, b, cand) for a, b in zip([0, *ends], ends))
        by = sentences.span_features(t, ends)
        assert abs(total - sum(w[k] * by[k] for k in by) - sum(s for e, s, _ in cand if e in ends)) < 1e-6
        return total

    for n in (20, 30, 60):
        assert len(sentences.split_unit("so it goes " + "... and then ".join(["on "] * n) + "to the end")) == 1
    r = random.Random(5)
    bits = ["... and so ", "a. ", "Then he went. ", "3. flour ", "“Stop!” ", "x" * 90 + " ", "no? ", "Dr. Who ", "e.g. this "]
    for _ in range(60):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 80))).strip()
        cand = sentences.Unit(t).candidates()
        assert abs(worth(t, cand) - brute(t, cand)) < 1e-6
    deep = "(" * 12 + "„Ja. Nein.“ [" + "{" * 9 + " One. Two. ]"
    assert sentences.pairs(deep)[deep.index("[")] == len(deep) - 1


def test_sentence_rows_and_long_texts(spark):
    d = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, "It is so. " * 30_000), (None, "x.")], "doc_id long, text string")
    got = sentences.split_sentences(d.withColumn("sent_end", F.lit(1)))
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 4: 30_000}
