"""Variant spellings of names typed by people: suffix blocking and longest-common-subsequence comparison.

A profile page names its subject several times. Per page the spellings are folded, split into tokens and aligned, so
that every page has a core (the agreed spelling of each part of the name, place and work) and the set of spellings
seen. Pages with equal cores are one node. The suffixes of three letters of all spelled tokens are indexed (longer ones
meet no further pair); a suffix shared by many nodes is cut into chunks that meet two by two. Of the nodes that meet,
those that edit distances of names and fields can't part are compared by the ratio of the longest common subsequence
of their tokens and by their other fields; linked nodes form entities, and pages of one entity are pairs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import one_delivery, shared_table

#: Shortest suffix indexed; spellings a block may hold before it is cut into chunks that meet two by two.
MIN_SUFFIX, CROWD = 3, 300
#: Least ratio of the longest common subsequence: with work that agrees, with a place only, without any other field,
#: and of places and work themselves.
SIMILAR, SIMILAR_PLACE, SIMILAR_ALONE, SIMILAR_FIELD = 0.8, 0.85, 0.88, 0.72

# Titles, legal forms and kinds of firm (with abbreviations), which do not tell names apart.
TITLES = frozenset("dr mr mrs ms miss prof sir rev hon herr frau hr fr dott".split())
FORMS = frozenset(
    "inc incorporated llc ltd limited gmbh ag co company corp corporation plc sa sarl srl kg ohg bv nv oy ab as llp lp pty the by and of "
    "associates associate assoc assocs brothers bros bro international intl manufacturing mfg engineering engg eng group holding holdings".split()
)
FIRM_WORDS = FORMS - frozenset("the by and of as ab sa".split())
# Given names with their short forms.
GIVEN = {
    "alexander": "alex sandy al lex sasha", "anthony": "tony ant", "andrew": "andy drew", "benjamin": "ben benny", "barbara": "barb babs", "catherine": "cathy cath kitty",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dorothy": "dot dottie dolly",
    "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora", "elizabeth": "liz beth lizzie eliza betty bess libby", "emily": "em emmy", "frances": "fran fanny frankie",
    "francis": "frank", "frederick": "fred freddie freddy", "george": "georgie", "gerald": "gerry jerry", "gregory": "greg gregg", "harold": "harry hal",
    "henrietta": "etta hetty hettie henny hen", "henry": "hank hal harry", "isabella": "bella izzy isa belle", "james": "jim jamie jimmy jem", "jennifer": "jen jenny",
    "jonathan": "jon jonny", "john": "jack johnny", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kat kay kit", "kenneth": "ken kenny",
    "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge greta", "matthew": "matt matty", "michael": "mike mick micky mikey",
    "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "oliver": "ollie olly", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "peter": "pete",
    "philip": "phil pip", "quentin": "quent quin quint", "rebecca": "becky becca", "richard": "rich rick dick richie ricky", "robert": "rob bob bobby robbie bert",
    "samuel": "sam sammy", "stephen": "steve stevie", "steven": "steve", "susanna": "sue susie suzy sukie anna", "theodora": "thea dora theo teddie", "theodore": "theo ted",
    "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ulli ully rick", "victoria": "vicky vic tori vicki", "vincent": "vince vinny", "walter": "walt wally",
    "wilhelmina": "mina wilma minnie willa billie", "william": "will bill billy willy liam", "yolanda": "yola yoli landa yolie", "zachary": "zach zack zac zak",
}
_FORMAL: dict[str, str] = {}
for _k, _v in GIVEN.items():
    _FORMAL[_k] = _k
    for _w in _v.split():
        _FORMAL.setdefault(_w, _k)
NAME_KEY = re.compile(r"(?i)(?:^|[:._-])(?:title|author|name|creator)$")
NOT_NAME_KEY = re.compile(r"(?i)site.?name|place.?name|application.?name|user.?name|host.?name|domain.?name|file.?name")
_HEAD = re.compile(r"\s[–—|·•]\s|\s-\s|:\s|\s\|\s?")
_TYPES = frozenset(("person", "organization", "localbusiness"))

NODE = "page_id long, core string, kind string, parts array<string>, spelled array<string>, place string, job string, employer string"


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = masks.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def abbreviates(short: str, long: str) -> bool:
    """short is made of letters of long in their order, with its first: mchts, merchants."""
    return 2 <= len(short) < len(long) and short[0] == long[0] and lcs(short, long) == len(short)


def formal(token: str) -> str | None:
    """The full given name a token stands for, typing errors allowed; None if it is none."""
    f = _FORMAL.get(token)
    if f or len(token) < 5:
        return f
    best, most = None, 0.82
    for g in GIVEN:
        if abs(len(g) - len(token)) <= 2:
            r = ratio(g, token)
            if r > most:
                best, most = g, r
    return best


_LONG_FORMS = sorted(w for w in FORMS if len(w) > 6)  # brothers, company, associates and the like


def is_form(token: str) -> bool:
    """A legal form or kind of firm, typing errors allowed in the long ones."""
    return token in FORMS or (len(token) > 5 and any(token[0] == w[0] and ratio(token, w) >= 0.85 for w in _LONG_FORMS))


def tokens(name: str) -> list[str]:
    s = re.sub(r"(?<=\w)['’`](?=\w)", "", name)
    s = re.sub(r"\b(?:[^\W\d_]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)  # G.m.b.H., L.L.C.
    return re.findall(r"[^\W\d_]+", fold(s))


def is_firm(names: list[str], kind: str | None) -> bool:
    if kind:
        return kind != "person"
    votes = 0
    for n in names:
        ts = tokens(n)
        if any(t in FIRM_WORDS for t in ts):
            votes += 1
        elif len([t for t in ts if len(t) > 2 and t not in TITLES]) > 2:
            votes += 1
        else:
            votes -= 1
    return votes > 0


def _agree(spellings: Counter) -> str:
    """The spelling most mentions share; among equals the one closest to all others, then the first by alphabet."""
    most = max(spellings.values())
    top = sorted(s for s, n in spellings.items() if n == most)
    if len(top) == 1:
        return top[0]
    return max(top, key=lambda s: (sum(n * ratio(s, o) for o, n in spellings.items()), [-ord(c) for c in s]))


def person(names: list[str]) -> tuple[list[str], set[str]]:
    """([family, given or initial or ''], spellings of the family name) of a person's mentions."""
    family: Counter = Counter()
    given: Counter = Counter()
    initials: Counter = Counter()
    for raw in names:
        ts = [t for t in tokens(raw) if t not in TITLES and t not in ("jr", "sr", "ii", "iii")]
        full = [t for t in ts if len(t) > 2 or t in _FORMAL]
        known = [(t, formal(t)) for t in full]
        giv = [(t, f) for t, f in known if f]
        if len(giv) == len(full) and len(full) > 1:
            # All look like given names: the surname is the last, or the first before a comma.
            sur = full[0] if "," in raw else full[-1]
            giv = [(t, f) for t, f in giv if t != sur][:1]
            fam = [sur]
        else:
            fam = [t for t, f in known if not f]
            if len(fam) > 1 and not giv:
                # Nothing is known of either: order and comma tell them apart.
                g = fam[-1] if "," in raw else fam[0]
                giv = [(g, g)]
                fam.remove(g)
            elif len(full) == 1 and giv and not fam:
                fam, giv = [full[0]], []
        for t in fam[-1:] if "," not in raw else fam[:1]:
            family[t] += 1
        for _, f in giv[:1]:
            given[f] += 1
        for t in ts:
            if t not in full and t:
                initials[t[0]] += 1
                break
    if not family:
        return [], set()
    name = given.most_common(1)[0][0] if given else (initials.most_common(1)[0][0] if initials else "")
    return [_agree(family), name], set(family)  # given names are shared by far too many to index


def firm(names: list[str]) -> tuple[list[str], set[str]]:
    """(agreed tokens of a firm's name in alphabetical order, all spellings of tokens)."""
    mentions = []
    for raw in names:
        ts = [t for t in tokens(raw) if not is_form(t)]
        if len(ts) >= 2 or (ts and not re.fullmatch(r"[A-Z]{2,6}", raw.strip())):
            mentions.append([t for t in ts if len(t) > 1])
    mentions = [m for m in mentions if m]
    if not mentions:
        return [], set()
    slots: list[Counter] = []
    for m in sorted(mentions, key=len, reverse=True):
        for t in m:
            best, most = None, 0.7
            for s in slots:
                r = max((1.0 if abbreviates(t, o) or abbreviates(o, t) else ratio(t, o)) for o in s)
                if r >= most:
                    best, most = s, r
            if best is None:
                best = Counter()
                slots.append(best)
            best[t] += 1
    need = max(1, len(mentions) // 2)
    kept = [s for s in slots if sum(s.values()) >= need] or slots
    agreed = []
    for s in kept:
        longest = max(map(len, s))
        words = Counter({t: n for t, n in s.items() if len(t) > longest - 3 or not any(abbreviates(t, o) for o in s)})
        agreed.append(_agree(words or s))
    return sorted(agreed), {t for s in kept for t in s}


def _entities(value) -> Iterator[dict]:
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo = v + todo
        elif isinstance(v, dict):
            t = v.get("@type")
            ts = [t] if isinstance(t, str) else t if isinstance(t, list) else []
            if any(isinstance(x, str) and x.lower() in _TYPES for x in ts):
                yield v
            elif "@graph" in v:
                todo = [v["@graph"], *todo]
            elif not t:
                todo = [x for x in v.values() if isinstance(x, (dict, list))] + todo


def _text(v) -> str:
    """The first string of a value that may be a string, an object with a name, or a list of either."""
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, dict):
        return _text(v.get("name") or v.get("addressLocality"))
    if isinstance(v, list):
        return next((x for x in map(_text, v) if x), "")
    return ""


def _field(s: str) -> str:
    return " ".join(re.findall(r"[^\W\d_]+", fold(re.sub(r"\(.*?\)", " ", s))))


def read_profile(title: str | None, meta: list[tuple[str, str]], blocks: list[str]) -> tuple:
    """(kind, parts, spellings, place, job, employer) of a profile page."""
    entity: dict = {}
    for b in blocks or ():
        try:
            found = next(_entities(json.loads(b)), None)
        except (ValueError, RecursionError, TypeError):
            continue
        if found:
            entity = found
            break
    names = []
    if title and _HEAD.split(title)[0].strip():
        names.append(_HEAD.split(title)[0].strip())
    place = ""
    for k, v in meta or ():
        if not v:
            continue
        if re.search(r"(?i)place.?name|locality", k):
            place = place or v
        elif NAME_KEY.search(k) and not NOT_NAME_KEY.search(k):
            names.append(v.strip())
    own = [entity.get("name")]
    alt = entity.get("alternateName")
    own += alt if isinstance(alt, list) else [alt]
    both = f"{_text(entity.get('givenName'))} {_text(entity.get('familyName'))}".strip()
    names += [x.strip() for x in [*own, both] if isinstance(x, str) and x.strip()]
    t = entity.get("@type")
    ts = [x.lower() for x in ([t] if isinstance(t, str) else t or []) if isinstance(x, str)]
    kind = "person" if "person" in ts else "firm" if ts else None
    corp = is_firm(names, kind)
    parts, spelled = (firm if corp else person)(names)
    address = entity.get("address")
    local = _text(address.get("addressLocality")) if isinstance(address, dict) else _text(address)
    return (
        "firm" if corp else "person", parts, spelled, _field(local or place), _field(_text(entity.get("jobTitle"))), _field(_text(entity.get("worksFor"))),
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in NODE.split(", ")]
    for pdf in batches:
        rows = []
        for pid, title, meta, blocks in zip(pdf["page_id"], pdf["title"], pdf["meta"], pdf["jsonld"]):
            pairs = [(m["key"], m["value"]) for m in (meta if meta is not None else ())]
            kind, parts, spelled, place, job, employer = read_profile(title, pairs, [b for b in (blocks if blocks is not None else ()) if b])
            if not parts:
                continue
            core = "|".join([kind, *parts, place, job, employer])
            rows.append((pid, core, kind, parts, sorted(spelled), place, job, employer))
        yield pd.DataFrame(rows, columns=cols)


def profiles(page: DataFrame) -> DataFrame:
    """One row per profile page that names a subject (NODE)."""
    own = page.where(F.col("meta")["og:type"] == "profile")
    one = one_delivery(own, "page_id", "title", F.map_entries("meta").alias("meta"), "jsonld")
    return one.select(F.col("page_id").cast("long").alias("page_id"), "title", "meta", "jsonld").mapInPandas(_read, NODE)


def block_keys(pages: DataFrame) -> DataFrame:
    """(key, chunk, crowd, node, token): suffix blocks. The token is the spelling whose suffix it is.

    Spellings that share any suffix share the shortest one, so its blocks hold every pair that meets, whatever the size
    of the table. A block of more than CROWD spellings is cut into chunks and every two of them meet in a block of
    their own (crowd: of two different chunks), so that no task holds a crowd and no pair is left out.
    """
    rows = (
        pages.select("node", "kind", F.explode("spelled").alias("token"))
        .where(F.length("token") >= MIN_SUFFIX)
        .distinct()
        .withColumn("suffix", F.expr(f"right(token, {MIN_SUFFIX})"))
    )
    rows = shared_table(rows, "names-suffixes")
    # Spellings by block, counted with a combining aggregation; a block's rows are never brought together for it.
    sizes = rows.groupBy("kind", "suffix").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("chunks"))
    cut = rows.join(sizes, ["kind", "suffix"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return cut.select(
        F.xxhash64("kind", "suffix", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"),
        "chunk", (F.col("chunk") != F.col("other")).alias("crowd"), "node", "token",
    )


def _near(x: Column, y: Column, least: float) -> Column:
    """Whether ratio(x, y) may reach `least`: what it says of edits bounds the Levenshtein distance from above."""
    return (x == y) | (F.levenshtein(x, y) <= (1 - least) * (F.length(x) + F.length(y)) + 1e-6)


def may_be_same() -> Column:
    """What every pair that compare() does not part fulfils, on columns named as in links(): only cheaper."""
    c = F.col
    size_a, size_b = F.size("parts_a"), F.size("parts_b")

    def longest_met(small: Column, large: Column) -> Column:
        top = F.array_max(F.transform(small, F.length))
        met = lambda t: F.exists(large, lambda o: (F.substring(o, 1, 1) == F.substring(t, 1, 1)) | _near(t, o, SIMILAR))
        return F.forall(small, lambda t: (F.length(t) < top) | met(t))

    person = _near(c("ta"), c("tb"), SIMILAR) | _near(c("parts_a")[0], c("parts_b")[0], SIMILAR)
    firm = (F.abs(size_a - size_b) <= 1) & ((F.least(size_a, size_b) > 1) | (F.greatest(size_a, size_b) < 2))
    firm = firm & F.when(size_a <= size_b, longest_met(c("parts_a"), c("parts_b"))).otherwise(longest_met(c("parts_b"), c("parts_a")))
    name = F.when(c("kind_a") == "person", person).otherwise(firm)
    told = lambda f: (c(f"{f}_a") != "") & (c(f"{f}_b") != "")
    like = lambda f, least=SIMILAR_FIELD: _near(c(f"{f}_a"), c(f"{f}_b"), least)
    work = (~told("job") | like("job")) & (~told("employer") | like("employer"))
    far = told("job") & told("employer") & like("place", 0.6)
    return F.when(told("place"), like("place") | far & work).otherwise(work) & name


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("strong", pa.bool_())])


def same_name(kind: str, x: list[str], y: list[str], tx: str, ty: str) -> float:
    """Likeness of two names, 0 if they differ; tx and ty are spellings that share a suffix."""
    if kind == "person":
        fam = max(ratio(tx, ty), ratio(x[0], y[0]))
        if fam < SIMILAR:
            return 0.0
        g, h = x[1], y[1]
        if g and h and g != h:
            if len(g) == 1 or len(h) == 1:
                short, long = (g, h) if len(g) <= len(h) else (h, g)
                firsts = {long[0]} | {n[0] for n in GIVEN.get(long, "").split()}
                if short not in firsts:
                    return 0.0
            elif ratio(g, h) < 0.85 or (g in GIVEN and h in GIVEN):
                return 0.0
        return fam if g and h and len(g) > 1 and len(h) > 1 else fam - 0.02
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(large) - len(small) > 1 or (len(small) < 2 and len(large) > 1):
        return 0.0
    free = list(large)
    worst = 1.0
    longest = max(map(len, small))  # the part that tells firms apart; trades are shorter and known from few words
    for t in small:
        best, at = 0.0, -1
        for i, o in enumerate(free):
            r = 1.0 if t == o else 0.95 if abbreviates(t, o) or abbreviates(o, t) else ratio(t, o)
            if {t, o} == {tx, ty}:
                r = max(r, ratio(tx, ty))
            if r > best:
                best, at = r, i
        if best < (SIMILAR if len(t) == longest else SIMILAR_FIELD):
            return 0.0
        if len(t) == longest:
            worst = min(worst, best)
        free.pop(at)
    return worst if len(small) == len(large) else worst - 0.05


def compare(kind: str, x: list[str], y: list[str], tx: str, ty: str, a: tuple[str, str, str], b: tuple[str, str, str]) -> bool | None:
    """True: one entity, by name and other fields; False: by name, with nothing else to compare; None: two."""
    like = same_name(kind, x, y, tx, ty)
    if not like:
        return None
    place = None if not a[0] or not b[0] else ratio(a[0], b[0]) >= SIMILAR_FIELD
    jobs = [ratio(p, q) >= SIMILAR_FIELD for p, q in ((a[1], b[1]), (a[2], b[2])) if p and q]
    work = all(jobs) if jobs else None
    if place is None and work is None:
        return False if like >= SIMILAR_ALONE else None
    if place is True:
        # At one place a differing work is a change of work, if the name is the same to the letter.
        return True if like >= (0.97 if work is False else SIMILAR if work else SIMILAR_PLACE) else None
    if work is True:
        return True if place is None or len(jobs) == 2 and like >= 0.97 and max(ratio(a[0], b[0]), 0) >= 0.6 else None
    return None


def links(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, strong): nodes of one entity among those that meet in a block."""
    f = ["kind", "parts", "place", "job", "employer"]
    side = lambda x: keys.join(nodes.select("node", *f), "node").select(
        "key", "crowd", F.col("chunk").alias(f"chunk_{x}"), F.col("node").alias(x), F.col("token").alias(f"t{x}"), *[F.col(c).alias(f"{c}_{x}") for c in f]
    )
    met = side("a").join(side("b").drop("crowd"), "key").where("a < b AND (NOT crowd OR chunk_a <> chunk_b)").where(may_be_same())
    # Of several pairs of spellings of two nodes the closest by length says enough: keep one for each pair of nodes.
    met = met.groupBy("a", "b").agg(
        F.min(F.struct(F.levenshtein("ta", "tb").alias("d"), F.col("ta"), F.col("tb"))).alias("t")
    ).select("a", "b", "t.ta", "t.tb")
    left = nodes.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in f])
    right = nodes.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in f])
    pairs = met.join(left, "a").join(right, "b").select(
        "a", "b", "ta", "tb", "kind_a", "parts_a", "parts_b", "place_a", "job_a", "employer_a", "place_b", "job_b", "employer_b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, j, ta, tb, kind, px, py, la, ja, ea, lb, jb, eb in zip(*(b.column(k).to_pylist() for k in range(13))):
                same = compare(kind, px, py, ta, tb, (la, ja, ea), (lb, jb, eb))
                if same is not None:
                    rows.append((i, j, same))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], c.type) for k, c in enumerate(_LINK)], schema=_LINK)

    return pairs.mapInArrow(run, "a long, b long, strong boolean")


def components(vertices: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(v, c): connected components by propagating the lowest id and jumping to the label's label, until nothing
    changes. vertices: (v), edges: (a, b); labels are written to the shared folder after every round."""
    both = shared_table(
        edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges"
    )
    labels = vertices.select("v", F.col("v").alias("c"))
    while True:
        near = both.join(labels.select(F.col("v").alias("y"), "c"), "y").groupBy(F.col("x").alias("v")).agg(F.min("c").alias("n"))
        step = labels.join(near, "v", "left").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("far"))
        new = step.join(jump, "c", "left").select("v", "old", F.least("c", "far").alias("c"))
        new = shared_table(new, f"{name}-labels")
        changed = new.where("old <> c").limit(1).count()
        labels = new.select("v", "c")
        if not changed:
            return labels


def entities(page: DataFrame) -> DataFrame:
    """(page_id, entity): the entity of every profile page that names a subject; entity is a page id of it.

    Pages without a usable name are left out. Pages with the same core are one node from the start, so a name typed
    alike on any number of pages is compared once.
    """
    read = shared_table(profiles(page), "names-read")
    seen = shared_table(read.join(read.groupBy("core").agg(F.min("page_id").alias("node")), "core"), "names-pages")
    nodes = shared_table(
        seen.groupBy("node").agg(
            *[F.first(c).alias(c) for c in ("kind", "parts", "place", "job", "employer")], F.count(F.lit(1)).alias("pages")
        ),
        "names-nodes",
    )
    edges = shared_table(links(nodes, shared_table(block_keys(seen), "names-keys")), "names-links")
    first = components(nodes.select(F.col("node").alias("v")), edges.where("strong").select("a", "b"), "names-strong")
    # Nodes that only their name links join an entity if it is the only one of that name, or by far the largest.
    size = nodes.select(F.col("node").alias("v"), "pages", ((F.col("place") != "") | (F.col("job") != "") | (F.col("employer") != "")).cast("int").alias("told")).join(first, "v")
    size = size.groupBy("c").agg(F.sum("pages").alias("pages"), F.max("told").alias("told"))
    la = first.select(F.col("v").alias("a"), F.col("c").alias("ca"))
    lb = first.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    weak = edges.where("NOT strong").join(la, "a").join(lb, "b").where("ca <> cb").select("ca", "cb")
    weak = weak.union(weak.select("cb", "ca")).distinct()
    sa = size.select(F.col("c").alias("ca"), F.col("pages").alias("pa"), F.col("told").alias("oa"))
    sb = size.select(F.col("c").alias("cb"), F.col("pages").alias("pb"), F.col("told").alias("ob"))
    cand = weak.join(sa, "ca").join(sb, "cb").where("ob > oa OR (ob = oa AND (pb > pa OR (pb = pa AND cb < ca)))")
    # Partners that tell place or work count before those that don't.
    per = cand.groupBy("ca").agg(
        F.max(F.struct("ob", "pb", F.negative("cb").alias("m"))).alias("top"), F.max("ob").alias("o")
    )
    rival = cand.join(per.select("ca", "o"), "ca").where("ob = o").groupBy("ca").agg(F.sum("pb").alias("all"))
    chosen = per.join(rival, "ca").where(F.col("top.pb") * 3 >= F.col("all") * 2).select(F.col("ca").alias("a"), F.negative("top.m").alias("b"))
    second = components(size.select(F.col("c").alias("v")), chosen, "names-weak")
    final = first.withColumnRenamed("c", "mid").join(second.select(F.col("v").alias("mid"), "c"), "mid").select(F.col("v").alias("node"), F.col("c").alias("entity"))
    return seen.select("page_id", "node").join(final, "node").select("page_id", "entity")


def same_entity_pairs(page: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b), a < b: profile pages about the same person or organisation.

    Deliveries of a page count once. Null titles, meta, JSON-LD, broken JSON and pages without a name are handled: the
    latter are in no pair. Relatives and sister firms share part of a name only and stay apart, as do namesakes whose
    place and work both differ.
    """
    e = shared_table(entities(page), "names-entities")
    x = e.select(F.col("page_id").alias("page_id_a"), "entity")
    y = e.select(F.col("page_id").alias("page_id_b"), "entity")
    return x.join(y, "entity").where("page_id_a < page_id_b").select("page_id_a", "page_id_b")
