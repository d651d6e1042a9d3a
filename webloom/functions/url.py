"""URL functions as Column expressions.

Nothing here leaves the JVM: every function is a composition of built-in string functions, so it stays inside
whole-stage code generation and never throws (ANSI mode is on by default in Spark 4; parse_url is avoided).
All take and return nullable strings; a null URL behaves like ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query keys that only track, as agreed for address comparison.
TRACKING = (
    r"(?i)^(utm_|gclid$|fbclid$|mc_cid$|mc_eid$|ref$|referrer$|igshid$|msclkid$|yclid$|_ga$|s_kwcid$)"
)
# A path segment that is a slug rather than a template word.
SLUG = r"^[0-9]+$|^[0-9a-f]{8,}$|^.{25,}$|\d{3,}"
# Weight of a path hint.
PATH_HINTS = (
    ("about", 10), ("company", 9), ("who-we-are", 9), ("our-story", 8), ("pricing", 9), ("plans", 8), ("price", 7),
    ("product", 8), ("products", 8), ("services", 8), ("service", 7), ("solutions", 7), ("features", 7),
    ("platform", 6), ("contact", 7), ("locations", 6), ("store", 5), ("faq", 7), ("help", 6), ("support", 6),
    ("docs", 6), ("documentation", 6), ("blog", 5), ("news", 5), ("press", 5), ("resources", 4), ("guides", 5),
    ("case-stud", 5), ("customers", 4), ("team", 4), ("careers", 2),
)
# Path words of key pages, utility pages and asset files.
KEY_WORDS = (
    "about about-us company who-we-are our-story pricing prices plans product products service services solutions "
    "contact contact-us support help faq faqs docs documentation"
).split()
UTILITY_WORDS = (
    "cart checkout basket login signin sign-in signup register account my-?account admin wp-admin wp-login search api "
    "graphql cdn-cgi logout password order orders payment wishlist preferences settings session auth"
).split()
ASSET_EXT = (
    "jpg jpeg png gif webp avif svg ico css js mjs json xml pdf zip gz mp4 mp3 webm woff2? ttf eot dmg exe csv xlsx? "
    "docx? pptx?"
).split()
KEY_PAGE = rf"(?i)/({'|'.join(KEY_WORDS)})(/|$|\.)"
UTILITY = rf"(?i)/({'|'.join(UTILITY_WORDS)})(/|$|\?)"
ASSET = rf"(?i)\.({'|'.join(ASSET_EXT)})$"
# Registry suffixes that take two labels.
TWO_PART = (
    "co.uk org.uk ac.uk gov.uk co.in net.in org.in ac.in co.jp co.kr co.nz co.za com.au com.br com.cn com.mx com.sg "
    "com.tr com.tw com.hk com.my com.ph com.ar"
).split()

_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//([^/?#]*))?([^?#]*)(\?([^#]*))?"


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _clean(c: Column | str) -> Column:
    """Blanks and control characters around an address, and tabs or line ends within, carry no meaning."""
    return F.regexp_replace(_c(c), r"(?U)^[\s\x00-\x20]+|\s+$|[\t\r\n]", "")


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_clean(c), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(c: Column | str) -> Column:
    """Lower-cased authority with port."""
    return F.lower(F.regexp_extract(_clean(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def url_path(c: Column | str) -> Column:
    """Path without parameters of its last segment, as written."""
    u = _clean(c)
    raw = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), c)


def _quoted(c: Column) -> Column:
    """Form encoding; only keys and values with unusual characters pay for the round trip."""
    full = F.replace(F.replace(F.url_encode(_decoded(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(c.rlike(r"^[A-Za-z0-9_.~\-]*$"), c).otherwise(full)


def _query(q: Column) -> Column:
    def pair(p: Column) -> Column:
        eq = F.instr(p, "=")
        k = F.when(eq > 0, F.substring_index(p, "=", 1)).otherwise(p)
        v = F.when(eq > 0, F.substring(p, eq + 1, F.length(p))).otherwise(F.lit(""))
        return F.concat(_quoted(k), F.lit("="), _quoted(v))

    keep = F.filter(
        F.split(q, "&"),
        lambda p: (p != "") & ~_decoded(F.substring_index(p, "=", 1)).rlike(TRACKING),
    )
    return F.when(q == "", F.lit("")).otherwise(F.array_join(F.transform(keep, pair), "&"))


def normalize_url(c: Column | str) -> Column:
    """Comparison form of an absolute address, '' for anything that is not http(s).

    Scheme and authority in lower case, default port, fragment, path parameters and tracking keys dropped, repeated
    slashes collapsed, one trailing slash dropped, query re-encoded in its order.
    """
    whole = lambda parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    return bind(_clean(c), lambda u: bind(whole(_split(u)), lambda x: bind(whole(_forms(x)), _joined)))


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it: no part of an address is taken twice, and
    the plan stays small wherever the optimizer copies the expression to."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(u: Column) -> dict[str, Column]:
    """Scheme, authority, path and query of a clean address."""
    return {
        "s": F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), "n": F.lower(F.regexp_extract(u, _PARTS, 2)),
        "p": F.regexp_extract(u, _PARTS, 3), "q": F.regexp_extract(u, _PARTS, 5),
    }


def _forms(x) -> dict[str, Column]:
    """Comparison forms of the parts."""
    s, n, p = x["s"], x["n"], x["p"]
    path = F.when(p.rlike(";|//"), F.regexp_replace(F.regexp_replace(p, r";[^/]*$", ""), "/{2,}", "/")).otherwise(p)
    net = F.when((s == "http") & n.endswith(":80"), F.regexp_replace(n, ":80$", "")).when((s != "http") & n.endswith(":443"), F.regexp_replace(n, ":443$", "")).otherwise(n)
    query = F.when(x["q"] == "", x["q"]).otherwise(_query(x["q"]))
    return {"s": s, "n": net, "p": F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/$", "")), "q": query}


def _joined(x) -> Column:
    s, net, path, query = x["s"], x["n"], x["p"], x["q"]
    rooted = F.when((net != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    front = F.when((net != "") | path.startswith("/"), F.concat(s, F.lit("://"), net)).otherwise(F.concat(s, F.lit(":")))
    whole = F.concat(front, rooted, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    broken = net.contains("[") != net.contains("]")
    return F.when(s.isin("http", "https") & ~broken, whole).otherwise(F.lit(""))


def with_normalized(df: DataFrame, **urls: Column | str) -> DataFrame:
    """df with the comparison form (normalize_url) of each address as a column of the given name."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in urls], *[normalize_url(c).alias(k) for k, c in urls.items()])


def normalized_in_steps(df: DataFrame, **urls: Column | str) -> DataFrame:
    """with_normalized() as a chain of projections inside generated code: faster, for tables of references as a whole.
    Not for what is filtered by the result: the optimizer would unroll the chain into the filter. Names beginning with
    `_url_` are the steps' own."""
    keep = [c for c in df.columns if c not in urls]
    step = lambda d, no, f: d.select("*", *[v.alias(f"_url_{no}{n}_{k}") for k in urls for n, v in f(k).items()])
    part = lambda no, k: {n: F.col(f"_url_{no}{n}_{k}") for n in "snpq"}
    out = step(df, 0, lambda k: {"u": _clean(urls[k])})
    out = step(out, 1, lambda k: _split(F.col(f"_url_0u_{k}")))
    out = step(out, 2, lambda k: _forms(part(1, k)))
    last = [_joined(part(2, k)).alias(k) for k in urls]
    return out.select(*[F.col(f"`{c}`") for c in keep], *last)


def bare_host(c: Column | str) -> Column:
    """Authority without a leading www. (as a prefix, never as a set of characters)."""
    return F.regexp_replace(url_netloc(c), r"^www\.", "")


def exact_host(c: Column | str) -> Column:
    """Authority as it is compared for canonical hosts: lower case, port kept."""
    return url_netloc(c)


def host_no_port(c: Column | str) -> Column:
    """Host without www. and port: the form in which hosts of references are compared."""
    return F.regexp_replace(F.regexp_replace(url_netloc(c), ":.*$", ""), r"^www\.", "")


def same_site(a: Column | str, b: Column | str) -> Column:
    x, y = bare_host(a), bare_host(b)
    return (x != "") & (y != "") & (x == y)


def path_segments(c: Column | str) -> Column:
    return F.filter(F.split(url_path(c), "/"), lambda s: s != "")


def url_template(c: Column | str) -> Column:
    segs = F.transform(
        path_segments(c), lambda s: F.when(s.rlike(SLUG), F.lit("{slug}")).otherwise(F.lower(s))
    )
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def path_importance(c: Column | str) -> Column:
    return bind(F.lower(url_path(c)), lambda p: bind(F.when(p == "", F.lit("/")).otherwise(p), _importance))


def _importance(path: Column) -> Column:
    best = F.greatest(F.lit(0), *[F.when(path.contains(h), F.lit(w)).otherwise(F.lit(0)) for h, w in PATH_HINTS])
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    score = F.greatest(F.lit(0), best - F.greatest(F.lit(0), depth - 2))
    return F.when(path == "/", F.lit(12)).otherwise(score)


def is_key_page(c: Column | str) -> Column:
    return url_path(c).rlike(KEY_PAGE)


def is_crawlable(c: Column | str) -> Column:
    return ~url_path(c).rlike(ASSET) & ~_c(c).rlike(UTILITY)


def domain_label(c: Column | str) -> Column:
    """The label a brand would own: example of shop.example.co.uk; '' for addresses in figures."""
    parts = F.split(host_no_port(c), r"\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))
    return (
        F.when(F.forall(parts, lambda p: p.rlike(r"^[0-9]+$")) | (url_netloc(c) == ""), F.lit(""))
        .when(n < 2, F.try_element_at(parts, F.lit(1)))
        .when((n >= 3) & two.isin(*TWO_PART), F.try_element_at(parts, F.lit(-3)))
        .otherwise(F.try_element_at(parts, F.lit(-2)))
    )


def hostname_variants(c: Column | str) -> Column:
    """The www or apex twin of a host with a brand label and a dot; an array of at most one address."""
    host = url_netloc(c)
    scheme = F.when(url_scheme(c) == "", F.lit("https")).otherwise(url_scheme(c))
    other = (
        F.when(host.startswith("www."), F.substring(host, 5, 1000))
        .when(host.contains("."), F.concat(F.lit("www."), host))
    )
    ok = (domain_label(c) != "") & other.isNotNull()
    return F.when(ok, F.array(F.concat(scheme, F.lit("://"), other, F.lit("/")))).otherwise(
        F.array().cast("array<string>")
    )


def differs_only_trivially(a: Column | str, b: Column | str) -> Column:
    """Same host but for www., same path but for trailing slashes; scheme and query don't matter."""
    strip = lambda c: F.regexp_replace(url_path(c), "/+$", "")
    return (bare_host(a) == bare_host(b)) & (strip(a) == strip(b))


# Segments that mark a version or a locale.
VERSION_SEG = r"/(v?\d+(?:\.\d+)*|latest|stable|next|current)(/|$)"
LOCALE_SEG = r"/([a-z]{2}(?:[-_][a-z]{2})?)(/|$)"


def variant_pair(a: Column | str, b: Column | str) -> Column:
    """Two addresses that become equal, and at least one of them other, once their first version (or locale)
    segment is taken out."""
    hits = []
    for seg in (VERSION_SEG, LOCALE_SEG):
        first = f"(?i)^(.*?){seg}"
        sa, sb = F.regexp_replace(_c(a), first, "$1/"), F.regexp_replace(_c(b), first, "$1/")
        hits.append((sa == sb) & ((sa != _c(a)) | (sb != _c(b))))
    return hits[0] | hits[1]
