"""Functions on names, structured data and rendering of a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from . import url as U

# Schema.org types that state who publishes a site.
ENTITY_TYPES = (
    "organization localbusiness corporation website onlinestore store ngo educationalorganization governmentorganization "
    "restaurant medicalorganization sportsorganization performinggroup airline"
).split()
# Members of an entity that tell it from namesakes.
DISAMBIGUATORS = (
    "sameAs legalName identifier foundingDate address areaServed taxID vatID duns leiCode naics isicV4 telephone"
).split()
# Link relations that declare an outside reference.
REFERENCE_RELS = ("me", "author", "publisher", "alternate")
# What separates the parts of a title; the holder of a copyright line.
TITLE_SPLIT = r"(?U)\s*[|\x{2013}\x{2014}\x{b7}\x{2022}:]\s*|\s+-\s+"
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*,?\s*([A-Z][A-Za-z0-9&'’.\- ]{1,50})"
# Location prompts, language switches and calls to action.
LOCATION_HINT = (
    r"(?i)(select\s+(?:your\s+)?(?:city|location|store|region|area|branch)|change\s+(?:city|location|store|address)|"
    r"choose\s+(?:city|location|store)|deliver\s+to|delivery\s+location|"
    r"enter\s+(?:your\s+)?(?:pincode|pin code|zip|postcode|postal code)|set\s+(?:your\s+)?location|nearest\s+store|"
    r"pick\s+(?:a\s+)?(?:city|store))"
)
LANG_SWITCH = r"(?i)(language|idioma|langue|sprache|currency|country/region)"
CTA = (
    r"(?i)\b(buy|shop|order|book|start|get started|sign ?up|subscribe|try|download|contact|request|demo|add to cart|apply|"
    r"register|enrol|enroll|checkout|donate|join)\b"
)
#: Everyday words: a name made of nothing else needs to be told apart. A parameter, since the list is a choice of the
#: caller's language; this default is short and our own.
COMMON_WORDS = (
    "time people way day world life hand part place case week company system program question work number night point home "
    "water room area money story fact month lot right study book eye job word business issue side kind head house service "
    "friend power hour game line end law car city community name team minute idea body information back face level office "
    "door health person art history party result change morning reason research girl guy moment air teacher force education "
    "blue red green black white bright north south east west first next best new open smart simple direct prime global local "
    "clear fresh happy quick core bridge stone river sun star sky tree apple target square circle edge wave path spring light"
).split()


def split_title(c: Column | str) -> Column:
    """The parts of a title, blank ones left out."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.filter(F.transform(F.split(c, TITLE_SPLIT), F.trim), lambda s: s != "")


def copyright_holder(c: Column | str) -> Column:
    """The name in the first copyright line, '' if there is none."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_replace(F.regexp_extract(c, COPYRIGHT, 1), r"^[ .,]+|[ .,]+$", "")


def meta_get(meta: Column | str, *names: str) -> Column:
    """The first non-empty value among the names, '' if there is none."""
    m = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(*[F.nullif(m[n.lower()], F.lit("")) for n in names], F.lit(""))


def robots_directives(meta: Column | str, headers: Column | str) -> Column:
    """Directives of the robots and googlebot meta values and the X-Robots-Tag header, lower case, in that order."""
    m = F.col(meta) if isinstance(meta, str) else meta
    h = F.col(headers) if isinstance(headers, str) else headers
    lists = [F.nullif(v, F.lit("")) for v in (m["robots"], m["googlebot"], h["x-robots-tag"])]
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(F.transform(F.split(v, ","), lambda p: F.lower(F.trim(p))), empty) for v in lists]
    return F.concat(*parts)


def name_is_ambiguous(norm: Column | str, common=COMMON_WORDS) -> Column:
    """One token of four letters at most, or everyday words only."""
    toks = F.filter(F.split(F.coalesce(F.col(norm) if isinstance(norm, str) else norm, F.lit("")), " "), lambda t: t != "")
    known = F.array(*[F.lit(w) for w in common])
    short = (F.size(toks) == 1) & (F.length(F.try_element_at(toks, F.lit(1))) <= 4)
    return (F.size(toks) > 0) & (short | F.forall(toks, lambda t: F.array_contains(known, t)))


def mentions_name(name: Column, haystack: Column) -> Column:
    """Whether a text recognisably names a brand: contains its normalised name, also without blanks, or, if short
    itself, is compatible with it."""
    hay = T.normalize_entity_name(haystack)
    squash = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    near = T.names_compatible(name, hay) & (F.size(F.split(hay, " ")) <= 6)
    return (name != "") & (hay != "") & (hay.contains(name) | near | squash(hay).contains(squash(name)))


def brand_tokens(root_url: Column | str, site_name: Column | str) -> Column:
    """Words that name the site itself: the first label of its host and the words of its stated name."""
    label = F.split(U.host_no_port(root_url), r"\.")[0]
    return F.array_distinct(
        F.filter(F.concat(F.array(label), T.words(site_name)), lambda t: F.length(t) > 1)
    )


# --- JSON-LD nodes as VARIANT ----------------------------------------------------------------------------------


def node_types(node: Column | str) -> Column:
    """Types of a JSON-LD node, lower case."""
    n = F.col(node) if isinstance(node, str) else node
    many = F.try_variant_get(n, "$['@type']", "array<string>")
    one = F.try_variant_get(n, "$['@type']", "string")
    return F.transform(
        F.when(F.schema_of_variant(F.try_variant_get(n, "$['@type']", "variant")).startswith("ARRAY"), many).otherwise(
            F.when(one.isNotNull(), F.array(one))
        ),
        F.lower,
    )


def has_type(types: Column | str, *wanted: str) -> Column:
    t = F.col(types) if isinstance(types, str) else types
    return F.coalesce(F.arrays_overlap(t, F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


# --- Rendering --------------------------------------------------------------------------------------------------


def rendering_classification(visible: Column, hidden: Column, empty_root: Column, script: Column, html: Column, tags: Column) -> Column:
    """How content reaches a reader, judged by the served document alone."""
    heavy = (html > 0) & (script / F.greatest(html, F.lit(1)) >= 0.4) & (tags >= 3)
    return (
        F.when(visible >= 120, "server_rendered")
        .when(empty_root | heavy, "likely_client_rendered")
        .when((hidden >= 60) & (hidden >= 2 * F.greatest(F.lit(1), visible)), "interaction_required")
        .otherwise("server_rendered_thin")
    )


def rendering_of(base: Column, words: Column, rendered_words: Column) -> Column:
    """The classification, raised where a rendered snapshot shows the content."""
    shown = rendered_words >= F.greatest(F.lit(120), 3 * F.greatest(F.lit(1), words))
    thin = base.isin("likely_client_rendered", "server_rendered_thin")
    return F.when(thin & F.coalesce(shown, F.lit(False)), F.lit("verified_after_render")).otherwise(base)


def has_cta(buttons: Column, main_labels: Column) -> Column:
    return F.exists(buttons, lambda b: b.rlike(CTA)) | F.exists(main_labels, lambda t: F.coalesce(t, F.lit("")).rlike(CTA))


def context_gate_signals(hits: Column, selects: Column, buttons: Column) -> Column:
    """Signs that content waits for a place to be chosen, language and currency switches left out."""
    place = r"city|location|store|region|branch|pincode|zip|area"
    named = F.transform(
        F.filter(selects, lambda s: F.lower(s["name"]).rlike(place)),
        lambda s: F.format_string('<select name="%s"> with %d options', s["name"], s["n_options"]),
    )
    asked = F.transform(F.filter(buttons, lambda b: b.rlike(LOCATION_HINT)), lambda b: F.concat(F.lit("control: "), T.truncate(b, 80)))
    return F.filter(F.concat(hits, named, asked), lambda h: ~(h.rlike(LANG_SWITCH) & ~h.rlike(LOCATION_HINT)))
