"""Improvements that are no defects, in a fixed order; each is left out where a rule already covers it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules
from .evidence import Audit

# Markers of question-and-answer content; entity types asked for a description or references.
QUESTION = ("faq", "frequently asked", "how do i", "how to", "what is", "can i ", "do you ", "?")
ENTITY = ("organization", "localbusiness", "corporation", "website", "onlinestore", "store")


def _types(*names: str) -> Column:
    return F.array(*[F.lit(n.lower()) for n in names])


def _has(a: Audit, *names: str) -> DataFrame:
    return a.nodes.where(F.arrays_overlap("types", _types(*names))).select("site_id", "page_ord").distinct()


def opportunities(a: Audit, found: DataFrame) -> DataFrame:
    """(site_id, op_id, kind, priority, stage, observation, observed_at): PO-001.. per site in the fixed order."""
    fired = found.select("site_id", "rule")
    home = a.home.select("site_id", "home_ord", "home_url")
    ent = _has(a, *ENTITY).select("site_id").distinct()
    c = a.content

    def unless(df: DataFrame, *codes: str) -> DataFrame:
        return df.join(fired.where(F.col("rule").isin(*codes)).select("site_id").distinct(), "site_id", "left_anti")

    def op(df: DataFrame, no: int, kind: str, prio: str, stage: str, text, at: str) -> DataFrame:
        return df.select(
            "site_id", F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.lit(prio).alias("priority"), F.lit(stage).alias("stage"),
            (F.lit(text) if isinstance(text, str) else text).alias("observation"), F.col(at).alias("observed_at"),
        )

    declared = rules.declared_references(a).select("site_id").distinct()
    probed = rules.probe_summary(a)
    o1 = unless(home.join(ent, "site_id", "left_semi").join(declared, "site_id", "left_anti"), "FI-002", "EX-003")
    o2 = unless(probed.where("references_resolved > 0 AND independent_descriptions_found = 0").join(home, "site_id"), "EX-002")
    same = a.nodes.where(F.arrays_overlap("types", _types(*ENTITY)) & (F.size("same_as") > 0)).select("site_id").distinct()
    o3 = unless(home.join(ent, "site_id", "left_semi").join(same, "site_id", "left_anti"), "FI-002")
    o4 = unless(a.site.where("scope = 'site' AND sitemap_status IN ('absent', 'unreachable', 'invalid', 'empty')"), "MR-008").withColumn("at", F.coalesce("robots_url", "root_url"))
    marks = F.size(T.has_any("text_main", QUESTION))
    asks = c.where((marks >= 2) & (F.regexp_count("text_main", F.lit(r"\?")) >= 3)).join(_has(a, "FAQPage", "QAPage", "HowTo").select("site_id").distinct(), "site_id", "left_anti")
    first = lambda df: df.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("final_url", "page_ord").alias("at"))
    o5 = first(asks)
    o6 = first(c.where("depth >= 2").join(_has(a, "BreadcrumbList").select("site_id").distinct(), "site_id", "left_anti")).where("n >= 2")
    flat = c.where((F.col("words_main") >= 400) & (F.size(F.filter("headings", lambda h: h["level"].isin(2, 3))) < 2))
    o7 = unless(first(flat).where("n >= 2"), "MR-005", "MR-006")
    told = a.nodes.where(F.arrays_overlap("types", _types(*ENTITY)) & (T.word_count("description") >= 12)).select("site_id", F.col("page_ord").alias("home_ord")).distinct()
    o8 = unless(home.join(told, ["site_id", "home_ord"], "left_anti"), "AX-002", "FI-002")
    maps = a.sitemap_urls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    o9 = a.site.where("sitemap_status = 'ok'").join(maps, "site_id", "left").where(F.col("sitemap_lastmod_count") < F.greatest(F.lit(1), F.floor(F.coalesce("n", F.lit(0)) / 2)))
    o9 = unless(o9, "MR-008")
    priced = c.where(F.size(T.find_prices("text_main")) > 0).join(_has(a, "Product", "Offer", "AggregateOffer", "Service"), ["site_id", "page_ord"], "left_anti")
    o10 = unless(first(priced).where("n >= 2"), "FI-003")
    parts = [
        op(o1, 1, "external_identifiers", "P3", "IDENTIFY", "entity markup declares no outside reference", "home_url"),
        op(o2, 2, "independent_description", "P3", "IDENTIFY", "no outside reference carries a description", "home_url"),
        op(o3, 3, "same_as", "P2", "IDENTIFY", "entity markup declares no sameAs", "home_url"),
        op(o4, 4, "sitemap_absent", "P3", "DISCOVER", F.format_string("no usable sitemap (%s)", "sitemap_status"), "at"),
        op(o5, 5, "faq_markup", "P3", "CITE", F.format_string("%d pages with questions and answers", "n"), "at"),
        op(o6, 6, "breadcrumbs", "P3", "UNDERSTAND", F.format_string("%d pages at depth 2 or more", "n"), "at"),
        op(o7, 7, "passage_structure", "P3", "EXTRACT", F.format_string("%d long pages with fewer than two section headings", "n"), "at"),
        op(o8, 8, "entity_summary", "P2", "CITE", "the entry page's entity markup has no description", "home_url"),
        op(o9, 9, "sitemap_lastmod", "P3", "TRUST", F.format_string("%d dates of change in the sitemap", "sitemap_lastmod_count"), "root_url"),
        op(o10, 10, "product_markup", "P2", "EXTRACT", F.format_string("%d pages show prices without product markup", "n"), "at"),
    ]
    u = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("site_id").orderBy("no")
    return u.withColumn("op_id", F.format_string("PO-%03d", F.row_number().over(w))).select("site_id", "op_id", "kind", "priority", "stage", "observation", "observed_at")
