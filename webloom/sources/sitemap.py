"""Sitemaps: locations, counts, state and the order of what to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..runtime import shared_table

LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def parse_sitemap(xml: Column | str) -> Column:
    """struct(is_index, locs): locations of a sitemap or an index of sitemaps; nothing for input that is no markup.
    Malformed documents give the locations that can be read (Spark's xpath throws on them)."""
    x = F.coalesce(F.col(xml) if isinstance(xml, str) else xml, F.lit(""))
    markup = F.ltrim(x).startswith("<")
    locs = F.transform(
        F.regexp_extract_all(x, F.lit(LOC), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))
    )
    none = F.array().cast("array<string>")
    return F.struct(
        (markup & x.rlike(r"(?i)<(\w+:)?sitemapindex")).alias("is_index"), F.when(markup, locs).otherwise(none).alias("locs")
    )


def count_lastmod(xml: Column | str) -> Column:
    x = F.coalesce(F.col(xml) if isinstance(xml, str) else xml, F.lit(""))
    return F.regexp_count(x, F.lit("(?i)<lastmod>"))


def sitemap_status(attempts: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, sitemap_status) of a site's attempts: 'ok' if one could be read and the site has entries, 'empty' if one
    could be read and none of its entries is an address, else 'invalid' if a document without locations was served,
    else 'unreachable'; 'absent' for those of `sites` without an attempt. attempts: (site_id, status, xml).

    A document that was not served (2xx) or is blank is unreachable, one without locations invalid.
    """
    locs = parse_sitemap("xml")["locs"]
    served = F.coalesce((F.col("status") >= 200) & (F.col("status") < 300), F.lit(False)) & (F.trim(F.coalesce("xml", F.lit(""))) != "")
    usable = F.exists(locs, lambda u: U.url_scheme(u).isin("http", "https"))
    state = F.when(~served, 2).when(F.size(locs) == 0, 3).when(~usable, 4).otherwise(5)
    names = F.array(*[F.lit(x) for x in ("absent", "unreachable", "invalid", "empty", "ok")])
    best = attempts.groupBy("site_id").agg(F.max(state).alias("s"))
    if sites is not None:
        best = sites.select("site_id").distinct().join(best, "site_id", "full")
    return best.select("site_id", F.element_at(names, F.coalesce("s", F.lit(1))).alias("sitemap_status"))


def first_seen(rows: DataFrame, site: str, url: str, order: list) -> DataFrame:
    """(site_id, url_norm, ord): distinct comparison forms in the order first met."""
    w = Window.partitionBy(site).orderBy(*order)
    n = U.with_normalized(rows.select(F.col(site).alias("site_id"), F.col(url).alias("_u"), F.row_number().over(w).alias("ord")), url_norm="_u")
    return n.where("url_norm <> ''").groupBy("site_id", "url_norm").agg(F.min("ord").alias("ord"))


def stratified_queue(candidates: DataFrame, budget: int = 20, per_bucket: int = 3, few_buckets: int = 4, per_bucket_few: int = 6) -> DataFrame:
    """(site_id, url_norm, template, round, position): a sample that spreads over a site's templates.

    candidates: (site_id, url_norm, ord). Addresses fall into buckets by template; buckets come in the order of their
    highest importance, then of their name; a bucket gives its addresses by importance, then in order. Rounds take one
    from each bucket in turn, at most per_bucket a bucket (per_bucket_few on sites of few_buckets or fewer), until the
    budget is used. Addresses that are no content are left out.
    """
    c = candidates.where(U.is_crawlable("url_norm")).select(
        "site_id", "url_norm", "ord", U.url_template("url_norm").alias("template"), U.path_importance("url_norm").alias("importance")
    )
    own = Window.partitionBy("site_id", "template").orderBy(F.col("importance").desc(), "ord")
    # Rounds beyond the larger cap are of no use: the ranking is cut before anything else is ordered.
    c = c.withColumn("round", F.row_number().over(own)).where(F.col("round") <= max(per_bucket, per_bucket_few))
    c = shared_table(c, "queue")  # a few rows a template, read three times below
    heads = c.where("round = 1").select("site_id", "template", F.col("importance").alias("top"))
    rank = Window.partitionBy("site_id").orderBy(F.col("top").desc(), "template")
    heads = heads.withColumn("bucket", F.row_number().over(rank)).where(F.col("bucket") <= budget)
    n = heads.groupBy("site_id").agg(F.max("bucket").alias("buckets"))
    c = c.join(heads.select("site_id", "template", "bucket"), ["site_id", "template"]).join(n, "site_id")
    cap = F.when(F.col("buckets") <= few_buckets, per_bucket_few).otherwise(per_bucket)
    pos = Window.partitionBy("site_id").orderBy("round", "bucket")
    return (
        c.where(F.col("round") <= cap)
        .withColumn("position", F.row_number().over(pos))
        .where(F.col("position") <= budget)
        .select("site_id", "url_norm", "template", "round", "position")
    )
