"""robots.txt as tables: state, lines, rules that block an address."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import normalize_url


def robots_state(status: Column, body: Column) -> Column:
    """'present' (a 2xx answer with a body), 'absent' (404, 410 or an empty 2xx) or 'unknown'."""
    ok = (status >= 200) & (status < 300)
    filled = F.trim(F.coalesce(body, F.lit(""))) != ""
    return (
        F.when(ok & filled, "present").when(ok | status.isin(404, 410), "absent").otherwise("unknown")
    )


def robots_lines(robots: DataFrame) -> DataFrame:
    """(site_id, line_no, agent, field, value): lines of robots.text, comments cut off; the agent is that of the last
    user-agent line above ('*' before the first). A null or empty text has no lines."""
    lines = robots.select("site_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "raw"))
    clean = F.trim(F.split_part(F.col("raw"), F.lit("#"), F.lit(1)))
    lines = lines.withColumn("line", clean).where(F.instr("line", ":") > 0)
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.select("site_id", "line_no", field.alias("field"), value.alias("value"))
    above = Window.partitionBy("site_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(above)
    return lines.withColumn("agent", F.coalesce(agent, F.lit("*"))).where(
        F.col("field").isin("user-agent", "disallow", "allow", "sitemap", "crawl-delay")
    )


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    """(site_id, line_no, sitemap)."""
    return lines.where("field = 'sitemap' AND value <> ''").select("site_id", "line_no", F.col("value").alias("sitemap"))


def robots_crawl_delay(lines: DataFrame) -> DataFrame:
    """(site_id, crawl_delay): the first crawl delay that is a number."""
    d = lines.where("field = 'crawl-delay'").select("site_id", "line_no", F.col("value").try_cast("double").alias("d")).where("d IS NOT NULL")
    return d.groupBy("site_id").agg(F.min(F.struct("line_no", "d"))["d"].alias("crawl_delay"))


def blocking_rules(lines: DataFrame, urls: DataFrame) -> DataFrame:
    """(site_id, url, agent, rule): for every address the longest disallowed prefix of its path, of any agent; among
    equals the first line. Wild cards and end marks at the end of a rule don't count for its length."""
    rules = lines.where("field = 'disallow' AND value <> ''").select(
        "site_id", "line_no", "agent", F.col("value").alias("rule"), F.regexp_replace("value", r"[*$]+$", "").alias("prefix")
    )
    path = F.regexp_extract(normalize_url("url"), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    # Rules of one site are few; the join is on the site, the prefix is a residual condition.
    met = urls.select("site_id", "url", path.alias("p")).join(rules, "site_id").where(F.col("p").startswith(F.col("prefix")))
    w = Window.partitionBy("site_id", "url").orderBy(F.length("prefix").desc(), "line_no")
    return met.withColumn("rk", F.row_number().over(w)).where("rk = 1").select("site_id", "url", "agent", "rule")


def allowed(robots: DataFrame, urls: DataFrame, agent: str = "webloom") -> DataFrame:
    """(site_id, url, allowed): the standard library's reading of robots.text for an agent; sites without a text allow
    all. Addresses of a site are judged in slices, so a site with most of them is no single task."""
    schema = "site_id long, url string, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, RobotFileParser] = {}
        for pdf in batches:
            out = []
            for text, url in zip(pdf["text"], pdf["url"]):
                if not text:
                    out.append(True)
                    continue
                p = known.get(text)
                if p is None:
                    if len(known) > 200:
                        known.clear()
                    p = known[text] = RobotFileParser()
                    p.parse(text.splitlines())
                out.append(p.can_fetch(agent, url or ""))
            yield pd.DataFrame({"site_id": pdf["site_id"], "url": pdf["url"], "allowed": out})

    texts = robots.groupBy("site_id").agg(F.max("text").alias("text"))
    return urls.select("site_id", "url").join(texts, "site_id", "left").mapInPandas(run, schema)
