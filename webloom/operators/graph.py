"""Depth of pages in the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_table


def depths(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(site_id, url, depth): least number of links from a site's seeds, breadth first.

    edges: (site_id, src, dst), seeds: (site_id, url). Every round joins the frontier only, and what is reached is
    written to the shared folder; it ends when nothing new is reached, or at depth `most` where one is given. Unreached
    pages give no row; nulls reach nothing.
    """
    seen = shared_table(seeds.where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "depth-0")
    front = seen
    e = shared_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("site_id", F.col("src").alias("url"), "dst").distinct(), "depth-edges")
    d = 0
    while most is None or d < most:
        d += 1
        new = e.join(front.select("site_id", "url"), ["site_id", "url"], "left_semi").select("site_id", F.col("dst").alias("url")).distinct()
        front = shared_table(new.join(seen.select("site_id", "url"), ["site_id", "url"], "left_anti").withColumn("depth", F.lit(d)), f"depth-{d}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if d % 16 == 0:  # a long chain of pages must not make a long plan
            seen = shared_table(seen, f"depth-seen-{d}")
    return seen
