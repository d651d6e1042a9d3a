"""References to records that do not exist, told apart by the validity intervals of their parents.

References and parent keys are put in one stream, co-partitioned by key (and a slice of time) and sorted by time; one
linear pass over each sorted partition then knows at every reference how many parents are open. There is no join of
references with parents, so neither a key with a third of all references nor one with a third of all parents is ever
multiplied out. The stream of a key is cut into slices of time, and a slice with very many references into salted
parts, each with the slice's few parent steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import normalized_in_steps
from ..runtime import shared_table

#: Length of a slice of time in days. A hot key's stream is cut at slice borders; what is open at a border is
#: carried in as one row. Any length gives the same result.
SLICE_DAYS = 1
#: References of one key in one slice from which the slice is cut into parts of so many references. Any number gives
#: the same result. Such slices are at most one in PART references; up to HOT_SLICES of them are broadcast, more are
#: joined.
PART, HOT_SLICES = 200_000, 100_000


def _key(*cols: Column) -> Column:
    """128 bits that stand for the key; shorter than addresses, and no two keys of any feasible table share them."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in cols])))


def parent_intervals(pages: DataFrame) -> DataFrame:
    """(k, opened, closed): from when to when a page answers at an address of its site.

    One row for each page and distinct address (url, final_url). A page opens with its earliest delivery and closes
    with deleted_at; a page whose deletion is not after its opening is never on record.
    """
    one = pages.groupBy("page_id").agg(
        F.min("ingested_at").alias("opened"),
        F.min("deleted_at").alias("closed"),
        F.min(F.struct("site_id", "url", "final_url")).alias("p"),
    )
    named = normalized_in_steps(one.select("p.site_id", "opened", "closed", "p.url", "p.final_url"), url="url", final_url="final_url")
    return (
        named.select("site_id", F.explode(F.array_distinct(F.array("url", "final_url"))).alias("u"), "opened", "closed")
        .where((F.col("u") != "") & (F.col("closed").isNull() | (F.col("closed") > F.col("opened"))))
        .select(_key(F.col("site_id"), F.col("u")).alias("k"), "opened", "closed")
    )


def references(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(src, id, k, t) of every reference; tables: name -> (table, id, address, time). k is null for what is no address."""
    parts = [
        normalized_in_steps(df.select(F.lit(name).alias("src"), F.col(i).alias("id"), "site_id", F.col(u).alias("u"), F.col(t).alias("t")), u="u").select(
            "src", "id", F.when(F.col("u") != "", _key(F.col("site_id"), F.col("u"))).alias("k"), "t"
        )
        for name, (df, i, u, t) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _salted(rows: DataFrame, parts: DataFrame, one: bool) -> DataFrame:
    """rows (k, s, ...) with a salt: `one` of each hot slice's parts, or all of them."""
    j = rows.join(parts, ["k", "s"], "left")
    n = F.coalesce("parts", F.lit(1).cast("long"))
    salt = F.pmod(F.xxhash64("src", "id"), n) if one else F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return j.withColumn("salt", salt).drop("parts")


def classify(refs: DataFrame, parents: DataFrame, slice_days: int = SLICE_DAYS, part: int = PART) -> DataFrame:
    """refs with `state`: 'ok', or 'missing' (no parent is known at any time), 'deleted' (parents were there, none is
    left), 'late' (none yet, one comes later).

    refs: (src, id, k, t), parents: (k, opened, closed). A reference without a time can't be placed: its state is
    'missing' if no parent has its key, else 'ok' is not claimed and it is 'undated'. A null key is 'missing'. Repeated
    references stay. refs is read several times and should be a stored table.
    """
    lost = refs.where("k IS NULL").select("src", "id", "t", F.lit("missing").alias("state"))
    refs = refs.where("k IS NOT NULL")
    sl = lambda t: F.floor(F.unix_date(F.to_date(t)) / slice_days)
    opened = parents.select("k", F.col("opened").alias("t"), F.lit(1).alias("d"), F.lit(1).alias("o"))
    closed = parents.where(F.col("closed").isNotNull()).select(
        "k", F.col("closed").alias("t"), F.lit(-1).alias("d"), F.lit(0).alias("o")
    )
    # Steps of one key at one time are one row, however many parents share the address.
    steps = opened.unionByName(closed).groupBy("k", "t").agg(F.sum("d").alias("d"), F.sum("o").alias("o"))

    # What is open at the start of a slice: sums by slice, then a running sum by key over slices (at most one row a
    # day and key, never one a reference).
    wanted = refs.groupBy("k", sl(F.col("t")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    hot = wanted.where((F.col("n") > part) & F.col("s").isNotNull()).select("k", "s", F.ceil(F.col("n") / part).alias("parts"))
    n_hot = hot.limit(HOT_SLICES + 1).count()
    if 0 < n_hot <= HOT_SLICES:
        hot = F.broadcast(hot)
    by_slice = (
        steps.select("k", sl(F.col("t")).alias("s"), "d", "o")
        .unionByName(wanted.select("k", "s", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("o")))
        .groupBy("k", "s")
        .agg(F.sum("d").alias("d"), F.sum("o").alias("o"))
    )
    before = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("k")
    carried = by_slice.select(
        "k",
        "s",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"),
        F.coalesce(F.sum("o").over(before), F.lit(0)).alias("o"),
        F.sum("o").over(whole).alias("ever"),
    )

    none_t, none_s = F.lit(None).cast(refs.schema["t"].dataType), F.lit(None).cast("string")
    head = carried.select(
        "k", "s", none_t.alias("t"), F.lit(0).alias("kind"), "d", "o", "ever", none_s.alias("src"),
        F.lit(None).cast("long").alias("id"),
    )
    zero = F.lit(0).cast("long")
    mid = steps.select(
        "k", sl(F.col("t")).alias("s"), "t", F.lit(1).alias("kind"), "d", "o", zero.alias("ever"), none_s.alias("src"),
        F.lit(None).cast("long").alias("id"),
    )
    tail = refs.select(
        "k", sl(F.col("t")).alias("s"), "t", F.lit(2).alias("kind"), zero.alias("d"), zero.alias("o"),
        zero.alias("ever"), "src", "id",
    )
    if n_hot:
        # Steps and head of a hot slice go to each of its parts, a reference to one of them.
        stream = _salted(head.unionByName(mid), hot, False).unionByName(_salted(tail, hot, True))
    else:
        stream = head.unionByName(mid).unionByName(tail).withColumn("salt", F.lit(0).cast("long"))
    # The slice's head row has no time and sorts first; parents come before references of the same moment.
    run = (
        Window.partitionBy("k", "s", "salt")
        .orderBy(F.col("t").asc_nulls_first(), "kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        stream.select(
            "src", "id", "t", "kind",
            F.sum("d").over(run).alias("open"), F.sum("o").over(run).alias("seen"), F.sum("ever").over(run).alias("ever"),
        )
        .where("kind = 2")
        .select(
            "src", "id", "t",
            F.when(F.col("ever") == 0, "missing")
            .when(F.col("t").isNull(), "undated")
            .when(F.col("open") > 0, "ok")
            .when(F.col("seen") > 0, "deleted")
            .otherwise("late")
            .alias("state"),
        )
        .unionByName(lost)
    )


def orphan_references(page: DataFrame, link_edge: DataFrame, sitemap_entry: DataFrame, fetch_failure: DataFrame) -> DataFrame:
    """(ref_table, ref_id, t, state) of every reference of the three tables to a page not on record at its time.

    References repeated under one id count once. A null or unusable address equals no page's and is 'missing'; a
    reference without a time is left out, as its period is not defined. Empty tables give no rows.
    """
    refs = references(
        {
            "link_edge": (link_edge, "edge_id", "dst", "seen_at"),
            "sitemap_entry": (sitemap_entry, "entry_id", "loc", "seen_at"),
            "fetch_failure": (fetch_failure, "failure_id", "url", "failed_at"),
        }
    ).where(F.col("t").isNotNull() & F.col("id").isNotNull())
    found = classify(shared_table(refs, "references"), parent_intervals(page)).where("state <> 'ok'")
    return found.select(F.col("src").alias("ref_table"), F.col("id").alias("ref_id"), "t", "state").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    return (
        orphans.groupBy("ref_table", F.date_format("t", "yyyy-MM").alias("period"), "state")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )
