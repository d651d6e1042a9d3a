"""Set similarity inside blocks: all pairs above a threshold, and first pairs below one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..runtime import shared_table


def prefix_join(rows: DataFrame, block: list[str], key: str, tokens: str, threshold: float) -> DataFrame:
    """(block..., a, b, similarity), a < b, for every pair of rows of a block whose token sets reach the threshold.

    Exact prefix filtering: two sets of similarity t or more share one of the first n - ceil(t * n) + 1 of their
    tokens in any fixed order. Tokens are ordered by how many rows of all blocks have them, rarest first, so frequent
    tokens (boilerplate of a template) hardly ever stand in a prefix and no posting list is long. Only prefixes are
    joined; candidates are then verified on the full sets. Empty sets and nulls match nothing. Keys are unique. The sets
    are hashed once and stored: they are read four times, and tokens cost more than their hashes.
    """
    base = rows.where(F.size(tokens) > 0).select(*block, F.col(key).alias("k"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("h"))
    base = shared_table(base, "sets")
    freq = base.select(F.explode("h").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    n = F.size("h")
    ranked = (
        base.select(*block, "k", n.alias("n"), F.explode("h").alias("t"))
        .join(freq, "t")
        .groupBy(*block, "k", "n")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("f", "t"))), F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")).alias("prefix"))
    )
    post = ranked.select(*block, "k", "n", F.explode("prefix").alias("p")).select(*block, "k", "n", F.col("p.t").alias("t"))
    x = post.select(*block, "t", F.col("k").alias("a"), F.col("n").alias("na"))
    y = post.select(*block, "t", F.col("k").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    met = x.join(y, [*block, "t"]).where(fits).select(*block, "a", "b").distinct()
    left = base.select(*block, F.col("k").alias("a"), F.col("h").alias("ha"))
    right = base.select(*block, F.col("k").alias("b"), F.col("h").alias("hb"))
    return (
        met.join(left, [*block, "a"]).join(right, [*block, "b"])
        .withColumn("similarity", jaccard(F.col("ha"), F.col("hb")))
        .where(F.col("similarity") >= threshold)
        .select(*block, "a", "b", "similarity")
    )


def first_unlike(rows: DataFrame, block: list[str], order: str, tokens: str, below: float, skip: Column | None = None, ahead: int = 4) -> DataFrame:
    """(block..., a, b, similarity): for every row the first later row of its block that is less similar than `below`.

    skip: a condition on columns n_a and n_b (see extra columns) under which a pair isn't looked at. Most rows differ
    from their next few; these are compared by a window over the next `ahead` rows. Only rows that are alike to all of
    them meet the rest of their block. rows needs a column `n`; order is unique in a block.
    """
    skip = F.lit(False) if skip is None else skip
    w = Window.partitionBy(*block).orderBy(order)
    near = rows.select(*block, F.col(order).alias("a"), F.col(tokens).alias("ta"), F.col("n").alias("n_a"), F.row_number().over(w).alias("pos"))
    near = near.withColumn("next", F.collect_list(F.struct(F.col("a").alias("b"), F.col("ta").alias("tb"), F.col("n_a").alias("n_b"))).over(
        Window.partitionBy(*block).orderBy("a").rowsBetween(1, ahead)
    )).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*block)))
    tried = near.select(*block, "a", "ta", "n_a", "pos", "size", F.posexplode_outer("next").alias("i", "x")).select(
        *block, "a", "ta", "n_a", "pos", "size", "i", F.col("x.b").alias("b"), F.col("x.tb").alias("tb"), F.col("x.n_b").alias("n_b")
    )
    tried = tried.withColumn("similarity", jaccard(F.col("ta"), F.col("tb")))
    hit = F.col("b").isNotNull() & ~skip & (F.col("similarity") < below)
    best = tried.groupBy(*block, "a", "pos", "size").agg(F.min(F.when(hit, F.struct("i", "b", "similarity"))).alias("m"))
    found = best.where("m IS NOT NULL").select(*block, "a", "m.b", "m.similarity")
    rest = best.where(F.col("m").isNull() & (F.col("pos") + ahead < F.col("size"))).select(*block, "a", "pos")
    left = rest.join(near.select(*block, "a", "ta", "n_a"), [*block, "a"])
    right = near.select(*block, F.col("a").alias("b"), F.col("ta").alias("tb"), F.col("n_a").alias("n_b"), F.col("pos").alias("at"))
    far = left.join(right, block).where((F.col("at") > F.col("pos") + ahead) & ~skip).withColumn("similarity", jaccard(F.col("ta"), F.col("tb")))
    far = far.where(F.col("similarity") < below).groupBy(*block, "a").agg(F.min(F.struct("at", "b", "similarity")).alias("m")).select(*block, "a", "m.b", "m.similarity")
    return found.unionByName(far)
