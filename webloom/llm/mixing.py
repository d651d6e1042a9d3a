"""Mixing sources to target weights: weighted sampling without replacement to token budgets, epochs first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shared_table

#: File of a public tokenizer (tiktoken ranks); read by every worker, never copied.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slices a range of keys is cut into; only the slice in which the budget ends is looked at further, and it is cut
#: again until it holds at most SORTED records, which are then sorted. A power of two, so that borders are exact.
SLICES, SORTED = 256, 200_000
#: Characters handed to the tokenizer at once. Longer texts are counted piece by piece, cut at a blank before a word,
#: where this tokenizer's pre-split always has a border, so the count is the same.
PIECE = 100_000

# Fixed value: the pre-split pattern of this byte-level BPE.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)


def normal_source(c: Column | str) -> Column:
    """A source's name without differences of case, blanks and joiners."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[^\p{L}\p{N}]+", "_")


def _encoder(vocab: str):
    import base64

    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict = {}


def n_tokens(text: str, enc) -> int:
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total = at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # A border between a letter and a blank that a letter follows.
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, vocab: str = VOCAB) -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, source, tokens, quality), one narrow stage.

    quality, the weight in sampling, lies in (0, 1]: the share of letters among the text's characters other than
    blanks, times the share of lines that do not repeat an earlier line of the text.
    """
    ddl = "doc_id long, source string, tokens long, quality double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(vocab) or _ENCODERS.setdefault(vocab, _encoder(vocab))
        for b in batches:
            texts = b.column(2).to_pylist()
            counts, weight = [], []
            for t in texts:
                counts.append(n_tokens(t, enc))
                dense = "".join(t.split())
                lines = [x for x in t.split("\n") if x]
                letters = sum(map(str.isalpha, dense)) / max(1, len(dense))
                weight.append(max(0.01, letters * len(set(lines)) / max(1, len(lines))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(weight, pa.float64())],
                names=["doc_id", "source", "tokens", "quality"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("length(text) > 0").mapInArrow(run, ddl)


def sampling_key(seed: int, weight: Column | str = "quality", key: str = "doc_id") -> Column:
    """Exponential key with rate `weight`: in ascending order this is Efraimidis-Spirakis sampling without
    replacement. It depends on seed and id only, so a task run again draws the same."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11)
    u = (h.cast("double") + 1.0) / float(2**53 + 1)
    return -F.log(u) / (F.col(weight) if isinstance(weight, str) else weight)


def plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source of targets: budget, complete epochs and the rest to draw, from tokens per source.

    Without total_tokens the mix is the largest one in which every source keeps its share within its repeats. Sources
    without tokens (or with no share) can give nothing; the others keep their shares of what is left. Both inputs are
    a row per source; targets is a fixed table.
    """
    have = counted.groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.count(F.lit(1)).alias("docs_available"))
    t = targets.select(
        normal_source("source").alias("source"),
        F.col("target_share").cast("double").alias("target_share"),
        F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats"),
    ).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(F.broadcast(have), "source", "left").withColumns(
        {
            "tokens_available": F.coalesce("tokens_available", F.lit(0)),
            "docs_available": F.coalesce("docs_available", F.lit(0)),
        }
    )
    can = F.col("tokens_available") * F.col("max_repeats")
    usable = (can > 0) & (F.col("target_share") > 0)
    every = Window.partitionBy()  # a row per source: a fixed, small number
    j = j.withColumn("live", F.sum(F.when(usable, F.col("target_share"))).over(every))
    j = j.withColumn("share", F.when(usable, F.col("target_share") / F.col("live")).otherwise(F.lit(0.0)))
    most = F.min(F.when(usable, can / F.col("share"))).over(every)
    total = F.least(most, F.lit(float(total_tokens))) if total_tokens is not None else most
    budget = F.coalesce(F.col("share") * F.col("total"), F.lit(0.0))
    avail = F.greatest(F.col("tokens_available"), F.lit(1))
    return (
        j.withColumn("total", total)
        .withColumn("budget", budget)
        .withColumn("epochs", F.least(F.floor(F.col("budget") / avail + 1e-9), F.col("max_repeats").cast("long")))
        .withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens_available"), F.lit(0.0)))
        .withColumn("rest", F.when(F.col("epochs") >= F.col("max_repeats"), F.lit(0.0)).otherwise(F.col("rest")))
        .select("source", "target_share", "max_repeats", "tokens_available", "docs_available", "budget", "epochs", "rest")
    )


def border(keyed: DataFrame, rest: dict[str, float], slices: int = SLICES, most: int = SORTED) -> list[tuple[str, float, float, int]]:
    """(source, from, to, tokens before) of the range of positions in which each source's rest ends, at most `most`
    records wide where positions differ.

    keyed: (source, at, tokens), at: position in [0, 1). Each round sums the tokens of `slices` slices of every open
    range; what comes to the driver is one row per source (a row per source of the targets, a fixed table).
    """
    spark = keyed.sparkSession
    done: list[tuple[str, float, float, int]] = []
    open_ = [(s, 0.0, 1.0, 0, r) for s, r in rest.items() if r > 0]
    ddl = "source string, lo double, hi double, base long, rest double"
    while open_:
        now = F.broadcast(spark.createDataFrame(open_, ddl))
        at = F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo")) * slices)
        inside = keyed.join(now, "source").where("at >= lo AND at < hi").groupBy("source", "lo", "hi", "base", "rest", at.alias("slice"))
        sums = inside.agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("records"))
        w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("base") + F.sum("n").over(w)).where("upto > rest")
        first = sums.groupBy("source", "lo", "hi", "rest").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"), "records"), "slice").alias("f"))
        left = {s: (lo, hi, base, r) for s, lo, hi, base, r in open_}
        open_ = []
        for x in first.collect():
            lo, hi, _, r = left.pop(x.source)
            step = (hi - lo) / slices
            a, b = lo + x.f.slice * step, lo + (x.f.slice + 1) * step
            if x.f.records <= most or not lo < b < hi or step < 1e-13:
                done.append((x.source, a, b, x.f.before))
            else:
                open_.append((x.source, a, b, x.f.before, r))
        # A source whose records all fit has no border.
    return done


def select(counted: DataFrame, planned: DataFrame, seed: int = 0, slices: int = SLICES, most: int = SORTED) -> DataFrame:
    """(doc_id, source, tokens, times) of every record used: complete epochs, then the records with the lowest keys
    as long as their running sum of tokens stays within the rest.

    The running sum is taken from coarse to fine: sums by slice of the key range, then by slice of the slice in which
    the budget ends, until few records are left to be sorted; no source is sorted as a whole, whatever its size. Ties
    of keys are ordered by doc_id.
    """
    # A monotone map of (0, inf) to [0, 1), finer where the keys are.
    keyed = counted.withColumn("key", sampling_key(seed)).withColumn("at", F.least(1 - F.exp(-F.col("key") / 2), F.lit(1 - 2.0**-53)))
    rest = {r.source: r.rest for r in planned.select("source", "rest").collect()}  # a row per source of the targets
    ends = border(keyed.select("source", "at", "tokens"), rest, slices, most)
    at = counted.sparkSession.createDataFrame(ends, "source string, lo double, hi double, before long")
    keyed = keyed.join(F.broadcast(planned.select("source", "epochs", "rest")), "source").join(F.broadcast(at), "source", "left")
    run = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.coalesce((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), F.lit(False))
    inside = keyed.where(edge).withColumn("upto", F.col("before") + F.sum("tokens").over(run))
    inside = inside.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int"))
    whole = F.col("lo").isNull() | (F.col("at") < F.col("lo"))
    clear = keyed.where(~edge).withColumn("extra", (whole & (F.col("rest") > 0)).cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("times")]
    return clear.select(*cols).unionByName(inside.select(*cols)).where("times > 0")


def mix(docs: DataFrame, targets: DataFrame, vocab: str = VOCAB, seed: int = 0, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mix of docs (doc_id, text, source) by targets (source, target_share, max_repeats).

    Sources are compared without case, stray blanks and joiners; a null source and sources without target are left
    out, null and empty texts have no tokens. report, one row per source of targets: tokens_available, repeats_used
    (the most times one of its records is used), tokens_taken, actual_share. Where target_share shares a budget with
    whole records, the actual share stays below by less than one record.
    """
    wanted = targets.select(normal_source("source").alias("source")).distinct()
    own = docs.select("doc_id", normal_source("source").alias("source"), "text").join(F.broadcast(wanted), "source", "left_semi")
    counted = shared_table(token_counts(own, vocab), "mix-tokens")
    planned = shared_table(plan(counted, targets, total_tokens).coalesce(1), "mix-plan")
    chosen = select(counted, planned, seed)
    taken = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("times")).alias("tokens_taken"),
        F.max("times").alias("repeats_used"),
        F.sum("times").alias("records_taken"),
    )
    zero = F.lit(0).cast("long")
    report = planned.join(F.broadcast(taken), "source", "left").select(
        "source", "target_share", "max_repeats", "docs_available", "tokens_available",
        F.coalesce("repeats_used", zero).alias("repeats_used"),
        F.coalesce("records_taken", zero).alias("records_taken"),
        F.coalesce("tokens_taken", zero).alias("tokens_taken"),
    )
    whole = F.sum("tokens_taken").over(Window.partitionBy())
    report = report.withColumn(
        "actual_share", F.when(whole > 0, F.round(F.col("tokens_taken") / whole, 6)).otherwise(F.lit(0.0))
    )
    return chosen, report
