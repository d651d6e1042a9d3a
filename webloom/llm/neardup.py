"""Near-duplicate records by meet-in-the-middle ball hashing of minhash fingerprints.

A fingerprint is a word of SYMBOLS minhash symbols. Two fingerprints that agree in at least KEEP positions lie within
the radius 2 * (SYMBOLS - KEEP) of each other when deletions and insertions are counted. Every fingerprint emits its
ball of half that radius in the direction of deletions: all its variants with SYMBOLS - KEEP symbols deleted. Two
fingerprints within the radius share a variant: they meet in the middle, and an equi-join on variants finds them
without any pairwise comparison. Colliding pairs are made distinct, dropped where a longer sketch of the fingerprint
shows them to lie far below the threshold, and verified on the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import one_delivery, shared_table

#: Words in a row that make a shingle, least similarity (Jaccard) of a pair, least words of a text.
WORDS, SIMILARITY, MIN_WORDS = 6, 0.6, 40
#: Symbols of a fingerprint and symbols a variant keeps. A pair of similarity s is found with the probability that at
#: least KEEP of SYMBOLS agree: 0.988 at s = 0.6, 0.998 at 0.7, 0.9999 at 0.8 (120 variants a record).
SYMBOLS, KEEP = 10, 3
#: Further minhash symbols of four bits that are kept with a fingerprint, and by how many standard deviations a pair
#: may agree in fewer of them than is expected at the threshold: one pair in 30,000 at the threshold is beyond that.
SKETCH, DEVIATIONS = 128, 4.0

_WORD = re.compile(r"[a-z0-9][a-z0-9'\-]*")
_SEEDS = np.array([xxhash.xxh64_intdigest(b"symbol", i) for i in range(SYMBOLS)], np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(b"sketch", i) | 1 for i in range(SKETCH)], np.uint64)[:, None]
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ws: list[str], cache: dict[str, int], n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's n-word sequences."""
    if len(cache) > 500_000:
        cache.clear()
    ids = []
    for w in ws:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w.encode())
        ids.append(h)
    a = np.array(ids, np.uint64)
    m = len(a) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : i + m]
    return np.unique(_mix(h))


def sketch(h: np.ndarray) -> list[int]:
    """SKETCH symbols of four bits, sixteen in a word; two sketches are compared by exclusive or and counting."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):  # long texts in pieces: the product has a row for each symbol
        np.minimum(low, (h[at : at + 4096][None, :] * _ODD).min(axis=1), out=low)
    nibbles = ((low >> np.uint64(7)) & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def least_agreement(similarity: float) -> int:
    """Sketch symbols in which a pair at the threshold agrees but for DEVIATIONS standard deviations."""
    p = similarity + (1 - similarity) / 16
    return int(SKETCH * p - DEVIATIONS * (SKETCH * p * (1 - p)) ** 0.5)


def agreement(a: Column, b: Column) -> Column:
    """Symbols in which two sketches agree."""

    def differing(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(SKETCH) - sum((differing(i) for i in range(1, SKETCH // 16)), differing(0))


def fingerprints(records: DataFrame, key: str, text: str, min_words: int = MIN_WORDS, n: int = WORDS) -> DataFrame:
    """(id, copy, size, symbols, sketch): hash of the word sequence (equal for copies), number of shingles, fingerprint.

    Null texts and texts with fewer than min_words words (min_words >= n) give no row.
    """
    longs = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("copy", pa.binary()), ("size", pa.int32()), ("symbols", longs), ("sketch", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        with np.errstate(over="ignore"):
            for b in batches:
                ids, copies, sizes, symbols, sketches = [], [], [], [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ws = words(t)
                    if len(ws) < min_words:
                        continue
                    h = shingle_hashes(ws, cache, n)
                    ids.append(i)
                    copies.append(xxhash.xxh128_digest(" ".join(ws)))
                    sizes.append(len(h))
                    symbols.append(np.array([_mix(h ^ s).min() for s in _SEEDS], np.uint64).view(np.int64).tolist())
                    sketches.append(sketch(h))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(copies, pa.binary()), pa.array(sizes, pa.int32()),
                        pa.array(symbols, longs), pa.array(sketches, longs),
                    ],
                    schema=schema,
                )

    return (
        records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        .where("length(text) > 0 AND id IS NOT NULL")
        .mapInArrow(run, "id long, copy binary, size int, symbols array<long>, sketch array<long>")
    )


def variants(fp: DataFrame, symbols: int = SYMBOLS, keep: int = KEEP) -> DataFrame:
    """(v, id, size): each fingerprint's ball of half the radius, as hashes of (positions kept, their symbols)."""
    kept = [F.xxhash64(F.lit(n), *[F.col("symbols")[i] for i in c]) for n, c in enumerate(combinations(range(symbols), keep))]
    return fp.select("id", "size", F.explode(F.array(*kept)).alias("v"))


def candidates(fp: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: pairs that share a variant, whose sizes allow the similarity and whose sketches do not rule it out.

    The join is on the variant only; a variant that very many records share is split by the adaptive skew join.
    Sketches are joined to distinct pairs, so a variant stays three numbers wide.
    """
    x = variants(fp).select("v", F.col("id").alias("a"), F.col("size").alias("na"))
    y = variants(fp).select("v", F.col("id").alias("b"), F.col("size").alias("nb"))
    fits = (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    met = x.join(y.hint("merge"), "v").where(fits).select("a", "b").distinct()
    left, right = (fp.select(F.col("id").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    near = agreement(F.col("sa"), F.col("sb")) >= least_agreement(similarity)
    return met.join(left, "a").join(right, "b").where(near).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, n: int = WORDS) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the similarity, computed exactly on the word sequences.

    texts: (id, text). Texts are merged, never broadcast: the optimizer would judge them by their compressed size.
    Pairs are sorted by a within partitions, so a text of many pairs is cut into words once.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set] = {}

        def grams(i: int, t: str) -> set:
            s = sets.get(i)
            if s is None:
                if len(sets) > 2000:
                    sets.clear()
                ws = words(t)
                s = sets[i] = set(zip(*[ws[k:] for k in range(n)]))
            return s

        for b in batches:
            rows = []
            for a, c, ta, tc in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = grams(a, ta), grams(c, tc)
                both = len(x & y)
                j = both / (len(x) + len(y) - both) if x or y else 1.0
                if j >= similarity:
                    rows.append((a, c, j))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema
            )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return (
        pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb").sortWithinPartitions("a")
        .mapInArrow(run, "a long, b long, jaccard double")
    )


def near_duplicates(page: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, jaccard) between representatives of different texts, and for every page its
    representative (id, rep): the lowest id with the same word sequence.

    Exact copies are collapsed before anything is compared, so a text with a third of all pages costs one comparison
    per neighbour. Deliveries of a page count once. Pages with null or short texts are in neither table.
    """
    one = one_delivery(page.select("page_id", "text_main"), "page_id", "text_main")
    fp = shared_table(fingerprints(one, "page_id", "text_main", min_words), "neardup-fp")
    reps = fp.groupBy("copy").agg(F.min("id").alias("rep"))
    members = fp.select("id", "copy").join(reps, "copy").select("id", "rep")
    first = fp.groupBy("copy").agg(F.min(F.struct("id", "size", "symbols", "sketch")).alias("r")).select("r.*")
    pairs = shared_table(candidates(first, similarity), "neardup-pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    raw = page.select(F.col("page_id").alias("id"), F.col("text_main").alias("text")).where("text IS NOT NULL")
    texts = raw.join(ends, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    return verify(pairs, texts, similarity), members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of pages (page_id_a < page_id_b): links between representatives carried over to their copies, and
    pairs of copies of one text."""
    m = members.select(F.col("id"), F.col("rep"))
    left = m.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    right = m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b")).distinct()
