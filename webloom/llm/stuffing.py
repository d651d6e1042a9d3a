"""Keyword-stuffed and link-list pages: block-wise compression ratio, normalised by length and language.

A page's lines are sentences or not; the lines of either kind, wherever they stand, make up its blocks. Every block is
compressed against a prior: the page's own link labels are the compressor's dictionary, and tokens in tag notation
are folded to that notation first, so that lists of labels and tags, which need not repeat themselves, are as
redundant to the compressor as repeated keywords. What ratio is usual for a block's length and language is counted
over all blocks of all pages; a block that shrinks far more than usual is extremely redundant, and low density of
sentence punctuation confirms it. Stuffed text that carries punctuation ("sentences" that only repeat keywords) cannot
be confirmed that way; there a low share of distinct words does it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_table

#: Redundancy (ratio over the usual ratio) from which a block is extreme: with and without sentence punctuation.
EXTREME_SENTENCES, EXTREME_LIST = 1.65, 1.2
#: Bytes a block must be smaller than usual when compressed: less can come about by chance (a word said twice).
EVIDENCE = 8
#: Marks of sentence ends per word below which a line is no sentence.
LOW_PUNCTUATION = 0.04
#: Share of distinct words below which redundant sentences count as stuffing.
DISTINCT = 0.4
#: Bytes after which a block is closed; the rest of its kind goes on in the next.
BLOCK_BYTES = 4096
#: Share of a page's words in stuffed blocks from which it is a case.
PAGE_SHARE = 0.5
#: Usual ratio before anything is counted: A + B * log2(bytes); it weighs as much as PRIOR_BLOCKS blocks.
A, B, PRIOR_BLOCKS = 0.40, 0.155, 30

_END = re.compile(r"[.!?…](?=[\"”»’)\]]*(?:\s|$))|[。！？।؟]")
_TOKEN = regex.compile(r"\p{Han}|[\p{Hiragana}\p{Katakana}\p{Thai}]{1,4}|[\p{L}\p{N}][\p{L}\p{N}\p{M}'’_:\-]*")
_PLAIN = re.compile(r"[a-z0-9][a-z0-9'_:\-]*")
_SPACED = re.compile(r"[^\W_][\w'’:\-]*")
#: Letters beyond Latin, Greek and Cyrillic on, and those of scripts without blanks.
_BEYOND = re.compile("[\u0370-\u1dff\u3040-\ud7ff]")
_UNSPACED = re.compile("[\u0e00-\u0fff\u1780-\u17ff\u3040-\ud7ff]")
# Notations of tags: #word, key:word, letters with a number, words joined by underscores.
_NOTATION = re.compile(r"(?<!\S)(?:#[\w\-]+|([a-z]{2,}:)[\w\-]+|[A-Za-z]{2,}-\d{3,}|\w+_\w+)(?![^\s,;|])")
# Frequent function words by which a block's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and a in to is for with was on that by from it at",
    "fr": "le la les de des du et est une un pour dans que il à qu en",
    "es": "el la los las de y que en una un para se con por no",
    "de": "der die das und ist ein eine mit von zu im den wer nicht aus am",
    "it": "il la di che e un una per con non del della sono",
    "pt": "o a os as de e que um uma para com não do da em",
    "nl": "de het een en van is in op te dat met voor niet",
}
_FW = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SCRIPTS = [
    (k, regex.compile(p))
    for k, p in (("cyrillic", r"\p{Cyrillic}"), ("kana", r"[\p{Hiragana}\p{Katakana}]"), ("han", r"\p{Han}"), ("arabic", r"\p{Arabic}"),
                 ("devanagari", r"\p{Devanagari}"), ("thai", r"\p{Thai}"), ("hangul", r"\p{Hangul}"))
]


def tokens(low: str) -> list[str]:
    """Words of a lower-cased text; in scripts without blanks, short pieces."""
    if low.isascii():
        return _PLAIN.findall(low)
    return _TOKEN.findall(low) if _UNSPACED.search(low) else _SPACED.findall(low)


def guess_language(text: str, ws: list[str]) -> str:
    if not text.isascii() and _BEYOND.search(text):
        letters = len(regex.findall(r"\p{L}", text)) or 1
        for k, p in _SCRIPTS:
            if len(p.findall(text)) > 0.3 * letters:
                return k
    best, most = "none", 0.05 * len(ws)
    count = Counter(ws)
    for k, fw in _FW.items():
        n = sum(count[w] for w in fw)
        if n > most:
            best, most = k, n
    return best


def blocks(text: str) -> list[tuple[bool, str]]:
    """(has sentence punctuation, text): the lines of either kind in their order, a block for every BLOCK_BYTES. A line
    is a sentence line if its marks per word reach LOW_PUNCTUATION. What stands between the lines of a kind does not
    part them, so spam that alternates with short sentences is still held together."""
    out: list[tuple[bool, str]] = []
    open_: dict[bool, list[str]] = {True: [], False: []}
    size = {True: 0, False: 0}
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        n = len(_TOKEN.findall(line)) if not line.isascii() and _UNSPACED.search(line) else len(line.split())
        kind = len(_END.findall(line)) >= LOW_PUNCTUATION * n
        for at in range(0, len(line), BLOCK_BYTES):
            piece = line[at : at + BLOCK_BYTES]
            if size[kind] and size[kind] + len(piece) > BLOCK_BYTES:
                out.append((kind, "\n".join(open_[kind])))
                open_[kind], size[kind] = [], 0
            open_[kind].append(piece)
            size[kind] += len(piece) + 1
    return out + [(k, "\n".join(ls)) for k, ls in open_.items() if ls]


def folded(block: str) -> str:
    """block with every tag as its notation only."""
    return _NOTATION.sub(lambda m: m.group(1) or ("#" if m.group()[0] == "#" else "_" if "_" in m.group() else "-"), block)


def packed(text: str, prior: bytes = b"") -> int:
    """Bytes of the compressed text, without header, with `prior` as the compressor's dictionary."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, prior) if prior else zlib.compressobj(6, zlib.DEFLATED, -15, 9)
    data = text.encode("utf-8", "surrogatepass")
    return len(z.compress(data)) + len(z.flush())


def features(text: str, names: list[str]) -> list[tuple]:
    """One tuple per block: (sentences, words, log2 bytes, ratio, language, distinct share)."""
    out = []
    parts = blocks(text)
    prior = "\n".join(dict.fromkeys(names)).lower().encode("utf-8", "surrogatepass")[-32768:] if any(not k for k, _ in parts) else b""
    for kind, b in parts:
        low = b.lower()
        ws = tokens(low)
        size = len(b.encode("utf-8", "surrogatepass"))
        small = packed(low) if kind else packed(folded(b).lower(), prior)
        out.append((kind, len(ws) or 1, math.log2(size), size / small, guess_language(b, ws), len(set(ws)) / (len(ws) or 1)))
    return out


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("sentences", pa.bool_()), ("words", pa.int64()), ("bits", pa.float64()), ("ratio", pa.float64()),
        ("lang", pa.string()), ("distinct_share", pa.float64()),
    ]
)


def block_features(page: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t, labels in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows.extend((i, *f) for f in features(t, [x for x in labels or () if x]))
            cols = list(zip(*rows)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    # Labels of links within the content; those of menus and footers name no content.
    labels = F.transform(F.filter("links", lambda x: F.coalesce(x["region"], F.lit("")).isin("main", "aside", "")), lambda x: x["text"])
    return (
        page.where("length(text_main) > 0 AND page_id IS NOT NULL")
        .select(F.col("page_id").cast("long"), F.col("text_main"), labels.alias("labels"))
        .mapInArrow(run, "page_id long, sentences boolean, words long, bits double, ratio double, lang string, distinct_share double")
    )


def stuffed_pages(page: DataFrame) -> DataFrame:
    """(page_id, stuffed_share) of pages whose words are for the greater part in stuffed blocks.

    Null, empty and blank texts are no cases; deliveries of a page count once (they have the same content, so any of
    them decides). Null links, labels and languages are handled; page.lang is not trusted and not read.
    """
    one = shared_table(block_features(page), "stuffing")
    # Half octaves of the length; a text in no recognised language is held against all that are. Lists are measured
    # against the same usual ratios as sentences: what is usual is said by running text.
    half = F.floor(2 * F.col("bits"))
    prior = F.lit(A) + F.lit(B) * (F.col("half") + 0.5) / 2
    known = one.where("sentences AND lang <> 'none'").withColumn("half", half)
    median = [F.percentile_approx("ratio", 0.5).alias("median"), F.count(F.lit(1)).alias("n")]
    usual = (
        known.groupBy("lang", "half").agg(*median)
        .unionByName(known.groupBy("half").agg(*median).withColumn("lang", F.lit("none")))
        .select(
            "lang", "half",
            ((F.col("n") * F.col("median") + PRIOR_BLOCKS * prior) / (F.col("n") + PRIOR_BLOCKS)).alias("usual"),
        )
    )
    # A row for each language and half octave: a bounded table.
    j = one.withColumn("half", half).join(F.broadcast(usual), ["lang", "half"], "left")
    red = F.col("ratio") / F.coalesce("usual", prior)
    size = F.pow(F.lit(2.0), "bits")
    saved = size / F.coalesce("usual", prior) - size / F.col("ratio")
    stuffed = (saved >= EVIDENCE) & F.when(
        F.col("sentences"), (red >= EXTREME_SENTENCES) & (F.col("distinct_share") < DISTINCT)
    ).otherwise(red >= EXTREME_LIST)
    per_page = j.groupBy("page_id").agg(
        (F.sum(F.when(stuffed, F.col("words")).otherwise(0)) / F.sum("words")).alias("stuffed_share")
    )
    return per_page.where(F.col("stuffed_share") >= PAGE_SHARE)
