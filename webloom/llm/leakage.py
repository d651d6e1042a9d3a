"""Evaluation texts leaking into training text: matching statistics against a suffix automaton of the test items.

The automaton of all normalised items is built once on the driver and broadcast; its size is proven small (linear in
the items' words, and items beyond CHUNK_WORDS go to further automata). Training texts are streamed past it word by
word in narrow stages, one after the other for each automaton: no shuffle, no state between rows, any text length.
What several automata find is held on the words of the original text and united before anything is counted or cut, so
results do not depend on CHUNK_WORDS.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that must match in a row.
MIN_WORDS = 13
#: Share of a text's words inside leaked spans from which the whole text is to go.
MAX_COVERAGE = 0.5
#: Words of items in one automaton: at 670 bytes a word in memory (44 when it is sent), as measured
#: with few repeated words, this bounds it to about 100 MB.
CHUNK_WORDS = 150_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{Mn}+")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return _MARK.sub("", unicodedata.normalize("NFD", text.lower()))


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower case, without accents."""
    return _WORD.findall(fold(text))


class Automaton:
    """Suffix automaton over words of several items; a state knows the items its words occur in."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        nxt: list[dict[int, int]] = [{}]
        link, length, who = [-1], [0], [-1]
        last = 0
        for n, (_, text) in enumerate(items):
            # A symbol of its own ends each item, so that no match runs from one item into the next.
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)] + [-n - 1]
            for c in seq:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                who.append(n)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        twin = len(nxt)
                        nxt.append(dict(nxt[q]))
                        length.append(length[p] + 1)
                        link.append(link[q])
                        who.append(-1)
                        while p != -1 and nxt[p].get(c) == q:
                            nxt[p][c] = twin
                            p = link[p]
                        link[q] = link[cur] = twin
                last = cur
        self.nxt, self.link, self.length, self.min_words = nxt, link, length, min_words
        # For a state of min_words or more: the items that hold its words, and the next shorter such state that more
        # items hold (or -1). States with the same items share one tuple.
        order = sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True)
        held: dict[int, set[int]] = {}
        for s in order:
            if length[s] < min_words:
                break
            own = held.setdefault(s, set())
            if who[s] >= 0:
                own.add(who[s])
            if length[link[s]] >= min_words:
                held.setdefault(link[s], set()).update(own)
        same: dict[tuple, tuple] = {}
        self.items_at = {s: same.setdefault(t, t) for s, t in ((s, tuple(sorted(v))) for s, v in held.items())}
        self.wider: dict[int, int] = {}
        for s in reversed(order):
            if length[s] >= min_words:
                up = link[s]
                if length[up] < min_words:
                    self.wider[s] = -1
                else:
                    self.wider[s] = up if self.items_at[up] is not self.items_at[s] else self.wider[up]

    def scan(self, text: str) -> tuple[dict[int, int], list[tuple[int, int]], int]:
        """(item index -> longest match in words, leaked spans as word positions, words of the text)."""
        ws = words(text)
        get = self.vocab.get
        seq = [get(w, -1) for w in ws]
        need = self.min_words
        run = most = 0
        for c in seq:
            run = run + 1 if c >= 0 else 0
            if run > most:
                most = run
        if most < need:
            return {}, [], len(ws)
        nxt, link, length, items_at, wider = self.nxt, self.link, self.length, self.items_at, self.wider
        state = ln = 0
        best: dict[int, int] = {}
        spans: list[list[int]] = []
        for at, c in enumerate(seq):
            if c < 0:
                state = ln = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                ln = length[state]
            to = nxt[state].get(c)
            if to is None:
                state = ln = 0
                continue
            state, ln = to, ln + 1
            if ln >= need:
                if spans and at - ln + 1 <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], at - ln + 1)
                    spans[-1][1] = at + 1
                else:
                    spans.append([at - ln + 1, at + 1])
                at_state, n = state, ln
                while at_state >= 0:  # items of shorter matches that end here, too
                    for i in items_at[at_state]:
                        if n > best.get(i, 0):
                            best[i] = n
                    at_state = wider[at_state]
                    n = length[at_state]
        return best, [(a, b) for a, b in spans], len(ws)


def _chunks(items: DataFrame, item_id: str, item_text: str) -> list[list[tuple[int, str]]]:
    """The items in lists of at most CHUNK_WORDS words (one longer item is a list of its own). Items stream to the
    driver; they are the held-out set, whose size is fixed and does not grow with the corpus."""
    out: list[list[tuple[int, str]]] = [[]]
    room = CHUNK_WORDS
    rows = items.where(F.col(item_text).isNotNull()).select(item_id, item_text).distinct().orderBy(item_id, item_text)
    for i, text in rows.toLocalIterator():
        n = len(words(text))
        if n > room and out[-1]:
            out.append([])
            room = CHUNK_WORDS
        out[-1].append((i, text))
        room -= n
    return [c for c in out if c]


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, text string, words long, hits array<struct<item:bigint,longest:int>>, spans array<struct<a:int,b:int>>"
_HITS = pa.list_(pa.struct([("item", pa.int64()), ("longest", pa.int32())]))
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _found(docs: DataFrame, chunks: list[list[tuple[int, str]]], doc_id: str, text: str, min_words: int, only: bool) -> DataFrame:
    """(doc_id, text, words, hits, spans) of every document, or with `only` of those with a hit and without text. Each
    automaton adds what it finds on the words of the unchanged text; the last one unites the spans."""
    cur = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(0).cast("long").alias("words"),
        F.expr("cast(array() as array<struct<item:bigint,longest:int>>)").alias("hits"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("spans"),
    )
    for k, chunk in enumerate(chunks):
        sent = docs.sparkSession.sparkContext.broadcast(Automaton(chunk, min_words))
        last = k == len(chunks) - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for b in batches:
                ids, texts, total, hits, spans = (b.column(i).to_pylist() for i in range(5))
                for i, t in enumerate(texts):
                    best, more, total[i] = auto.scan(t or "")
                    if best:
                        hits[i] = hits[i] + [{"item": auto.ids[n], "longest": v} for n, v in best.items()]
                        own = [(s["a"], s["b"]) for s in spans[i]] + more
                        spans[i] = [{"a": x, "b": y} for x, y in unite(own)]
                keep = [i for i in range(len(ids)) if hits[i]] if last and only else range(len(ids))
                kept = [None] * len(keep) if last and only else texts
                pick = lambda c: [c[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pick(ids), pa.int64()), pa.array(kept, pa.string()), pa.array(pick(total), pa.int64()), pa.array(pick(hits), _HITS), pa.array(pick(spans), _SPANS)],
                    names=["doc_id", "text", "words", "hits", "spans"],
                )

        cur = cur.mapInArrow(run, _FOUND)
    return cur.where(F.size("hits") > 0) if only else cur


def _covered() -> Column:
    """Words inside spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "item_text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, coverage): documents that hold at least min_words consecutive words of an item.

    longest: words of the longest match with that item; coverage: share of the document's words inside spans that
    leaked from any item. Null and empty texts match nothing; repeated texts each give their rows; no items, no rows.
    A word longer or a text longer than usual makes no difference. An item id with several texts counts as one item.
    """
    own = docs.where((F.length(text) > 0) & F.col(doc_id).isNotNull())
    found = _found(own, _chunks(items, item_id, item_text), doc_id, text, min_words, True)
    rows = found.select("doc_id", (_covered() / F.col("words")).alias("coverage"), F.explode("hits").alias("h"))
    # One row for an item, whose texts may have been in several automata.
    return rows.select("doc_id", F.col("h.item").alias("item_id"), F.col("h.longest").alias("longest"), "coverage").groupBy("doc_id", "item_id", "coverage").agg(
        F.max("longest").alias("longest")
    ).select("doc_id", "item_id", "longest", "coverage")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS,
                  max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(doc_id, removed_words, coverage, dropped, clean): every document without its leaked spans.

    Spans of min_words or more are cut out; where they cover more than max_coverage of the words the document is
    dropped (clean is null). Documents without a leak come back as they are, null texts as ''. All spans are of the
    original text and cut at once.
    """
    found = _found(docs, _chunks(items, item_id, item_text), doc_id, text, min_words, False)
    j = found.withColumn("removed_words", _covered()).withColumn("coverage", F.col("removed_words") / F.greatest("words", F.lit(1)))
    ddl = "doc_id long, removed_words long, coverage double, dropped boolean, clean string"
    j = j.select("doc_id", "removed_words", "coverage", (F.col("coverage") > max_coverage).alias("dropped"), F.coalesce("text", F.lit("")).alias("clean"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(4).to_pylist()
            for i, (gone, spans) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist())):
                texts[i] = None if gone else cut(texts[i], [(s["a"], s["b"]) for s in spans]) if spans else texts[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string())], names=["doc_id", "removed_words", "coverage", "dropped", "clean"])

    return j.mapInArrow(run, ddl)


_RUN = regex.compile(r"[\p{L}\p{N}\p{Mn}]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, each span with the blanks and marks inside it."""
    at = [m.span() for m in _RUN.finditer(text) if words(m.group())]
    # A run may hold several words once its accents are gone; then positions are counted on the folded words.
    counts = [len(words(text[a:b])) for a, b in at]
    edges: list[tuple[int, int]] = []
    for (a, b), n in zip(at, counts):
        edges.extend([(a, b)] * n)
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : edges[s][0]])
        last = edges[e - 1][1]
    out.append(text[last:])
    return "".join(out)
