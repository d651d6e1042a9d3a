"""Sentence boundaries across languages and scripts: semi-Markov dynamic programming over whole spans.

A text is cut into units at blank lines. In a unit, every place where a sentence might end (a closing mark with the
quotation marks and brackets that follow it, or in scripts without periods a blank between letters) is a candidate.
The program then picks the sequence of spans with the highest total score. A span is scored as a whole: on its length,
on the kind of its opening word, on what its closing word, mark and the word after say (lists of abbreviations are
features of the closing word only), and on quotations and brackets it cuts through. The weights of these are fitted on
the labelled units below, by a structured perceptron with a margin; none of them is decided by a single feature.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs below which a span is hardly a sentence, and from which it is over long.
LEAST_SPAN, LONG_SPAN = 3, 400
#: Score up to which a candidate is none.
IMPOSSIBLE = -4.0

# Words before a period that is part of them. TITLE never ends a sentence, NUMBERED not before a figure,
# OTHER not before a word in lower case.
TITLE = frozenset(
    "dr mr mrs ms prof rev hon gen col capt lt sgt st sen gov pres messrs mme mlle mgr me hr fr frl herr ing dipl sr sra srta dra "
    "d dña lic sig sig.ra dott prof.ssa avv г гг гр проф акад им ул тов д-р г-н г-жа د أ م डॉ श्री पं प्रो สมช ดร".split()
)
NUMBERED = frozenset(
    "no nr nos fig figs p pp pg pág págs núm nº art sec ch chap vol ext tel approx aprox ca env vs jan feb mar apr jun jul aug "
    "sep sept oct nov dec bd kap abb ziff abs s n rund circa cca стр рис гл см ок".split()
)
OTHER = frozenset(
    "etc usw usf bzw ggf evtl inkl zzgl z.b d.h u.a o.ä i.d.r e.g i.e cf viz al et inc corp co ltd llc bros dept est assn intl mfg "
    "approx a.m p.m u.s u.k u.n e.u misc ave blvd rd p.ej ej p.ex ex ss dcha izq т.д т.п т.е др пр шт руб коп тыс млн млрд кг напр "
    "min max incl excl resp".split()
)
MONTHS = frozenset(
    "january february march april may june july august september october november december januar februar märz april mai juni juli "
    "august september oktober november dezember janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre января февраля марта апреля мая июня "
    "июля августа сентября октября ноября декабря jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
#: Legal forms, which follow other abbreviations within one name.
FORMS = frozenset("inc corp co ltd llc plc gmbh bros sa srl ag".split())
# Verbs that report direct speech, and words by which a sentence goes on after a quotation.
SPEECH = frozenset(
    "said says asked asks shouted shouts wrote writes replied cried called whispered answered added told explained yelled "
    "sagte fragte rief schrieb antwortete dit demanda écrivit répondit cria dijo preguntó escribió respondió gritó".split()
)
GOES_ON = regex.compile(r"^(?:ثم|و(?=\p{L})|وقال|قال|और|तो|कहकर|ने|कहा|然后|并|就|后|说|道|地|的|と|って|という|は|を|が|に|などと)")

_BLANK_LINE = regex.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
_MARK = regex.compile(r"[.!?…‽。！？．｡।॥؟۔]+")
_WIDE = frozenset("。！？．｡।॥؟۔")
_CLOSE = "\"'”’»›)]}」』）】》〉“"
_OPEN_OF = {"”": "“„«", "“": "„", "’": "‘‚", "»": "«", "›": "‹", ")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "）": "（", "】": "【", "》": "《", "〉": "〈"}
_OPENERS = frozenset("“„«‹([{「『（【《〈¿¡‘‚")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’&.\-]*")
_LAST = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’\-.]*$")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])\s+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Arabic}\p{Devanagari}\p{Thai}\p{Hebrew}\p{Bengali}\p{Tamil}]")
_VOWEL = regex.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüãõœæаеёиоуыэюя]", regex.I)


def pairs(unit: str) -> dict[int, int]:
    """Matched quotation marks and brackets: position of the opening one -> position of the closing one.

    Marks without a partner are ignored. Straight quotation marks open after a blank or an opening mark and close
    elsewhere; apostrophes inside words are no quotation marks.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    at_of: dict[str, list[int]] = {}  # places in the stack of every kind of mark
    straight = False  # a straight quotation mark is open

    def push(c: str, i: int) -> None:
        at_of.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    def close(at: int, i: int) -> None:
        out[stack[at][1]] = i
        while len(stack) > at:
            at_of[stack.pop()[0]].pop()

    for i, c in enumerate(unit):
        if c == '"':
            if straight:
                close(at_of[c][-1], i)
                straight = False
            elif i == 0 or unit[i - 1].isspace() or unit[i - 1] in _OPENERS or unit[i - 1] in "-–—/:" or _CASELESS.match(unit[i - 1]):
                push(c, i)
                straight = True
        elif c in "„«‹([{「『（【《〈":
            push(c, i)
        elif c == "“":
            # Closes a German quotation, else opens an English one.
            if stack and stack[-1][0] == "„":
                close(len(stack) - 1, i)
            else:
                push(c, i)
        elif c in _OPEN_OF and c != "’":
            at = max((at_of[k][-1] for k in _OPEN_OF[c] if at_of.get(k)), default=None)
            if at is not None:
                close(at, i)
                straight = bool(at_of.get('"'))
    return out


class Unit:
    """One unit (no blank line inside): its candidates with what surrounds them."""

    def __init__(self, text: str):
        self.text = text
        found = pairs(text)
        self.inside = sorted(found.items())
        self.closer = {b: a for a, b in found.items()}

    def candidates(self) -> list[tuple[int, float, int]]:
        """(end, closing score, pairs cut) of the candidates inside the unit, its own end not included, in ascending
        order; pairs cut: matched quotation marks and brackets that are open there."""
        t = self.text
        n = len(t)
        got: dict[int, float] = {}
        for m in _MARK.finditer(t):
            end = m.end()
            closers = []
            while True:
                k = end
                while k < n and t[k] in "\xa0  " and k + 1 < n and t[k + 1] in "»":
                    k += 1  # a blank before a closing guillemet
                if k < n and k in self.closer and self.closer[k] < m.start():
                    closers.append(k)
                    end = k + 1
                else:
                    break
            if end >= n:
                continue
            got[end] = self.mark_score(m.start(), m.end(), end, closers)
        if _THAI_GAP.search(t):
            for m in _THAI_GAP.finditer(t):
                got.setdefault(m.start(), self.gap_score(m.start(), m.end()))
        out = []
        open_: list[int] = []  # closing places of the pairs open so far
        k = 0
        for e in sorted(got):
            while k < len(self.inside) and self.inside[k][0] < e:
                while open_ and open_[-1] < self.inside[k][0]:
                    open_.pop()
                open_.append(self.inside[k][1])
                k += 1
            while open_ and open_[-1] < e:
                open_.pop()
            out.append((e, got[e], len(open_)))
        return out

    def gap_score(self, a: int, b: int) -> float:
        """A blank between letters of a script that has no periods: it separates sentences, but for repetition and
        abbreviation signs."""
        return -2.0 if self.text[a - 1] in "ๆฯ" else 2.0

    def mark_score(self, a: int, b: int, end: int, closers: list[int]) -> float:
        """How much the surroundings of the mark t[a:b], closing at `end`, speak for a sentence end; above 0: for it."""
        t = self.text
        mark = t[a:b]
        rest = t[end : end + 80]
        body = rest.lstrip()
        gap = len(rest) != len(body) or not body
        first = body[:1]
        bare = body.lstrip("\"'“„«‹([{「『（【《〈‘‚¿¡-–—*• \xa0")
        nxt = _WORD.match(bare)
        word = nxt.group() if nxt else ""
        letter = bare[:1]
        caseless = bool(letter) and bool(_CASELESS.match(letter))
        upper = letter.isupper() or (letter.islower() and any(c.isupper() for c in word[1:]) and "." not in word)
        lower = letter.islower() and not upper
        wide = mark[-1] in _WIDE

        if closers:
            return self.closed_score(a, closers, word, upper, lower, caseless, gap, bare)
        if wide or (mark[-1] in "!?‽" and mark not in (".",)):
            if wide:
                return 3.0
            if not gap and not (upper or caseless or first in _OPENERS):
                return -4.0
            return 1.0 if lower else 3.0
        if mark in ("...", "…", "..", "....") or (len(mark) > 1 and set(mark) <= {".", "…"}):
            return -3.0 if lower or not body else 1.5
        # One period.
        if a == 0 or t[a - 1].isspace():
            return -6.0  # ".5", ". . ."
        prev = _LAST.search(t, max(0, a - 40), a)
        tok = prev.group() if prev else ""
        low = tok.lower().rstrip(".")
        tail = low.rsplit(".", 1)[-1]
        if not gap:
            if not (upper or caseless) or not letter:
                return -6.0
            # A missing blank: word.Word, but not U.S. or a.B or file.Name after figures
            if len(tail) < 2 or not tail.isalpha() or tail in TITLE or low in OTHER or (len(word) == 1 and bare[1:2] == "."):
                return -4.0 if not (tail.isdigit() and len(word) > 1) else 1.0
            return 2.0 if first == letter or first in _OPENERS else -1.0
        if tok.isdigit() or (tok and tok[-1].isdigit()):
            if a < 12 and not t[:a].rstrip("0123456789").strip():
                return -6.0  # "8. Heading": a number that opens its unit
            if len(tok) <= 2 and tok.isdigit() and word.lower().rstrip(".") in MONTHS:
                return -6.0
            return -3.0 if lower else 2.0
        if len(tail) == 1 and tail.isalpha():
            # Initials and abbreviations of single letters.
            if tok[-1:].isupper() and "." not in tok:
                return -6.0
            if "." in tok or low in OTHER:
                return -6.0 if lower or not (upper or caseless) else self.after_abbreviation(low, word)
            if low in NUMBERED and word[:1].isdigit():
                return -6.0
            if low in TITLE and not lower:
                # Russian "д." ends "и т. д.": a title only where no single letter stands before it.
                before = t[max(0, a - len(tok) - 12) : a - len(tok)].rstrip()
                if not (before.endswith(".") and len(before) > 1 and regex.search(r"(?<!\p{L})\p{L}\.$", before)):
                    return -6.0
            after = regex.match(r"\p{L}\.", bare)
            if after:
                return -6.0  # z. B., т. д.
            return -5.0 if lower else 1.0
        if low in TITLE or tail in TITLE:
            return -6.0
        if low in NUMBERED:
            if word[:1].isdigit():
                return -6.0
            return -4.0 if lower else (0.5 if low in OTHER or len(low) > 3 else -1.0)
        if low in OTHER or tail in OTHER or low in FORMS:
            return -5.0 if lower or word[:1].isdigit() else self.after_abbreviation(low, word)
        if lower:
            # An ordinary word before, a small letter after: writers who use no capitals.
            return 0.5 if len(low) > 2 and _VOWEL.search(low) and "." not in low else -4.0
        if word[:1].isdigit() or upper or caseless or first in _OPENERS or not word:
            return 2.5
        return 1.0

    def after_abbreviation(self, low: str, word: str) -> float:
        """An abbreviation may end a sentence; not where the next word is the rest of one name."""
        if word.lower().rstrip(".") in FORMS:
            return -5.0
        return 1.5

    def closed_score(self, a: int, closers: list[int], word: str, upper: bool, lower: bool, caseless: bool, gap: bool, bare: str) -> float:
        """The mark stands inside quotation marks or brackets that close right after it."""
        t = self.text
        last = closers[-1]
        opened = self.closer[last]
        before = t[max(0, opened - 40) : opened].rstrip()
        whole = not before or before[-1] in ".!?…。！？।؟" or (before[-1] in _CLOSE and len(before) > 1 and before[-2] in ".!?…。！？।؟")
        bracket = t[last] in ")]}）】"
        if lower:
            return -6.0
        if bracket:
            return 2.0 if whole else -2.0
        if caseless or not bare:
            if GOES_ON.match(bare):
                return -5.0
            return 3.0 if whole else 1.0
        if word[:1].isdigit():
            return 1.0 if gap else -2.0
        if whole and upper:
            # "Stop!" Anna shouted: the reporting clause goes on.
            ws = [w.group().lower() for w in _WORD.finditer(bare[:60])][:3]
            if any(w in SPEECH for w in ws[1:3]):
                return -5.0
        return 2.5 if upper or bare[:1] in _OPENERS else 0.5


def _opening(t: str, at: int) -> str:
    """Kind of the first word of a span."""
    m = _WORD.search(t, at, at + 40)
    if not m:
        return "open none"
    c = m.group()[0]
    if c.isupper() or t[at : at + 1] in "¿¡":
        return "open capital"
    return "open caseless" if _CASELESS.match(c) else "open figure" if c.isdigit() else "open small"


#: Features of a span besides the score of its closing word and mark, whose weight is 1.
FEATURES = ("short", "over long", "open none", "open capital", "open caseless", "open figure", "open small", "pairs cut", "spans")


def split_unit(t: str, weights: dict[str, float] | None = None, margin: dict[int, float] | None = None) -> list[int]:
    """Ends of the sentences of one unit (which has no blank around it): the best sequence of spans.

    weights: of FEATURES, the fitted ones by default. margin: what is added to the score of an end (for fitting).
    """
    w = fitted() if weights is None else weights
    unit = Unit(t)
    cand = [c for c in unit.candidates() if c[1] > IMPOSSIBLE]
    ends = [c[0] for c in cand] + [len(t)]
    cut = [c[2] for c in cand] + [0]
    more = (margin or {}).get
    close = [s + w["pairs cut"] * c + more(e, 0.0) for e, s, c in cand] + [0.0]
    starts = [0, *ends[:-1]]
    best = [0.0] * (len(ends) + 1)
    back = [0] * (len(ends) + 1)
    first: list[float] = []  # what is reached before a span from each start, and what its opening says
    near: deque[int] = deque()  # starts whose spans are of usual length, the best first
    far = -1  # the best start whose span is over long: there the length score falls alike for all
    per = w["over long"] / 100
    to_near = to_far = 0
    for j in range(1, len(ends) + 1):
        end = ends[j - 1]
        opened = w[_opening(t, starts[j - 1])] + w["spans"] + (w["pairs cut"] * cut[j - 2] if j > 1 else 0.0)
        first.append(best[j - 1] + opened)
        while to_near < j and end - starts[to_near] >= LEAST_SPAN:
            while near and first[near[-1]] <= first[to_near]:
                near.pop()
            near.append(to_near)
            to_near += 1
        while to_far < to_near and end - starts[to_far] > LONG_SPAN:
            if far < 0 or first[to_far] - per * starts[to_far] >= first[far] - per * starts[far]:
                far = to_far
            to_far += 1
        while near and near[0] < to_far:
            near.popleft()
        top, arg = -math.inf, j - 1
        for i in (*range(j - 1, to_near - 1, -1), *([near[0]] if near else ()), *([far] if far >= 0 else ())):
            n = end - starts[i]
            s = first[i] + close[j - 1] + (w["short"] if n < LEAST_SPAN else per * max(0, n - LONG_SPAN))
            if s > top:
                top, arg = s, i
        best[j], back[j] = top, arg
    out = []
    j = len(ends)
    while j:
        out.append(ends[j - 1])
        j = back[j]
    return out[::-1]


def span_features(t: str, ends: list[int]) -> dict[str, float]:
    """Sums of FEATURES over the spans that end at `ends`."""
    depth = {e: c for e, _, c in Unit(t).candidates()}
    out = dict.fromkeys(FEATURES, 0.0)
    for a, b in zip([0, *ends[:-1]], ends):
        out[_opening(t, a)] += 1
        out["spans"] += 1
        out["pairs cut"] += depth.get(a, 0) + depth.get(b, 0)
        out["short"] += b - a < LEAST_SPAN
        out["over long"] += max(0, b - a - LONG_SPAN) / 100
    return out


# Labelled units: sentences as they follow each other in one unit.
LABELLED = [
    ["Mrs. Alder came in at 9.15 a.m. and put the keys down.", "The yard opens at 6 p.m.", "Nobody waits."], ["It seemed done... but the lid was loose.", "Who did that?!", "Somebody."],
    ['The porter wrote "It fell. Twice. We saw it." and left.', "The press (see the plan. It is old. It is torn!) costs 9 crowns."], ['"Hold on!" Martha shouted from the loft.', '"It is late." Nobody moved.', "A. B. Cole lives in St. Ann Road."],
    ["He asked: 'Why now? Why here?'", "They went to Lund Bros. Ltd. and back.", "Version 3.1.4 came out in No. 7 of the paper."], ["we close at noon.", "everyone knows that.", "nothing helps, e.g. a lock."], ["It rose by .7 percent (it had been 1.2. It fell later.) in May.", "See Fig. 4 and pp. 9 to 12.", "Done."],
    ["Herr Dr. Kolb schrieb: „Das geht nicht. Bitte warten!“ und ging um 8 Uhr.", "Am 3. Mai kam der 2. Brief, z. B. von Frau Low.", "Gut so."], ["Die Kiste (Nr. 8. Sie ist leer.) steht im Hof.", "Wer war das?", "Niemand weiß es."],
    ["M. Roux a dit : « Ça tient. Merci ! » puis il est sorti.", "Le prix (voir p. 4. Il baisse.) reste bas.", "Quelle chance !"], ["La Sra. Gil dijo: «No cabe. Hay que ver.» y salió.", "¿Quién llamó?", "¡Nadie!", "Pesa 2.5 kg, aprox. como antes."],
    ["Il sig. Neri arrivò alle 7.30 e disse «Va bene. Andiamo.» poi partì.", "Chi parla?", "Nessuno."], ["O Sr. Dias perguntou: “Cabe? Não sei.” e saiu.", "Está pronto.", "Fim."], ["Dhr. Vos zei: “Het past. Echt waar!” en ging weg.", "Het is laat.", "Klaar."],
    ["Г-н Орлов сказал: «Не подходит. Проверьте!» и ушёл.", "В 2019 г. было тихо, т. е. пусто.", "Кто там?"], ["他说：“不行。请看。”然后走了。", "价格是3.5元。", "谁知道？"], ["「無理です。見てください。」と彼は言った。", "価格は高い。", "本当？"],
    ["قال: «لا يصلح. انظر!» ثم خرج.", "من هناك؟", "لا أحد."], ["उसने कहा: “नहीं। देखो।” और चला गया।", "कौन है?", "कोई नहीं।"], ["เขาไปตลาดเมื่อวาน", "ราคาแพงมาก", "ไม่มีใครรู้"],
    ["1. flour 2. eggs and ... well ... that is all.", "Stir it."], ["The end came late.It was dark.", "Nobody spoke."], ["[Note. It is short.]", "The rest follows (as ever).", "Ok."], ["Wait!", "No.", "Go (now)!"],
]
#: Rounds over the labelled units at most, step of an update, and margin by which a wrong end must lose.
ROUNDS, STEP, MARGIN = 30, 0.25, 1.0
#: Weights of length before anything is learned: of a span of a sign or two, and of every 100 signs beyond LONG_SPAN.
BEFORE = {"short": -1.0, "over long": -0.04}


def fit(labelled: list[list[str]] = LABELLED) -> dict[str, float]:
    """Weights of FEATURES: whenever the best spans (wrong ends favoured by MARGIN) are not the labelled ones, weights
    move from the former's features to the latter's."""
    w = dict.fromkeys(FEATURES, 0.0) | BEFORE
    units = []
    for parts in labelled:
        t, ends = "", []
        for x in parts:
            # A missing blank is part of a label as "late.It".
            t = f"{t} {x}" if t and not (_WIDE_END.search(t) and _CASELESS.match(x)) else t + x
            ends.append(len(t))
        for m in _GLUED.finditer(t):
            ends.append(m.end())
        units.append((t, sorted(ends)))
    for _ in range(ROUNDS):
        wrong = 0
        for t, gold in units:
            favour = {e: -MARGIN if e in gold else MARGIN for e, *_ in Unit(t).candidates()}
            got = split_unit(t, w, favour)
            if got != gold:
                wrong += 1
                good, bad = span_features(t, gold), span_features(t, got)
                for k in FEATURES:
                    w[k] += STEP * (good[k] - bad[k])
        if not wrong:
            break
    return w


_WIDE_END = regex.compile(r"[。！？][”」』]?$")
_GLUED = regex.compile(r"(?<=\p{Ll}{3})\.(?=\p{Lu}\p{Ll}+ )")
_FITTED: dict[str, float] = {}


def fitted() -> dict[str, float]:
    """The weights fitted on the labelled units; the same on every machine."""
    if not _FITTED:
        _FITTED.update(fit())
    return _FITTED


def sentence_ends(text: str) -> list[int]:
    """Positions (in code points, from the start of the text) just after each sentence's last character."""
    out = []
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        raw = text[at : m.start() if m else len(text)]
        unit = raw.strip()
        if unit:
            lead = at + len(raw) - len(raw.lstrip())
            for e in split_unit(unit):
                piece = unit[:e].rstrip()
                out.append(lead + len(piece))
        at = m.end() if m else len(text)
    return out


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end): the sentences of every document, in code points.

    A blank line always ends a unit, with or without a closing mark; a single line break does not. Text inside matched
    quotation marks or brackets is never split. Null, empty and blank texts give no rows; very long texts are handled
    unit by unit. lang is not read: it may be missing or wrong.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int32()), ("sent_start", pa.int32()), ("sent_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                last = 0
                for n, e in enumerate(sentence_ends(t)):
                    start = last + len(t[last:e]) - len(t[last:e].lstrip())
                    for c, v in zip(cols, (d, n, start, e)):
                        c.append(v)
                    last = e
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .where("length(text) > 0 AND doc_id IS NOT NULL")
        .mapInArrow(run, "doc_id long, sent_no int, sent_start int, sent_end int")
    )
