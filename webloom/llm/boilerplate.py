"""Page boilerplate mixed with main content: boosted trees over the nodes of a page, decoded along its hierarchy.

The nodes of a page are the lines (blocks) of its text, each mapped to the node of the captured document that holds it:
depth, tag, attribute tokens, what it stands in, density of text and links of the subtree it belongs to, and its
siblings. Where no document was captured, or a line is not in it, these features are missing and the line's own tokens,
place and neighbours are left. A classifier of gradient-boosted trees scores every node, whatever its length; decoding
along the hierarchy (page > container or zone between running text > line) then keeps an ancestor's choice and its
descendants' from contradicting each other: a zone that goes takes all its lines with it.

The classifier is fitted when it is asked for, on two bounded sets of labelled nodes: documents composed from labelled
exemplars (below), and at most TRAIN_PAGES pages of the data, whose text_chrome and navigation elements label their
lines as boilerplate and whose long paragraphs are labelled as body.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import one_delivery

from .boosting import BoostedTrees
from .residue import Index, is_residue, term_counts
from .stuffing import stuffed_pages

#: Bound of the labelled pages taken from the data, and number of documents composed from exemplars.
TRAIN_PAGES, COMPOSED_PAGES = 400, 2000
#: Trees of the classifier and their depth.
TREES, DEPTH = 100, 5
#: Weight of a zone's own evidence against its lines' in decoding, and score below which a line is sure to be running
#: text, which parts zones.
ZONE_WEIGHT, RUNNING = 0.1, -4.0
#: Words and sentence marks of a line that labels a sampled page's body (labels only: every line is scored).
PARAGRAPH_WORDS, PARAGRAPH_MARKS = 26, 2

# Labelled exemplars of what tokens a node carries, in several languages. Single words, lower case.
CUES: dict[str, str] = {
    "nav": "home start startseite accueil inicio início menu menü menú about us über uns nosotros propos products produkte produits productos "
    "prices preise tarifs precios news neuigkeiten aktuelles actualités noticias guides ratgeber conseils guías stores filialen shops "
    "magasins tiendas contact kontakt contacto search suche recherche buscar login log basket warenkorb panier cesta cart account konto "
    "compte cuenta help hilfe aide ayuda faq blog services categories current skip content top back next previous",
    "cookie": "cookie cookies store stores stored data",
    "consent": "consent privacy accept reject agree decline necessary statistics adverts manage settings preferences choose device "
    "partners tracking traceurs appareil données einwilligung zustimmen akzeptieren annehmen ablehnen auswählen gerät geräte statistik "
    "warenkorb speichern speichert einstellungen öffnen accepter refuser choisir choix gérer mesurer visites dépose aceptar rechazar configurar ajustes "
    "datos equipo medir visitas usamos nutzen utilisons necessary datenschutz cookies-richtlinie",
    "side": "related recommended popular trending read most may also like section share copy link print mail friend follow comment comments add report "
    "liked people newsletter letter sign subscribe e-mail email enter chat help ähnliche beliebt teilen drucken kommentar "
    "newsletter abonnieren partager imprimer articles liés abonnez compartir relacionados suscríbete más leído",
    "foot": "copyright rights reserved kept terms use conditions imprint impressum agb datenschutz versand delivery privacy legal mentions légales "
    "livraison données aviso privacidad envíos derechos guardados reservados droits gardés réservés rechte vorbehalten bleiben bei registered "
    "lane street road avenue straße platz rue calle open mon tue wed thu fri sat sun follow photos clips letters facebook instagram youtube "
    "linkedin twitter sitemap",
    "tag": "tags tag keywords keyword topics schlagwörter stichworte thema themen mots-clés étiquettes etiquetas palabras temas filed",
    "unit": "mm cm m km g kg mg ml l w kw v hz gb mb inch in ft oz lb % °c",
    "function": "the of and a in to is for with was on that by from it at le la les de des du et est une un pour dans que il el los las y en una "
    "se con por no der die das und ist ein eine mit von zu im den wer nicht aus am which when because since until although this its our their",
}
_BIT = {k: 1 << i for i, k in enumerate(CUES)}
_CUE: dict[str, int] = {}
for _k, _v in CUES.items():
    for _w in _v.split():
        _CUE[_w] = _CUE.get(_w, 0) | _BIT[_k]
_NAV, _COOKIE, _CONSENT, _SIDE, _FOOT, _TAGS, _UNIT, _FUNC = (
    _BIT[k] for k in ("nav", "cookie", "consent", "side", "foot", "tag", "unit", "function")
)
_LANGUAGES = frozenset("EN DE FR ES IT PT NL PL RU".split())

_END = re.compile(r"[.!?…](?=[\"”»’)\]]*(?:\s|$))|[。！？।؟]")
_STRIP = ".,;:!?()[]{}\"'“”„«»‘’…▾"
_CLEAN = str.maketrans({c: " " for c in ".,;:!?()[]{}\"“”„«»‘…▾"})
_BULLETS = frozenset("·•|»▾–—›→")
_SLASHES = frozenset(("/", ">"))
_STEP = re.compile(r"^\s*(?:step|schritt|étape|paso|\d+[.)])\s*\d*", re.I)
_LABEL = re.compile(r"^[^:]{2,28}:\s")

# --- Nodes of the captured document -------------------------------------------------------------------------------

# Elements by role, and tokens of class, id and role attributes that tell what an element is for.
_CHROME_TAGS = frozenset("nav aside footer header menu dialog form".split())
_BODY_TAGS = frozenset("main article section blockquote figure table".split())
_HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6 title".split())
_LEAF_TAGS = frozenset("li a td th dd dt option button label summary".split())
_SKIP_TAGS = frozenset("script style template svg head".split())
_VOID = frozenset("br img hr input meta link source track wbr area base col embed".split())
_INLINE = frozenset("a b i u em strong span small sup sub code abbr cite mark time font label".split())
_CHROME_TOKENS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs crumbs header footer foot sidebar side aside widget cookie cookies consent gdpr banner "
    "share social sharing related recommend recommended popular trending newsletter subscribe signup comment comments chat promo ad ads legal copyright toolbar topbar search".split()
)
_BODY_TOKENS = frozenset("content main article post entry body text story page".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_WS = re.compile(r"\s+")
DOM = 10
_NO_NODE = [-1.0] * DOM


class Node:
    """An element of a document: tag, depth, role of it and what it stands in (1 chrome, -1 body, 0 neither), attribute
    tokens, and what its subtree holds."""

    __slots__ = ("tag", "depth", "up", "role", "tokens", "blocks", "chars", "linked", "kids", "short")

    def __init__(self, tag: str, up: Node | None, tokens: int):
        self.tag, self.up, self.tokens = tag, up, tokens
        self.depth = up.depth + 1 if up else 0
        own = 1 if tag in _CHROME_TAGS else -1 if tag in _BODY_TAGS else 0
        self.role = own or (up.role if up else 0)
        self.blocks = self.chars = self.linked = self.kids = self.short = 0


def dom_blocks(body: str) -> list[tuple[str, Node]]:
    """(text, node) of the blocks of a document in order: an element's text with that of inline elements in it.

    Unclosed, stray and broken tags are handled; scripts, styles and comments hold no text.
    """
    out: list[tuple[str, Node]] = []
    at = Node("", None, 0)
    hold: list[str] = []
    skip = 0
    last = 0
    linked = 0

    def close_block() -> None:
        nonlocal linked
        text = _WS.sub(" ", html.unescape("".join(hold))).strip()
        hold.clear()
        if text:
            out.append((text, at))
            at.kids += 1
            at.short += len(text) < 60
            n = at
            while n is not None:
                n.blocks += 1
                n.chars += len(text)
                n.linked += min(linked, len(text))
                n = n.up
        linked = 0

    for m in _MARKUP.finditer(body):
        if not skip and m.start() > last:
            piece = body[last : m.start()]
            hold.append(piece)
            if at.tag == "a":
                linked += len(piece)
        last = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _SKIP_TAGS:
            skip = 0 if m.group(1) else 1
            continue
        if skip:
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                hold.append("\n" if tag == "br" else " ")
            continue
        if tag not in _INLINE:
            close_block()
        if m.group(1):
            n = at
            while n is not None and n.tag != tag:
                n = n.up
            if n is not None and n.up is not None:
                at = n.up
        else:
            bits = 0
            for a in _ATTRIBUTE.finditer(m.group(3) or ""):
                for t in _TOKEN.findall((a.group(1) or a.group(2) or a.group(3) or "").lower()):
                    bits |= (t in _CHROME_TOKENS) | (t in _BODY_TOKENS) << 1
            at = Node(tag, at, bits | (at.tokens & 1))
    if not skip:
        hold.append(body[last:])
    close_block()
    return out


def dom_features(node: Node, at: int, n: int) -> list[float]:
    """What the document shows of a node; at: its place among n blocks."""
    block = node
    while block.up is not None and block.up.up is not None and block.tag in _INLINE:
        block = block.up
    up = block.up or block
    kind = 3 if block.tag in _HEADING_TAGS else 2 if block.tag in _LEAF_TAGS else 1 if block.tag == "p" else 0
    return [
        1.0, float(block.depth), float(kind), float(block.role), float(node.tokens & 1), float(node.tokens >> 1 & 1), up.chars / (up.blocks or 1),
        up.linked / (up.chars or 1), float(min(up.blocks, 60)), at / (n or 1),
    ]


def line_nodes(lines: list[str], body: str | None) -> tuple[list[list[float]], list[int]]:
    """(document features, container) of every line: those of the first block with the line's text that no earlier line
    took. container: number of the chrome element it stands in, -1 for none."""
    if not body:
        return [_NO_NODE] * len(lines), [-1] * len(lines)
    blocks = dom_blocks(body)
    places: dict[str, list[int]] = {}
    for i in range(len(blocks) - 1, -1, -1):
        for piece in blocks[i][0].split("\n"):
            places.setdefault(piece, []).append(i)
    out, box, ids = [], [], {}
    for x in lines:
        own = places.get(_WS.sub(" ", x).strip())
        if not own:
            out.append(_NO_NODE)
            box.append(-1)
            continue
        i = own.pop() if len(own) > 1 else own[0]
        node = blocks[i][1]
        out.append(dom_features(node, i, len(blocks)))
        top = node
        while top is not None and top.tag not in _CHROME_TAGS:
            top = top.up
        box.append(-1 if top is None else ids.setdefault(id(top), len(ids)))
    return out, box


# --- Features of lines ---------------------------------------------------------------------------------------------

FEATURES = 44 + DOM


def line_features(line: str) -> list[float]:
    """What a node shows by itself; the first entries are reused for its siblings."""
    toks = line.split()
    n = len(toks) or 1
    bullets = sum(map(_BULLETS.__contains__, toks))
    slashes = sum(map(_SLASHES.__contains__, toks))
    ws = line.translate(_CLEAN).split()
    words = len(ws)
    low = line.translate(_CLEAN).lower().split()
    firsts = [w[0] for w in ws]
    caps = sum(map(str.isupper, firsts))
    digits = sum(map(str.isdigit, firsts))
    short = sum(len(w) <= 2 for w in ws)
    nav = consent = side = foot = unit = func = tags = cookie = 0
    for c in filter(None, map(_CUE.get, low)):
        nav += (c & _NAV) > 0
        cookie += (c & _COOKIE) > 0
        consent += (c & _CONSENT) > 0
        side += (c & _SIDE) > 0
        foot += (c & _FOOT) > 0
        unit += (c & _UNIT) > 0
        func += (c & _FUNC) > 0
    lead = 0
    for c in filter(None, map(_CUE.get, low[:4])):
        lead += (c & _SIDE) > 0
        tags += (c & _TAGS) > 0
    nav += sum(map(_LANGUAGES.__contains__, ws[-3:]))
    marks = len(_END.findall(line))
    w = words or 1
    start = line[:9].lower()
    sign = "©" in line or "(c)" in line or "(C)" in line or start == "copyright"
    return [
        min(n, 60), marks / w, (nav + consent + side + foot) / w, min(len(line), 400), marks, float(line.rstrip()[-1:] in ".!?…"),
        bullets / n, slashes / n, (line.count(",") + line.count(";")) / w, caps / w, digits / w, float(sign), func / w,
        nav / w, consent / w, side / w, foot / w, min(consent, 8), min(side, 8), min(foot, 8), unit / w, float(bool(_STEP.match(line))),
        float(bool(_LABEL.match(line))), float("  " in line), short / w, float("[" in line or "(" in line), bullets + slashes, lead, tags, min(cookie, 4),
    ]


def page_features(lines: list[str], links, chrome: frozenset[str], heads: frozenset[str], body: str | None = None, only: list[int] | None = None) -> tuple[np.ndarray, list[int]]:
    """(features, containers): a row per line in `only` (all by default) with its own features, its siblings', its place,
    its page's and its document's. links: (label, region) of the page's links."""
    wanted = range(len(lines)) if only is None else only
    n = len(lines)
    own = [line_features(x) for x in lines]
    dom, box = line_nodes(lines, body)
    labels = frozenset(w for x, _ in links for w in x.lower().split())
    outer = frozenset(w for x, r in links if r in ("nav", "footer", "aside", "header") for w in x.lower().split())
    rows = []
    for i in wanted:
        f = own[i]
        line = lines[i].lower()
        short = len(line) < 400
        toks = [t.strip(_STRIP) for t in line.split()] if short else []
        linked = sum(map(labels.__contains__, toks)) / (len(toks) or 1)
        region = sum(map(outer.__contains__, toks)) / (len(toks) or 1)
        set_i = frozenset(filter(None, toks))
        in_chrome = max((len(set_i & c) / len(set_i | c) for c in chrome), default=0.0) if set_i else 0.0
        prev = own[i - 1][:3] if i else [0.0, 0.0, 0.0]
        nxt = own[i + 1][:3] if i + 1 < n else [0.0, 0.0, 0.0]
        rows.append(
            f + prev + nxt + [min(i, 12), min(n - 1 - i, 12), i / n, linked, in_chrome, float(line.strip() in heads), float(min(n, 60)), region] + dom[i]
        )
    return np.array(rows, float).reshape(len(rows), FEATURES), box


def label_regions(links) -> list[tuple[str, str]]:
    return [(x["text"], x["region"] or "") for x in links or () if x and x["text"]]


def chrome_sets(text: str | None) -> frozenset[frozenset[str]]:
    return frozenset(
        frozenset(t.strip(_STRIP) for t in x.lower().split() if t.strip(_STRIP)) for x in (text or "").split("\n") if x.strip()
    )


# --- Labelled exemplars ------------------------------------------------------------------------------------------

_ITEMS = (
    "oak table|desk lamp|coffee grinder|rain jacket|bike pump|steel kettle|wool socks|garden chair|paint brush|travel mug|"
    "wall clock|tool box|yoga mat|bread knife|phone case|ski goggles|hand saw|tea pot|fish tank|door mat"
).split("|")
_NAMES = "Halford Lindmark Osterby Brennick Calloway Dunmere Ellstone Farrow Greyhurst Hollin".split()
_KINDS = "Tools Supplies Bakery Works Studio Market Clinic Trading House Group".split()
_PLACES = "Ashford Brookvale Carndale Easton Foxhill Glenport Harwick Kingsmere".split()
_MENUS = (
    "Home|About us|Products|Prices|News|Contact|Stores|Guides|Services|Blog|Help", "Start|Über uns|Produkte|Preise|Aktuelles|Kontakt|Filialen|Ratgeber",
    "Accueil|À propos|Produits|Tarifs|Actualités|Contact|Magasins|Conseils", "Inicio|Nosotros|Productos|Precios|Noticias|Contacto|Tiendas|Guías",
)
_EXTRA = "|Search|Log in|Basket|EN DE|Menu ▾|Cart (2)|My account".split("|")
_CONSENT_LINES = (
    "We use cookies to improve this website. Accept all cookies or open the settings.|Cookies help us to measure how our store is used. OK / Decline|"
    "Cookie settings: necessary, marketing, analytics. Save my choice and close|{name} values your privacy. You can accept, reject or manage cookies.|"
    "We and our {n} partners store and access data on your device. Agree or decline|By using this website you accept our cookie policy.|By staying on this site you agree to small files on your device.|"
    "Manage your privacy preferences|Necessary only / Statistics / Adverts / Accept all|Your consent: choose which partners may store data. Save and close|To run this shop, {name} and {n} partners keep data on your device. Agree / Reject|"
    "Wir nutzen Cookies für die Statistik. Alle akzeptieren oder Einstellungen öffnen.|{name} speichert kleine Dateien auf Ihrem Gerät. Annehmen oder ablehnen|"
    "Nous utilisons des cookies pour les statistiques. Tout accepter ou gérer vos choix.|Des traceurs sont déposés sur votre appareil par {name}. Refuser ou accepter|"
    "Usamos cookies para mejorar esta página. Aceptar o rechazar|Las cookies guardan datos en su equipo. Configurar ajustes, {name}|We keep small files on this device to count visits. By reading on you agree. You may reject them in the settings."
).split("|")
_SIDE_LINES = (
    "Customers also bought {list}|Related posts: {list}|Most read today: {list}|Most popular this month: {list}|More in this section: {list}|Also in this section {list}|You might also like {list}|See also: {list}|"
    "Related articles: {list}|Related products: {list}|Popular right now: {a} ! {b} ! {c}|Recommended for you {list}|Trending: {list}|This section: {list}|In the same section: {a}, {b}, {c}|You may like: {list}|Read next: {list}|Most viewed {list}|"
    "Share this article: Copy  Print  Mail|Share: Facebook  Twitter  Copy link|Share on Facebook  Twitter  Mail|Print this page · Mail it to a friend · Copy the link|{n} people like this · Comment · Share|{n} comments · Add yours · Report|Liked by {n} readers · Comment · Report|"
    "Subscribe to our newsletter and save {n}%. Enter your e-mail|Sign up for news and offers. Enter your e-mail|Get {n}% off your first order: sign up for the newsletter|Join our mailing list and get {n}% off. E-mail|Sign up for our letter. Enter e-mail|"
    "Questions? Chat with us now|Chat with us, we are here until {n}:00|Do you need help? Chat with our desk, open until {n}:00|Leave a comment|Write a comment · Report this|Ähnliche Artikel: {list}|Newsletter abonnieren und {n}% sparen|Partager cette page: Copier  Imprimer|"
    "Articles liés: {list}|Compartir esta página: Copiar  Imprimir|Más leído: {list}|Subscribe to our letter. Enter e-mail|Comments ({n}) · Report"
).split("|")
_FOOT_LINES = (
    "© 20{y} {name}. All rights reserved.|© 20{y} {name}, tous droits réservés|© 20{y} {name} – Alle Rechte vorbehalten|© 20{y} {name}, derechos reservados|© {name} 20{y}. Rights kept.|"
    "Copyright 20{y} by {name}, registered in {p}|Copyright © {name} – a company of {p}|(c) 20{y} {name} - legal notice|{name}, {n} High Street, {p}. Open Mon to Fri|{name}, {n} Mill Road, {p}. Open Tue to Sat|{name} · {n} Station Road · {p}|Hauptstraße {n}, {p}. Geöffnet Mon bis Sat, {name}|"
    "Terms  Privacy  Imprint|Terms of service · Privacy policy · Delivery|Privacy | Terms | Sitemap|Datenschutz AGB Impressum|AGB  Versand  Kontakt|Mentions légales | Livraison | Confidentialité|Données personnelles  Mentions légales|Aviso legal  Privacidad|Envíos · Aviso legal · Contacto|"
    "Follow us on Facebook Instagram YouTube|Follow us: Instagram  YouTube  LinkedIn|Follow: Photos  Clips|Our letters · Our photos · Follow us"
).split("|")
# Headings of one word.
_WORDS = "Kurbel Hocker Hobel Leiter Schaufel Kelle Échelle Tabouret Rabot Truelle Pelle Marteau Escalera Taburete Cepillo Paleta Martillo Scala Sgabello Pialla Ladder Stool Trowel Bellows Anvil Sieve".split()
_PROSE = (
    "The {a} from {p} was tested last spring because the old one leaked.|Each {a} ships with a spare handle and a short note.|Visitors compare the {a} with the {b} every autumn.|"
    "When the shop moved to {p}, orders for the {a} doubled within {n} weeks.|The guide explains how the museum in {p} stored its {a}.|Nobody noticed that the {b} was broken until May.|"
    "The baker told us that brass and cork age differently in the yard.|Der {a} aus {p} wurde im Mai geprüft und blieb robust.|Wer die Werkbank kauft, braucht Holz und etwas Geduld.|"
    "La lampe de {p} a été vérifiée en mai et reste solide.|On y trouve du bronze et du lin pour chaque presse.|La bomba de {p} se revisó en mayo y sigue firme.|El precio ronda las {n} coronas, casi menos que en {p}.|"
    "La doctora {p} guarda {n} piezas de haya en el taller.|M. {p} vend {n} lampes en cuivre à la foire.|Die Anleitung nennt Messing und Leinen nur am Rand."
).split("|")
_DECOYS = (
    "Store cookies and dry cakes beside the {a}, never in tin boxes, and check the lid each week.|When a shop asks for cookie consent twice, the {a} page loses readers, as one editor showed.|When a site asks for cookie consent twice, the search box loses its users, as one printer showed.|"
    "Not one reader noticed the consent box of the {a} page last winter.|Prices of the {a} rose by {n} crowns, and news of it spread.|Prices for a good {a} began at {n} crowns in {p}.|Prices for the {b} went up to {n} crowns, though few people complained.|The guide to prices says that a {a} costs {n} crowns.|Prices start low in {p}, where the {a} is made.|In {p} the prices for a {a} stay near {n} crowns.|Nobody noticed the contact form, and the news page was hidden.|"
    "The workshop opens Mon to Fri, and the {a} is shown after lunch.|The museum published a newsletter in May, and many readers asked for the next one.|"
    "Our privacy study followed {n} shops for two years and found that few people read the terms.|People who share a {a} with a friend often buy a second one.|"
    "The contact form on this site was broken in spring, so orders were lost.|The copyright of the drawings stayed with the {p} archive until 19{y}.|"
    "Readers liked the {a} most, and comments on it were kind.|The search box of the store was moved next to the basket, which helped.|A {a} needs rest: the strap was checked before the move.|"
    "The privacy notice of the {p} museum is two lines long, and people read it.|Store cookies and rusks next to the {a}, never in tin boxes.|"
    "Keep the cookies in the tin and the {a} on the shelf.|The cookie jar from {p} was mended twice, and the {a} once.|A shop that stores data on a device should say so, wrote the {p} paper.|Put the cookies beside the {a}, not under it.|Dry cakes and cookies keep for {n} days in a cool store.|"
    "Cookies, rusks and dry cakes keep best beside the {a}.|Never store cookies with onions, and lift the lid twice a week.|In the store of the museum lie {n} letters and a {a}.|"
    "Visits to the {a} page fell when the menu changed.|The settings of the {a} are easy to forget, so write them down."
).split("|")
_BODY_SHORT = (
    "Step {m} > turn the {a} > lift the lid|Step {m}: turn the {a}, then wait|{m}. Fold the {a}|Sizes: {m} mm / {n} mm / {k} mm|Width: {m} mm | {n} mm | {k} mm|Length: {m} cm | {n} cm|Handle: {n} mm, brass|Wheel: {n}.{m} mm, ash wood|"
    "Weight: {n} kg, {m} parts|Tagged: {list}|Tags: {a} | {b} | {c}|Tags for this text: {list}|Keywords: {list}|Filed under tags: {list}|{A} and lid|{A} notes|What to know about the {a}|{A}|Why the {a} failed|{A} – a short glossary|"
    "{a} – a tool for the yard|{A}: what buyers ask|Material: oak, steel, cork|Schlagwörter: {list}|Mots-clés: {list}|Colours: red | blue | green|{m} mm, {n} mm, {k} mm|- {a}|Ingredients: flour, water, salt|{word}|{word}|{word}|{word}"
).split("|")


def _fill(t: str, r: random.Random) -> str:
    a, b, c, d = r.sample(_ITEMS, 4)
    items = r.choice((", ", ", ", "; ")).join(r.sample(_ITEMS, r.randint(2, 6)))
    return t.format(
        list=items, a=a, b=b, c=c, d=d, A=a.capitalize(), name=f"{r.choice(_NAMES)} {r.choice(_KINDS)}", p=r.choice(_PLACES), n=r.randint(2, 99),
        word=r.choice(_WORDS), m=r.randint(1, 9), k=r.randint(100, 999), y=r.randint(10, 29),
    )


def _menu(r: random.Random) -> str:
    items = r.choice(_MENUS).split("|")
    items = r.sample(items, r.randint(3, min(7, len(items))))
    sep = r.choice((" · ", " / ", " | ", " • ", " ", " ", "  "))
    k = r.randrange(len(items))
    items[k] = r.choice((items[k], f"[{items[k]}]", f"{items[k]} ▾", f"{items[k]} (current)"))
    e = r.choice(_EXTRA)
    return sep.join(items + ([e] if e else []))


def _crumb(r: random.Random) -> str:
    items = r.sample(r.choice(_MENUS).split("|"), 2) + [r.choice(_ITEMS).capitalize()]
    return r.choice((" > ", " » ", " / ", " › ")).join(items)


_BOX = {"nav": ("nav", "header", "ul", "div"), "consent": ("div", "aside", "dialog"), "side": ("aside", "div", "section"), "foot": ("footer", "div")}
_CLASS = {"nav": "menu navbar top-nav", "consent": "cookie-banner consent gdpr", "side": "sidebar related share-box", "foot": "footer site-footer legal"}


def _document(lines: list[tuple[str, str]], r: random.Random) -> str:
    """Markup of a page whose boilerplate stands in elements of its own, or, as often, leaked into the content."""
    leak = r.random() < 0.7
    out = ["<html><body>"]
    outer, inner = r.choice((("main", "p"), ("div", "p"), ("article", "p"), ("div", "div"), ("section", "p")))
    out.append(f'<{outer} class="{r.choice(("content", "post", "x1f", "", "wrap"))}">')
    for text, kind in lines:
        t = html.escape(text)
        if kind == "head":
            out.append(f"<h2>{t}</h2>")
        elif kind in ("body", "short") or leak and r.random() < 0.85:
            out.append(f"<{inner}>{t}</{inner}>")
        else:
            box = r.choice(_BOX[kind])
            cls = r.choice((*_CLASS[kind].split(), "c81", ""))
            out.append(f'</{outer}><{box} class="{cls}">{t}</{box}><{outer}>')
    return "".join(out) + f"</{outer}></body></html>"


def composed_pages(n: int = COMPOSED_PAGES, seed: int = 7) -> list[tuple]:
    """(lines, labels, links, chrome text, headings, markup) of pages put together from the exemplars."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        lines: list[tuple[str, str]] = []
        menu = _menu(r)
        chrome = [menu] if r.random() < 0.6 else []
        lead = [(_menu(r), "nav"), (_crumb(r), "nav"), (_fill(r.choice(_CONSENT_LINES), r), "consent"), (_crumb(r), "nav"), (menu, "nav")]
        lines += r.sample(lead, r.choice((0, 0, 1, 1, 2, 3)))
        heads = []
        for _ in range(r.randint(1, 7)):
            k = r.random()
            if k < 0.36:
                lines.append((" ".join(_fill(r.choice(_PROSE), r) for _ in range(r.randint(1, 5))), "body"))
            elif k < 0.46:
                lines.append((_fill(r.choice(_DECOYS), r), "body"))
            elif k < 0.60:
                mixed = [r.choice(_PROSE) for _ in range(r.randint(1, 3))] + [r.choice(_DECOYS)]
                r.shuffle(mixed)
                lines.append((" ".join(_fill(x, r) for x in mixed), "body"))
            elif k < 0.80:
                s = _fill(r.choice(_BODY_SHORT), r)
                plain = ":" not in s and ">" not in s and "|" not in s
                if plain and r.random() < 0.7:
                    heads.append(s)
                lines.append((s, "head" if plain and r.random() < 0.8 else "short"))
            elif k < 0.97:
                lines.append((_fill(r.choice(_SIDE_LINES), r), "side"))
            else:  # a long notice, as long as a paragraph
                lines.append((" ".join(_fill(r.choice(_CONSENT_LINES + _FOOT_LINES[:12]), r) for _ in range(r.randint(3, 8))), "consent"))
        tail = [(_fill(r.choice(_SIDE_LINES), r), "side"), (_fill(r.choice(_FOOT_LINES), r), "foot"), (_fill(r.choice(_FOOT_LINES), r), "foot"), (_fill(r.choice(_CONSENT_LINES), r), "consent")]
        lines += r.sample(tail, r.choice((0, 0, 1, 1, 2)))
        if r.random() < 0.3:
            chrome.append(_fill(r.choice(_FOOT_LINES), r))
        links = [(x, r.choice(("nav", "footer", "main"))) for x in r.sample(_MENUS[0].split("|"), 4)] + [(x, r.choice(("main", "main", "nav"))) for x in r.sample(_ITEMS, 3)]
        own = [int(k not in ("body", "short", "head")) for _, k in lines]
        out.append(([x for x, _ in lines], own, links, "\n".join(chrome), heads, _document(lines, r) if r.random() < 0.8 else None))
    return out


def training_set(sample: list[tuple], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the composed documents and of sampled pages (text_main, text_chrome, links,
    headings, body): their chrome lines and navigation elements are boilerplate, their paragraphs body; other lines
    stay unlabelled."""
    xs, ys, ws = [], [], []
    for lines, labels, links, chrome, heads, body in composed_pages(seed=seed):
        xs.append(page_features(lines, links, chrome_sets(chrome), frozenset(h.lower() for h in heads), body)[0])
        ys += labels
        ws += [1.0] * len(labels)
    for main, chrome, links, heads, body in sample:
        para = [x for x in (main or "").split("\n") if len(_END.findall(x)) >= PARAGRAPH_MARKS and len(x.split()) >= PARAGRAPH_WORDS]
        top = [x for x in (chrome or "").split("\n") if x.strip()]
        if not para or not top:
            continue
        # As if the chrome stood around the body, which is what it does where extraction fails.
        lines = top[:1] + para + top[1:]
        x, _ = page_features(lines, label_regions(links), frozenset(), frozenset(h.lower() for h in heads or () if h), body)
        xs.append(x)
        ys += [1] + [0] * len(para) + [1] * (len(top) - 1)
        ws += [0.5] * len(lines)
    return np.concatenate(xs), np.array(ys, float), np.array(ws)


def fit(sample: list[tuple] = (), seed: int = 7) -> BoostedTrees:
    """The classifier; it can be kept (it pickles) and handed to boilerplate_lines()."""
    return BoostedTrees(trees=TREES, depth=DEPTH).fit(*training_set(list(sample), seed))


# --- Decoding ----------------------------------------------------------------------------------------------------


def decode(scores: list[float | None], box: list[int]) -> list[int]:
    """Lines to drop. The hierarchy: page > zones > lines; a zone is a chrome element of the document, or a run of lines
    between running text (lines sure to be body). scores: a line's log-odds of being boilerplate, None for blank ones.
    A zone's evidence is the mean of its lines' scores; dropping a zone drops all its lines, keeping it leaves the
    choice to each line, so no line contradicts its zone."""
    zones: dict[tuple, list[int]] = {}
    run = 0
    for i, v in enumerate(scores):
        if v is None:
            continue
        if box[i] >= 0:
            zones.setdefault(("box", box[i]), []).append(i)
        elif v < RUNNING:
            run += 1
        else:
            zones.setdefault(("run", run), []).append(i)
    out: list[int] = []
    for z in zones.values():
        total = sum(scores[i] for i in z)
        drop_zone = (1 + ZONE_WEIGHT) * total
        keep_zone = sum(abs(scores[i]) for i in z) - ZONE_WEIGHT * total
        out += z if drop_zone > keep_zone else [i for i in z if scores[i] > 0]
    return sorted(out)


def boilerplate_lines(page: DataFrame, capture: DataFrame | None = None, exclude: bool = True, train_pages: int = TRAIN_PAGES,
                      model: BoostedTrees | None = None, stuffed: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no) of every line of text_main (from 0, split at line feeds) that is boilerplate.

    capture: (page_id, body, fetched_at), the documents; the latest of a page counts, pages without one are judged by
    their text alone. Pages that are residue or stuffed are left out (with exclude; stuffed: (page_id) if known already).
    model: a fitted classifier, else one is fitted. Blank lines are never named. Null texts give no rows, null links,
    chrome and headings count as empty, deliveries of a page count once, and text is read whole.
    """
    spark = page.sparkSession
    links = F.transform("links", lambda x: F.struct(x["text"].alias("text"), x["region"].alias("region")))
    heads = F.transform("headings", lambda x: x["heading"])
    own = page.where("length(text_main) > 0 AND page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), "text_main", "text_chrome", links.alias("links"), heads.alias("heads")
    )
    bodies = None
    if capture is not None:
        bodies = (
            capture.where("length(body) > 0 AND page_id IS NOT NULL").groupBy(F.col("page_id").cast("long").alias("page_id"))
            .agg(F.max(F.struct("fetched_at", "body"))["body"].alias("body"))
        )
    if model is None:
        # The bounded sample: the pages whose ids hash lowest, the same on every run. Only ids compete for it, so that
        # no task sends texts that are not taken.
        ids = [
            r[0]
            for r in own.where("length(text_chrome) > 0").select("page_id", F.xxhash64("page_id").alias("h")).distinct()
            .orderBy("h", "page_id").limit(train_pages).collect()
        ]
        taken = own.where(F.col("page_id").isin(ids)).dropDuplicates(["page_id"])
        seen = bodies.where(F.col("page_id").isin(ids)) if bodies is not None else None
        taken = taken.join(seen, "page_id", "left") if seen is not None else taken.withColumn("body", F.lit(None).cast("string"))
        model = fit([tuple(r)[1:6] for r in taken.orderBy("page_id").collect()] if ids else [])
    index = Index(*term_counts(page)) if exclude else None
    sent = spark.sparkContext.broadcast((model, index))
    cols = own.join(bodies.hint("merge"), "page_id", "left") if bodies is not None else own.withColumn("body", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = sent.value
        for b in batches:
            pages = []
            for i, main, chrome, links, heads, body in zip(*(b.column(k).to_pylist() for k in range(6))):
                if index is not None and is_residue(index, main):
                    continue
                lines = main.split("\n")
                ask = [k for k, x in enumerate(lines) if x and not x.isspace()]
                if ask:
                    x, box = page_features(lines, label_regions(links), chrome_sets(chrome), frozenset(h.lower() for h in heads or () if h), body, ask)
                    pages.append((i, len(lines), ask, x, box))
            ids: list[int] = []
            nos: list[int] = []
            if pages:
                score = model.decision(np.concatenate([p[3] for p in pages]))
                at = 0
                for i, n, ask, _, box in pages:
                    of: list[float | None] = [None] * n
                    for k, v in zip(ask, score[at : at + len(ask)].tolist()):
                        of[k] = v
                    at += len(ask)
                    drop = decode(of, box)
                    ids += [i] * len(drop)
                    nos += drop
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32())], names=["page_id", "line_no"])

    found = cols.mapInArrow(run, "page_id long, line_no int").distinct()
    if exclude:
        found = found.join((stuffed if stuffed is not None else stuffed_pages(page)).select("page_id"), "page_id", "left_anti")
    return found


def main_body(page: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, body): text_main without the named lines; pages without any keep their text."""
    one = one_delivery(page.where("text_main IS NOT NULL"), "page_id", "text_main")
    gone = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(
        F.split("text_main", "\n"), lambda x, i: F.coalesce(~F.array_contains("gone", i), F.lit(True))
    )
    return one.join(gone, "page_id", "left").select("page_id", F.array_join(kept, "\n").alias("body"))
