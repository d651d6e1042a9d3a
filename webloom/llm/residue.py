"""Template residue and error-page text: labelled exemplars in an inverted index, TF-IDF containment of windows.

A page's words are cut into passage windows (lines, and sentences within them). A window retrieves exemplars through
an inverted index from terms; the share of the window's TF-IDF mass that one exemplar contains is its coverage. Pages
whose windows are mostly covered by residue are cases.

Placeholders are windows of their own: a slot in template notation is one wildcard term, whatever stands in it, and
the exemplars of slots hold these terms, so that one slot fully covered by them makes a page a case, unless the
sentence around it is covered by the exemplars of writing ABOUT placeholders. Slots in square brackets, a notation
that prose uses, too, are windows of the words in them.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coverage from which a window counts as residue, share of a page's words in such windows from which it is a case,
#: and coverage of a slot's sentence by an exemplar of writing about slots from which the slot is only a mention.
WINDOW_COVER, PAGE_COVER, MENTION_COVER = 0.6, 0.5, 0.55

#: Labelled exemplars, each the vocabulary of one kind of page in one language: our own wording of what such pages say,
#: followed by related words. Figures don't count: a term is a run of letters; ~name stands for a slot of that notation.
EXEMPLARS: dict[str, list[str]] = {
    "error": [
        "Error. Sorry, oops, that page, file, document, image, listing, item or product was not found here. Nothing is at the address, link or url you "
        "requested; it is missing, gone, moved, removed, deleted, expired, out of date, broken, wrong, no longer available, or does not exist any more. It leads nowhere, "
        "lives elsewhere, or its owner or author took it away. Please check the spelling, go back, return to the home, start or front page of the site, shop or store, use search or the menu. "
        "Internal server error: something unexpected went wrong, failed, broke or happened on our side or end while building, loading, rendering or processing the request. "
        "Our staff, team, desk, support or administrator has been told, notified or informed. Call, contact or write to us with this code, ticket, reference, number, id or node. "
        "Bad gateway, gateway timeout, service unavailable, temporarily down for maintenance, overloaded or offline between the front end and backend. Please try again, reload, refresh or "
        "come back later, soon, in a few minutes or moments. Too many requests, rate limit reached, exceeded, slow down. The database connection failed: it was reset, lost, refused, dropped or timed out, or could not be established. "
        "Access denied, forbidden, unauthorized, you do not have permission, please log in or sign in, your session has expired. Fatal error, warning, uncaught exception, stack trace, traceback "
        "follows, most recent call last, in module, line, function, template, loader, load, render, null, none returned nothing, undefined variable. We cannot, can't, couldn't or are unable to complete, find, open, show or display what you were looking for; you followed an old link.",
        "Fehler. Seite, Datei, Dokument, Artikel oder Adresse nicht gefunden, gibt es nicht mehr, existiert nicht, wurde verschoben, entfernt, gelöscht, ist abgelaufen, fehlt hier. Diese, dieser, dieses, der Link führt ins Leere, ist veraltet. "
        "Interner Serverfehler, interner Fehler ist beim Laden, Aufbau oder Verarbeiten der Anfrage aufgetreten. Der Dienst oder Server ist zurzeit, derzeit, momentan, vorübergehend nicht erreichbar oder verfügbar, wegen Wartung. Zugriff verweigert, Sitzung abgelaufen, "
        "keine Berechtigung. Bitte versuchen Sie es später, gleich, in wenigen Minuten noch einmal, erneut, wieder, laden Sie neu, zurück zur Startseite. Unser Team wurde informiert, benachrichtigt. Es tut uns leid, leider, etwas ging schief. Verbindung zur Datenbank fehlgeschlagen.",
        "Erreur. Page, fichier, document, article ou adresse introuvable, non trouvé, n'existe pas, n'existe plus, supprimé, déplacé, expiré, manquant. Ce lien, cette page ne mène nulle part, est cassé, périmé. Erreur interne du serveur, une erreur est survenue, s'est produite pendant, "
        "lors du chargement, du traitement de la demande. Le service, le serveur, le site est momentanément, temporairement, actuellement indisponible, inaccessible, en maintenance. Accès refusé, interdit, session expirée, connectez vous. Veuillez réessayer, essayer, actualiser, recharger plus tard, bientôt, dans quelques minutes, "
        "retour à l'accueil. Notre équipe a été prévenue. Désolé, quelque chose s'est mal passé. Connexion à la base de données impossible.",
        "Error. Página, archivo, documento, artículo o dirección no encontrada, no existe, ya no existe, eliminado, movido, caducado, falta. Este enlace, esta página no lleva a ninguna parte, está roto. Error interno del servidor, se ha producido un error al cargar, durante la carga, al procesar la solicitud. "
        "El servicio, el servidor, el sitio no está disponible por ahora, por el momento, temporalmente, en mantenimiento. Acceso denegado, prohibido, sesión caducada. Por favor inténtelo de nuevo, vuelva a intentar, pruebe más tarde, recargue, en unos minutos, volver al inicio. Nuestro equipo ha sido avisado. "
        "Lo sentimos, algo salió mal. No se pudo conectar con la base de datos.",
        "Errore. Pagina, file o indirizzo non trovata, non esiste più, rimossa, spostata. Errore interno del server durante il caricamento. Il servizio non è al momento disponibile, in manutenzione. Accesso negato, sessione scaduta. Riprova più tardi, torna alla pagina iniziale. Qualcosa è andato storto.",
        "Erro. Página, arquivo ou endereço não encontrada, não existe mais, removida. Erro interno do servidor ao carregar. O serviço está temporariamente indisponível, em manutenção. Acesso negado, sessão expirada. Tente novamente mais tarde, voltar ao início. Algo deu errado.",
        "Fout. Pagina, bestand of adres niet gevonden, bestaat niet meer, verwijderd, verplaatst. Interne serverfout bij het laden. De dienst is tijdelijk niet beschikbaar, onderhoud. Toegang geweigerd, sessie verlopen. Probeer het later opnieuw, terug naar de startpagina. Er ging iets mis.",
        "Ошибка. Страница, файл или адрес не найдена, не найден, не существует, больше нет, удалена, перемещена. Внутренняя ошибка сервера при загрузке, произошла ошибка. Сервис, сервер временно недоступен, идут работы. Доступ запрещён, сессия истекла. Попробуйте ещё раз позже, вернуться на главную. Что-то пошло не так.",
    ],
    "script": [
        "This site, shop, store, page, app, application or catalogue requires, needs or must have JavaScript, scripts or scripting, and cookies, allowed, enabled, on, turned on, switched on or activated; it does not run or work without them. Your browser has them disabled, off, blocked or not supported. "
        "Please enable, allow, activate, turn or switch on scripts in the settings of your browser to view, see, use, open, run or continue to the content of this address, then reload. Loading, please wait, one moment, if nothing happens or opens. Checking, verifying your browser before you access or the page opens, security check. You have to, you need to, is required, for this.",
        "Bitte aktivieren, erlauben, einschalten Sie JavaScript, Skripte und Cookies in Ihrem Browser, um diese Seite, diesen Shop, Inhalt zu sehen, nutzen, laden, anzuzeigen. Diese Seite benötigt, braucht JavaScript, funktioniert nicht ohne. JavaScript ist deaktiviert, ausgeschaltet, blockiert. Browser wird geprüft, wird geladen, bitte warten.",
        "Veuillez activer, autoriser JavaScript, les scripts et les cookies dans votre navigateur pour continuer, voir, afficher, utiliser ce site, cette page, cette boutique, ce catalogue. Ce site nécessite JavaScript, ne fonctionne pas sans. JavaScript est désactivé, bloqué. Vérification du navigateur, chargement, patientez.",
        "Por favor active, habilite, permita JavaScript, scripts y cookies en su navegador para ver, usar, continuar, abrir este sitio, esta página, esta tienda, este catálogo. Este sitio necesita, requiere JavaScript, no funciona sin. JavaScript está desactivado, bloqueado. Comprobando el navegador, cargando, espere.",
        "Attiva, abilita JavaScript e i cookie nel browser per continuare, vedere questa pagina, questo sito. JavaScript è disattivato.", "Ative, habilite o JavaScript e os cookies no navegador para continuar, ver esta página, este site. O JavaScript está desativado.",
        "Schakel JavaScript en cookies in je browser in om verder te gaan, deze pagina te bekijken. JavaScript is uitgeschakeld.", "Пожалуйста, включите JavaScript и cookies в браузере, чтобы продолжить, открыть эту страницу, сайт. JavaScript отключён.",
    ],
    "filler": [
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
        "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure "
        "dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat "
        "non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
        # Pseudo-Latin is made of any Latin words: those a first reader has, and those of the usual generators.
        "et in est non ut cum ad quod qui sed si quae quam ex de esse nec hoc se ab aut enim etiam per atque autem quid nam haec tamen sunt ita ac pro quo ne nunc sic tam sine contra inter ante post sub super trans "
        "tandem saepe quasi semper iam diu mox tum ibi ubi bene male multum vel res rem rebus rei omnia nihil donum dona verbum bellum bello regnum caelum ferrum ferro aurum auro lumen nomen flumen carmen opus tempus corpus vulnus genus "
        "ager agri puer pueri vir viri filius servus dominus amicus populus locus animus annus terra luna stella aqua vita via porta puella femina rosa silva insula patria magna bona mala misera pulchra parva longa alta nova sola "
        "orbis urbs rex dux pax lex vox nox mare mons pons fons navis vestis vesti hostis civis mens gens pars ars mors amor labor dolor timor honor manus domus dies fides spes venit vidit vicit dicit facit habet amat portat vocat fugat pugnat "
        "amo porto laudo voco paro narro pugno do sto video habeo moneo teneo timeo rego duco dico mitto pono scribo lego curro vinco cano cado peto credo vivo volvo culpo temno facio capio iacio fugio pario audio venio sentio volo nolo volunt nolunt velit nolent "
        "aliqua aliquam aliquet amet aptent arcu auctor augue bibendum blandit commodo congue consequat convallis cras cursus dapibus diam dictum dignissim donec dui egestas eget eleifend elementum erat eros euismod facilisis fames faucibus felis fermentum feugiat "
        "fringilla fusce gravida hendrerit iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas magnis malesuada massa mattis mauris metus molestie morbi nibh nisl nullam odio orci ornare pellentesque pharetra "
        "phasellus placerat porttitor posuere praesent pretium proin pulvinar purus quisque rhoncus risus rutrum sagittis sapien scelerisque sem sodales sollicitudin suscipit suspendisse tellus tincidunt tortor tristique turpis ultrices urna varius vehicula vestibulum vitae vivamus viverra volutpat vulputate",
        "Sample, dummy, example, placeholder, filler or blank text, content, copy, headline, title, heading, intro, subtitle, caption, paragraph, description, line, lines or image goes, comes or stands here, to be replaced, written, added, filled in, changed, edited or deleted before launch. "
        "Your text, headline, slogan, name or product here. Add, insert, write, enter, ask the owner, client, author or editor for a short text, two or three sentences, about this box, block or section. Do not publish. Todo, tbd, fixme, coming soon, test test, foo bar baz. This is a sample page, replace it with your own.",
        "Hier steht, kommt, folgt Ihr Text, Blindtext, Beispieltext, Mustertext, Platzhalter, Überschrift, Bild. Bitte vor dem Start, der Veröffentlichung ersetzen, ergänzen, einfügen, austauschen, ändern. Noch kein Inhalt, Text folgt, nicht veröffentlichen.",
        "Votre texte, titre, image ici, texte d'exemple, faux texte, contenu provisoire à remplacer, compléter, ajouter, modifier avant la mise en ligne, la publication. Ne pas publier. Bientôt disponible.",
        "Su texto, título, imagen aquí, texto de ejemplo, de relleno, contenido provisional para, que debe reemplazar, sustituir, añadir, cambiar antes de publicar, del lanzamiento. No publicar. Próximamente.",
    ],
    "slot": [
        "~mustache ~block ~erb ~wiki ~dollar ~percent ~upper ~underscore ~hash ~at ~brace ~insert ~object ~undefined ~nan",
        "dear hello hi hey welcome thanks by for at from to only just call since on until published posted updated written order price ~null",
        # What is written in square brackets where a value should stand.
        "your first last full user given family middle name names date day month year time city town place country state street address zip postal code company firm brand shop store site url link domain email mail e-mail phone fax number no id order offer product item unit size colour amount price total sum currency discount percent "
        "author editor sender recipient customer client member headline title subject heading text message image photo logo insert enter add here start end expiry deadline signature role position job department",
    ],
    "mention": [
        "The guide, manual, chapter, sheet, table, example, lesson, article, note or documentation shows, says, explains, describes, lists or tells how and why to write, type, put, place, set, enter, use, escape or leave a placeholder, variable, field, tag, token, marker, slot, macro, merge or syntax in the template, letter, mail, editor, "
        "form, letter, page, script, code or printed document. It must or should be quoted, escaped, closed or left alone where or when the value, name or date should appear, be printed, be replaced, is filled in, is sent, or when someone edits by hand. The tool, program, system, engine, printer or server fills, replaces, inserts, prints, reads it then. Between the brackets, braces or signs, together with the, on page, of the, in the, as in, is explained, is called, stands for, means, looks like.",
        "undefined behaviour, behavior, term, terms, reference, references, variable, variables, function, functions, value, values, symbol, symbols, state, states",
        "Im Editor, in der Vorlage, im Formular, Brief steht der Platzhalter, die Variable, das Feld für den Namen, das Datum, wird erklärt, beschrieben, ersetzt, ausgefüllt, muss in Anführungszeichen", "Dans le modèle, l'éditeur, le formulaire, le champ, la variable, la balise pour le nom, la date est expliqué, décrit, remplacé, rempli, doit être",
        "En la plantilla, el editor, el formulario, el campo, la variable, la etiqueta para el nombre, la fecha se explica, se describe, se sustituye, se rellena, debe ir",
    ],
}

# The notations of slots, and the traces of failed substitution.
SLOT = regex.compile(
    r"""(?P<mustache>\{\{[^{}\n]+\}\})|(?P<block>\{%[^%{}]+%\})|(?P<erb><%[=-]?[^<>%]+%>)|(?P<wiki>\[\[\s*[\w.\- ]+\s*\]\])|(?P<dollar>\$\{[^{}\n]+\})
      |(?P<percent>%%\w[\w .]*%%)|(?P<upper>(?<![\w%])%[A-Z][A-Z_]{2,}%(?!\w))|(?P<underscore>(?<!\w)__[A-Z][A-Z_]+__(?!\w))|(?P<hash>(?<![\w\#])\#[A-Z][A-Z_]{2,}\#(?!\w))
      |(?P<at>(?<!\w)@@?[A-Z][A-Z_]{2,}@@?(?!\w))|(?P<brace>(?<![\w{$])\{[a-z][\w.]+\})|(?P<insert>\[(?:insert|enter|your|add)\s[\w ]+\])
      |(?P<object>\[object\ Object\])|(?P<undefined>(?<![\w"'`])undefined(?![\w"'`]))|(?P<nan>(?<![\w"'`])NaN(?![\w"'`]))
      |(?P<null>(?<![\w"'`])(?:null|None)(?![\w"'`]))|(?P<square>(?<!\w)\[[a-z]+(?:[ \-][a-z]+)*\](?!\())""",
    regex.X,
)
# The same, for counting in the JVM.
_JVM_SLOT = {
    "mustache": r"\{\{[^{}\n]+\}\}", "block": r"\{%[^%{}]+%\}", "erb": r"<%[=-]?[^<>%]+%>", "wiki": r"\[\[\s*[\w.\- ]+\s*\]\]", "dollar": r"\$\{[^{}\n]+\}", "percent": r"%%\w[\w .]*%%",
    "upper": r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?!\w)", "underscore": r"(?<!\w)__[A-Z][A-Z_]+__(?!\w)", "hash": r"(?<![\w#])#[A-Z][A-Z_]{2,}#(?!\w)", "at": r"(?<!\w)@@?[A-Z][A-Z_]{2,}@@?(?!\w)",
    "brace": r"(?<![\w{$])\{[a-z][\w.]+\}", "insert": r"\[(?:insert|enter|your|add)\s[\w ]+\]", "object": r"\[object Object\]", "undefined": r"\bundefined\b", "nan": r"\bNaN\b", "null": r"\b(?:null|None)\b",
}
# What any of them contains; texts without it, nearly all, are settled by one plain search.
_HINT = re.compile(r"[{}<\[%#]|__|@|undefined|NaN|null|None")
_QUOTES = "\"'`“”„«»‘’"
_TERM = re.compile(r"~?[^\W\d_]+(?:['’][^\W\d_]+)?")
_PLAIN = re.compile(r"~?[a-z]+(?:'[a-z]+)?")
_WINDOW = regex.compile(r"\n|(?<=[.!?…])[\"”»’)]*\s+")
_DROP = regex.compile(r"(?is)<(script|style|title|template|svg|nav|footer|aside)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG = regex.compile(r"(?s)<[^>]*(?:>|\Z)")
_SEPARATOR = re.compile(r"[·|/•»>▾©]|^copyright|^\(c\)", re.I)
_NAVISH = regex.compile(r"^(?:[^.!?·|/•»>▾]+\s[·|/•»>▾]\s?){2,}|^\s*(?:©|\(c\)|copyright\b)", regex.I)


def terms(text: str) -> list[str]:
    low = text.lower()
    return _PLAIN.findall(low) if low.isascii() else _TERM.findall(low)


def vocabulary() -> list[str]:
    return sorted({t for group in EXEMPLARS.values() for e in group for t in terms(e)})


class Index:
    """Inverted index from terms to labelled exemplars."""

    def __init__(self, df: dict[str, int], n_docs: int):
        self.idf = {t: math.log((n_docs + 1) / (df.get(t, 0) + 1)) + 0.1 for t in vocabulary()}
        rare = sorted(self.idf.values())
        self.other = rare[len(rare) // 2] if rare else 1.0  # what a term of no exemplar weighs
        self.label: list[str] = []
        self.postings: dict[str, list[int]] = {}
        for label, group in EXEMPLARS.items():
            for e in group:
                self.label.append(label)
                for t in set(terms(e)):
                    self.postings.setdefault(t, []).append(len(self.label) - 1)

    def cover(self, ts: list[str]) -> tuple[float, dict[str, float]]:
        """(TF-IDF mass of a window of terms, best containment by an exemplar of each label)."""
        got: dict[int, float] = {}
        mass = 0.0
        idf, postings, other = self.idf, self.postings, self.other
        for t in ts:
            w = idf.get(t)
            if w is None:
                mass += other
                continue
            mass += w
            for e in postings[t]:
                got[e] = got.get(e, 0.0) + w
        best: dict[str, float] = {}
        for e, v in got.items():
            k = self.label[e]
            if v > best.get(k, 0.0):
                best[k] = v
        return mass, {k: v / mass for k, v in best.items()} if mass else {}


def has_slot(index: Index, text: str) -> bool:
    """At least one slot that the exemplars cover stands where a value should."""
    if not _HINT.search(text):
        return False
    for m in SLOT.finditer(text):
        a, b = m.span()
        if text[a - 1 : a] in _QUOTES and a and text[b : b + 1] and text[b : b + 1] in _QUOTES:
            continue  # quoted: written about
        kind = m.lastgroup
        lo = max(text.rfind(mark, 0, a) for mark in ("\n", ". ", "! ", "? ")) + 1
        nxt = _WINDOW.search(text, b)
        hi = nxt.start() if nxt else len(text)
        if kind == "square":
            own = terms(m.group())
        elif kind == "null":
            own = [*terms(text[lo:a])[-1:], "~null"]  # a name after a greeting, a value after its label
        else:
            own = [f"~{kind}"]
        if kind == "null" and len(own) < 2 or index.cover(own)[1].get("slot", 0.0) < 1.0:
            continue
        after = terms(text[b:hi])[:1]
        if kind == "undefined" and after and index.cover([kind, *after])[1].get("mention", 0.0) == 1.0:
            continue  # an adjective of what follows
        around = terms(SLOT.sub(lambda s: s.group() if s.lastgroup == "undefined" else " ", text[lo:hi]))
        if around and index.cover(around)[1].get("mention", 0.0) >= MENTION_COVER:
            continue
        return True
    return False


def is_residue(index: Index, text: str) -> bool:
    """The words shown are residue: an unfilled slot, or mostly windows that exemplars cover."""
    if has_slot(index, text):
        return True
    lines = [x for x in text.split("\n") if x and not (_SEPARATOR.search(x) and _NAVISH.search(x))]
    # Windows are residue only where exemplar terms make up WINDOW_COVER of them: without enough such terms on the
    # page no window needs to be looked at.
    weights = list(map(index.idf.get, terms("\n".join(lines))))
    seen = sum(filter(None, weights))
    if seen < WINDOW_COVER * PAGE_COVER * (seen + weights.count(None) * index.other):
        return False
    total = inside = 0.0
    for line in lines:
        for w in _WINDOW.split(line):
            if not w or w.isspace():
                continue
            mass, by = index.cover(terms(w))
            total += mass
            if max(by.get("error", 0.0), by.get("script", 0.0), by.get("filler", 0.0)) >= WINDOW_COVER:
                inside += mass
    return total > 0 and inside >= PAGE_COVER * total


def shown(body: str) -> str:
    """The words a document shows: no markup, scripts, title, navigation or footer; noscript text counts."""
    head = regex.sub(r"(?is)<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", " ", body, count=1)
    return html.unescape(_TAG.sub("\n", _DROP.sub("\n", head))).strip()


def term_counts(page: DataFrame) -> tuple[dict[str, int], int]:
    """Document frequencies of the exemplars' terms over all pages, and the number of pages.

    Counted in the cluster; what comes to the driver is one row per exemplar term (a fixed list).
    """
    vocab = F.array(*[F.lit(t) for t in vocabulary()])
    own = F.array_intersect(F.regexp_extract_all(F.lower("text_main"), F.lit(r"(\p{L}+(?:['’]\p{L}+)?)"), F.lit(1)), vocab)
    slots = F.filter(F.array(*[F.when(F.col("text_main").rlike(p), F.lit(f"~{k}")) for k, p in _JVM_SLOT.items()]), lambda x: x.isNotNull())
    own = F.when(F.col("text_main").rlike(_HINT.pattern), F.concat(own, slots)).otherwise(own)
    rows = (
        page.where("length(text_main) > 0")
        .select(F.explode(F.concat(F.array(F.lit("")), own)).alias("t"))
        .groupBy("t")
        .count()
        .collect()
    )
    df = {r["t"]: r["count"] for r in rows}
    return df, df.pop("", 0)


def residue_pages(page: DataFrame, capture: DataFrame) -> DataFrame:
    """(page_id) of pages whose words are residue: text_main, or where it is null or blank what capture.body shows.

    Pages without any words are no cases; a page is a case once, whatever its deliveries and fetches; of several
    fetches with a body the latest counts. Null bodies, cut-off markup and very long texts are handled.
    """
    df, n = term_counts(page)
    sent = page.sparkSession.sparkContext.broadcast(Index(df, n))

    def run(batches: Iterator[pa.RecordBatch], body: bool) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            ids = [
                i for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if is_residue(index, shown(t) if body else t)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["page_id"])

    blank = F.col("text_main").isNull() | (F.trim(F.regexp_replace("text_main", r"(?U)\s+", "")) == "")
    texts = page.where(~blank & F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("text_main").alias("t"))
    bare = page.where(blank).select("page_id").distinct()
    bodies = (
        capture.where("length(body) > 0")
        .select(F.col("page_id").cast("long").alias("page_id"), "body", "fetched_at")
        .join(bare, "page_id", "left_semi")
        .groupBy("page_id")
        .agg(F.max(F.struct("fetched_at", "body"))["body"].alias("t"))
    )
    a = texts.mapInArrow(lambda it: run(it, False), "page_id long")
    b = bodies.mapInArrow(lambda it: run(it, True), "page_id long")
    return a.unionByName(b).distinct()
