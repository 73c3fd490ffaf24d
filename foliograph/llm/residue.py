"""Problem 9: documents with unfilled placeholders, filler paragraphs or nothing but an error page.

Method: placeholder and filler detectors read every document, and so does the comparison of title (whose words are
the slug) and body. Each line apart from properties and navigation is measured by how much of it is in the words of
failed responses; that is weak evidence, enough only for a line that says nothing else. Other lines are residue as
duplicated low-information text: sentences, names left open, that stand in documents of several hosts nearly only
where a failure is told, under titles that don't speak of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from foliograph.session import cut_lineage

#: Forms of template placeholders that nobody filled, each with a string it can't do without.
PLACEHOLDERS = (
    ("{{", r"\{\{(?!\s*(?:query|embed)\b)[^{}\n]+\}\}"),
    ("{%", r"\{%[^%\n]+%\}"),
    ("<%", r"<%[^%\n]+%>"),
    ("${", r"\$\{[^{}\n]+\}"),
    ("#{", r"#\{[^{}\n]+\}"),
    ("%%", r"%%[A-Za-z][\w .-]*%%"),
    ("@@", r"@@[A-Za-z][\w .-]*@@"),
    ("__", r"__(?<!\w__)[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__"),
    ("[[[", r"\[\[\[[^\[\]\n]+\]\]\]"),
    (
        "[",
        r"\[(?<![\[!\w]\[)(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|HIER|hier|Hier|Ihr|votre|Votre|su|tu)\s"
        r"[^\[\]\n]+\](?![\](])",
    ),
    ("{", r"\{(?<![\\\w$#{}%]\{)[a-z][a-z0-9]*(?:_[a-z0-9]+)+\}(?!\})"),
    ("<<", r"<<[A-Za-z][\w .-]*>>"),
    ("<", r"<(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|enter)\s[^<>\n]+>"),
)

#: Words that say of a text that it isn't one, and those for what they speak of.
STAND_INS = frozenset(
    """placeholder dummy sample lorem ipsum filler replace overwrite swap blindtext platzhalter beispieltext ersetzen provisoire factice
    remplacez exemple provisional relleno muestra ejemplo sustituya reemplace reemplaza segnaposto esempio sostituire""".split()
)
TEXT_WORDS = frozenset(
    """text texts paragraph content copy description section block introduction sentence sentences words word body heading summary
    absatz inhalt beschreibung texte paragraphe contenu texto párrafo contenido testo paragrafo contenuto""".split()
)
HERE = frozenset("here soon hier bald ici bientôt aquí pronto qui presto".split())
_ASIDE = frozenset(
    """own real coming goes write add insert enter enough publish publishing before later example short brief one two three few thema sinn
    zweck ohne später steht folgt kommt nur propio propia propres propre publicar publier está""".split()
)

#: Words of the usual pseudo-Latin.
LATIN = frozenset(
    """ad adipiscing ager aliqua aliquam aliquet aliquip amet anim ante arcu at augue aute bibendum blandit canto carta
    cillum commodo condimentum congue consectetur consequat convallis cras culpa cupidatat curabitur cursus deserunt diam
    dictum dignissim dolor dolore donec duis egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam
    eu euismod ex excepteur exercitation facilisis faucibus felis fermentum finis fringilla fugiat fusce gravida habitant
    hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris laborum lacinia lacus
    laoreet lectus leo libero ligula lobortis lorem luctus lumen maecenas magna malesuada massa mattis mauris mensis metus
    minim mollis mollit mora morbi nam nec neque nibh nisi nisl non nostra nostrud nulla nullam nunc occaecat odio officia
    orbis orci ornare pagina pariatur pellentesque pharetra placerat porta porttitor posuere praesent pretium proident purus
    quam qui quidem quis reprehenderit rhoncus risus rutrum sagittis saltem sapien scelerisque sed sem semper senectus sidus
    sint sit sollicitudin sunt suscipit suspendisse tellus tempor tempus terga tincidunt tortor tristique turpis ulla
    ullamco ultrices ultricies urna ut varius vehicula vel velit velum veniam vestibulum vitae vivamus vix viverra volutpat
    voluptate vulputate""".split()
)

#: Words that tell of a failed response or of scripts that are needed, in the languages of the web.
HEADS = frozenset(
    """error errors exception forbidden denied unauthorized unavailable expired timeout timed javascript js script scripts
    noscript cookies oops whoops failed failure loading permission disabled blocked maintenance captcha unreachable refused traceback
    fehler zugriff verweigert abgelaufen wartungsarbeiten erreur introuvable refusé interdit expiré indisponible acceso denegado caducado
    errore erro negato negado scaduta expirou ошибка доступ запрещён""".split()
)

#: Words that stand beside them.
COMPANIONS = frozenset(
    """page pages site website web address link url file resource document server host app browser request requested response access
    account session connection network service gateway bad method internal many wait moment second seconds minute minutes try again
    later retry reload refresh enable enabled activate turn allow sign log login view display open opening check checking find found
    looking exist exists moved removed deleted gone longer available load complete completed process handle continue sorry please happened
    happens wrong something required requires require need needs run temporarily currently code id reference incident ray work works
    properly blocks administrator status http https nginx apache openresty cloudflare iis caddy
    seite angeforderte adresse datei server gefunden verfügbar existiert aktivieren anzuzeigen browser erneut versuchen später laden
    demandée demandé existe activer activez continuer réessayez navigateur lien accès serveur
    página pagina enlace encontrada encontrado disponible activar active navegador intente nuevo servidor trovata disponibile encontrada
    страница найдена""".split()
)

#: Words that deny, and what is denied where a response has failed.
DENIALS = frozenset("not no cannot can't couldn't can‘t doesn't isn't don't wasn't nicht kein keine ne pas non não не unable longer".split())
DENIED = frozenset(
    """find found exist exists available load complete completed process handle open work works respond gefunden verfügbar existiert
    existe trouvée disponible encontrada encontrado trovata disponibile найдена""".split()
)

#: Words that say nothing by themselves.
PLAIN = frozenset(
    """a an the this that of to in on at for from by with and or but if is are was were be been has have had do does did it its you your
    we we're our us i may can could will would should up out so as there here nothing take takes before until most recent call last
    der die das den dem des ein eine einen ist sind wird wurde bitte sie ihr ihre und oder um zu auf im in mit von für es
    le la les l un une des du de est et ou sur dans pour votre vous veuillez plus par qui que
    el los las una es y o en del con por favor su para ya se lo il o a os as um uma è é si не на и""".split()
) | DENIALS

#: Lines that only lead to other pages.
NAVIGATION = (
    r"(?:main )?menu",
    r"search(?:…|\.\.\.)?",
    r"home",
    r"about(?: us)?",
    r"contact(?: us)?",
    r"log ?in|sign in|log ?out|sign up",
    r"skip to (?:main )?content",
    r"(?:back|go back|return) to (?:start|top|home|the homepage)",
    r"(?:←|«|‹|<)? ?(?:previous|prev|back)(?: page)?(?: ?[·|/] ?next(?: page)? ?(?:→|»|›|>)?)?",
    r"next(?: page)? ?(?:→|»|›|>)?",
    r"(?:©|\(c\)|copyright\b).*",
    r"all rights reserved\.?",
)

_any = lambda parts: "|".join(f"(?:{p})" for p in parts)
_placeholders = [(hint, re.compile(p).search) for hint, p in PLACEHOLDERS]
_fences = re.compile(r"(?ms)^[ \t>]*(?:[-*+] )?(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*\1[`~]*[ \t]*\r?$|\Z)")
_spans = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
#: A text without any of these has no sentence that stands in.
_STAND_IN_SIGNS = (*STAND_INS, *HERE)
_sentences = re.compile(r"(?<=[.!?…;])\s+").split
_navigation = re.compile(_any(NAVIGATION), re.I).fullmatch
_menu = re.compile(r" [|·] ").split
#: Lines that only a program writes: tracebacks, exceptions, notices in a tag for browsers without scripts.
_machine = re.compile(r"traceback \(most recent call last\):?|file \".+\", line \d+.*|[a-z.]*(?:error|exception): .*|<noscript>.*</noscript>", re.I).fullmatch
_status = re.compile(r"[45]\d\d").fullmatch
_tokens = re.compile(r"\w+(?:'\w+)?").findall
#: Reason phrases of failed responses, as the protocol names them.
_phrases = frozenset(s.phrase.lower() for s in HTTPStatus if s >= 400)
_name = re.compile(r"(?<=\s)[„“\"'«(]*[A-ZÀ-ÖØ-Þ]\w+")
_numbers = re.compile(r"\d+")
_parts = re.compile(r"(?<=[.!?…;])\s+|[\r\n]+").split
#: Without one of these, or a denial, no text tells of a failure.
_SIGNS = ("…", "...", *HEADS, *(p for p in _phrases if HEADS.isdisjoint(p.split())))
_any_status = re.compile(r"(?<!\w)[45]\d\d(?!\w)").search
_property = re.compile(r"\s*[A-Za-z0-9_.-]+::(?:\s|$)").match
_lead = re.compile(r"^(?:[\s>]|[-*+•] |#{1,6} )+")
_lines = re.compile(r"\r\n|\r|\n").split


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands outside code."""
    hits = [search for hint, search in _placeholders if hint in text and search(text)]
    if not hits:
        return False
    if "`" not in text and "~~~" not in text:
        return True
    bare = _spans.sub(" ", _fences.sub("\n", text))
    return any(search(bare) for search in hits)


def is_filler(line: str) -> bool:
    """Whether a paragraph is pseudo-Latin, the same few words again and again, or says that it stands in."""
    return _is_wordless(line) or _stands_in(line)


def _is_wordless(line: str) -> bool:
    tokens = line.split()
    if len(tokens) < 5:
        return False
    kinds = set(tokens)
    if len(kinds) * 3 > len(tokens) + 6 and kinds.isdisjoint(LATIN):
        return False
    tokens = _lead.sub("", line).split()
    kinds = {t.strip(".,;:!?").lower() for t in tokens}
    if len(tokens) < 5:
        return False
    if len(kinds) * 4 <= len(tokens) and all(k.isalpha() and len(k) > 2 for k in kinds):
        return True
    return len(kinds & LATIN) * 10 >= 6 * len(kinds)


def stands_in(sentence: str) -> bool:
    """Whether a sentence says that it is no text: most of its words speak of texts and one that they stand in or come later."""
    words = _tokens(sentence.replace("’", "'"))
    low = [w.lower() for w in words]
    kinds = set(low)
    if STAND_INS.isdisjoint(kinds) and (HERE.isdisjoint(kinds) or TEXT_WORDS.isdisjoint(kinds)):
        return False
    known = unknown = 0
    for k, w in enumerate(low):
        if w in STAND_INS or w in TEXT_WORDS or w in HERE or w in _ASIDE:
            known += 1
        elif not (w in PLAIN or k and words[k][0].isupper()):
            unknown += 1
    return known >= SURE * (known + unknown)


def _stands_in(line: str) -> bool:
    low = line.lower()
    if not any(x in low for x in _STAND_IN_SIGNS):
        return False
    parts = [s for s in _sentences(_lead.sub("", line).strip()) if s]
    return sum(map(stands_in, parts)) * 2 >= len(parts) > 0


def has_filler(text: str) -> bool:
    """Whether at least one paragraph outside code fences is filler."""
    low = text.lower()
    test = is_filler if any(h in low for h in _STAND_IN_SIGNS) else _is_wordless
    if not any(map(test, _lines(text))):
        return False
    return "`" not in text and "~~~" not in text or any(map(test, _lines(_fences.sub("\n", text))))


def _leads_on(line: str) -> bool:
    """Whether a line is navigation: one of its usual forms, or a row of short labels."""
    if _navigation(line):
        return True
    labels = _menu(line)
    return len(labels) > 1 and all(0 < len(x.split()) <= 4 for x in labels)


def rest_lines(text: str) -> list[str]:
    """What a document says apart from properties and navigation."""
    rest = []
    for line in _lines(text):
        if line.strip() and not _property(line):
            bare = _lead.sub("", line).strip()
            if bare and not _leads_on(bare):
                rest.append(bare)
    return rest


def response_share(line: str) -> tuple[float, bool]:
    """How much of a line is in the words of failed responses, from 0 to 1, and whether one of them tells of a failure.

    Words that say nothing and numbers don't count, and neither does the first name (a capitalised word within
    the line): a response names what was asked for.
    """
    if line.strip(" .!:0123456789–—-").lower() in _phrases:
        return 1.0, True
    words = _tokens(line.replace("’", "'"))
    low = [w.lower() for w in words]
    kinds = set(low)
    if COMPANIONS.isdisjoint(kinds) and HEADS.isdisjoint(kinds) and not any(map(_status, low)):
        return 0.0, False
    known = unknown = names = 0
    head = named = False
    for k, w in enumerate(low):
        if w in HEADS or _status(w):
            known, head = known + 1, True
        elif w in COMPANIONS:
            known += 1
        elif w in PLAIN or w[0].isdigit() or any(c.isdigit() for c in w):
            continue
        elif k and words[k][0].isupper():
            names += not named
            unknown += named or names > 1
            named = True
            continue
        else:
            unknown += 1
        named = False
    share = known / (known + unknown) if known else 0.0
    state = share >= STATE and line.endswith(("…", "..."))
    return (1.0, True) if state else (share, head or not (DENIALS.isdisjoint(kinds) or DENIED.isdisjoint(kinds)))


#: Shares of a line: a response for sure, one if other evidence agrees, and a state that is never over ("Loading notes…").
SURE, LIKELY, STATE = 0.6, 0.3, 0.5


def is_error(line: str) -> bool:
    """Whether a line is an error message or a notice about scripts by its words alone."""
    return bool(_machine(line)) or response_share(line)[0] >= SURE


def may_fail(text: str) -> bool:
    """Whether a text can tell of a failure; a quick test that never misses."""
    low = text.replace("’", "'").lower()
    if any(x in low for x in _SIGNS) or _any_status(low):
        return True
    for line in _lines(low):
        if any(x in line for x in DENIED):
            kinds = set(_tokens(line))
            if not (DENIALS.isdisjoint(kinds) or DENIED.isdisjoint(kinds)):
                return True
    return False


def judged(rest: list[str]) -> tuple[list[str], bool, set[str]]:
    """Lines that aren't responses by their words alone, whether any line tells of a failure, and the words that do.

    In a traceback the source line below a frame, and marks below that, are part of the response.
    """
    plain: list[str] = []
    told: set[str] = set()
    failed = traced = framed = False
    for line in rest:
        if _machine(line):
            failed = True
            traced = traced or line.lower().startswith("traceback")
            framed = traced and line.lower().startswith("file ")
        elif framed or traced and not line.strip("~^ "):
            framed = False
        else:
            share, head = response_share(line)
            if share < SURE:
                plain.append(line)
            if share >= LIKELY and head:
                failed = True
                told.update(w for w in map(str.lower, _tokens(line)) if w in HEADS or w in COMPANIONS)
    return plain, failed, told


def pieces(text: str) -> set[int]:
    """Hashes of the sentences of a text, names and numbers left open, so that a template has the same whatever it was filled with."""
    masked = _numbers.sub("0", _name.sub("§", text)).lower()
    return {xxh3_64_intdigest(s) - (1 << 63) for x in _parts(masked) if (s := x.strip(" \t>-*+•#"))}


def compared(text: str, title: str | None) -> tuple[bool, bool, set[int]]:
    """Whether a document tells of a failure and whether its title doesn't, and the pieces that aren't responses."""
    if may_fail(text):
        plain, failed, told = judged(rest_lines(text))
        if failed:
            return True, told.isdisjoint({w.lower() for w in _tokens(title or "")}), pieces("\n".join(plain))
    return False, False, pieces(text)


def inspect(docs: DataFrame, key: str, text: str, title: str, host: str) -> DataFrame:
    """Every document's own findings, with the pieces of its lines that aren't responses by their words alone."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, host string, placeholder boolean, filler boolean, failed boolean, mismatched boolean, pieces array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for body, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                failed, mismatched, found = compared(body, name)
                row = has_placeholder(body), has_filler(body), failed, mismatched, list(found)
                for col, value in zip(cols, row):
                    col.append(value)
            kinds = [pa.bool_()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols, kinds)], names=[key, "host", "placeholder", "filler", "failed", "mismatched", "pieces"])

    return (
        docs.select(F.col(key), F.col(host).cast("string").alias("host"), F.col(text).alias("text"), F.col(title).cast("string").alias("title"))
        .filter(F.col(key).isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
        .mapInArrow(run, schema)
    )


def find_residue(
    docs: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", host: str = "source", min_docs: int = 3, min_hosts: int = 2, min_share: float = 0.8
) -> DataFrame:
    """(``doc_id``, ``placeholder``, ``filler``, ``error_page``) of the documents that are residue.

    A document of any length is an error page if it tells of a failure and every line apart from properties and
    navigation is a response: by its words alone, or, where the title has none of the words that tell of the
    failure, as duplicated text. Text is duplicated if its sentences, names left open, stand in at least
    ``min_docs`` documents of at least ``min_hosts`` hosts, ``min_share`` of which tell of a failure; more than
    half of a document's other sentences must be. All documents are counted, whatever their length.

    Null, empty and blank texts are no case. Null titles and hosts are allowed; a null host is no host. Repeated
    rows count once; an empty table gives an empty result. Texts are read once and never shuffled: only the
    hashes of sentences that documents with a failure have are looked up in all others.
    """
    seen = cut_lineage(inspect(docs, key, text, title, host))
    each = seen.filter(F.size("pieces") > 0).select(key, "host", "failed", "mismatched", F.explode("pieces").alias("piece"))
    open_cases = each.filter(F.col("failed") & F.col("mismatched")).select(key, "piece").distinct()
    uses = each.select(key, "host", "failed", "piece").join(open_cases.select("piece").distinct(), "piece", "left_semi")
    known = (
        uses.groupBy("piece", key)
        .agg(F.min("host").alias("host"), F.max("failed").alias("failed"))
        .groupBy("piece")
        .agg(F.count("*").alias("docs"), F.avg(F.col("failed").cast("double")).alias("share"), F.countDistinct("host").alias("hosts"))
        .filter((F.col("docs") >= min_docs) & (F.col("hosts") >= min_hosts) & (F.col("share") >= min_share))
        .select("piece", F.lit(1).alias("known"))
    )
    backed = (
        open_cases.join(known, "piece", "left")
        .groupBy(key)
        .agg(F.count("*").alias("all"), F.count("known").alias("known"))
        .filter(F.col("known") * 2 > F.col("all"))
        .select(key)
    )
    no = F.lit(False)
    own = seen.select(key, "placeholder", "filler", (F.col("failed") & (F.size("pieces") == 0)).alias("error_page")).filter(F.col("placeholder") | F.col("filler") | F.col("error_page"))
    pages = backed.select(key, no.alias("placeholder"), no.alias("filler"), F.lit(True).alias("error_page"))
    return own.unionByName(pages).groupBy(key).agg(*[F.max(c).alias(c) for c in ("placeholder", "filler", "error_page")])


def without_residue(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that are residue; rows without a key are kept."""
    return docs.join(find_residue(docs, key=key, **options).select(key), key, "left_anti")
