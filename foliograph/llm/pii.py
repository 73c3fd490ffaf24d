"""Problem 6: personal information in free text, found and replaced by typed placeholders.

E-mail addresses, phone and identity numbers and street addresses have forms of their own. Names don't, and
there is no list of them: they are learned from the corpus. Method: information-theoretic sanitisation. For
every capitalised term it is counted how often it occurs and how often in a frame that reveals a person (after
a title or an initial, beside a contact, or as the local part of an address in the same text). A term whose
pointwise mutual information with these frames exceeds the disclosure threshold reveals a family; a term that
exceeds it with "stands before or behind a family" reveals a given name. A mention is a given name or initial
with a family, and is generalised to a placeholder. The thresholds decide about mentions without a frame of
their own; one that its own frame reveals (a title before both words, an initial, the local part of an address)
counts whatever else its family word stands for in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut_lineage

#: Endings that make an address-like string the name of a file.
FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp bmp ico pdf md txt js ts css html htm json yaml yml zip gz mp3 mp4 mov py sh".split())
#: Words before a name that belong to a person.
TITLES = frozenset(
    "Dr Prof Mr Mrs Ms Miss Mx Sir Dame Frau Herr Fr Hr Mme Mlle Madame Monsieur Señor Señora Sr Sra Don Doña Dipl Ing".split()
)

_AT = r"(?:@|&\#64;|[ ]?[\[({][ ]?(?:at|AT)[ ]?[\])}][ ]?)"
_DOT = r"(?:\.|[ ]?[\[({][ ]?(?:dot|DOT)[ ]?[\])}][ ]?|[ ](?:dot|DOT)[ ])"
_SPELLED_DOT = r"(?:[ ]?[\[({][ ]?(?:dot|DOT)[ ]?[\])}][ ]?|[ ](?:dot|DOT)[ ])"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_LOCAL = r"(?<![\w.+%-])[^\W_](?:[\w.+%-]*[\w+%-])?"
EMAIL = re.compile(
    rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}(?P<end>[^\W\d_]{{2,24}})"
    rf"|[ ](?:at|AT)[ ]{_LABEL}(?:\.{_LABEL})*{_SPELLED_DOT}(?:{_LABEL}{_DOT})*[^\W\d_]{{2,24}})(?![\w@-])"
)

PHONE = re.compile(
    r"(?<![\w+./-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,12})){1,6}"
    r"|00[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}"
    r"|(?:1[ .-])?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?[2-9]\d{2}([.-])\d{3}\1\d{4}"
    r"|1[2-9]\d{9}"
    r"|0[1-9](?:[ .-]?\d{2}){4}"
    r"|0[1-9]\d{2,4}[ ]\d{5,7}"
    r"|0[1-9]\d{1,3}[ ]\d{3,4}[ ]\d{3,4}"
    r"|0[1-9]\d{1,4}[/]\d{4,9}(?:[ -]?\d{1,5})?"
    r"|\(0[1-9]\d{1,4}\)[ ]?\d{3,8}(?:[ -]?\d{2,5})*"
    r")(?![\w/-]|\.\d)"
)

ID_NUMBER = re.compile(
    r"(?<![\w+./-])(?<!\d )(?:"
    r"\d{3}([ -])\d{2}\1\d{4}"
    r"|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}"
    r"|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"
    r"|[A-Z]{1,2}\d{7}"
    r")(?![\w/-]|[ ]\d{2}|\.\d)"
)

_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
_STREET = (
    r"(?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.|Boulevard|Blvd\.?|Court|Ct\.|Place|Pl\.|Square|Sq\.|Way|Terrace|Close"
    r"|Crescent|Row|Quay|Walk|Gardens|Parade|Alley)"
)
_UNIT = r"(?:,?[ ](?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Room|Whg|Appt)\.?[ ]\#?[\w-]+)?"
_TOWN = rf"(?:(?:New|Old|Saint|St\.|Sankt|Bad|San|Santa|Los|Las|Le|La|Port|Fort|Upper|Lower|Great|Little)[ ])?{_CAP}(?:[ ](?:am|an[ ]der|upon|on|sur|in)[ ](?:the[ ])?{_CAP})?"
_POST = r"(?:,?[ ](?:[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}|(?:[A-Z]{2}[ ])?\d{5}(?:-\d{4})?)(?!\w))?"
ADDRESS = re.compile(
    rf"(?<![\w.-])(?:"
    rf"\d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}{_STREET}(?![\w]){_UNIT},[ ]{_TOWN}{_POST}"
    rf"|(?:{_CAP}[ ]){{1,3}}{_STREET}[ ]\d{{1,5}}[A-Za-z]?{_UNIT},[ ]{_TOWN}{_POST}"
    rf"|[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm)[ ]\d{{1,4}}[ ]?[a-z]?{_UNIT},[ ](?:\d{{5}}[ ])?{_TOWN}"
    rf"|\d{{1,5}}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|calle|via)[ ]"
    rf"(?:(?:du|de[ ]la|des|de|d[’'])[ ]?)?(?:l[’'])?{_CAP}(?:[ ]{_CAP}){{0,3}}{_UNIT},[ ](?:\d{{5}}[ ])?{_TOWN}"
    rf")"
)

#: A text without any of these, or without a comma, has no address.
_STREET_HINTS = (
    "Street", "St.", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr.", "Boulevard", "Blvd", "Court", "Ct.", "Place", "Pl.", "Square", "Sq.", "Way", "Terrace", "Close",
    "Crescent", "Row", "Quay", "Walk", "Gardens", "Parade", "Alley", "straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ufer", "damm", "rue ", "avenue ",
    "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "route ", "calle ", "via ",
)
_digit = re.compile(r"\d").search
_bracketed_at = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]").search

#: A capitalised word, perhaps joined by hyphens or an apostrophe, or an initial.
_TERM = re.compile(r"(?<![\w’'-])(?:[^\W\d_a-zß-öø-ÿ]\.(?=[ ])|[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[’'-][^\W\d_]+)*)")


def fold(term: str) -> str:
    """Letters of a term without accents, in lower case, as addresses write it."""
    plain = unicodedata.normalize("NFKD", term.lower().replace("ø", "").replace("ß", "ss"))
    return "".join(c for c in plain if c.isalpha() and c.isascii())


def structured(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of what has a form of its own, in order and without overlaps; the longer kind first."""
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, begin: int, end: int) -> None:
        if all(end <= a or begin >= b for a, b in taken):
            taken.append((begin, end))
            found.append((kind, begin, end))

    if "@" in text or "&#64;" in text or "dot" in text or "DOT" in text or _bracketed_at(text):
        for m in EMAIL.finditer(text):
            if (m["end"] or "").lower() not in FILE_ENDINGS:
                add("email", m.start(), m.end())
    if _digit(text):
        if "," in text and any(x in text for x in _STREET_HINTS):
            for m in ADDRESS.finditer(text):
                add("address", m.start(), m.end())
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                add("phone", m.start(), m.end())
        for m in ID_NUMBER.finditer(text):
            add("id_number", m.start(), m.end())
    return sorted(found, key=lambda x: x[1])


def name_candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int, bool, bool, int]]:
    """(first, second, begin, end, framed, leads, own): terms, and neighbouring terms that could be a name.

    ``second`` is the possible family, ``first`` the possible given name, '' for an initial; a term alone has
    begin = end. ``framed`` tells that the place reveals a person, ``leads`` that the term alone stands right
    before another, as given names do. ``own`` tells what the frame says of this mention: 2 that it is a person, 1
    that it is one unless its terms are plain words ('Plan B. Then', 'Sr. Software Engineer'), 0 nothing certain.
    """
    terms = [m for m in _TERM.finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
    local = {fold(x) for kind, a, b in spans if kind == "email" for x in re.split(r"[^\w-]|_|\d", re.split(_AT + r"|[ ](?:at|AT)[ ]", text[a:b])[0])}
    starts = {a: kind for kind, a, b in spans}
    out = []
    for k, m in enumerate(terms):
        word = m.group()
        initial = word.endswith(".")
        before = terms[k - 1] if k else None
        after = terms[k + 1] if k + 1 < len(terms) else None
        gap = text[m.end() : after.start()] if after is not None else ""
        title = word.rstrip(".") in TITLES
        leads = gap == " " and not after.group().endswith(".") and not title
        if not initial:
            framed = not leads and (_titled(text, m.start(), before) or fold(word) in local)
            out.append(("", word, m.start(), m.start(), framed, leads, 0))
        if leads:
            titled = _titled(text, m.start(), before)
            framed = initial or titled or _beside_contact(text, after.end(), starts)
            sure = initial and titled or _in_address(word, after.group(), local)
            own = 2 if sure else 1 if titled or initial and not _counts_off(text, m.start(), before) else 0
            out.append(("" if initial else word, after.group(), m.start(), after.end(), framed, False, own))
        elif gap == ", " and not initial:
            other = "" if after.group().endswith(".") else after.group()
            own = 2 if _in_address(after.group(), word, local) else 0
            if not own and not other:
                further = terms[k + 2].start() if k + 2 < len(terms) else -1
                own = int(text[after.end() : further] != " " if further >= 0 else True)
            out.append((other, word, m.start(), after.end(), _titled(text, m.start(), before) or not other, False, own))
    return out


def _titled(text: str, begin: int, before: re.Match | None) -> bool:
    """Whether a title stands right before a place."""
    if before is None:
        return False
    gap = text[before.end() : begin]
    return before.group().rstrip(".") in TITLES and gap in (" ", ". ")


def _in_address(given: str, family: str, local: set[str]) -> bool:
    """Whether the local part of an address in the text has the family and the given name, or the initial, as written."""
    first, last = fold(given), fold(family)
    if not first or not last:
        return False
    return last in local and first in local or first + last in local


def _counts_off(text: str, begin: int, before: re.Match | None) -> bool:
    """Whether a capitalised word or a number stands right before an initial, as in 'Plan B.'; another initial doesn't count."""
    if begin > 1 and text[begin - 1] == " " and text[begin - 2].isdigit():
        return True
    return before is not None and text[before.end() : begin] == " " and not before.group().endswith(".")


def _beside_contact(text: str, end: int, starts: dict[int, str]) -> bool:
    """Whether an e-mail address or phone number follows within a few signs."""
    return any(starts.get(end + k) in ("email", "phone") and not any(c.isalnum() for c in text[end : end + k]) for k in range(1, 5))


_FOUND = "array<struct<kind:string,begin:int,end:int,value:string>>"
_PAIRS = "array<struct<first:string,second:string,begin:int,end:int,framed:boolean,own:int,value:string>>"
_TERMS = "array<struct<term:string,n:int,framed:int,leads:int>>"


def counted(candidates: list[tuple[str, str, int, int, bool, bool, int]]) -> list[dict]:
    """Terms by themselves with how often a text has them, in a frame and before another: all that is asked of them."""
    terms: dict[str, list[int]] = {}
    for _, term, begin, end, framed, leads, _ in candidates:
        if begin == end:
            row = terms.setdefault(term, [0, 0, 0])
            row[0] += 1
            row[1] += framed
            row[2] += leads
    return [{"term": t, "n": n, "framed": framed, "leads": leads} for t, (n, framed, leads) in terms.items()]


def _last(loaded_at: str = "loaded_at", tie: Column | str = "tie") -> Column:
    """What the deliveries of a record are ordered by; of those loaded at one time the same holds wherever it is asked."""
    return F.struct(F.coalesce(F.col(loaded_at).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")), tie)


def inspect(records: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``found``, ``pairs``, ``terms``): spans with a form, pairs that could be names and counts of terms, of each record's last delivery.

    A delivery with a null or empty text counts as any other: if it is the last, the record has nothing.
    """
    kind = records.schema[key].dataType.simpleString()
    when = records.schema["loaded_at"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    pair_type = pa.list_(
        pa.struct(
            [("first", pa.string()), ("second", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]
            + [("framed", pa.bool_()), ("own", pa.int32()), ("value", pa.string())]
        )
    )
    term_type = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32()), ("framed", pa.int32()), ("leads", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, pairs, terms = [], [], []
            for body in batch.column(3).to_pylist():
                spans = structured(body) if body else []
                names = name_candidates(body, spans) if body else []
                found.append([{"kind": k, "begin": a, "end": b, "value": body[a:b]} for k, a, b in spans])
                pairs.append(
                    [
                        {"first": x, "second": y, "begin": a, "end": b, "framed": framed, "own": own, "value": body[a:b]}
                        for x, y, a, b, framed, _, own in names
                        if b > a
                    ]
                )
                terms.append(counted(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(found, found_type), pa.array(pairs, pair_type), pa.array(terms, term_type)],
                names=[key, "loaded_at", "tie", "found", "pairs", "terms"],
            )

    rows = (
        records.filter(F.col(key).isNotNull())
        .select(F.col(key), F.col("loaded_at"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
        .mapInArrow(run, f"{key} {kind}, loaded_at {when}, tie bigint, found {_FOUND}, pairs {_PAIRS}, terms {_TERMS}")
    )
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct("found", "pairs", "terms"), _last()).alias("x"))
        .select(key, "x.found", "x.pairs", "x.terms")
    )


def _disclosure(together: Column, term: Column, frame: Column, every: Column) -> Column:
    """Pointwise mutual information in bits; null where they never meet."""
    return F.when(together > 0, F.log2(together * every / (term * frame)))


def family_terms(alone: DataFrame, pairs: DataFrame, threshold: float, least_share: float) -> DataFrame:
    """(``term``, ``bits``): terms that reveal a family by the frames they occur in.

    ``alone``: (term, n, framed, leads), counts of all terms; ``pairs``: (second, framed). ``threshold`` is a share of
    the most a frame can tell, minus the logarithm of how frequent frames are. ``least_share`` of a term's own
    occurrences must be framed, so that a frequent word isn't taken for a name because of a stray frame, and at most
    half of them may lead another term. Pairs count for their second term, beside the term alone.
    """
    of_pairs = pairs.filter("framed").groupBy(F.col("second").alias("term")).agg(F.count("*").alias("framed"))
    none = F.lit(0).cast("long")
    uses = alone.select("term", "n", "framed", "leads").unionByName(of_pairs.select("term", none.alias("n"), "framed", none.alias("leads")))
    uses = uses.groupBy("term").agg(F.sum("n").alias("n"), F.sum("framed").alias("framed"), F.sum("leads").alias("leads"))
    totals = uses.agg(F.sum("n").alias("all"), F.sum("framed").alias("frames"))
    every, frames = totals.select("all").scalar(), totals.select("frames").scalar()
    bits = _disclosure(F.col("framed"), F.col("n"), frames, every)
    return (
        uses.filter(F.col("n") > 0)
        .select("term", "n", "framed", "leads", bits.alias("bits"))
        .filter(F.col("leads") * 2 <= F.col("n"))
        .filter((F.col("bits") >= -F.log2(frames / every) * threshold) & (F.col("framed") >= F.col("n") * least_share))
        .select("term", "bits")
    )


def given_terms(with_family: DataFrame, alone: DataFrame, threshold: float, least_share: float) -> DataFrame:
    """(``term``, ``bits``): terms that reveal a given name by standing with families, as the pairs of ``with_family`` do."""
    uses = alone.select("term", "n")
    met = with_family.filter(F.col("first") != "").groupBy(F.col("first").alias("term")).agg(F.count("*").alias("together"))
    every = uses.agg(F.sum("n")).scalar()
    framed = met.agg(F.sum("together")).scalar()
    return (
        met.join(uses, "term")
        .select("term", "n", "together", _disclosure(F.col("together"), F.col("n"), framed, every).alias("bits"))
        .filter((F.col("bits") >= -F.log2(framed / every) * threshold) & (F.col("together") >= F.col("n") * least_share))
        .select("term", "bits")
    )


def own_frames(pairs: DataFrame, families: DataFrame, records: DataFrame, text: str) -> DataFrame:
    """The pairs that their own frame reveals, whatever the thresholds say of their terms.

    A pair with a doubtful frame counts unless each of its terms is also a plain word, written in lower case
    somewhere in the corpus, or its first term is a family, learned or by its place in most framed pairs, and its
    second isn't learned ('Dr. Family Foundry'). The texts are read for plain words only if there is such a pair.
    """
    framed = pairs.filter(F.col("own") > 0)
    known = families.select(F.col("term").alias("second"), F.lit(True).alias("family"))
    framed = cut_lineage(framed.join(known, "second", "left"))
    settled = framed.filter((F.col("own") == 2) | F.col("family")).select(*pairs.columns)
    doubtful = framed.filter((F.col("own") == 1) & F.col("family").isNull()).select(*pairs.columns)
    if doubtful.isEmpty():
        return settled
    asked = doubtful.select(F.explode(F.array(F.lower("first"), F.lower("second"))).alias("word")).filter("word <> ''").distinct()
    words = records.select(F.explode(F.array_distinct(F.split(F.col(text), r"[^\p{L}]+"))).alias("word")).filter(F.col("word") == F.lower("word"))
    plain = cut_lineage(words.join(asked, "word", "left_semi").distinct())
    last = (
        framed.select(F.explode(F.array(F.struct(F.col("first").alias("term"), F.lit(-1).alias("n")), F.struct(F.col("second").alias("term"), F.lit(1).alias("n")))).alias("x"))
        .groupBy("x.term")
        .agg(F.sum("x.n").alias("n"))
        .filter("n > 0")
    )
    families = families.select("term").unionByName(last.select("term")).distinct()
    firsts, seconds = plain.select(F.col("word").alias("a"), F.lit(True).alias("plain_first")), plain.select(F.col("word").alias("b"), F.lit(True).alias("plain_second"))
    revealed = (
        doubtful.join(families.select(F.col("term").alias("first")), "first", "left_anti")
        .join(firsts, F.lower("first") == F.col("a"), "left")
        .join(seconds, F.lower("second") == F.col("b"), "left")
        .filter(F.col("plain_second").isNull() | ((F.col("first") != "") & F.col("plain_first").isNull()))
    )
    return settled.unionByName(revealed.select(*pairs.columns))


def find_names(
    seen: DataFrame, key: str, records: DataFrame, text: str, threshold: float = 0.27, family_share: float = 0.05, given_share: float = 0.5
) -> DataFrame:
    """(``key``, ``begin``, ``end``, ``value``) of the names among the candidates of ``seen``, read from ``text`` of ``records``."""
    candidates = seen.select(F.col(key), F.explode("pairs").alias("c")).select(key, "c.*")
    terms = seen.select(F.explode("terms").alias("t")).groupBy("t.term")
    alone = cut_lineage(terms.agg(*[F.sum(f"t.{c}").alias(c) for c in ("n", "framed", "leads")]))
    families = cut_lineage(family_terms(alone, candidates.select("second", "framed"), threshold, family_share))
    pairs = candidates.select(key, "first", "second", "begin", "end", "value", "own")
    revealed = cut_lineage(own_frames(pairs, families, records, text))
    learned = pairs.join(families.select(F.col("term").alias("second")), "second", "left_semi")
    places = [key, "begin", "end", "value"]
    firsts = learned.select("first", *places).unionByName(revealed.select("first", *places)).dropDuplicates([key, "begin", "end"])
    givens = given_terms(firsts, alone, threshold, given_share)
    either = families.select(F.col("term").alias("second")).unionByName(revealed.select("second")).distinct()
    with_given = (
        pairs.filter(F.col("first") != "")
        .join(either, "second", "left_semi")
        .join(givens.select(F.col("term").alias("first")), "first", "left_semi")
    )
    with_initial = learned.filter(F.col("first") == "")
    every = with_initial.select(*places).unionByName(with_given.select(*places)).unionByName(revealed.select(*places))
    return every.dropDuplicates([key, "begin", "end"])


def find_personal(records: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(``key``, ``kind``, ``begin``, ``end``, ``value``): personal information of each record, in characters of its text.

    Kinds are 'email', 'phone', 'id_number', 'address' and 'name'. Of several deliveries of a record
    (``loaded_at``) the last counts. Null and empty texts have none, rows without a key are left out, an empty
    table gives an empty result. Texts are read where they lie; only spans and candidate terms are shuffled, and
    the learned terms are joined, not broadcast, however many they become.
    """
    seen = cut_lineage(inspect(records, key, text))
    formed = seen.select(F.col(key), F.explode("found").alias("x")).select(key, "x.kind", "x.begin", "x.end", "x.value")
    names = find_names(seen, key, records, text, **options).select(key, F.lit("name").alias("kind"), "begin", "end", "value")
    return formed.unionByName(names)


def redact(records: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(``key``, ``redacted``): the last delivery of each record with placeholders such as [EMAIL] and [NAME].

    Overlapping names (as in "A B, C D") are replaced once, from the first on. Null and empty texts stay, also
    where an older delivery had a text; spans and text come from the same delivery. The texts are shuffled once.
    """
    spans = find_personal(records, key, text, **options)
    by_record = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "kind"))).alias("spans"))
    last = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(text).alias("text")), _last(tie=F.xxhash64(text))).alias("x"))
    body = F.coalesce("x.text", F.lit(""))
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["begin"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.substring(body, acc["at"] + 1, s["begin"] - acc["at"]),
                    F.lit("["),
                    F.upper(s["kind"]),
                    F.lit("]"),
                ).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    joined = last.join(by_record, key, "left").withColumn("s", step)
    done = F.concat(F.col("s.out"), F.substring(body, F.col("s.at") + 1, F.length(body)))
    return joined.select(key, F.when(F.col("spans").isNull(), F.col("x.text")).otherwise(done).alias("redacted"))
