"""Problem 4: one form for strings that look the same.

Method: a longest-match transducer over grapheme clusters. Its mapping is computed once from Unicode rules
(widths, canonical composition, blanks, joined letters) and a fixed list of look-alike letters: every letter, in each
script it can come from, with every mark it can carry, is a key of its own, and no two keys disagree. The keys are
compiled into a trie, and a string is rewritten in one pass, each cluster (a base with its marks) by the longest
key. Case, accents that are there or not, raised digits, hyphens and letters such as œ stay apart.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut_lineage
from foliograph.sources import present

#: Letters of other scripts that look like a Latin one, by the Latin one.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ",
    "L": "Ꮮ", "M": "МΜᎷϺ", "N": "ΝᏁ", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ",
    "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уүγ",
    "ç": "ҫ", "ë": "ё", "ï": "їϊ", "Ë": "Ё", "Ï": "ЇΪ", "Ÿ": "Ϋ", "ä": "ӓ", "Ä": "Ӓ", "ö": "ӧ", "Ö": "Ӧ", "ó": "ό", "ă": "ӑ", "Ă": "Ӑ", "æ": "ӕ", "Æ": "Ӕ",
    "í": "ί", "Á": "Ά", "É": "Έ", "Ó": "Ό", "Í": "Ί", "ĕ": "ӗ", "Ĕ": "Ӗ", "è": "ѐ", "È": "Ѐ", "ə": "ә", "Ə": "Ә",
}

#: Compatibility forms that change width or join letters, as against those that raise, circle or square them.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
_JOINED = ("ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "Ǆ", "ǅ", "ǆ", "Ǉ", "ǈ", "ǉ", "Ǌ", "ǋ", "ǌ", "Ǳ", "ǲ", "ǳ", "Ĳ", "ĳ")
_MATH_LOOK = ("<font>",)

#: Characters without width besides those of category Cf.
_NO_WIDTH = frozenset(map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0)))


def _compatible(c: str) -> str | None:
    """What a character stands for if only its width, kind of blank or joining differs."""
    category = unicodedata.category(c)
    if c in _NO_WIDTH or category == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    if category in ("Zs", "Zl", "Zp") or c == "\x85":
        return " "
    if category == "Cc":
        return ""
    if c in _JOINED:
        return unicodedata.normalize("NFKC", c)
    rule = unicodedata.decomposition(c)
    if rule.startswith(_SAME_LOOK) or (rule.startswith(_MATH_LOOK) and c not in "ℏ"):
        return "".join(chr(int(x, 16)) for x in rule.split()[1:])
    return None


def _singles() -> dict[str, str]:
    """What every single character stands for, in final form."""
    table: dict[str, str] = {}
    for latin, others in LOOKALIKES.items():
        for other in others:
            if table.setdefault(other, latin) != latin:
                raise ValueError(f"{other!r} is mapped twice")
    for c in map(chr, (*range(0x20), *range(0x7F, 0xD800), *range(0xE000, sys.maxunicode + 1))):
        if c not in table and (to := " " if c in "\t\n\r\x0b\x0c" else _compatible(c)) is not None:
            table[c] = to
    # What a rule leads to may itself be a look-alike, such as a bold Greek letter.
    return {c: "".join(table.get(x, x) for x in to) for c, to in table.items()}


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Keys of one or more code points, fully decomposed, and their final form; checked for conflicts.

    Beside single characters there is a key for each composed letter with its base in any of the scripts it can come
    from, so that no form depends on whether a mark was typed by itself.
    """
    singles = _singles()
    origins: dict[str, list[str]] = {}
    for c, to in singles.items():
        if len(to) == 1:
            origins.setdefault(to, []).append(c)
    keys: dict[str, str] = {}

    def add(source: str, to: str) -> None:
        source = unicodedata.normalize("NFD", source)
        if source != to and keys.setdefault(source, to) != to:
            raise ValueError(f"{source!r} stands for {keys[source]!r} and for {to!r}")

    for c, to in singles.items():
        add(c, to)
    for c in map(chr, (*range(0xC0, 0xAC00), *range(0xF900, 0xFB50))):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            base = singles.get(parts[0], parts[0])
            final = singles.get(c, unicodedata.normalize("NFC", base + parts[1:]))
            for first in {parts[0], base, *origins.get(base, ())}:
                if len(unicodedata.normalize("NFD", first)) == 1:
                    add(first + parts[1:], final)
    return keys


class _Trie:
    """Keys by their characters; a node is [form of the key that ends here, children]."""

    def __init__(self, keys: dict[str, str]):
        self.root: dict[str, list] = {}
        for key, to in keys.items():
            level, node = self.root, [None, {}]
            for c in key:
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = to

    def rewrite(self, text: str) -> str:
        """One pass over the decomposed text; the longest key at each place, else the character itself."""
        text = unicodedata.normalize("NFD", text)
        root = self.root
        out: list[str] = []
        at, end = 0, len(text)
        while at < end:
            level, best, k = root, text[at], at
            done = at + 1
            while k < end and (node := level.get(text[k])) is not None:
                k += 1
                if node[0] is not None:
                    best, done = node[0], k
                level = node[1]
            out.append(best)
            at = done
        return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=1)
def transducer() -> _Trie:
    """The compiled mapping; every form is its own form."""
    trie = _Trie(mapping())
    for key, to in mapping().items():
        if trie.rewrite(to) != unicodedata.normalize("NFC", to):
            raise ValueError(f"conflict at {key!r}")
    return trie


def one_form(text: str | None) -> str | None:
    """The form all strings that look like ``text`` have; null stays null."""
    if text is None or text.isascii() and text.isprintable():
        return text
    return transducer().rewrite(text)


#: Printable ASCII is its own form and never leaves the JVM.
_PLAIN = r"^[ -~]*\z"


def odd_forms(texts: DataFrame) -> DataFrame:
    """(``text``, ``form``) of each distinct string of ``texts`` (text) that isn't printable ASCII; each is rewritten once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array(map(one_form, batch.column(0).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms], names=["text", "form"])

    return texts.select("text").filter(~F.col("text").rlike(_PLAIN)).distinct().mapInArrow(run, "text string, form string")


def look_alike_pairs(entries: DataFrame, links: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(``kind``, ``id_lo``, ``id_hi``): entries with entries, and entries with pages' links, that look the same.

    ``entries``: (scope, id, text); ``links``: (scope, id, text), one row per distinct link of a page; ``texts``:
    (text), all strings of both and perhaps more, if they can be had cheaper. Only strings that differ although
    their form is the same make a pair, each once, within a scope. Null and empty strings and null scopes or ids are
    no values. Of two such strings at least one isn't its own form, so only strings that aren't, and their forms,
    are looked for among titles and links: a pair of equal strings never arises.
    """

    def clean(df: DataFrame, side: str) -> DataFrame:
        ok = present(F.col("text")) & F.col("scope").isNotNull() & F.col("id").isNotNull()
        return df.filter(ok).select("scope", F.col("id").cast("long").alias("id"), "text", F.lit(side).alias("side"))

    every = clean(entries, "title").unionByName(clean(links, "link"))
    changed = cut_lineage(odd_forms(every if texts is None else texts).filter((F.col("form") != F.col("text")) & (F.col("form") != "")))
    wanted = changed.unionByName(changed.select(F.col("form").alias("text"), "form").distinct())
    met = cut_lineage(every.join(wanted, "text").distinct())
    mixed = (
        met.groupBy("scope", "form")
        .agg(F.min("text").alias("first"), F.max("text").alias("last"), F.max((F.col("side") == "title").cast("int")).alias("titled"))
        .filter((F.col("first") != F.col("last")) & (F.col("titled") == 1))
        .select("scope", "form")
    )
    kept = met.join(mixed, ["scope", "form"], "left_semi")
    titles = kept.filter(F.col("side") == "title").select("scope", "form", F.col("id").alias("id_lo"), F.col("text").alias("text_lo"))
    both = titles.join(kept.select("scope", "form", F.col("id").alias("id_hi"), "text", "side"), ["scope", "form"])
    differ = F.col("text") != F.col("text_lo")
    ordered = (F.col("side") == "link") | (F.col("id_lo") < F.col("id_hi"))
    kind = F.when(F.col("side") == "title", "title_title").otherwise("link_title")
    return both.filter(differ & ordered).select(kind.alias("kind"), "id_lo", "id_hi").distinct()
