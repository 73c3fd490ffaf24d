r"""Text of outliner pages as column expressions.

Blanks are those of ``BLANK`` (the Unicode blanks a browser engine trims), not the ASCII ones of ``trim``. Lines
end in ``\n`` unless a function says otherwise; a line that ends in ``\r`` is no property line. All functions
take and return columns and stay in the JVM, but for letters outside ASCII in :func:`route_slug`.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code points of blanks; those that end a line for a pattern.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
LINE_ENDS = (0x0A, 0x0D, 0x2028, 0x2029)


def _class(codes) -> str:
    return "".join(rf"\u{c:04X}" for c in codes)


BLANK = f"[{_class(BLANKS)}]"
LINE_BLANK = f"[{_class(c for c in BLANKS if c != 0x0A)}]"
IN_LINE = f"[^{_class(LINE_ENDS)}]"

#: The patterns of links and properties.
LINK = r"\[\[([^\[\]|]+?)(?:\|[^\]]+)?\]\]"
LINK_PARTS = r"\[\[([^\[\]|]+?)(?:\|([^\]]+))?\]\]"
JOURNAL_DAY = r"^\d{4}-\d{2}-\d{2}\z"
LEADING_KEY = r"[a-z][a-z0-9_-]*::[^\n]*"
PROPERTY = rf"[A-Za-z0-9_-]+::{IN_LINE}+"

#: Entities and what they stand for, in the order they are replaced.
ENTITIES = {
    "&sect;": "§", "&mdash;": "—", "&ndash;": "–", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&middot;": "·", "&hellip;": "…", "&amp;": "&",
}

#: What a page's file name writes for a character of its title; each alone, in this order.
FILE_ENCODINGS = (("/", "___"), (":", "%3A"), ("?", "%3F"), ('"', "%22"))


def _literal(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def java_free(pattern: str) -> str:
    """A pattern of this module for Python's expressions, which name code points alike and end a text with ``\\Z``."""
    return pattern.replace(r"\z", r"\Z")


def strip_blank(c: Column) -> Column:
    """Without the blanks at both ends."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def lines_of(c: Column) -> Column:
    """Lines, ended by a line feed."""
    return F.split(c, "\n", -1)


def any_lines_of(c: Column) -> Column:
    """Lines, ended by a line feed with or without a carriage return."""
    return F.split(c, "\r?\n", -1)


def decode_entities(c: Column) -> Column:
    """The nine entities that titles are written with; the ampersand last, so nothing is decoded twice."""
    for old, new in ENTITIES.items():
        c = _literal(c, old, new)
    return c


def escape_html(c: Column) -> Column:
    """``& < > "`` as entities."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = _literal(c, old, new)
    return c


def _compatible(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text)


_compatible_udf = F.udf(_compatible, StringType(), useArrow=True)


def route_slug(title: Column) -> Column:
    """The slug a page's address is made of: at most 80 letters, digits, hyphens and underscores.

    Lower case comes before decomposition, as addresses in use rely on it.
    """
    low = F.lower(title)
    plain = low.rlike(r"\A[\x00-\x7F]*\z")
    flat = F.when(plain, low).otherwise(_compatible_udf(F.when(~plain, low)))
    c = _literal(flat, "§", "section")
    c = F.regexp_replace(c, rf"(?:(?![A-Za-z0-9_-])(?!{BLANK}).)+", "")
    c = F.regexp_replace(c, rf"{BLANK}+", "-")
    c = F.regexp_replace(c, "-+", "-")
    return F.substring(F.regexp_replace(c, r"\A-|-\z", ""), 1, 80)


def region_slug(text: Column) -> Column:
    """The id of a heading without one of its own."""
    c = F.regexp_replace(F.lower(text), "['’]", "")
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def key_slug(text: Column, length: int = 60) -> Column:
    """The part of a log key that names an entry."""
    c = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.substring(c, 1, length)


def vault_title(title: Column) -> Column:
    """A title that can be a file name."""
    c = _literal(title, " / ", ", ")
    c = F.regexp_replace(c, r"[/\\]", "-")
    c = _literal(c, ":", " -")
    c = F.regexp_replace(c, r'[*?"<>|]', "")
    return strip_blank(F.regexp_replace(c, rf"{BLANK}+", " "))


def file_candidates(title: Column) -> Column:
    """The names a page's file can have without ending, best first."""
    return F.array(title, *[_literal(title, old, new) for old, new in FILE_ENCODINGS])


def file_stem(file: Column) -> Column:
    """A file name without the ending of a page."""
    return F.regexp_replace(file, r"\.mdx?\z", "")


def links(content: Column) -> Column:
    """Titles a text links to, decoded, in the order they first come; none longer than 199."""
    titles = F.transform(F.regexp_extract_all(content, F.lit(LINK), F.lit(1)), lambda t: decode_entities(strip_blank(t)))
    return F.array_distinct(F.filter(titles, lambda t: F.length(t).between(1, 199)))


def without_leading_properties(content: Column) -> Column:
    """The text behind the leading ``key::`` lines; the whole text if it doesn't begin with one."""
    block = rf"\A(?:{LINE_BLANK}*\n)*(?:{LEADING_KEY}(?:\n|\z))+(?:{LINE_BLANK}*(?:\n|\z))*"
    return F.regexp_replace(content, block, "")


def property_block(content: Column) -> Column:
    """The leading property lines, as one text."""
    return F.regexp_extract(content, rf"\A(?:{LINE_BLANK}*\n)*((?:{PROPERTY}(?:\n|\z))*)", 1)


def properties(content: Column) -> Column:
    """The leading properties as a map; of a key that comes twice the last holds."""
    rows = F.filter(lines_of(property_block(content)), lambda x: x != "")
    pairs = F.transform(
        rows, lambda x: F.struct(F.regexp_extract(x, "^([^:]+)::", 1).alias("key"), strip_blank(F.regexp_extract(x, r"^[^:]+::(.*)\z", 1)).alias("value"))
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def property_body(content: Column) -> Column:
    """The text behind the leading properties and the blank line after them."""
    block = rf"\A(?:{LINE_BLANK}*\n)*(?:(?:{PROPERTY}(?:\n|\z))+(?:{LINE_BLANK}*(?:\n|\z))?)?"
    return F.regexp_replace(content, block, "")


def first_property(content: Column, key: str) -> Column:
    """The first ``key::`` at the start of a line anywhere; null if there is none or it is empty.

    Blanks after the colons may be line ends, so an empty property takes the next line's text.
    """
    found = strip_blank(F.regexp_extract(content, rf"(?md)^{key}::{BLANK}*({IN_LINE}+)$", 1))
    return F.when(found != "", found)


def tags(content: Column) -> Column:
    """The tags of a page: its linked ones if any, else those between commas."""
    raw = F.coalesce(first_property(content, "tags"), F.lit(""))
    linked = links(raw)
    listed = F.filter(F.transform(F.split(raw, ",", -1), strip_blank), lambda t: t != "")
    return F.when(F.size(linked) > 0, linked).otherwise(listed)


def image_assets(body: Column) -> Column:
    """File names of the graph's own images that a text embeds."""
    refs = F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    local = F.filter(refs, lambda r: r.rlike(r"\A(?:(?:\.\.|\.)/)*assets/.+"))
    return F.array_distinct(F.filter(F.transform(local, lambda r: F.element_at(F.split(r, "/"), -1)), lambda f: f != ""))


def normalized(body: Column) -> Column:
    """A text as it is compared: single blanks, no blanks at the ends of lines, no empty lines."""
    c = F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), r"[ \t]+", " ")
    c = F.regexp_replace(c, rf"(?md)^{LINE_BLANK}+|{LINE_BLANK}+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n"), r"\A\n+|\n+\z", "")


def content_hash(body: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a normalized text."""
    return F.substring(F.sha2(normalized(body), 256), 1, 16)


def json_quote(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1))


def share(part: Column, whole: Column) -> Column:
    """A ratio; null if there is nothing to compare with."""
    return F.when(whole > 0, part / whole)
