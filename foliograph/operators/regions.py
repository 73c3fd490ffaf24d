"""Named regions of pages: heading sections and fenced blocks, as line intervals.

Lines count from 0 and intervals include both ends. Everything is computed within a row from the array of its
lines, so no page is shuffled and hot pages don't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions.stages import staged

#: The forms of anchors.
HEADING = r"^(#{1,6})\s+(.+?)\s*\z"
SECTION_HEADING = r"^\s*<SectionHeading\b[^>]*/>\s*\z"
COMMENT_OPEN = r"^<!--\s*region:\s*([A-Za-z0-9_-]+)\s*-->\s*\z"
COMMENT_CLOSE = r"^<!--\s*/region\s*-->\s*\z"
COMPONENT_OPEN = r"""^\s*<Region\s+name=["']([A-Za-z0-9_-]+)["']\s*>\s*\z"""
COMPONENT_CLOSE = r"^\s*</Region>\s*\z"
ID_ATTRIBUTE = r"""\bid=["']([A-Za-z0-9_-]+)["']"""
LEVEL_ATTRIBUTE = r"""\blevel=["']?(\d)["']?"""
SOURCE_ATTRIBUTE = r"""\bsource=["']([^"']+)["']"""
PROJECTED_ANCHOR = r"<(?:Region|SectionHeading)\b[^>]*\bprojected\b"
PROJECTED_COMMENT = r"^<!--\s*projected:\s*(.*?)-->\s*\z"
PREVIEW = 72
REGIONS = "array<struct<id:string,kind:string,level:int,body_start:int,body_end:int,span_start:int,span_end:int>>"


def headings(lines: Column) -> Column:
    """Headings among lines: array of (``line``, ``level``, ``id``)."""
    level = lambda x: F.when(x.rlike(HEADING), F.length(F.regexp_extract(x, HEADING, 1))).when(
        x.rlike(SECTION_HEADING) & x.rlike(ID_ATTRIBUTE),
        F.when(x.rlike(LEVEL_ATTRIBUTE), F.regexp_extract(x, LEVEL_ATTRIBUTE, 1).cast("int")).otherwise(2),
    )
    name = lambda x: F.when(x.rlike(HEADING), T.region_slug(F.regexp_extract(x, HEADING, 2))).otherwise(
        F.regexp_extract(x, ID_ATTRIBUTE, 1)
    )
    each = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("line"), level(x).alias("level"), name(x).alias("id")))
    return F.filter(each, lambda h: h["level"].isNotNull())


def _sections(lines: Column, found: Column) -> Column:
    """Heading regions: to the line before the next heading of the same or a higher level."""
    last = F.size(lines) - 1

    def region(h: Column) -> Column:
        later = F.filter(found, lambda o: (o["line"] > h["line"]) & (o["level"] <= h["level"]))
        end = F.coalesce(F.array_min(F.transform(later, lambda o: o["line"])) - 1, last)
        return F.struct(
            h["id"].alias("id"),
            F.lit("heading").alias("kind"),
            h["level"].alias("level"),
            (h["line"] + 1).alias("body_start"),
            end.alias("body_end"),
            h["line"].alias("span_start"),
            F.greatest(end, h["line"]).alias("span_end"),
        )

    return F.transform(found, region)


def _fences(lines: Column, opening: str, closing: str) -> Column:
    """Fenced regions: to the first closing line; without one there is no region."""
    marks = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("line"), x.rlike(closing).alias("close"), F.regexp_extract(x, opening, 1).alias("id"))),
        lambda m: m["close"] | (m["id"] != ""),
    )

    def region(o: Column) -> Column:
        close = F.array_min(F.transform(F.filter(marks, lambda m: m["close"] & (m["line"] > o["line"])), lambda m: m["line"]))
        return F.struct(
            o["id"].alias("id"),
            F.lit("fence").alias("kind"),
            F.lit(None).cast("int").alias("level"),
            (o["line"] + 1).alias("body_start"),
            (close - 1).alias("body_end"),
            o["line"].alias("span_start"),
            close.alias("span_end"),
        )

    found = F.filter(F.transform(F.filter(marks, lambda m: m["id"] != ""), region), lambda r: r["span_end"].isNotNull())
    # Most pages have no fence: one test of each line then takes the place of the marks.
    return F.when(F.exists(lines, lambda x: x.rlike(opening)), found).otherwise(F.array().cast(REGIONS))


def body_lines(lines: Column, region: Column) -> Column:
    """The lines of a region's body."""
    size = F.greatest(region["body_end"] - region["body_start"] + 1, F.lit(0))
    return F.slice(lines, region["body_start"] + 1, size)


def preview(lines: Column, region: Column) -> Column:
    """The first line of a region that says something, without decoration."""
    bare = F.transform(
        body_lines(lines, region),
        lambda x: T.strip_blank(F.regexp_replace(F.regexp_replace(x, rf"\A(?:[>#*_`-]|{T.BLANK})+", ""), rf"(?:[*_`~]|{T.BLANK})+\z", "")),
    )
    return F.substring(F.coalesce(F.get(F.filter(bare, lambda x: x != ""), F.lit(0)), F.lit("")), 1, PREVIEW)


def projected_source(lines: Column, region: Column) -> Column:
    """Where a projected region comes from: from its anchor, else from the first line of its body; null if free."""
    anchor = F.get(lines, region["span_start"])
    first = F.get(F.filter(F.transform(body_lines(lines, region), T.strip_blank), lambda x: x != ""), F.lit(0))
    marker = F.when(anchor.rlike(PROJECTED_ANCHOR), anchor).otherwise(F.regexp_extract(first, PROJECTED_COMMENT, 1))
    source = F.regexp_extract(marker, SOURCE_ATTRIBUTE, 1)
    return F.when(source != "", source)


def regions_of(lines: Column) -> Column:
    """All regions of a page: heading sections, then comment fences, then component fences, each in line order."""
    return F.concat(
        _sections(lines, headings(lines)),
        _fences(lines, COMMENT_OPEN, COMMENT_CLOSE),
        _fences(lines, COMPONENT_OPEN, COMPONENT_CLOSE),
    )


def page_regions(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Every region of every page: ``keys``, id, kind, level, body and span lines, preview, source and hash.

    Ids may repeat in a page; (kind, span_start) tells regions apart. Headings inside code fences count.
    """
    rows = with_regions(pages, keys, T.lines_of(F.coalesce(F.col(content), F.lit(""))))
    each = rows.select(*keys, "lines", F.explode("regions").alias("r"))
    r, lines = F.col("r"), F.col("lines")
    return each.select(
        *keys,
        "r.*",
        preview(lines, r).alias("preview"),
        projected_source(lines, r).alias("source"),
        T.content_hash(F.array_join(body_lines(lines, r), "\n")).alias("content_hash"),
    )


def with_regions(pages: DataFrame, keys: list[str], lines: Column, **more: Column) -> DataFrame:
    """``keys``, ``lines``, ``regions`` and ``more`` (columns made from ``lines``), all computed once per page."""
    rows = staged(pages, keys, lines=lines)
    rows = staged(rows, [*keys, "lines"], _heads=headings(F.col("lines")), **more)
    sections = _sections(F.col("lines"), F.col("_heads"))
    every = F.concat(sections, _fences(F.col("lines"), COMMENT_OPEN, COMMENT_CLOSE), _fences(F.col("lines"), COMPONENT_OPEN, COMPONENT_CLOSE))
    return staged(rows, [*keys, "lines", *more], regions=every)


# Editing. Each verb takes the text of a page and one of its regions as columns and returns the new text.


def _eol(content: Column) -> Column:
    return F.when(content.contains("\r\n"), "\r\n").otherwise("\n")


def _joined(content: Column, *parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n") if content is None else F.replace(F.array_join(F.concat(*parts), "\n"), F.lit("\n"), _eol(content))


def _head(lines: Column, n: Column) -> Column:
    return F.slice(lines, F.lit(1), F.greatest(n, F.lit(0)))


def _tail(lines: Column, start: Column) -> Column:
    return F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))


def replace_body(content: Column, region: Column, body: Column) -> Column:
    """A new body; the anchors and the rest of the page stay."""
    lines = T.any_lines_of(content)
    count = F.greatest(region["body_end"] - region["body_start"] + 1, F.lit(0))
    return _joined(content, _head(lines, region["body_start"]), F.split(body, "\n", -1), _tail(lines, region["body_start"] + count))


def insert_into_body(content: Column, region: Column, text: Column) -> Column:
    """``text`` at the end of a body, one empty line before it if the body says something."""
    lines = T.any_lines_of(content)
    at = region["body_end"] + 1
    says = F.exists(body_lines(lines, region), lambda x: T.strip_blank(x) != "")
    gap = says & (T.strip_blank(F.coalesce(F.get(lines, at - 1), F.lit(""))) != "")
    block = F.concat(F.when(gap, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.split(text, "\n", -1))
    return _joined(content, _head(lines, at), block, _tail(lines, at))


def render_region(kind: str, name: Column, body: Column | None = None, level: int = 2, text: Column | None = None) -> Column:
    """The lines of a new region: a 'fence' or a 'section'."""
    body = F.lit("") if body is None else F.regexp_replace(F.coalesce(body, F.lit("")), r"\r?\n\z", "")
    inner = F.split(body, "\n", -1)
    if kind == "section":
        label = F.lit("") if text is None else F.coalesce(text, F.lit(""))
        head = F.concat(F.lit(f'<SectionHeading level="{level}" id="'), name, F.lit('" text="'), label, F.lit('" />'))
        return F.when(body != "", F.concat(F.array(head, F.lit("")), inner)).otherwise(F.array(head))
    head = F.concat(F.lit('<Region name="'), name, F.lit('">'))
    end = F.lit("</Region>")
    return F.when(body != "", F.concat(F.array(head, F.lit("")), inner, F.array(F.lit(""), end))).otherwise(F.array(head, F.lit(""), end))


def create_after(content: Column, region: Column, new_lines: Column) -> Column:
    """New lines as a block behind a region, an empty line on either side."""
    lines = T.any_lines_of(content)
    at = region["span_end"] + 1
    follows = T.strip_blank(F.coalesce(F.get(lines, at), F.lit(""))) != ""
    gap = F.when(follows, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return _joined(content, _head(lines, at), F.array(F.lit("")), new_lines, gap, _tail(lines, at))


def rename(content: Column, region: Column, new_id: Column) -> Column:
    """(``status``, ``content``, ``reason``): the id of a region's anchor changed, or why it can't be."""
    lines = T.any_lines_of(content)
    at = region["span_start"]
    anchor = F.get(lines, at)
    quoted = F.concat(F.lit("$1"), new_id, F.lit("$2"))
    changed = (
        F.when(anchor.rlike(COMPONENT_OPEN), F.regexp_replace(anchor, F.lit(r"""(name=["'])[A-Za-z0-9_-]+(["'])"""), quoted))
        .when(anchor.rlike(COMMENT_OPEN), F.regexp_replace(anchor, F.lit(r"(region:\s*)[A-Za-z0-9_-]+"), F.concat(F.lit("$1"), new_id)))
        .when(anchor.rlike(SECTION_HEADING), F.regexp_replace(anchor, F.lit(r"""(\bid=["'])[A-Za-z0-9_-]+(["'])"""), quoted))
    )
    taken = F.exists(regions_of(T.lines_of(content)), lambda r: r["id"] == new_id)
    reason = (
        F.when(~new_id.rlike(r"^[A-Za-z0-9_-]+\z"), "invalid id")
        .when(taken, "id exists")
        .when(changed.isNull() & anchor.rlike(HEADING), "a heading's id follows from its text")
        .when(changed.isNull() | (changed == anchor), "anchor can't be rewritten")
    )
    text = _joined(content, _head(lines, at), F.array(changed), _tail(lines, at + 1))
    return F.struct(
        F.when(reason.isNull(), "ok").otherwise("refused").alias("status"), F.when(reason.isNull(), text).alias("content"), reason.alias("reason")
    )


def rewrite_refs(content: Column, old_id: str, new_id: str) -> Column:
    """(``content``, ``count``): references ``#old`` and ``/old`` renamed, longer ids left alone."""
    pattern = rf"([#/])\Q{old_id}\E(?![A-Za-z0-9_-])"
    return F.struct(F.regexp_replace(content, pattern, rf"$1{new_id}").alias("content"), F.regexp_count(content, F.lit(pattern)).alias("count"))


def move(content: Column, region: Column, target: Column, position: str) -> Column:
    """(``status``, ``content``): a region moved 'before' or 'after' another; refused if they overlap."""
    lines = T.any_lines_of(content)
    s0, s1, t0, t1 = region["span_start"], region["span_end"], target["span_start"], target["span_end"]
    apart = (t1 < s0) | (t0 > s1)
    size = s1 - s0 + 1
    moved = F.slice(lines, s0 + 1, size)
    rest = F.concat(_head(lines, s0), _tail(lines, s1 + 1))
    edge = t1 + 1 if position == "after" else t0
    at = F.when(t0 > s1, edge - size).otherwise(edge)
    text = _joined(content, _head(rest, at), moved, _tail(rest, at))
    return F.struct(F.when(apart, "ok").otherwise("refused").alias("status"), F.when(apart, text).alias("content"))
