"""Citation recall of pages by region: how many of the findings a region states are cited.

All of a page is in one row: findings find their innermost region with array functions instead of an interval
join, and one aggregation adds up the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import regions as R

#: The marks of findings and citations.
BAND = r"_\(([^)]+)\)_"
BANDS = ("well-supported", "supported", "grounded")
REFERENCE = r"\[\^([^\]]+)\](?!:)"
DEFINITION = r"^\s*-?\s*\[\^([^\]]+)\]:\s*.*\bfinding::\s*([0-9a-fA-F-]{36}(?![0-9a-fA-F-])|\S+)"
ROOT = ":root"


def is_finding(line: Column) -> Column:
    """Whether a line states a finding: one of its marks is a band, or begins with 'unverified'."""
    marks = F.transform(F.regexp_extract_all(line, F.lit(BAND), F.lit(1)), T.strip_blank)
    return F.exists(marks, lambda m: m.isin(*BANDS) | m.rlike(r"(?i)^unverified\b"))


def cited_key(line: Column) -> Column:
    """The key of the first citation on a line, null without one."""
    key = F.regexp_extract(line, REFERENCE, 1)
    return F.when(key != "", key)


def source_title(line: Column) -> Column:
    """The title a flush-left bullet gives the findings under it; null for other lines."""
    text = T.strip_blank(F.regexp_extract(line, r"^[-*]\s+(.*)\z", 1))
    other = is_finding(line) | text.rlike(r"^\[\^[^\]]+\]:") | text.rlike(r"(?i)^(?:Citations|Unverified)\b")
    return F.when((text != "") & ~other, text)


def citations(lines: Column) -> Column:
    """The finding each citation key of a page stands for; the last definition holds."""
    pairs = F.filter(
        F.transform(lines, lambda x: F.struct(F.regexp_extract(x, DEFINITION, 1).alias("key"), F.regexp_extract(x, DEFINITION, 2).alias("value"))),
        lambda p: p["key"] != "",
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def innermost(found: Column, line: Column) -> Column:
    """The region around a line that starts last, and of those the one that ends first."""
    around = F.filter(found, lambda r: (r["span_start"] <= line) & (r["span_end"] >= line))
    order = F.transform(around, lambda r: F.struct((-r["span_start"]).alias("a"), r["span_end"].alias("b"), r.alias("r")))
    return F.get(F.array_sort(order), F.lit(0))["r"]


def unique_ids(bases: Column) -> Column:
    """(``line``, ``id``) of (``line``, ``base``) in order: the base, or the base with the first free number from 2 on if it is in use."""

    def free(done: Column, base: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda n: F.concat(base, F.lit("-"), n.cast("string")))
        choices = F.concat(F.array(base), numbered)
        return F.get(F.filter(choices, lambda c: ~F.exists(done, lambda d: d["id"] == c)), F.lit(0))

    none = F.array().cast("array<struct<line:int,id:string>>")
    return F.aggregate(bases, none, lambda done, b: F.concat(done, F.array(F.struct(b["line"].alias("line"), free(done, b["base"]).alias("id")))))


def findings(pages: DataFrame, keys: list[str], content: str = "content", subdivide_root: bool = False) -> DataFrame:
    """One row per finding: ``keys``, line, the id, kind and start of its region, its citation and what that resolves to.

    With ``subdivide_root``, findings outside every region belong to the last flush-left bullet outside every
    region above them, as ``src:<slug>``; a title whose id is in use gets the first of -2, -3 and so on that isn't.
    """
    lines = T.any_lines_of(F.coalesce(F.col(content), F.lit("")))
    rows = R.with_regions(pages, keys, lines, map=citations(F.col("lines")))
    each = rows.select(*keys, "regions", "map", F.posexplode("lines").alias("line", "text"))
    each = each.filter(F.col("text").rlike(BAND if not subdivide_root else rf"{BAND}|^[-*]\s"))
    marked = each.select(
        *keys, "line", "text", "map", is_finding(F.col("text")).alias("finding"), source_title(F.col("text")).alias("title"), innermost(F.col("regions"), F.col("line")).alias("owner")
    )
    if subdivide_root:
        marked = marked.filter(F.col("finding") | (F.col("title").isNotNull() & F.col("owner").isNull()))
        opens = F.col("owner").isNull() & ~F.col("finding")
        stem = F.coalesce(F.nullif(T.strip_blank(F.regexp_replace("title", r"\s*\([^()]*\)\s*\z", "")), F.lit("")), F.col("title"))
        slug = F.substring(T.region_slug(stem), 1, 60)
        base = F.when(opens, F.concat(F.lit("src:"), F.when(slug != "", slug).otherwise("group")))
        marked = marked.withColumn("base", base)
        bases = marked.filter(F.col("base").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "base"))).alias("bases"))
        ids = bases.select(*keys, F.explode(unique_ids(F.col("bases"))).alias("x")).select(*keys, "x.line", "x.id")
        named = marked.join(ids, [*keys, "line"], "left")
        above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        group = F.last(F.when(F.col("id").isNotNull(), F.struct("id", "title")), ignorenulls=True).over(above)
        marked = named.withColumn("group", group)
    else:
        none = F.lit(None).cast("struct<id:string,title:string>")
        marked = marked.withColumn("group", none)
    key = cited_key(F.col("text"))
    return marked.filter("finding").select(
        *keys,
        "line",
        F.coalesce("owner.id", "group.id", F.lit(ROOT)).alias("region"),
        F.coalesce("owner.kind", F.lit("root")).alias("kind"),
        F.coalesce("owner.span_start", F.lit(-1)).alias("span_start"),
        F.when(F.col("owner").isNull(), F.col("group.title")).alias("group_title"),
        key.isNotNull().alias("cited"),
        F.element_at("map", key).alias("finding_id"),
    )


def region_recall(pages: DataFrame, keys: list[str], content: str = "content", subdivide_root: bool = False) -> DataFrame:
    """Recall of every region of every page, the root and regions without findings included.

    ``keys``, region, kind, span_start, cited, total, recall (null without findings), the resolved ids of the
    cited findings in order, and ``place``, the order they are read in: the root, the regions by their lines, then
    the groups by their first finding.
    """
    found = findings(pages, keys, content, subdivide_root)
    lines = T.any_lines_of(F.coalesce(F.col(content), F.lit("")))
    regions = R.with_regions(pages, keys, lines).select(*keys, F.explode("regions").alias("r"))
    regions = regions.select(*keys, F.col("r.id").alias("region"), "r.kind", "r.span_start", "r.span_end")
    roots = pages.select(*keys, F.lit(ROOT).alias("region"), F.lit("root").alias("kind"), F.lit(-1).alias("span_start"), F.lit(-1).alias("span_end"))
    none = [F.lit(None).cast("int").alias("line"), F.lit(None).cast("boolean").alias("cited"), F.lit(None).cast("string").alias("finding_id")]
    every = regions.unionByName(roots).select(*keys, "region", "kind", "span_start", "span_end", *none)
    rows = every.unionByName(found.select(*keys, "region", "kind", "span_start", F.lit(None).cast("int").alias("span_end"), "line", "cited", "finding_id"))
    ids = F.array_sort(F.collect_list(F.when(F.col("cited") & F.col("finding_id").isNotNull(), F.struct("line", "finding_id"))))
    group = F.col("region").startswith("src:") & (F.col("kind") == "root")
    rank = F.when(F.col("region") == ROOT, 0).when(~group, 1).otherwise(2)
    order = Window.partitionBy(*keys).orderBy("rank", F.when(group, F.col("first")).otherwise(F.col("span_start")), F.col("span_end"), "region")
    return (
        rows.groupBy(*keys, "region", "kind", "span_start")
        .agg(F.count_if("cited").alias("cited"), F.count("line").alias("total"), ids.alias("ids"), F.min("line").alias("first"), F.max("span_end").alias("span_end"))
        .withColumn("rank", rank)
        .select(
            *keys, "region", "kind", "span_start", "cited", "total", T.share(F.col("cited"), F.col("total")).alias("recall"),
            F.transform("ids", lambda x: x["finding_id"]).alias("finding_ids"), F.row_number().over(order).alias("place"),
        )
    )


def page_recall(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Recall of every page: what all its regions add up to."""
    by_region = region_recall(pages, keys, content)
    sums = by_region.groupBy(*keys).agg(F.sum("cited").alias("cited"), F.sum("total").alias("total"))
    return sums.withColumn("recall", T.share(F.col("cited"), F.col("total")))


def recall_lines(by_region: DataFrame, keys: list[str]) -> DataFrame:
    """One line a page: the page's recall, then each region with findings."""
    shown = lambda c, t: F.when(t > 0, F.format_string("%d/%d=%.2f", c, t, c / t)).otherwise(F.format_string("%d/%d=n/a", c, t))
    part = F.when(
        (F.col("total") > 0) & (F.col("region") != ROOT), F.struct("span_start", F.concat_ws(" ", "region", shown(F.col("cited"), F.col("total"))).alias("text"))
    )
    sums = by_region.groupBy(*keys).agg(F.sum("cited").alias("c"), F.sum("total").alias("t"), F.array_sort(F.collect_list(part)).alias("parts"))
    head = F.concat(F.lit("recall "), shown(F.col("c"), F.col("t")))
    return sums.select(*keys, F.array_join(F.concat(F.array(head), F.transform("parts", lambda p: p["text"])), " · ").alias("line"))
