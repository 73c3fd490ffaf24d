"""Where a page belongs: evidence that ties it to the sections of a manifest.

The pairs of pages and sections are never spelled out. Each kind of evidence is an equality join that yields
(page, section) only where there is some; their union is added up per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators.pages import top_sections

UNCATEGORIZED = "(uncategorized)"
#: What each kind of evidence weighs.
WEIGHTS = {"category_match": 20, "outbound": 5, "inbound": 3, "shared_tags": 1}


def section_members(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """(``graph``, ``section``, ``title``): manifest titles by the category of their page."""
    meta = metadata.select("graph", "title", "category")
    return (
        entries.select("graph", "title")
        .distinct()
        .join(meta, ["graph", "title"], "left")
        .select("graph", F.coalesce("category", F.lit(UNCATEGORIZED)).alias("section"), "title")
        .distinct()
    )


def section_tags(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """(``graph``, ``section``, ``tag``, ``n``): how often the entries of a section have a tag."""
    meta = metadata.select("graph", "title", F.coalesce("category", F.lit(UNCATEGORIZED)).alias("section"), "tags")
    each = entries.select("graph", "title").join(meta, ["graph", "title"])
    return each.select("graph", "section", F.explode("tags").alias("tag")).groupBy("graph", "section", "tag").agg(F.count("*").alias("n"))


def propose(candidates: DataFrame, entries: DataFrame, metadata: DataFrame, top: int = 3) -> DataFrame:
    """(``graph``, ``title``, ``section``, ``rank``, ``score`` and the evidence): the best sections of every candidate.

    ``candidates``: (graph, title). Links out count the candidate's distinct links to members, links in the
    members that link to it, tags the candidate's tags (repeats included) that any member has.
    """
    wanted = candidates.select("graph", "title").distinct()
    meta = metadata.join(wanted, ["graph", "title"], "left_semi")
    members = section_members(entries, metadata)
    sections = members.select("graph", "section").distinct()

    def evidence(df: DataFrame, kind: str) -> DataFrame:
        return df.select("graph", "title", "section", *[F.lit(int(k == kind)).alias(k) for k in WEIGHTS])

    match = meta.select("graph", "title", F.col("category").alias("section")).join(sections, ["graph", "section"], "left_semi")
    out = meta.select("graph", "title", F.explode(F.array_distinct("wikilinks")).alias("member")).join(
        members.select("graph", "section", F.col("title").alias("member")), ["graph", "member"]
    )
    inward = (
        metadata.select("graph", F.col("title").alias("member"), F.explode(F.array_distinct("wikilinks")).alias("title"))
        .join(wanted.join(meta.select("graph", "title"), ["graph", "title"], "left_semi"), ["graph", "title"], "left_semi")
        .join(members.select("graph", "section", F.col("title").alias("member")), ["graph", "member"])
    )
    tags = meta.select("graph", "title", F.explode("tags").alias("tag")).join(
        section_tags(entries, metadata).select("graph", "section", "tag"), ["graph", "tag"]
    )
    every = evidence(match, "category_match")
    for df, kind in ((out, "outbound"), (inward, "inbound"), (tags, "shared_tags")):
        every = every.unionByName(evidence(df, kind))
    sums = every.groupBy("graph", "title", "section").agg(*[F.sum(k).alias(k) for k in WEIGHTS])
    score = sum(F.col(k) * w for k, w in WEIGHTS.items())
    ranked = top_sections(sums.withColumn("score", score).filter(F.col("score") > 0), ["graph", "title"], top)
    return ranked.select("graph", "title", "section", "rank", "score", *WEIGHTS)


def reasons(proposals: DataFrame) -> DataFrame:
    """``proposals`` with ``rationale``: a sentence per kind of evidence."""

    def many(n: str, one: str) -> Column:
        return F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, F.lit(f" {one}")).otherwise(F.lit(f" {one}s")))

    sentences = F.array(
        F.when(F.col("category_match") > 0, F.concat(F.lit('Its category is "'), "section", F.lit('".'))),
        F.when(F.col("outbound") > 0, F.concat(F.lit("Links to "), many("outbound", "page"), F.lit(" of this section."))),
        F.when(F.col("inbound") > 0, F.concat(many("inbound", "page"), F.lit(" of this section link to it."))),
        F.when(F.col("shared_tags") > 0, F.concat(F.lit("Shares "), many("shared_tags", "tag"), F.lit(" with this section."))),
    )
    return proposals.withColumn("rationale", F.array_compact(sentences))


def unplaced(candidates: DataFrame, metadata: DataFrame, proposals: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``reason``) of the candidates without any section."""
    meta = metadata.select("graph", "title", F.lit(True).alias("read"), "category")
    return (
        candidates.select("graph", "title")
        .distinct()
        .join(proposals.select("graph", "title").distinct(), ["graph", "title"], "left_anti")
        .join(meta, ["graph", "title"], "left")
        .select(
            "graph",
            "title",
            F.when(F.col("read").isNull(), "no metadata").when(F.col("category").isNotNull(), "category without overlap").otherwise("no signal").alias("reason"),
        )
    )


def proposal_markdown(proposals: DataFrame, left_over: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``markdown``): each candidate's sections with their reasons."""
    rows = reasons(proposals)
    part = F.concat(
        F.format_string("%d. **%s** (score %d)", F.col("rank"), F.col("section"), F.col("score")),
        F.array_join(F.transform("rationale", lambda r: F.concat(F.lit("\n   - "), r)), ""),
    )
    ranked = rows.groupBy("graph", "title").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))).alias("parts"))
    placed = ranked.select("graph", "title", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))
    none = left_over.select("graph", "title", F.concat(F.lit("_"), "reason", F.lit("_")).alias("body"))
    return placed.unionByName(none).select("graph", "title", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("markdown"))
