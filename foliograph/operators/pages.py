"""Pages of the graphs and what is read from their text: properties, metadata, links and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions.stages import staged
from foliograph.sources import latest_rows, present


def alive_pages(graph_pages: DataFrame, text: bool = True) -> DataFrame:
    """(``graph``, ``title``, ``file``, ``page_id``, ``content``): the pages there now, one per title of a graph.

    Of several alive pages of one title the newest (then the greatest id) holds. Null content is empty text.
    Without ``text`` there is no content, and no text is read or shuffled; what looks for pages by name needs none.
    """
    content = ["raw_content"] if text else []
    rows = latest_rows(graph_pages, "page_id", ["graph_path", "title", "file", *content, "created_at", "deleted_at"])
    alive = rows.filter(F.col("deleted_at").isNull() & present(F.col("title")) & F.col("graph_path").isNotNull())
    row = F.struct("file", "page_id", *[F.coalesce(c, F.lit("")).alias("content") for c in content])
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp")), "page_id")
    return (
        alive.groupBy(F.col("graph_path").alias("graph"), "title")
        .agg(F.max_by(row, order).alias("r"))
        .select("graph", "title", "r.*")
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Category, type, project, tags and links of every page, read from its text."""
    c = F.col("content")
    return pages.select(
        "graph",
        "title",
        "file",
        T.first_property(c, "category").alias("category"),
        T.first_property(c, "type").alias("type"),
        T.first_property(c, "project").alias("project"),
        T.tags(c).alias("tags"),
        T.links(c).alias("wikilinks"),
    )


def page_properties(pages: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``key``, ``value``) of the leading properties."""
    return pages.select("graph", "title", F.explode(T.properties(F.col("content"))).alias("key", "value"))


def block_end(lines: Column) -> Column:
    """Number of the first line (from 1) that is neither a property nor blank; 0 without one."""
    content = F.transform(lines, lambda x: ~x.rlike("(?i)^[a-z0-9_-]+::") & (T.strip_blank(x) != ""))
    return F.array_position(content, F.lit(True))


def links_in_order(lines: Column, end: Column) -> Column:
    """Links of a page with their place in it: array of (``dst``, ``weight``, ``seq``).

    A link of a ``related::`` line before line ``end`` weighs 2, any other 1. Blank titles and journal days are
    no links.
    """
    in_block = lambda i: (end == 0) | (i + 1 < end)
    of_line = F.transform(
        lines,
        lambda x, i: F.transform(
            F.regexp_extract_all(x, F.lit(T.LINK), F.lit(1)),
            lambda t: F.struct(
                T.decode_entities(T.strip_blank(t)).alias("dst"),
                F.when(in_block(i) & x.rlike(r"(?i)^related::\s*\S"), 2).otherwise(1).alias("weight"),
            ),
        ),
    )
    placed = F.transform(F.flatten(of_line), lambda e, i: F.struct(e["dst"].alias("dst"), e["weight"].alias("weight"), i.cast("int").alias("seq")))
    return F.filter(placed, lambda e: (e["dst"] != "") & ~e["dst"].rlike(T.JOURNAL_DAY))


def outlinks(pages: DataFrame) -> DataFrame:
    """(``graph``, ``src``, ``dst``, ``weight``, ``seq``): one row per page and title it links to, itself excluded.

    Of a title that comes more than once the greatest weight and the first place hold. Pages without a link
    never reach the line-by-line part.
    """
    linked = pages.filter(F.col("content").contains("[[")).select("graph", F.col("title").alias("src"), "content")
    rows = staged(linked, ["graph", "src"], lines=T.lines_of(F.col("content")))
    rows = staged(rows, ["graph", "src", "lines"], end=block_end(F.col("lines")))
    each = rows.select("graph", "src", F.explode(links_in_order(F.col("lines"), F.col("end"))).alias("e"))
    return (
        each.filter(F.col("e.dst") != F.col("src"))
        .groupBy("graph", "src", F.col("e.dst").alias("dst"))
        .agg(F.max("e.weight").alias("weight"), F.min("e.seq").alias("seq"))
    )


def link_counts(edges: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``sources``, ``weight``): how many pages link to a title, and how strongly."""
    return edges.groupBy("graph", F.col("dst").alias("title")).agg(F.count("*").alias("sources"), F.sum("weight").alias("weight"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``degree``): number of titles a page links to."""
    return edges.groupBy("graph", F.col("src").alias("title")).agg(F.count("*").alias("degree"))


def resolve(wanted: DataFrame, pages: DataFrame, title: str = "title", file: str | None = "file") -> DataFrame:
    """``wanted`` (with ``graph``) with ``page_file``: the page's file, or null if there is none.

    A named file is taken or nothing is; otherwise the title's five possible file names are tried in order. The
    names of ``pages`` are joined by equality and the first match in order wins, one row per row of ``wanted``.
    """
    named = present(F.col(file)) if file else F.lit(False)
    rows = wanted.withColumn("_file", F.when(named, F.col(file) if file else F.lit(None).cast("string")).otherwise(""))
    by_title = F.transform(T.file_candidates(F.col("_title")), lambda c: F.concat(c, F.lit(".md")))
    names = F.when(F.col("_file") != "", F.array("_file")).otherwise(by_title)
    keys = rows.select(F.col("graph"), F.col(title).alias("_title"), "_file").distinct()
    tries = keys.select("graph", "_title", "_file", F.posexplode(F.array_distinct(names)).alias("rank", "_name"))
    files = pages.select("graph", F.col("file").alias("_name")).distinct()
    hits = tries.join(files, ["graph", "_name"]).groupBy("graph", "_title", "_file").agg(F.min_by("_name", "rank").alias("page_file"))
    hits = hits.withColumnRenamed("_title", title) if title != "_title" else hits
    return rows.join(hits, ["graph", title, "_file"], "left").drop("_file")


def top_sections(scored: DataFrame, by: list[str], top: int) -> DataFrame:
    """The best ``top`` rows per group: by score, then by the section's name as a reader sorts it."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.collate("section", "UNICODE"), "section")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
