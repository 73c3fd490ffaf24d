"""Seeded, relevance-scored selection of pages, hop by hop, and the links that lead out of it.

A hop ranks a snapshot of the candidates, so the loop is level-synchronous: one join, one aggregation and one
ranked cut per hop, for all graphs at once, each ended by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators.pages import resolve
from foliograph.session import cut_lineage

HUB_FACTOR = 0.15


def select_subgraph(
    edges: DataFrame,
    nodes: DataFrame,
    seeds: DataFrame,
    max_pages: int = 25,
    max_hops: int = 2,
    hub_outdegree: int = 40,
    min_score: float = 1.0,
) -> DataFrame:
    """(``graph``, ``title``, ``hop``, ``score``): seeds and the best linked pages around them, per graph.

    ``edges``: (graph, src, dst, weight, seq); ``nodes``: (graph, title) of the titles that have a page;
    ``seeds``: (graph, title, seed_order). Seeds that have a page are always taken, beyond ``max_pages`` too, and
    score infinity; a seed given twice counts its links twice. A candidate scores the weights of the links from
    pages taken so far, times ``HUB_FACTOR`` if it links to more than ``hub_outdegree`` titles; ties go to what
    was linked first. A hop takes candidates of at least ``min_score`` until the graph has ``max_pages``.
    """
    degrees = edges.groupBy("graph", F.col("src").alias("title")).agg(F.count("*").alias("degree"))
    known = nodes.select("graph", "title").distinct()
    first = (
        seeds.join(known, ["graph", "title"], "left_semi")
        .groupBy("graph", "title")
        .agg(F.count("*").alias("times"), F.min("seed_order").cast("int").alias("place"))
    )
    taken = cut_lineage(
        first.select("graph", "title", F.lit(0).alias("hop"), F.lit(float("inf")).alias("score"), "times", F.col("place").alias("place"))
    )
    for hop in range(1, max_hops + 1):
        counts = taken.groupBy("graph").agg(F.count("*").alias("size"))
        noted = (
            edges.join(taken.select("graph", F.col("title").alias("src"), "hop", "place", "times"), ["graph", "src"])
            .groupBy("graph", F.col("dst").alias("title"))
            .agg(F.sum(F.col("weight") * F.col("times")).alias("raw"), F.min(F.struct("hop", "place", "seq")).alias("first_seen"))
            .join(taken.select("graph", "title"), ["graph", "title"], "left_anti")
            .join(known, ["graph", "title"], "left_semi")
            .join(degrees, ["graph", "title"], "left")
        )
        hub = F.coalesce("degree", F.lit(0)) > hub_outdegree
        scored = noted.withColumn("score", F.when(hub, F.col("raw") * F.lit(HUB_FACTOR)).otherwise(F.col("raw").cast("double")))
        # The constant cut lets every task keep its best before the shuffle; the graph's own room follows.
        order = Window.partitionBy("graph").orderBy(F.desc("score"), "first_seen")
        ranked = scored.filter(F.col("score") >= min_score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_pages)
        added = cut_lineage(
            ranked.join(counts, "graph")
            .filter(F.col("place") + F.col("size") <= max_pages)
            .select("graph", "title", F.lit(hop).alias("hop"), "score", F.lit(1).cast("long").alias("times"), "place")
        )
        if added.isEmpty():
            break
        taken = taken.unionByName(added)
    return taken.select("graph", "title", "hop", "score")


def boundary(edges: DataFrame, nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``exists``, ``refs``, ``referenced_by``): titles that selected pages link to outside the selection."""
    inside = selected.select("graph", "title")
    known = nodes.select("graph", "title", F.lit(True).alias("there")).distinct()
    return (
        edges.join(inside.select("graph", F.col("title").alias("src")), ["graph", "src"], "left_semi")
        .select("graph", F.col("dst").alias("title"), "src")
        .join(inside, ["graph", "title"], "left_anti")
        .groupBy("graph", "title")
        .agg(F.array_sort(F.collect_set("src")).alias("referenced_by"))
        .join(known, ["graph", "title"], "left")
        .select("graph", "title", F.coalesce("there", F.lit(False)).alias("exists"), F.size("referenced_by").alias("refs"), "referenced_by")
    )


def neighbours(pages: DataFrame, start: DataFrame, hops: int = 1, names: DataFrame | None = None) -> DataFrame:
    """(``graph``, ``title``, ``hop``): titles within ``hops`` links of ``start`` that have a page and aren't in it.

    ``pages``: (graph, title, file, content). Both ends of a link are found by the file names a title can have, as
    everywhere a title is looked up; links are all titles a page's text names, journal days that have a page included.
    ``names``: the same pages without their content, if they can be had cheaper.
    """
    names = pages if names is None else names
    start = start.select("graph", "title").distinct()
    linked = pages.filter(F.col("content").contains("[[")).select("graph", F.col("file").alias("page_file"), F.explode(T.links(F.col("content"))).alias("title"))
    found = None
    frontier = start
    for hop in range(1, hops + 1):
        read = resolve(frontier, names, file=None).filter(F.col("page_file").isNotNull()).select("graph", "page_file").distinct()
        new = linked.join(read, ["graph", "page_file"], "left_semi").select("graph", "title").distinct().join(start, ["graph", "title"], "left_anti")
        if found is not None:
            new = new.join(found.select("graph", "title"), ["graph", "title"], "left_anti")
        there = resolve(new, names, file=None).filter(F.col("page_file").isNotNull())
        new = cut_lineage(there.select("graph", "title", F.lit(hop).alias("hop")))
        found = new if found is None else found.unionByName(new)
        frontier = new
        if hop < hops and new.isEmpty():
            break
    return found if found is not None else start.select("graph", "title", F.lit(0).alias("hop")).limit(0)


def ranked_pages(selected: DataFrame) -> DataFrame:
    """``selected`` with ``place`` in its graph: by hop, then score, then the title as a reader sorts it."""
    order = Window.partitionBy("graph").orderBy("hop", F.desc("score"), F.collate("title", "UNICODE"), "title")
    return selected.withColumn("place", F.row_number().over(order))


def ranked_boundary(edge: DataFrame) -> DataFrame:
    """``edge`` with ``place`` in its graph: by the number of references, then the title as a reader sorts it."""
    order = Window.partitionBy("graph").orderBy(F.desc("refs"), F.collate("title", "UNICODE"), "title")
    return edge.withColumn("place", F.row_number().over(order))
