"""Problem 5: references to records that do not exist, direct and inherited.

A reference names a record of another table by a string within a scope (here: a page of the same graph), and
holds at the time its row was read. Direct orphans come from two joins down the foreign keys: an anti join
that leaves only references without a record there at that time, then a join of those few with all records
ever known under the name, which tells missing, deleted and late ones apart. Inherited orphans come from a
fixpoint: a record that refers to the page of an orphaned record is orphaned too, in rounds of semi joins over
the reference graph until a round adds nothing.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.session import cut_lineage
from foliograph.sources import latest_rows, present

#: Fixed value: a link that names a journal day, not a page.
JOURNAL_DAY = r"^\d{4}-\d{2}-\d{2}\z"

#: Columns of a reference and of a target.
REFERENCE = ["src_table", "record_id", "scope", "field", "kind", "ref", "at"]
TARGET = ["page_id", "scope", "kind", "name", "created_at", "deleted_at"]


def page_references(page_metadata: DataFrame) -> DataFrame:
    """One row per page reading and distinct wikilink; journal days aren't references."""
    rows = latest_rows(page_metadata, "page_id", ["graph_path", "wikilinks", "read_at"])
    return (
        rows.select("page_id", "graph_path", "read_at", F.explode(F.array_distinct("wikilinks")).alias("ref"))
        .filter(present(F.col("ref")) & ~F.col("ref").rlike(JOURNAL_DAY))
        .select(
            F.lit("page_metadata").alias("src_table"),
            F.col("page_id").cast("long").alias("record_id"),
            F.col("graph_path").alias("scope"),
            F.lit("wikilinks").alias("field"),
            F.lit("title").alias("kind"),
            "ref",
            F.col("read_at").alias("at"),
        )
    )


def entry_references(publish_entries: DataFrame) -> DataFrame:
    """One row per manifest entry and distinct reference: its file, else its title, and its filters' pages."""
    rows = latest_rows(publish_entries, "entry_id", ["graph_path", "title", "file", "filters", "generated_at"])
    has_file = present(F.col("file"))
    own = F.struct(
        F.when(has_file, F.lit("file")).otherwise(F.lit("title")).alias("field"),
        F.when(has_file, F.lit("file")).otherwise(F.lit("title")).alias("kind"),
        F.when(has_file, F.col("file")).otherwise(F.col("title")).alias("ref"),
    )
    spliced = F.array_distinct(
        F.flatten(
            F.array(
                F.transform(F.coalesce("filters", F.array()), lambda f: f["prepend"]),
                F.transform(F.coalesce("filters", F.array()), lambda f: f["append"]),
            )
        )
    )
    via = F.transform(spliced, lambda ref: F.struct(F.lit("filters").alias("field"), F.lit("title").alias("kind"), ref.alias("ref")))
    return (
        rows.select("entry_id", "graph_path", "generated_at", F.explode(F.concat(F.array(own), via)).alias("r"))
        .filter(present(F.col("r.ref")))
        .select(
            F.lit("publish_entries").alias("src_table"),
            F.col("entry_id").cast("long").alias("record_id"),
            F.col("graph_path").alias("scope"),
            F.col("r.field").alias("field"),
            F.col("r.kind").alias("kind"),
            F.col("r.ref").alias("ref"),
            F.col("generated_at").alias("at"),
        )
    )


def page_targets(graph_pages: DataFrame) -> DataFrame:
    """Each page twice, under its title and under its file; pages without either name or scope can't be referred to."""
    rows = latest_rows(graph_pages, "page_id", ["graph_path", "title", "file", "created_at", "deleted_at"])
    names = F.array(
        F.struct(F.lit("title").alias("kind"), F.col("title").alias("name")),
        F.struct(F.lit("file").alias("kind"), F.col("file").alias("name")),
    )
    return (
        rows.select("page_id", F.col("graph_path").alias("scope"), "created_at", "deleted_at", F.explode(names).alias("n"))
        .filter(present(F.col("n.name")) & F.col("scope").isNotNull())
        .select("page_id", "scope", F.col("n.kind").alias("kind"), F.col("n.name").alias("name"), "created_at", "deleted_at")
    )


def _is_there(at: Column, created: Column, deleted: Column) -> Column:
    return (created <= at) & (deleted.isNull() | (deleted > at))


def direct_orphans(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References (columns ``REFERENCE``) no target is there for at their time, each once, with ``state``.

    ``state``: 'missing' if the scope never has a target of that name, else 'deleted' if one was created by
    then, else 'late'. A reference with a null scope or time has nothing to be there and comes out: 'missing'
    without a scope, 'late' without a time if the name exists. A target without a creation time is never there.
    Neither join needs one task to hold all rows of a name: hot names are split by the adaptive skew join.
    """
    t = targets.select(
        F.col("scope").alias("t_scope"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"), "created_at", "deleted_at"
    )
    same = (F.col("scope") == F.col("t_scope")) & (F.col("kind") == F.col("t_kind")) & (F.col("ref") == F.col("t_name"))
    there = _is_there(F.col("at"), F.col("created_at"), F.col("deleted_at"))
    broken = references.select(*REFERENCE).join(t, same & there, "left_anti")
    by_then = F.max(F.when(F.col("created_at") <= F.col("at"), 1).otherwise(0))
    return (
        broken.join(t.drop("deleted_at"), same, "left")
        .groupBy(*REFERENCE)
        .agg(F.count("t_name").alias("known"), by_then.alias("by_then"))
        .select(
            *REFERENCE,
            F.when(F.col("known") == 0, "missing").when(F.col("by_then") == 1, "deleted").otherwise("late").alias("state"),
        )
    )


def orphan_cascade(references: DataFrame, targets: DataFrame) -> DataFrame:
    """(``src_table``, ``record_id``, ``orphan``, ``round``): every record with a broken reference, direct or inherited.

    Round 0 are the records with a direct orphan. In round n a record joins if a page it refers to, there at
    the time of the reference, is the page of a record of round n - 1. The loop ends when a round adds nothing,
    as it must, since every round adds records that weren't found before. Each round costs
    one semi join over the edges and one anti join over the records found, and ends in a checkpoint.
    """
    t = targets.select(
        "page_id", F.col("scope").alias("t_scope"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"), "created_at", "deleted_at"
    )
    same = (F.col("scope") == F.col("t_scope")) & (F.col("kind") == F.col("t_kind")) & (F.col("ref") == F.col("t_name"))
    there = _is_there(F.col("at"), F.col("created_at"), F.col("deleted_at"))
    edges = cut_lineage(
        references.join(t, same & there)
        .select("src_table", "record_id", F.col("page_id").cast("long").alias("page_id"))
        .distinct()
    )
    found = cut_lineage(
        direct_orphans(references, targets)
        .select("src_table", "record_id")
        .distinct()
        .select("src_table", "record_id", F.lit("direct").alias("orphan"), F.lit(0).alias("round"))
    )
    frontier = found
    for n in count(1):
        pages = frontier.filter(F.col("src_table") == "page_metadata").select(F.col("record_id").alias("page_id"))
        added = (
            edges.join(pages, "page_id", "left_semi")
            .select("src_table", "record_id")
            .distinct()
            .join(found, ["src_table", "record_id"], "left_anti")
        )
        frontier = cut_lineage(added.select("src_table", "record_id", F.lit("inherited").alias("orphan"), F.lit(n).alias("round")))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def orphan_totals(orphans: DataFrame) -> DataFrame:
    """Orphan references and the records that have them, per table, month of the referring row and state."""
    return (
        orphans.groupBy("src_table", F.date_format("at", "yyyy-MM").alias("month"), "state")
        .agg(F.count("*").alias("refs"), F.countDistinct("record_id").alias("records"))
    )
