"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.operators import orphans
from foliograph.sources import load


def _references(spark: SparkSession, base: str) -> DataFrame:
    return orphans.page_references(load(spark, base, "page_metadata")).unionByName(
        orphans.entry_references(load(spark, base, "publish_entries"))
    )


def _orphans(spark: SparkSession, base: str) -> DataFrame:
    return orphans.direct_orphans(_references(spark, base), orphans.page_targets(load(spark, base, "graph_pages")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Every reference to a page that isn't there, with its state."""
    return _orphans(spark, base).select("src_table", "record_id", "field", "ref", "state")


def p5_totals(spark: SparkSession, base: str) -> DataFrame:
    """Orphan references per table and month of the referring row."""
    return orphans.orphan_totals(_orphans(spark, base))


def p5_cascade(spark: SparkSession, base: str) -> DataFrame:
    """Records with a broken reference, direct or inherited through the pages they refer to."""
    return orphans.orphan_cascade(_references(spark, base), orphans.page_targets(load(spark, base, "graph_pages")))


QUERIES = {"p5_found": p5_found, "p5_totals": p5_totals, "p5_cascade": p5_cascade}

_COMMON = r"""
    m AS (SELECT page_id, any_value(graph_path) AS g, any_value(wikilinks) AS links, any_value(read_at) AS t
          FROM page_metadata GROUP BY page_id),
    e AS (SELECT entry_id, any_value(graph_path) AS g, any_value(title) AS title, any_value(file) AS file,
                 any_value(filters) AS filters, any_value(generated_at) AS t
          FROM publish_entries GROUP BY entry_id),
    p AS (SELECT page_id, max_by(graph_path, loaded_at) AS g, max_by(title, loaded_at) AS title, max_by(file, loaded_at) AS file,
                 max(created_at) AS c, arg_max_null(deleted_at, loaded_at) AS d
          FROM graph_pages GROUP BY page_id),
    f AS (SELECT entry_id, g, t, unnest(filters) AS x FROM e),
    refs AS (
        SELECT DISTINCT 'page_metadata' AS src_table, page_id AS record_id, g, 'wikilinks' AS field, 'title' AS kind, ref, t
        FROM (SELECT page_id, g, t, unnest(links) AS ref FROM m) WHERE NOT regexp_matches(ref, '^\d{4}-\d{2}-\d{2}$')
        UNION SELECT 'publish_entries', entry_id, g, 'file', 'file', file, t FROM e
        UNION SELECT 'publish_entries', entry_id, g, 'title', 'title', title, t FROM e WHERE file IS NULL OR file = ''
        UNION SELECT 'publish_entries', entry_id, g, 'filters', 'title', x.prepend, t FROM f
        UNION SELECT 'publish_entries', entry_id, g, 'filters', 'title', x.append, t FROM f),
    n AS (SELECT page_id, g, 'title' AS kind, title AS name, c, d FROM p UNION ALL SELECT page_id, g, 'file', file, c, d FROM p),
    o AS (
        SELECT src_table, record_id, field, ref, t,
               CASE WHEN count(n.name) = 0 THEN 'missing' WHEN bool_or(c <= t) THEN 'deleted' ELSE 'late' END AS state
        FROM refs LEFT JOIN n ON n.g = refs.g AND n.kind = refs.kind AND n.name = refs.ref
        WHERE ref <> ''
        GROUP BY src_table, record_id, field, ref, t
        HAVING NOT coalesce(bool_or(c <= t AND (d IS NULL OR d > t)), false))
"""

SQL = {
    "p5_found": f"WITH {_COMMON} SELECT src_table, record_id, field, ref, state FROM o",
    "p5_totals": f"""WITH {_COMMON}
        SELECT src_table, strftime(t, '%Y-%m') AS month, state, count(*) AS refs, count(DISTINCT record_id) AS records
        FROM o GROUP BY ALL""",
    "p5_cascade": f"""WITH RECURSIVE {_COMMON},
        edge AS (SELECT DISTINCT src_table, record_id, n.page_id
                 FROM refs JOIN n ON n.g = refs.g AND n.kind = refs.kind AND n.name = refs.ref AND c <= t AND (d IS NULL OR d > t)),
        -- Each record keeps the round it was first found in; the recursion ends when a round finds none that is new.
        walk(src_table, record_id, round) USING KEY (src_table, record_id) AS (
            SELECT DISTINCT src_table, record_id, 0 FROM o
            UNION
            SELECT DISTINCT edge.src_table, edge.record_id, walk.round + 1
            FROM walk JOIN edge ON walk.src_table = 'page_metadata' AND edge.page_id = walk.record_id
            WHERE NOT EXISTS (SELECT 1 FROM recurring.walk AS r WHERE r.src_table = edge.src_table AND r.record_id = edge.record_id))
        SELECT src_table, record_id, CASE WHEN min(round) = 0 THEN 'direct' ELSE 'inherited' END AS orphan,
               CAST(min(round) AS INT) AS round
        FROM walk GROUP BY src_table, record_id""",
}
