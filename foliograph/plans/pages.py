"""Queries over the pages of the graphs: what their text says, how they link, and what they become."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliograph.functions import text as T
from foliograph.operators import drift, placement, projection, subgraph, transform
from foliograph.operators import pages as P
from foliograph.plans import dialect as D
from foliograph.session import cut_lineage
from foliograph.sources import latest_rows, load, present

#: The present of the queries that compare with it.
NOW = datetime(2025, 7, 1, tzinfo=timezone.utc)
#: Rules of the redaction modes the test manifests use.
RULES = {"names": {"notice": "> Names removed.\n\n", "rules": [{"pattern": r"\b[A-Z][a-z]+(?= (?:restores|hides|moves))", "replacement": "[name]"}]}}
MODES = ["none", "names", "light"]


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return P.alive_pages(load(spark, base, "graph_pages"))


def _names(spark: SparkSession, base: str) -> DataFrame:
    """The pages without their text."""
    return P.alive_pages(load(spark, base, "graph_pages"), text=False)


def _near(spark: SparkSession, base: str, entries: DataFrame) -> DataFrame:
    return subgraph.neighbours(_pages(spark, base), entries, 1, cut_lineage(_names(spark, base).select("graph", "file").distinct()))


def _entries(spark: SparkSession, base: str) -> DataFrame:
    columns = ["graph_path", "entry_index", "title", "tier", "backlinks", "exclude", "redact", "file", "filters"]
    rows = latest_rows(load(spark, base, "publish_entries"), "entry_id", columns)
    return rows.withColumnRenamed("graph_path", "graph").filter(present(F.col("graph")) & present(F.col("title")))


def _bodies(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(load(spark, base, "page_bodies"), "body_id", ["body"])
    return rows.select("body_id", F.coalesce("body", F.lit("")).alias("content"))


def _placed(spark: SparkSession, base: str) -> DataFrame:
    return P.resolve(_entries(spark, base), _names(spark, base))


def _of_kind(findings: DataFrame, kind: str) -> DataFrame:
    return findings.filter(F.col("kind") == kind)


def _seeds(spark: SparkSession, base: str) -> DataFrame:
    """Every seed of every manifest in its order; a title given twice stays twice."""
    seeds = _entries(spark, base).filter(F.col("tier") == "seed")
    return seeds.select("graph", "title", F.col("entry_index").alias("seed_order"))


def r_metadata(spark: SparkSession, base: str) -> DataFrame:
    """Category, type, project, tags and number of links of every page."""
    m = P.page_metadata(_pages(spark, base))
    return m.select("graph", "title", "category", "type", "project", F.array_join("tags", "|").alias("tags"), F.size("wikilinks").alias("links"))


def r_properties(spark: SparkSession, base: str) -> DataFrame:
    """The leading properties of every page."""
    return P.page_properties(_pages(spark, base))


def r_outlinks(spark: SparkSession, base: str) -> DataFrame:
    """Weighted links between titles."""
    return P.outlinks(_pages(spark, base)).select("graph", "src", "dst", "weight")


def r_linked(spark: SparkSession, base: str) -> DataFrame:
    """How many pages link to each title."""
    return P.link_counts(P.outlinks(_pages(spark, base)))


def r_hubs(spark: SparkSession, base: str) -> DataFrame:
    """Pages with more than 4 links out."""
    return P.out_degrees(P.outlinks(_pages(spark, base))).filter(F.col("degree") > 4)


def r_resolved(spark: SparkSession, base: str) -> DataFrame:
    """The file of every manifest entry's page."""
    return P.resolve(_entries(spark, base), _names(spark, base)).select("graph", "entry_index", "title", "page_file")


def r_slugs(spark: SparkSession, base: str) -> DataFrame:
    """Slug and vault name of every title."""
    t = _names(spark, base).select("title").distinct()
    return t.select("title", T.route_slug(F.col("title")).alias("slug"), T.vault_title(F.col("title")).alias("vault_title"))


def r_assets(spark: SparkSession, base: str) -> DataFrame:
    """Images the bodies embed."""
    return _bodies(spark, base).select(F.explode(T.image_assets(F.col("content"))).alias("asset")).groupBy("asset").agg(F.count("*").alias("bodies"))


def _graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, titles and the selection around the seeds; each text is read once."""
    edges, nodes = cut_lineage(P.outlinks(_pages(spark, base))), cut_lineage(_names(spark, base).select("graph", "title"))
    return edges, nodes, subgraph.select_subgraph(edges, nodes, _seeds(spark, base), hub_outdegree=12)


def r_subgraph(spark: SparkSession, base: str) -> DataFrame:
    """Pages selected around the seeds of every manifest."""
    return _graph(spark, base)[2]


def r_boundary(spark: SparkSession, base: str) -> DataFrame:
    """Titles just outside those selections."""
    edges, nodes, chosen = _graph(spark, base)
    return subgraph.boundary(edges, nodes, chosen).select("graph", "title", "exists", "refs", F.array_join("referenced_by", "|").alias("referenced_by"))


def r_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """Pages one link away from a manifest that aren't in it."""
    return _near(spark, base, _entries(spark, base))


def r_audit(spark: SparkSession, base: str) -> DataFrame:
    """All drift findings of all manifests."""
    entries = cut_lineage(_entries(spark, base))
    return drift.audit(entries, _pages(spark, base), _near(spark, base, entries), NOW, known_modes=MODES, names=_names(spark, base))


def r_ranked_findings(spark: SparkSession, base: str) -> DataFrame:
    """All findings of a manifest in the order they are read."""
    return drift.ranked(r_audit(spark, base)).select("graph", "id", "place")


def r_ranked_pages(spark: SparkSession, base: str) -> DataFrame:
    """The pages selected around the seeds, and the titles outside, in the order they are listed."""
    edges, nodes, chosen = _graph(spark, base)
    inside = subgraph.ranked_pages(chosen).select("graph", "title", F.lit("page").alias("what"), "place")
    outside = subgraph.ranked_boundary(subgraph.boundary(edges, nodes, chosen)).select("graph", "title", F.lit("boundary").alias("what"), "place")
    return inside.unionByName(outside)


def r_severities(spark: SparkSession, base: str) -> DataFrame:
    """Findings per manifest and severity."""
    return drift.severity_counts(r_audit(spark, base))


def r_broken_filters(spark: SparkSession, base: str) -> DataFrame:
    """Filters that splice what isn't a published entry."""
    return _of_kind(drift.filter_findings(_entries(spark, base), MODES), "filter-reference-broken").select("graph", "id", "detail")


def r_self_filters(spark: SparkSession, base: str) -> DataFrame:
    """Filters that splice an entry into itself."""
    return _of_kind(drift.filter_findings(_entries(spark, base), MODES), "filter-self-reference").select("graph", "id")


def r_redact_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """Entries that redact in two ways."""
    return _of_kind(drift.entry_findings(_placed(spark, base)), "filter-redact-conflict").select("graph", "entry_index", "title")


def r_unknown_modes(spark: SparkSession, base: str) -> DataFrame:
    """Filters with a redact mode the host doesn't have."""
    return _of_kind(drift.filter_findings(_entries(spark, base), MODES), "filter-redact-mode-unknown").select("graph", "id")


def r_missing_sources(spark: SparkSession, base: str) -> DataFrame:
    """Entries without a page."""
    return _of_kind(drift.entry_findings(_placed(spark, base)), "source-missing").select("graph", "entry_index", "title")


def r_cycles(spark: SparkSession, base: str) -> DataFrame:
    """Filters that splice in a circle."""
    return drift.filter_cycles(_entries(spark, base)).select("graph", "id", "title")


def r_stale(spark: SparkSession, base: str) -> DataFrame:
    """Blocks verified too long ago, if every page ended with a block verified on the day it was created."""
    created = latest_rows(load(spark, base, "graph_pages"), "page_id", ["created_at"])
    day = F.date_format("created_at", "yyyy-MM-dd")
    pages = _pages(spark, base).join(created, "page_id").withColumn("content", F.concat("content", F.lit("\n- checked\n  verified:: [["), day, F.lit("]]")))
    return drift.stale_blocks(_entries(spark, base), pages, NOW).select("graph", "id", "detail")


def r_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Titles that several entries of a manifest have."""
    rows = _entries(spark, base).groupBy("graph", "title").agg(F.array_sort(F.collect_list("entry_index")).alias("at"))
    return rows.filter(F.size("at") > 1).select("graph", "title", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("entries"))


def r_sections(spark: SparkSession, base: str) -> DataFrame:
    """Tags of the sections of every manifest."""
    return placement.section_tags(_entries(spark, base), P.page_metadata(_pages(spark, base)))


def r_placement(spark: SparkSession, base: str) -> DataFrame:
    """The three best sections for every page a manifest's pages link to."""
    entries = cut_lineage(_entries(spark, base).select("graph", "title"))
    meta = cut_lineage(P.page_metadata(_pages(spark, base)).select("graph", "title", "category", "tags", "wikilinks"))
    return placement.propose(_near(spark, base, entries), entries, meta)


def r_backlinks(spark: SparkSession, base: str) -> DataFrame:
    """Entries whose backlinks name an excluded entry."""
    entries = _entries(spark, base)
    out = entries.filter(F.coalesce("exclude", F.lit(False))).select("graph", F.col("title").alias("link")).distinct()
    each = entries.select("graph", "entry_index", F.explode(F.array_distinct("backlinks")).alias("link"))
    return each.join(out, ["graph", "link"], "left_semi").select("graph", "entry_index", "link")


def r_published(spark: SparkSession, base: str) -> DataFrame:
    """What the site stores for every published entry."""
    rows = projection.site_records(_entries(spark, base), _pages(spark, base), RULES, names=_names(spark, base))
    return rows.select("graph", "slug", F.to_json("data").alias("data"), "body", "digest")


def r_record_issues(spark: SparkSession, base: str) -> DataFrame:
    """Pages that a site refuses whose schema asks for a title, a category and a type."""
    schema = StructType([StructField(name, StringType(), False) for name in ("title", "category", "type")])
    meta = P.page_metadata(_pages(spark, base))
    rows = meta.select("graph", F.col("title").alias("slug"), F.struct("title", "category", "type", "tags").alias("data"))
    return projection.record_issues(rows, schema)


def r_filter_warnings(spark: SparkSession, base: str) -> DataFrame:
    """Filters of all manifests that change nothing, and why."""
    return transform.filter_warnings(_entries(spark, base), _names(spark, base), list(RULES))


def r_run_counts(spark: SparkSession, base: str) -> DataFrame:
    """What a run over every manifest did."""
    rows = projection.run_counts(_entries(spark, base), _pages(spark, base), names=_names(spark, base))
    return rows.select("graph", "included", "excluded", "missing", "hydrated", "unhydrated")


def r_vault(spark: SparkSession, base: str) -> DataFrame:
    """The vault page of every page of the graphs."""
    names = cut_lineage(_names(spark, base).select("graph", "title", "file"))
    return projection.vault_plan(names, _pages(spark, base), names=names)


def r_vault_clean(spark: SparkSession, base: str) -> DataFrame:
    """Every body without outliner syntax."""
    return _bodies(spark, base).select("body_id", transform.vault_body(F.col("content")).alias("text"))


def r_contents(spark: SparkSession, base: str) -> DataFrame:
    """A contents page per manifest."""
    rows = _entries(spark, base).select("graph", F.col("tier").alias("group"), "title", F.col("entry_index").alias("ord"))
    return projection.contents_page(rows, "Contents")


def r_dependencies(spark: SparkSession, base: str) -> DataFrame:
    """Files every published entry is made from."""
    return projection.dependencies(_entries(spark, base), cut_lineage(_names(spark, base)))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("r_")}

def _finding(kind: str, key: str, rest: str, index: str = "entry_index::INT", title: str = "title", detail: str = "NULL") -> str:
    """One kind of finding as rows of the audit."""
    return f"SELECT graph, '{kind}:' || {key} AS id, '{kind}' AS kind, '{drift.KINDS[kind]}' AS severity, {index} AS entry_index, {title} AS title, {detail} AS detail FROM {rest}"


_LAST = "last AS (SELECT graph, title, max_by(coalesce(exclude, false), entry_index) AS out, max(entry_index) AS entry_index FROM entries GROUP BY ALL)"
#: Circles of at most all entries: paths from the smallest title of each, without coming to one twice.
_CIRCLES = f"""{_LAST},
    ref AS (SELECT DISTINCT f.graph, f.title, coalesce(prepend, append) AS ref FROM filt f JOIN last h ON h.graph = f.graph AND h.title = f.title AND h.entry_index = f.entry_index
            JOIN last l ON l.graph = f.graph AND l.title = coalesce(prepend, append) AND NOT l.out WHERE coalesce(prepend, append) <> f.title),
    walk AS (SELECT graph, title AS start, ref AS spot, [title] AS path FROM ref WHERE ref > title
             UNION ALL SELECT w.graph, start, ref.ref, list_append(path, spot) FROM walk w JOIN ref ON ref.graph = w.graph AND ref.title = w.spot WHERE w.spot <> start AND NOT list_contains(path, w.spot) AND ref.ref >= start),
    circle AS (SELECT DISTINCT graph, start, array_to_string(path, '->') AS path FROM walk WHERE spot = start)"""
_STALE = r"""
    vl AS (SELECT graph, title, entry_index, i, x, try_strptime(nullif(regexp_extract(x, '^\s*verified::\s*(?:\[\[)?(\d{4}-\d{2}-\d{2})(?:\]\])?\s*$', 1), ''), '%Y-%m-%d') AS day FROM (
           SELECT graph, title, entry_index, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM seen)),
    old AS (SELECT *, floor(date_diff('millisecond', day, TIMESTAMP '2025-07-01') / 86400000.0)::BIGINT AS age FROM vl WHERE date_diff('millisecond', day, TIMESTAMP '2025-07-01') > 180 * 86400000::BIGINT),
    stale AS (SELECT o.graph, o.title, o.entry_index, o.i, o.day, concat_ws(' ', any_value(o.age)::VARCHAR, substr(max_by(n.t, n.i), 1, 120)) AS detail
              FROM old o LEFT JOIN (SELECT graph, title, entry_index, i, trim(regexp_extract(x, '^\s*[-*]\s+(.*)$', 1)) AS t FROM vl) n
                   ON n.graph = o.graph AND n.title = o.title AND n.entry_index = o.entry_index AND n.i BETWEEN o.i - 6 AND o.i - 1 AND n.t <> '' GROUP BY o.graph, o.title, o.entry_index, o.i, o.day)"""
_AUDIT = "\n UNION ALL ".join(
    [
        _finding("source-missing", "title", "resolved WHERE page_file IS NULL"),
        _finding("file-title-mismatch", "r.title", "resolved r JOIN entries e USING (graph, entry_index, title) WHERE page_file IS NOT NULL AND file <> '' AND NOT ends_with('/' || page_file, '/' || file)", title="r.title"),
        _finding("filter-redact-conflict", "title", "entries WHERE redact IS NOT NULL AND len(list_filter(filters, lambda f: f.redact IS NOT NULL)) > 0"),
        _finding("filter-self-reference", "title || '#' || pos", "filt WHERE coalesce(prepend, append) = title"),
        _finding(
            "filter-reference-broken", "f.title || '#' || pos || ':' || coalesce(prepend, append)",
            "(SELECT f.*, l.out FROM filt f LEFT JOIN last l ON l.graph = f.graph AND l.title = coalesce(f.prepend, f.append)) f WHERE coalesce(prepend, append) <> title AND coalesce(out, true)",
            detail="CASE WHEN out IS NULL THEN 'absent' ELSE 'excluded' END",
        ),
        _finding("filter-redact-mode-unknown", "title || '#' || pos || ':' || mode", "filt WHERE mode NOT IN ('none', 'names', 'light')"),
        _finding("filter-cycle", "path", "circle c JOIN (SELECT graph, title AS start, entry_index FROM last) USING (graph, start)", title="start", detail="path"),
        _finding("candidate-page", "title", "(SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY graph ORDER BY title) <= 25)", index="NULL::INT"),
        _finding("candidate-page", "'__truncation_marker__'", "(SELECT graph, count(*) - 25 AS more FROM near GROUP BY graph HAVING count(*) > 25)", index="NULL::INT", title="NULL", detail="more::VARCHAR"),
    ]
)
_AUDITED = f"WITH RECURSIVE {D.PAGES}, {D.ENTRIES}, {D.RESOLVED}, {D.META}, {D.NEAR}, {_CIRCLES}, found AS ({_AUDIT})"


def _hop(n: int) -> str:
    """CTEs of one hop of the selection: t<n> from t<n - 1>."""
    before = f"t{n - 1}"
    return f"""
    n{n} AS (SELECT e.graph, e.dst AS title, sum(e.weight * t.times) AS raw, min([t.hop, t.place, e.seq]) AS seen FROM edge e JOIN {before} t ON t.graph = e.graph AND t.title = e.src GROUP BY ALL),
    c{n} AS (SELECT n.*, CASE WHEN coalesce(degree, 0) > 12 THEN raw * 0.15::DOUBLE ELSE raw::DOUBLE END AS score FROM n{n} n JOIN pages p ON p.graph = n.graph AND p.title = n.title
             LEFT JOIN degree d ON d.graph = n.graph AND d.title = n.title WHERE NOT EXISTS (SELECT 1 FROM {before} t WHERE t.graph = n.graph AND t.title = n.title)),
    k{n} AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY score DESC, seen) AS place FROM c{n} WHERE score >= 1),
    t{n} AS (SELECT * FROM {before} UNION ALL SELECT k.graph, k.title, {n} AS hop, score, 1 AS times, place FROM k{n} k JOIN (SELECT graph, count(*) AS size FROM {before} GROUP BY ALL) s ON s.graph = k.graph WHERE place + size <= 25)"""


_SELECTED = f"""
    degree AS (SELECT graph, src AS title, count(*) AS degree FROM edge GROUP BY ALL),
    t0 AS (SELECT e.graph, e.title, 0 AS hop, 'infinity'::DOUBLE AS score, count(*) AS times, min(entry_index) AS place
           FROM entries e JOIN (SELECT DISTINCT graph, title FROM pages) p ON p.graph = e.graph AND p.title = e.title WHERE tier = 'seed' GROUP BY ALL),{_hop(1)},{_hop(2)},
    chosen AS (SELECT graph, title, hop, score FROM t2)"""
_EDGE_OF = """
    rim AS (SELECT e.graph, e.dst AS title, e.src FROM edge e JOIN chosen c ON c.graph = e.graph AND c.title = e.src WHERE NOT EXISTS (SELECT 1 FROM chosen o WHERE o.graph = e.graph AND o.title = e.dst)),
    boundary AS (SELECT graph, title, count(*) AS refs, string_agg(src, '|' ORDER BY src) AS referenced_by FROM rim GROUP BY ALL)"""

SQL = {
    "r_metadata": f"WITH {D.PAGES}, {D.META} SELECT graph, title, category, type, project, array_to_string(tags, '|') AS tags, len(links)::INT AS links FROM meta",
    "r_outlinks": f"WITH {D.PAGES}, {D.EDGES} SELECT graph, src, dst, weight FROM edge",
    "r_linked": f"WITH {D.PAGES}, {D.EDGES} SELECT graph, dst AS title, count(*) AS sources, sum(weight)::BIGINT AS weight FROM edge GROUP BY ALL",
    "r_resolved": f"WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED} SELECT * FROM resolved",
    "r_missing_sources": f"WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED} SELECT graph, entry_index, title FROM resolved WHERE page_file IS NULL",
    "r_assets": rf"""WITH {D.BODIES}, a AS (SELECT DISTINCT body_id, string_split(r, '/')[-1] AS asset FROM (
            SELECT body_id, unnest(regexp_extract_all(content, '!\[[^\]]*\]\(([^)\s]+)\)', 1)) AS r FROM bodies)
            WHERE regexp_matches(r, '^(?:(?:\.\.|\.)/)*assets/.+'))
        SELECT asset, count(*) AS bodies FROM a WHERE asset <> '' GROUP BY ALL""",
    "r_self_filters": f"WITH {D.ENTRIES} SELECT graph, 'filter-self-reference:' || title || '#' || pos AS id FROM filt WHERE coalesce(prepend, append) = title",
    "r_redact_conflicts": f"""WITH {D.ENTRIES} SELECT graph, entry_index, title FROM entries
        WHERE redact IS NOT NULL AND len(list_filter(filters, lambda f: f.redact IS NOT NULL)) > 0""",
    "r_unknown_modes": f"""WITH {D.ENTRIES} SELECT graph, 'filter-redact-mode-unknown:' || title || '#' || pos || ':' || mode AS id
        FROM filt WHERE mode NOT IN ('none', 'names', 'light')""",
    "r_duplicates": f"""WITH {D.ENTRIES} SELECT graph, title, string_agg(entry_index::VARCHAR, ',' ORDER BY entry_index) AS entries
        FROM entries GROUP BY graph, title HAVING count(*) > 1""",
    "r_sections": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.META} SELECT m.graph, coalesce(category, '(uncategorized)') AS section, tag, count(*) AS n
        FROM (SELECT m.*, unnest(tags) AS tag FROM entries e JOIN meta m ON m.graph = e.graph AND m.title = e.title) m GROUP BY ALL""",
    "r_placement": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.META}, {D.EDGES}, {D.NEAR},
            k AS (SELECT m.* FROM meta m JOIN near n ON n.graph = m.graph AND n.title = m.title),
            mem AS (SELECT DISTINCT e.graph, e.title, coalesce(m.category, '(uncategorized)') AS section FROM entries e LEFT JOIN meta m ON m.graph = e.graph AND m.title = e.title),
            stag AS (SELECT DISTINCT m.graph, coalesce(m.category, '(uncategorized)') AS section, unnest(m.tags) AS tag FROM entries e JOIN meta m ON m.graph = e.graph AND m.title = e.title),
            ev AS (
                SELECT DISTINCT k.graph, k.title, k.category AS section, 1 AS category_match, 0 AS outbound, 0 AS inbound, 0 AS shared_tags FROM k JOIN mem ON mem.graph = k.graph AND mem.section = k.category
                UNION ALL SELECT x.graph, x.title, mem.section, 0, 1, 0, 0 FROM (SELECT graph, title, unnest(links) AS l FROM k) x JOIN mem ON mem.graph = x.graph AND mem.title = x.l
                UNION ALL SELECT x.graph, x.l, mem.section, 0, 0, 1, 0 FROM (SELECT graph, title, unnest(links) AS l FROM meta) x JOIN mem ON mem.graph = x.graph AND mem.title = x.title
                    JOIN k ON k.graph = x.graph AND k.title = x.l
                UNION ALL SELECT x.graph, x.title, stag.section, 0, 0, 0, 1 FROM (SELECT graph, title, unnest(tags) AS t FROM k) x JOIN stag ON stag.graph = x.graph AND stag.tag = x.t),
            s AS (SELECT graph, title, section, sum(category_match)::BIGINT AS category_match, sum(outbound)::BIGINT AS outbound, sum(inbound)::BIGINT AS inbound, sum(shared_tags)::BIGINT AS shared_tags
                  FROM ev GROUP BY ALL)
        SELECT graph, title, section, (row_number() OVER (PARTITION BY graph, title ORDER BY score DESC, lower(section), section DESC))::INT AS rank, score, category_match, outbound, inbound, shared_tags
        FROM (SELECT *, category_match * 20 + outbound * 5 + inbound * 3 + shared_tags AS score FROM s) QUALIFY rank <= 3""",
    "r_backlinks": f"""WITH {D.ENTRIES}, x AS (SELECT DISTINCT graph, title FROM entries WHERE exclude),
            b AS (SELECT DISTINCT graph, entry_index, unnest(backlinks) AS link FROM entries)
        SELECT b.graph, entry_index, link FROM b JOIN x ON x.graph = b.graph AND x.title = b.link""",
    "r_run_counts": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED}, {D.PROPERTIES}, anchors AS (
            SELECT graph, title FROM props GROUP BY ALL HAVING bool_or(key = 'type' AND value IN ('anchor', 'image-anchor')) AND bool_or(key = 'tg-doc' AND value <> '')),
            state AS (SELECT p.graph, p.file, a.title IS NOT NULL AS missing FROM pages p LEFT JOIN anchors a ON a.graph = p.graph AND a.title = p.title)
        SELECT r.graph, count(*) FILTER (NOT coalesce(exclude, false) AND page_file IS NOT NULL) AS included, count(*) FILTER (coalesce(exclude, false)) AS excluded,
               count(*) FILTER (NOT coalesce(exclude, false) AND page_file IS NULL) AS missing, 0::BIGINT AS hydrated, count(*) FILTER (NOT coalesce(exclude, false) AND s.missing) AS unhydrated
        FROM resolved r JOIN entries e ON e.graph = r.graph AND e.entry_index = r.entry_index AND e.title = r.title LEFT JOIN state s ON s.graph = r.graph AND s.file = r.page_file GROUP BY ALL""",
    "r_record_issues": f"""WITH {D.PAGES}, {D.META}
        SELECT graph, title AS slug, 'category' AS field, 'is required' AS message FROM meta WHERE category IS NULL
        UNION ALL SELECT graph, title, 'type', 'is required' FROM meta WHERE type IS NULL""",
    "r_filter_warnings": f"""WITH {D.PAGES}, {D.ENTRIES}, f AS (
            SELECT t.*, coalesce(prepend, append) AS ref FROM filt t JOIN entries e USING (graph, entry_index, title) WHERE NOT coalesce(e.exclude, false)),
            w AS (SELECT f.graph, entry_index, pos::INT AS pos, CASE WHEN ref = f.title THEN 'splices itself' WHEN ref IS NOT NULL AND p.title IS NULL THEN 'no page ' || ref
                         WHEN ref IS NULL AND mode NOT IN ('none', 'names') THEN 'no rules for ' || mode END AS warning FROM f LEFT JOIN pages p ON p.graph = f.graph AND p.title = f.ref)
        SELECT * FROM w WHERE warning IS NOT NULL""",
    "r_hubs": f"WITH {D.PAGES}, {D.EDGES} SELECT graph, src AS title, count(*) AS degree FROM edge GROUP BY ALL HAVING count(*) > 4",
    "r_neighbours": f"WITH {D.PAGES}, {D.ENTRIES}, {D.META}, {D.NEAR} SELECT graph, title, 1 AS hop FROM near",
    "r_broken_filters": f"{_AUDITED} SELECT graph, id, detail FROM found WHERE kind = 'filter-reference-broken'",
    "r_cycles": f"{_AUDITED} SELECT graph, id, title FROM found WHERE kind = 'filter-cycle'",
    "r_audit": f"{_AUDITED} SELECT * FROM found",
    "r_severities": f"""{_AUDITED} SELECT graph, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info
        FROM found GROUP BY ALL""",
    "r_stale": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED}, seen AS (
            SELECT r.graph, r.title, r.entry_index, p.content || chr(10) || '- checked' || chr(10) || '  verified:: [[' || strftime(p.c, '%Y-%m-%d') || ']]' AS content
            FROM resolved r JOIN entries e USING (graph, entry_index, title) JOIN pages p ON p.graph = r.graph AND p.file = r.page_file WHERE NOT coalesce(exclude, false)), {_STALE}
        SELECT graph, 'block-stale-verified:' || title || '::' || strftime(day, '%Y-%m-%d') || '::' || i AS id, detail FROM stale""",
    "r_subgraph": f"WITH {D.PAGES}, {D.ENTRIES}, {D.EDGES}, {_SELECTED} SELECT * FROM chosen",
    "r_boundary": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.EDGES}, {_SELECTED}, {_EDGE_OF}
        SELECT b.graph, b.title, p.title IS NOT NULL AS exists, refs::INT AS refs, referenced_by FROM boundary b LEFT JOIN pages p ON p.graph = b.graph AND p.title = b.title""",
    "r_properties": f"WITH {D.PAGES}, {D.PROPERTIES} SELECT * FROM props",
    "r_slugs": f"WITH {D.PAGES} SELECT DISTINCT title, {D.route_slug('title')} AS slug, {D.vault_title('title')} AS vault_title FROM pages",
    "r_contents": f"""WITH {D.ENTRIES},
            grp AS (SELECT graph, tier, min(entry_index) AS ord, string_agg('- [[' || {D.vault_title('title')} || ']]', chr(10) ORDER BY entry_index, title) AS rows FROM entries GROUP BY ALL)
        SELECT graph, '---' || chr(10) || 'title: "Contents"' || chr(10) || 'type: "moc"' || chr(10) || 'projected_from: "page graph"' || chr(10) || '---' || chr(10) || chr(10) || '# Contents' || chr(10) || chr(10)
               || string_agg(CASE WHEN tier <> 'default' THEN '## ' || tier || chr(10) ELSE '' END || rows || chr(10), chr(10) ORDER BY ord) AS text FROM grp GROUP BY ALL""",
    "r_dependencies": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED}, shown AS (SELECT * FROM entries WHERE NOT coalesce(exclude, false)),
            spliced AS (SELECT f.graph, f.entry_index, coalesce(prepend, append) AS title FROM filt f JOIN shown s ON s.graph = f.graph AND s.entry_index = f.entry_index AND s.title = f.title WHERE coalesce(prepend, append) <> ''),
            {D.found_files("more", "spliced")}
        SELECT r.graph, r.entry_index, page_file AS path FROM resolved r JOIN shown s USING (graph, entry_index, title) WHERE page_file IS NOT NULL
        UNION SELECT s.graph, s.entry_index, m.file FROM spliced s JOIN more m ON m.graph = s.graph AND m.title = s.title""",
}
