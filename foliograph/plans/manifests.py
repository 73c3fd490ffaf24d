"""Queries over manifests as documents: validation, references, and ordered edits with their preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import manifest, patch
from foliograph.operators import pages as P
from foliograph.plans import dialect as D
from foliograph.session import cut_lineage
from foliograph.sources import latest_rows, load

_FIELDS = ["title", "tier", "backlinks", "exclude", "redact", "file", "filters"]


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return latest_rows(load(spark, base, "publish_entries"), "entry_id", ["graph_path", "entry_index", *_FIELDS]).withColumnRenamed("graph_path", "graph")


def _documents(spark: SparkSession, base: str) -> DataFrame:
    """(graph, entry_index, json): every entry as the manifest writes it, with the slips a writer makes.

    An entry with a file also has a field the schema doesn't know; one that is excluded says so in words where it
    has backlinks; one with both kinds of splices in its filters writes them into one.
    """
    rows = _rows(spark, base)
    excluded = F.col("exclude") & F.coalesce(F.size("backlinks") > 0, F.lit(False))
    slips = F.struct(
        "title", "tier", "backlinks",
        F.when(F.coalesce(excluded, F.lit(False)), F.parse_json(F.lit('"yes"'))).otherwise(F.parse_json(F.col("exclude").cast("string"))).alias("exclude"),
        "redact", "file", F.col("file").alias("slug"), "filters",
    )
    return rows.select("graph", "entry_index", "title", F.to_json(slips).alias("json"))


def r_issues(spark: SparkSession, base: str) -> DataFrame:
    """Every violation of the entries of all manifests."""
    found = manifest.entry_issues(manifest.entries_of_rows(_documents(spark, base), "graph"), "graph")
    return found.select("graph", "entry_index", "path", "message", "severity")


def r_valid(spark: SparkSession, base: str) -> DataFrame:
    """The entries of all manifests that are valid by themselves, counted anew."""
    rows = _documents(spark, base).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("entry_index", "json"))).alias("es"))
    texts = F.array_join(F.transform("es", lambda e: e["json"]), ",")
    raw = rows.select(F.col("graph").alias("manifest"), F.concat(F.lit('{"graphPath":"g","entries":['), texts, F.lit("]}")).alias("json"))
    good = manifest.valid_entries(raw)
    return good.select(F.col("manifest").alias("graph"), "entry_index", "raw_index", "title", "tier", F.size("filters").alias("filters"))


def r_reference_issues(spark: SparkSession, base: str) -> DataFrame:
    """Entries of all manifests whose page isn't there, and manifests of graphs without pages."""
    pages = P.alive_pages(load(spark, base, "graph_pages"), text=False)
    return manifest.reference_issues(_rows(spark, base), pages, pages.select("graph").distinct())


def _patched(spark: SparkSession, base: str) -> DataFrame:
    """Every manifest after its edits: excluded titles removed, marks of redaction unset, n-hop titles set to 2-hop, and pages that backlinks name added.

    Edits of titles with a file give no reason, and there is one to a title that no manifest has.
    """
    rows = _rows(spark, base)
    entries = rows.select(F.col("graph").alias("manifest"), "entry_index", "title", F.to_json(F.struct(*_FIELDS)).alias("entry"))
    title = rows.groupBy("graph", "title").agg(
        F.max(F.coalesce("exclude", F.lit(False))).alias("out"), F.max(F.col("redact").isNotNull()).alias("redacted"), F.max(F.col("tier") == "n-hop").alias("far"),
        F.max(F.col("file").isNotNull()).alias("filed"), F.min("entry_index").alias("at"),
    )
    op = F.when(F.col("out"), "remove").when(F.col("redacted"), "unset").when(F.col("far"), "set")
    none = F.lit(None).cast("string")
    edits = title.filter(op.isNotNull()).select(
        F.col("graph").alias("manifest"), F.col("at").alias("op_index"), op.alias("op"), "title", F.when(op == "unset", "redact").when(op == "set", "tier").alias("field"),
        F.when(op == "set", F.lit('"2-hop"')).alias("value"), none.alias("entry"), F.when(~F.col("filed"), "tidy").otherwise("").alias("rationale"),
    )
    named = rows.select("graph", F.explode(F.array_distinct("backlinks")).alias("title")).distinct().join(title.select("graph", "title"), ["graph", "title"], "left_anti")
    entry = F.to_json(F.struct("title", F.lit("n-hop").alias("tier")))
    added = named.filter(F.col("title") != "").select(
        F.col("graph").alias("manifest"), F.lit(1_000_000).alias("op_index"), F.lit("add").alias("op"), "title", none.alias("field"), none.alias("value"), entry.alias("entry"), F.lit("linked").alias("rationale")
    )
    lost = rows.select(F.col("graph").alias("manifest")).distinct().select(
        "manifest", F.lit(2_000_000).alias("op_index"), F.lit("remove").alias("op"), F.lit("no such title").alias("title"), none.alias("field"), none.alias("value"), none.alias("entry"), F.lit("r").alias("rationale")
    )
    return cut_lineage(patch.apply_patch(entries, edits.unionByName(added).unionByName(lost)))


def r_patch_log(spark: SparkSession, base: str) -> DataFrame:
    """What each edit came to: a change or an error."""
    rows = _patched(spark, base).filter(F.col("what") != "entry")
    return rows.select("manifest", "title", "what", "op", F.get_json_object("before", "$.tier").alias("tier_before"), F.get_json_object("after", "$.tier").alias("tier_after"), "message")


def r_patched(spark: SparkSession, base: str) -> DataFrame:
    """Every manifest after its edits."""
    rows = patch.patched_entries(_patched(spark, base))
    tier, redact = F.get_json_object("entry", "$.tier"), F.get_json_object("entry", "$.redact")
    return rows.select("manifest", "entry_index", "title", tier.alias("tier"), redact.alias("redact"))


def r_affected(spark: SparkSession, base: str) -> DataFrame:
    """Entries that the edits change, and those whose backlinks name a changed title, in order."""
    return patch.affected_entries(_patched(spark, base)).select("manifest", "entry_index", "title", "direct", "place")


def r_patch_reasons(spark: SparkSession, base: str) -> DataFrame:
    """The log of reasons of all edits."""
    return patch.rationale_log(_patched(spark, base), 1_750_000_000)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("r_")}

_AT = "'$.entries[' || entry_index || ']"
_ISSUES = f"""{D.ENTRIES},
    e AS (SELECT *, coalesce(exclude AND len(backlinks) > 0, false) AS slip FROM entries),
    titles AS (SELECT graph, title, list(entry_index ORDER BY entry_index) AS spots FROM e WHERE title <> '' GROUP BY ALL HAVING count(*) > 1),
    kinds AS (SELECT *, (prepend IS NOT NULL)::INT + (append IS NOT NULL)::INT + (mode IS NOT NULL)::INT AS n FROM filt),
    issue AS (
        SELECT graph, entry_index, {_AT}.title' AS path, 'must be a non-empty string' AS message, 'error' AS severity FROM e WHERE coalesce(title, '') = ''
        UNION ALL SELECT graph, entry_index, {_AT}.tier', 'must be one of seed, 1-hop, 2-hop, n-hop', 'error' FROM e WHERE coalesce(tier, '') NOT IN ('seed', '1-hop', '2-hop', 'n-hop')
        UNION ALL SELECT graph, entry_index, {_AT}.exclude', 'must be a boolean', 'error' FROM e WHERE slip
        UNION ALL SELECT graph, entry_index, {_AT}.redact', 'must be one of light', 'error' FROM e WHERE redact <> 'light'
        UNION ALL SELECT graph, entry_index, {_AT}.redact', 'redact and a redact filter exclude each other', 'error' FROM e
            WHERE redact = 'light' AND len(list_filter(filters, lambda f: f.redact <> '')) > 0
        UNION ALL SELECT graph, entry_index, {_AT}.slug', 'unknown field', 'warning' FROM e WHERE file IS NOT NULL
        UNION ALL SELECT graph, entry_index, {_AT}.filters[' || pos || ']', 'filter must have exactly one key', 'error' FROM kinds WHERE n <> 1
        UNION ALL SELECT graph, entry_index, {_AT}.filters[' || pos || '].' || CASE WHEN prepend = '' THEN 'prepend' WHEN append = '' THEN 'append' ELSE 'redact' END, 'must be a non-empty string', 'error'
            FROM kinds WHERE n = 1 AND (prepend = '' OR append = '' OR mode = '')
        UNION ALL SELECT graph, -1, '$.entries', 'title "' || title || '" at entries ' || array_to_string(spots, ', '), 'error' FROM titles)"""
_PATCH = f"""{D.ENTRIES},
    ti AS (SELECT graph, title, bool_or(coalesce(exclude, false)) AS out, bool_or(redact IS NOT NULL) AS redacted, bool_or(tier = 'n-hop') AS far, bool_or(file IS NOT NULL) AS filed, min(entry_index) AS spot
           FROM entries GROUP BY ALL),
    ed AS (SELECT *, CASE WHEN out THEN 'remove' WHEN redacted THEN 'unset' WHEN far THEN 'set' END AS op FROM ti),
    done AS (SELECT * FROM ed WHERE op IS NOT NULL AND NOT filed),
    named AS (SELECT DISTINCT graph, title FROM (SELECT graph, unnest(backlinks) AS title FROM entries) WHERE title <> ''),
    added AS (SELECT n.* FROM named n WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.graph = n.graph AND ti.title = n.title)),
    -- Edits find the first entry of their title.
    after AS (
        SELECT e.graph, 0 AS part, e.entry_index AS spot, e.title, CASE WHEN d.op = 'set' THEN '2-hop' ELSE tier END AS tier, CASE WHEN d.op = 'unset' THEN NULL ELSE redact END AS redact, backlinks
        FROM entries e LEFT JOIN done d ON d.graph = e.graph AND d.title = e.title AND d.spot = e.entry_index WHERE coalesce(d.op, '') <> 'remove'
        UNION ALL SELECT graph, 1, 1000000, title, 'n-hop', NULL, NULL FROM added),
    placed AS (SELECT *, (row_number() OVER (PARTITION BY graph ORDER BY part, spot, title) - 1)::INT AS entry_index FROM after),
    changed AS (SELECT graph, title, op FROM done UNION ALL SELECT graph, title, 'add' FROM added),
    hit AS (SELECT graph, entry_index, title, true AS direct FROM placed p WHERE EXISTS (SELECT 1 FROM changed c WHERE c.graph = p.graph AND c.title = p.title)),
    ripple AS (SELECT DISTINCT p.graph, p.entry_index, p.title, false AS direct FROM (SELECT *, unnest(backlinks) AS link FROM placed) p JOIN changed c ON c.graph = p.graph AND c.title = p.link
               WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.graph = p.graph AND h.entry_index = p.entry_index))"""

SQL = {
    "r_issues": f"WITH {_ISSUES} SELECT * FROM issue",
    "r_valid": f"""WITH {_ISSUES}, bad AS (SELECT DISTINCT graph, entry_index FROM issue WHERE severity = 'error' AND entry_index >= 0)
        SELECT e.graph, (row_number() OVER (PARTITION BY e.graph ORDER BY e.entry_index) - 1)::INT AS entry_index, e.entry_index AS raw_index, title, tier, len(filters)::INT AS filters
        FROM e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.graph = e.graph AND b.entry_index = e.entry_index)""",
    "r_reference_issues": f"""WITH {D.PAGES}, {D.ENTRIES}, {D.RESOLVED}, known AS (SELECT DISTINCT graph FROM pages)
        SELECT r.graph, r.entry_index, '$.entries[' || r.entry_index || ']' AS path, CASE WHEN page_file IS NULL THEN 'no page' ELSE 'page is in another file' END AS message,
               CASE WHEN page_file IS NULL THEN 'error' ELSE 'warning' END AS severity
        FROM resolved r JOIN entries e USING (graph, entry_index, title) JOIN known USING (graph) WHERE page_file IS NULL OR (file <> '' AND NOT ends_with('/' || page_file, '/' || file))
        UNION ALL SELECT DISTINCT graph, -1, '$.graphPath', 'graph has no pages', 'error' FROM entries WHERE graph NOT IN (SELECT graph FROM known)""",
    "r_patch_log": f"""WITH {_PATCH}, old AS (SELECT graph, title, min_by(tier, entry_index) AS tier FROM entries GROUP BY ALL)
        SELECT d.graph AS manifest, d.title, 'change' AS what, op, o.tier AS tier_before, CASE op WHEN 'remove' THEN NULL WHEN 'set' THEN '2-hop' ELSE o.tier END AS tier_after, NULL AS message
        FROM done d JOIN old o USING (graph, title)
        UNION ALL SELECT graph, title, 'error', op, NULL, NULL, 'rationale is required' FROM ed WHERE op IS NOT NULL AND filed
        UNION ALL SELECT graph, title, 'change', 'add', NULL, 'n-hop', NULL FROM added
        UNION ALL SELECT DISTINCT graph, 'no such title', 'error', 'remove', NULL, NULL, 'title is not in the manifest' FROM entries""",
    "r_patched": f"WITH {_PATCH} SELECT graph AS manifest, entry_index, title, tier, redact FROM placed",
    "r_affected": f"""WITH {_PATCH}, every AS (SELECT * FROM hit UNION ALL SELECT * FROM ripple)
        SELECT graph AS manifest, entry_index, title, direct, row_number() OVER (PARTITION BY graph ORDER BY NOT direct, entry_index)::INT AS place FROM every""",
    "r_patch_reasons": f"""WITH {_PATCH}, every AS (SELECT graph, title, op, 'tidy' AS rationale FROM done UNION ALL SELECT graph, title, 'add', 'linked' FROM added)
        SELECT graph AS manifest, 'manifest-edit-' || op || '-' || substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) || '-1750000000' AS key, op, title, rationale FROM every""",
}
