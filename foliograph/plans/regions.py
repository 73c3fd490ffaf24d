"""Queries over the regions of bodies: what they are, how well they are cited, edits of them, and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import recall, reconcile, regions
from foliograph.operators import pages as P
from foliograph.plans import dialect as D
from foliograph.sources import latest_rows, load, present


def _bodies(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(load(spark, base, "page_bodies"), "body_id", ["body"])
    return rows.select("body_id", F.coalesce("body", F.lit("")).alias("content"))


def r_regions(spark: SparkSession, base: str) -> DataFrame:
    """Regions of every body with their lines and hash."""
    return regions.page_regions(_bodies(spark, base), ["body_id"])


def r_findings(spark: SparkSession, base: str) -> DataFrame:
    """Findings of the bodies and whether they are cited."""
    return recall.findings(_bodies(spark, base), ["body_id"]).select("body_id", "line", "cited")


def r_recall(spark: SparkSession, base: str) -> DataFrame:
    """Citation recall of every region, those without findings included."""
    rows = recall.region_recall(_bodies(spark, base), ["body_id"])
    return rows.select("body_id", "region", "kind", "span_start", "cited", "total", "recall")


def r_recall_sources(spark: SparkSession, base: str) -> DataFrame:
    """Citation recall with the root divided by source, in the order it is read."""
    rows = recall.region_recall(_bodies(spark, base), ["body_id"], subdivide_root=True)
    return rows.select("body_id", "region", "kind", "cited", "total", "place")


def r_page_recall(spark: SparkSession, base: str) -> DataFrame:
    """Citation recall of every body."""
    return recall.page_recall(_bodies(spark, base), ["body_id"])


def r_recall_lines(spark: SparkSession, base: str) -> DataFrame:
    """The recall of every body as it is shown."""
    return recall.recall_lines(recall.region_recall(_bodies(spark, base), ["body_id"]), ["body_id"])


def r_hashes(spark: SparkSession, base: str) -> DataFrame:
    """Content hash of every body."""
    return _bodies(spark, base).select("body_id", T.content_hash(F.col("content")).alias("content_hash"))


def r_region_edits(spark: SparkSession, base: str) -> DataFrame:
    """What each verb makes of a body's first region: the hash of the new text."""
    rows = _bodies(spark, base).withColumn("rs", regions.regions_of(T.lines_of(F.col("content")))).filter(F.size("rs") > 0)
    order = F.transform("rs", lambda r: F.struct(r["span_start"].alias("a"), (-r["span_end"]).alias("b"), r["kind"].alias("k"), r.alias("r")))
    rows = rows.select("body_id", "content", F.array_sort(order)[0]["r"].alias("r"), F.array_sort(order)[F.size("rs") - 1]["r"].alias("t"))
    c, r, t = F.col("content"), F.col("r"), F.col("t")
    new = regions.render_region("fence", F.lit("new-part"), F.lit("words"))
    renamed, moved = regions.rename(c, r, F.lit("new-name")), regions.move(c, r, t, "after")
    edits = F.array(
        F.struct(F.lit("replace").alias("verb"), regions.replace_body(c, r, F.lit("new\nbody")).alias("text")),
        F.struct(F.lit("insert").alias("verb"), regions.insert_into_body(c, r, F.lit("more")).alias("text")),
        F.struct(F.lit("create").alias("verb"), regions.create_after(c, r, new).alias("text")),
        F.struct(F.lit("rename").alias("verb"), F.coalesce(renamed["content"], renamed["reason"]).alias("text")),
        F.struct(F.lit("move").alias("verb"), F.coalesce(moved["content"], moved["status"]).alias("text")),
    )
    return rows.select("body_id", F.explode(edits).alias("e")).select("body_id", "e.verb", F.md5("e.text").alias("text_hash"))


def _entries(spark: SparkSession, base: str) -> DataFrame:
    rows = latest_rows(load(spark, base, "publish_entries"), "entry_id", ["graph_path", "entry_index", "title", "file", "exclude"])
    return rows.withColumnRenamed("graph_path", "graph").filter(present(F.col("graph")) & present(F.col("title")))


def r_reconciled(spark: SparkSession, base: str) -> DataFrame:
    """Every manifest projected, stamped and reconciled with the pages there: what came of each entry.

    The page there is the latest body of the entry's title in its graph, which has no bridge yet.
    """
    pages = P.alive_pages(load(spark, base, "graph_pages"))
    bodies = latest_rows(load(spark, base, "page_bodies"), "body_id", ["graph_path", "title", "body", "rendered_at"])
    rows = bodies.filter(present(F.col("title"))).select(F.col("graph_path").alias("graph"), T.route_slug(F.col("title")).alias("slug"), "body", "rendered_at", "body_id")
    last = rows.groupBy("graph", "slug").agg(F.max_by("body", F.struct("rendered_at", "body_id")).alias("content"))
    targets = last.select("graph", "slug", F.coalesce("content", F.lit("")).alias("content"), F.lit(None).cast("map<string,string>").alias("prior"))
    done = reconcile.reconcile_manifest(_entries(spark, base), pages, targets)
    return done.select("graph", "slug", "title", "error", "grounded", "first_run", *[F.size(c).alias(c) for c in ("created", "regenerated", "removed", "unchanged")], F.md5("content").alias("content_hash"))


def r_health(spark: SparkSession, base: str) -> DataFrame:
    """State of every region of the bodies, were each heading's region projected: against a page and a projection with other words."""
    marked = F.regexp_replace("content", r"(?md)^(#{1,6}[ \t]+[^\s][^\r\n]*)", '$1\n<!-- projected: source="P#x" -->')
    pages = _bodies(spark, base).select(F.col("body_id").cast("string").alias("page"), marked.alias("content"))
    bridge = regions.page_regions(pages, ["page"]).filter(F.col("source").isNotNull())
    first = bridge.groupBy("page", "id").agg(F.min_by("content_hash", "span_start").alias("content_hash"))
    other = lambda old, new: pages.withColumn("content", F.replace("content", F.lit(old), F.lit(new)))
    return reconcile.bridge_health(other(" the ", " a "), first, other(" and ", " or "))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("r_")}

_ID = r"""\bid=["'']([A-Za-z0-9_-]+)["'']"""
_SLUG = r"trim(regexp_replace(replace(replace(lower({0}), '''', ''), '’', ''), '[^a-z0-9]+', '-', 'g'), '-')"
_PROJECTED = r"<(?:Region|SectionHeading)\b[^>]*\bprojected\b"
_SOURCE = r"""nullif(regexp_extract({0}, '\bsource=["'']([^"'']+)["'']', 1), '')"""

#: CTEs l (lines of bodies) and region, as a region is defined.
_REGIONS = rf"""{D.BODIES},
    l AS (SELECT body_id, (i - 1)::INT AS i, x FROM (SELECT body_id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM bodies)),
    ends AS (SELECT body_id, max(i) AS last FROM l GROUP BY ALL),
    h AS (SELECT body_id, i, CASE WHEN regexp_matches(x, '^#{{1,6}}\s+.+?\s*$') THEN length(regexp_extract(x, '^(#{{1,6}})\s', 1))
                                  WHEN regexp_matches(x, '^\s*<SectionHeading\b[^>]*/>\s*$') AND regexp_matches(x, '{_ID}')
                                  THEN coalesce(try_cast(nullif(regexp_extract(x, '\blevel=["'']?(\d)["'']?', 1), '') AS INT), 2) END::INT AS level,
                 CASE WHEN regexp_matches(x, '^#{{1,6}}\s+.+?\s*$') THEN {_SLUG.format(r"regexp_extract(x, '^#{1,6}\s+(.+?)\s*$', 1)")} ELSE regexp_extract(x, '{_ID}', 1) END AS id FROM l),
    hd AS (SELECT * FROM h WHERE level IS NOT NULL),
    sec AS (SELECT a.body_id, a.id, 'heading' AS kind, a.level, a.i + 1 AS body_start, coalesce(min(o.i) - 1, any_value(last)) AS body_end, a.i AS span_start
            FROM hd a JOIN ends USING (body_id) LEFT JOIN hd o ON o.body_id = a.body_id AND o.i > a.i AND o.level <= a.level GROUP BY ALL),
    mark AS (SELECT body_id, i, 1 AS form, regexp_extract(x, '^<!--\s*region:\s*([A-Za-z0-9_-]+)\s*-->\s*$', 1) AS id, regexp_matches(x, '^<!--\s*/region\s*-->\s*$') AS closes FROM l
             UNION ALL SELECT body_id, i, 2, regexp_extract(x, '^\s*<Region\s+name=["'']([A-Za-z0-9_-]+)["'']\s*>\s*$', 1), regexp_matches(x, '^\s*</Region>\s*$') FROM l),
    fen AS (SELECT a.body_id, a.id, 'fence' AS kind, NULL::INT AS level, a.i + 1 AS body_start, min(b.i) - 1 AS body_end, a.i AS span_start
            FROM mark a JOIN mark b ON b.body_id = a.body_id AND b.form = a.form AND b.closes AND b.i > a.i WHERE a.id <> '' GROUP BY a.body_id, a.form, a.id, a.i),
    region AS (SELECT *, greatest(body_end, span_start)::INT AS span_end FROM sec UNION ALL SELECT *, (body_end + 1)::INT FROM fen)"""
_SHOWN = rf"""{D.strip(rf"regexp_replace(regexp_replace(x, '\A(?:[>#*_`-]|{D.BLANK})+', ''), '(?:[*_`~]|{D.BLANK})+\z', '')")}"""
_INNER = rf"""
    inner_line AS (SELECT r.body_id, r.kind, r.span_start, l.i, l.x, {_SHOWN} AS shown, {D.strip("x")} AS bare
                   FROM region r JOIN l ON l.body_id = r.body_id AND l.i BETWEEN r.body_start AND r.body_end),
    text AS (SELECT body_id, kind, span_start, string_agg(x, chr(10) ORDER BY i) AS body, min_by(shown, i) FILTER (shown <> '') AS preview, min_by(bare, i) FILTER (bare <> '') AS head
             FROM inner_line GROUP BY ALL),
    told AS (SELECT r.*, coalesce(substr(t.preview, 1, 72), '') AS preview,
                    {_SOURCE.format(rf"CASE WHEN regexp_matches(a.x, '{_PROJECTED}') THEN a.x ELSE regexp_extract(t.head, '^<!--\s*projected:\s*(.*?)-->\s*$', 1) END")} AS source,
                    {D.HASHED.format("coalesce(t.body, '')")} AS content_hash
             FROM region r JOIN l a ON a.body_id = r.body_id AND a.i = r.span_start LEFT JOIN text t ON t.body_id = r.body_id AND t.kind = r.kind AND t.span_start = r.span_start)"""
_FOUND = rf"""
    lc AS (SELECT body_id, (i - 1)::INT AS i, x FROM (SELECT body_id, unnest(regexp_split_to_array(content, '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(content, '\r?\n'), 1) AS i FROM bodies)),
    said AS (SELECT *, len(list_filter(regexp_extract_all(x, '_\(([^)]+)\)_', 1), lambda m: trim(m) IN ('well-supported', 'supported', 'grounded') OR regexp_matches(trim(m), '^(?i)unverified\b'))) > 0 AS finding,
                    regexp_matches(x, '\[\^[^\]]+\](?:[^:]|$)') AS cited FROM lc),
    owned AS (SELECT s.*, r.id, r.kind, r.span_start FROM said s LEFT JOIN region r ON r.body_id = s.body_id AND s.i BETWEEN r.span_start AND r.span_end
              QUALIFY row_number() OVER (PARTITION BY s.body_id, s.i ORDER BY r.span_start DESC NULLS LAST, r.span_end) = 1)"""
_ROWS = """SELECT body_id, id AS region, kind, span_start, span_end, NULL::INT AS i, NULL::BOOL AS cited FROM region
           UNION ALL SELECT body_id, ':root', 'root', -1, -1, NULL, NULL FROM bodies"""
_SCORED = f"""rows AS ({_ROWS} UNION ALL SELECT body_id, coalesce(id, ':root'), coalesce(kind, 'root'), coalesce(span_start, -1), NULL, i, cited FROM owned WHERE finding),
    scored AS (SELECT body_id, region, kind, span_start, count(*) FILTER (cited) AS cited, count(i) AS total FROM rows GROUP BY ALL)"""
_GROUPS = rf"""
    opens AS (SELECT body_id, i, title, 'src:' || coalesce(nullif(substr({_SLUG.format("stem")}, 1, 60), ''), 'group') AS base FROM (
        SELECT *, coalesce(nullif(trim(regexp_replace(title, '\s*\([^()]*\)\s*$', '')), ''), title) AS stem FROM (
            SELECT *, {D.strip(r"regexp_extract(x, '^[-*]\s+(.*)$', 1)")} AS title FROM owned WHERE id IS NULL AND NOT finding)
        WHERE title <> '' AND NOT regexp_matches(title, '^\[\^[^\]]+\]:') AND NOT regexp_matches(title, '^(?i:Citations|Unverified)\b'))),
    -- Titles get their ids one after another, so that none takes an id in use.
    named AS (SELECT body_id, list(i ORDER BY i) AS spots, list_reduce(list([base] ORDER BY i), lambda acc, b: list_append(acc,
        CASE WHEN NOT list_contains(acc, b[1]) THEN b[1] ELSE list_filter(list_transform(range(2, len(acc) + 3), lambda n: b[1] || '-' || n), lambda c: NOT list_contains(acc, c))[1] END)) AS ids
        FROM opens GROUP BY ALL),
    grp AS (SELECT body_id, unnest(spots) AS i, unnest(ids) AS gid FROM named),
    ranged AS (SELECT body_id, i AS lo, coalesce(lead(i) OVER (PARTITION BY body_id ORDER BY i), 1000000000) AS hi, gid FROM grp),
    sub AS (SELECT o.body_id, coalesce(o.id, g.gid, ':root') AS region, coalesce(o.kind, 'root') AS kind, coalesce(o.span_start, -1) AS span_start, NULL::INT AS span_end, o.i, o.cited
            FROM owned o LEFT JOIN ranged g ON g.body_id = o.body_id AND o.id IS NULL AND o.i > g.lo AND o.i < g.hi WHERE finding),
    subrows AS ({_ROWS} UNION ALL SELECT * FROM sub)"""

_MARKED = _REGIONS.replace("coalesce(any_value(body), '')", r"""regexp_replace(coalesce(any_value(body), ''), '(?m)^(#{1,6}[ \t]+[^\s][^\r\n]*)', '\1' || chr(10) || '<!-- projected: source="P#x" -->', 'g')""")


def _edit(verb: str, text: str) -> str:
    return f"SELECT body_id, '{verb}' AS verb, md5({text}) AS text_hash FROM first"


_EOL = r"CASE WHEN contains(content, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END"


def _join(parts: str) -> str:
    return f"replace(array_to_string({parts}, chr(10)), chr(10), {_EOL})"


_EDITS = rf"""
    ranked AS (SELECT *, row_number() OVER w AS lo, count(*) OVER (PARTITION BY body_id) AS n FROM region WINDOW w AS (PARTITION BY body_id ORDER BY span_start, span_end DESC, kind)),
    first AS (SELECT b.body_id, content, regexp_split_to_array(content, '\r?\n') AS xs, a.body_start AS bs, a.body_end AS be, a.span_start AS s0, a.span_end AS s1, t.span_start AS t0, t.span_end AS t1,
                     greatest(a.body_end - a.body_start + 1, 0) AS size FROM bodies b JOIN ranked a ON a.body_id = b.body_id AND a.lo = 1 JOIN ranked t ON t.body_id = b.body_id AND t.lo = t.n),
    anchored AS (SELECT *, xs[s0 + 1] AS anchor FROM first),
    renamed AS (SELECT *, CASE WHEN regexp_matches(anchor, '^\s*<Region\s+name=["''][A-Za-z0-9_-]+["'']\s*>\s*$') THEN regexp_replace(anchor, '(name=["''])[A-Za-z0-9_-]+(["''])', '\1new-name\2')
                               WHEN regexp_matches(anchor, '^<!--\s*region:\s*[A-Za-z0-9_-]+\s*-->\s*$') THEN regexp_replace(anchor, '(region:\s*)[A-Za-z0-9_-]+', '\1new-name')
                               WHEN regexp_matches(anchor, '^\s*<SectionHeading\b[^>]*/>\s*$') THEN regexp_replace(anchor, '(\bid=["''])[A-Za-z0-9_-]+(["''])', '\1new-name\2') END AS new,
                         EXISTS (SELECT 1 FROM region r WHERE r.body_id = anchored.body_id AND r.id = 'new-name') AS taken FROM anchored)"""

SQL = {
    "r_regions": f"WITH {_REGIONS}, {_INNER} SELECT body_id, id, kind, level, body_start::INT AS body_start, body_end::INT AS body_end, span_start::INT AS span_start, span_end, preview, source, content_hash FROM told",
    "r_findings": f"WITH {_REGIONS}, {_FOUND} SELECT body_id, i AS line, cited FROM said WHERE finding",
    "r_recall": f"WITH {_REGIONS}, {_FOUND}, {_SCORED} SELECT *, cited / nullif(total, 0) AS recall FROM scored",
    "r_recall_sources": f"""WITH {_REGIONS}, {_FOUND}, {_GROUPS},
            sums AS (SELECT body_id, region, kind, span_start, max(span_end) AS span_end, count(*) FILTER (cited) AS cited, count(i) AS total, min(i) AS first,
                            CASE WHEN region = ':root' THEN 0 WHEN kind = 'root' THEN 2 ELSE 1 END AS rank FROM subrows GROUP BY body_id, region, kind, span_start)
        SELECT body_id, region, kind, cited, total,
               row_number() OVER (PARTITION BY body_id ORDER BY rank, CASE WHEN rank = 2 THEN first ELSE span_start END, span_end NULLS FIRST, region)::INT AS place FROM sums""",
    "r_page_recall": f"""WITH {_REGIONS}, {_FOUND}, s AS (SELECT body_id, count(*) AS total, count(*) FILTER (cited) AS cited FROM said WHERE finding GROUP BY ALL)
        SELECT body_id, coalesce(cited, 0)::BIGINT AS cited, coalesce(total, 0)::BIGINT AS total, cited / total AS recall FROM bodies LEFT JOIN s USING (body_id)""",
    "r_recall_lines": f"""WITH {_REGIONS}, {_FOUND}, {_SCORED},
            shown AS (SELECT *, cited || '/' || total || '=' || CASE WHEN total > 0 THEN printf('%.2f', cited / total) ELSE 'n/a' END AS share FROM scored),
            part AS (SELECT body_id, string_agg(region || ' ' || share, ' · ' ORDER BY span_start, region || ' ' || share) FILTER (total > 0 AND region <> ':root') AS parts, sum(cited)::BIGINT AS c, sum(total)::BIGINT AS t FROM shown GROUP BY ALL)
        SELECT body_id, 'recall ' || c || '/' || t || '=' || CASE WHEN t > 0 THEN printf('%.2f', c / t) ELSE 'n/a' END || coalesce(' · ' || parts, '') AS line FROM part""",
    "r_hashes": f"WITH {D.BODIES} SELECT body_id, {D.HASHED.format('content')} AS content_hash FROM bodies",
    "r_region_edits": f"""WITH {_REGIONS}, {_EDITS}
        {_edit("replace", _join("list_concat(list_concat(xs[1:bs], ['new', 'body']), xs[bs + size + 1:])"))}
        UNION ALL {_edit("insert", _join(f'''list_concat(list_concat(xs[1:be + 1], CASE WHEN len(list_filter(xs[bs + 1:be + 1], lambda x: {D.strip("x")} <> '')) > 0
                                            AND {D.strip("coalesce(xs[be + 1], '')")} <> '' THEN ['', 'more'] ELSE ['more'] END), xs[be + 2:])'''))}
        UNION ALL {_edit("create", _join(f'''list_concat(list_concat(list_concat(xs[1:s1 + 1], ['', '<Region name="new-part">', '', 'words', '', '</Region>']),
                                            CASE WHEN {D.strip("coalesce(xs[s1 + 2], '')")} <> '' THEN [''] ELSE [] END), xs[s1 + 2:])'''))}
        UNION ALL SELECT body_id, 'rename', md5(CASE WHEN taken THEN 'id exists' WHEN new IS NULL AND regexp_matches(anchor, '^(#{{1,6}})\\s+(.+?)\\s*$') THEN 'a heading''s id follows from its text'
                                            WHEN new IS NULL OR new = anchor THEN 'anchor can''t be rewritten' ELSE {_join("list_concat(list_concat(xs[1:s0], [new]), xs[s0 + 2:])")} END) FROM renamed
        UNION ALL {_edit("move", f'''CASE WHEN t1 < s0 OR t0 > s1 THEN {_join("list_concat(list_concat(list_concat(xs[1:s0], xs[s1 + 2:t1 + 1]), xs[s0 + 1:s1 + 1]), xs[t1 + 2:])")} ELSE 'refused' END''')}""",
    "r_health": f"""WITH {_MARKED}, {_INNER},
            was AS (SELECT body_id, id, min_by(content_hash, span_start) AS content_hash, min(span_start) AS span_start FROM told WHERE source IS NOT NULL GROUP BY ALL),
            now AS (SELECT w.*, {D.HASHED.format("replace(coalesce(t.body, ''), ' the ', ' a ')")} AS h, {D.HASHED.format("replace(coalesce(t.body, ''), ' and ', ' or ')")} AS n
                    FROM was w LEFT JOIN text t ON t.body_id = w.body_id AND t.kind = 'heading' AND t.span_start = w.span_start)
        SELECT body_id::VARCHAR AS page, id, CASE WHEN h <> content_hash THEN 'hash-mismatch' WHEN n <> content_hash THEN 'stale' ELSE 'synced' END AS state FROM now""",
}
