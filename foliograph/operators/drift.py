"""How far manifests have drifted from their graphs: one kind of finding per rule, ranked together.

``entries``: (graph, entry_index, title, file, exclude, redact, filters); ``pages``: those of
:func:`foliograph.operators.pages.alive_pages`. Every finding has id, kind, severity, the entry it stands at and
a detail. Nothing here depends on the clock: the present is an argument.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators.manifest import ENTRY_FIELDS
from foliograph.operators.pages import resolve
from foliograph.session import cut_lineage
from foliograph.sources import present

#: Kinds of findings in the order they are ranked, with their severity.
KINDS = {
    "source-missing": "error",
    "filter-redact-conflict": "error",
    "filter-self-reference": "error",
    "filter-reference-broken": "error",
    "filter-redact-mode-unknown": "error",
    "file-title-mismatch": "warn",
    "filter-cycle": "warn",
    "block-stale-verified": "warn",
    "unknown-field": "info",
    "candidate-page": "info",
}
SEVERITIES = ("error", "warn", "info")
VERIFIED = r"^\s*verified::\s*(?:\[\[)?(\d{4}-\d{2}-\d{2})(?:\]\])?\s*\z"
EXCERPT = 120
COLUMNS = ["graph", "id", "kind", "severity", "entry_index", "title", "detail"]


def _finding(df: DataFrame, kind: str, key: Column, detail: Column | None = None, title: str = "title", index: str | None = "entry_index") -> DataFrame:
    return df.select(
        "graph",
        F.concat_ws(":", F.lit(kind), key).alias("id"),
        F.lit(kind).alias("kind"),
        F.lit(KINDS[kind]).alias("severity"),
        (F.col(index) if index else F.lit(None)).cast("int").alias("entry_index"),
        F.col(title).alias("title"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )


def _rule(when: Column, kind: str, key: Column, detail: Column | None = None) -> Column:
    """A finding of the row at hand, or null."""
    said = (detail if detail is not None else F.lit(None)).cast("string")
    row = F.struct(F.concat_ws(":", F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), F.lit(KINDS[kind]).alias("severity"), said.alias("detail"))
    return F.when(F.coalesce(when, F.lit(False)), row)


def _apply(df: DataFrame, *rules: Column) -> DataFrame:
    """All findings of every row in one pass."""
    each = df.select("graph", F.col("entry_index").cast("int").alias("entry_index"), "title", F.explode(F.array_compact(F.array(*rules))).alias("x"))
    return each.select("graph", "entry_index", "title", "x.*").select(*COLUMNS)


def _filters(entries: DataFrame) -> DataFrame:
    each = entries.select("graph", "entry_index", "title", F.posexplode("filters").alias("pos", "f"))
    ref = F.coalesce(F.col("f.prepend"), F.col("f.append"))
    return each.select("graph", "entry_index", "title", "pos", ref.alias("ref"), F.col("f.redact").alias("mode"))


def _last_entries(entries: DataFrame) -> DataFrame:
    """(``graph``, ``ref``, ``excluded``, ``last_index``): of entries with one title the last holds."""
    return entries.groupBy("graph", F.col("title").alias("ref")).agg(
        F.max_by(F.coalesce("exclude", F.lit(False)), "entry_index").alias("excluded"), F.max("entry_index").alias("last_index")
    )


def entry_findings(placed: DataFrame) -> DataFrame:
    """Entries without a page, entries whose page isn't in the file they name, and entries that redact in two ways.

    ``placed``: entries with ``page_file``, as :func:`foliograph.operators.pages.resolve` gives them.
    """
    elsewhere = present(F.col("file")) & ~F.concat(F.lit("/"), "page_file").endswith(F.concat(F.lit("/"), F.col("file")))
    both = F.col("redact").isNotNull() & F.exists("filters", lambda f: f["redact"].isNotNull())
    return _apply(
        placed,
        _rule(F.col("page_file").isNull(), "source-missing", F.col("title")),
        _rule(F.col("page_file").isNotNull() & elsewhere, "file-title-mismatch", F.col("title")),
        _rule(both, "filter-redact-conflict", F.col("title")),
    )


def filter_findings(entries: DataFrame, known_modes: list[str] | None) -> DataFrame:
    """Filters that splice an entry into itself or what isn't a published entry, and modes the host doesn't have.

    Without a list of modes none is unknown. The filters are spelled out once for all rules.
    """
    rows = _filters(entries).join(_last_entries(entries).select("graph", "ref", "excluded"), ["graph", "ref"], "left")
    place = F.concat(F.col("title"), F.lit("#"), F.col("pos").cast("string"))
    self = F.col("ref") == F.col("title")
    lost = F.col("ref").isNotNull() & ~self & (F.col("excluded").isNull() | F.col("excluded"))
    unknown = F.col("mode").isNotNull() & ~F.col("mode").isin(*known_modes) if known_modes else F.lit(False)
    return _apply(
        rows,
        _rule(self, "filter-self-reference", place),
        _rule(lost, "filter-reference-broken", F.concat_ws(":", place, F.col("ref")), F.when(F.col("excluded").isNull(), "absent").otherwise("excluded")),
        _rule(unknown, "filter-redact-mode-unknown", F.concat_ws(":", place, F.col("mode"))),
    )


def _cycles(refs: pd.DataFrame) -> list[list[str]]:
    """Cycles that a depth-first search closes, in the order of the entries; each rotated to its smallest title."""
    after: dict[str, list[str]] = {}
    for title, ref in zip(refs["title"], refs["ref"]):
        row = after.setdefault(title, [])
        if ref not in row:
            row.append(ref)
    done: set[str] = set()
    found: dict[tuple[str, ...], list[str]] = {}
    for start in after:
        if start in done:
            continue
        path, on_path, todo = [start], {start}, [iter(after[start])]
        while todo:
            ref = next(todo[-1], None)
            if ref is None:
                todo.pop()
                node = path.pop()
                on_path.discard(node)
                done.add(node)
            elif ref in on_path:
                cycle = path[path.index(ref) :]
                k = cycle.index(min(cycle))
                canon = cycle[k:] + cycle[:k]
                found.setdefault(tuple(canon), canon)
            elif ref not in done:
                path.append(ref)
                on_path.add(ref)
                todo.append(iter(after.get(ref, ())))
    return list(found.values())


def filter_cycles(entries: DataFrame) -> DataFrame:
    """Filters that splice in a circle, one finding per cycle a depth-first search of the manifest closes.

    Only references between entries that are there, not excluded and not the entry itself count. References that
    end at an entry without references close no circle: they are removed in joins until none is left, so the search
    of a manifest sees nothing but its knots. Of entries with one title the last holds.
    """
    last = _last_entries(entries)
    refs = _filters(entries).filter(F.col("ref").isNotNull() & (F.col("ref") != F.col("title")))
    refs = refs.join(last.filter(~F.col("excluded")).select("graph", "ref"), ["graph", "ref"], "left_semi")
    holds = refs.groupBy("graph", "title").agg(F.min("entry_index").alias("first"), F.max("entry_index").alias("entry_index"))
    refs = cut_lineage(refs.join(holds, ["graph", "title", "entry_index"]).select("graph", "first", "pos", "title", "ref"))
    left = refs.count()
    while left:
        refs = cut_lineage(refs.join(refs.select("graph", F.col("title").alias("ref")).distinct(), ["graph", "ref"], "left_semi"))
        before, left = left, refs.count()
        if left == before:
            break

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "pos"], kind="stable")
        cycles = _cycles(pdf)
        return pd.DataFrame({"graph": [pdf["graph"].iloc[0]] * len(cycles), "title": [c[0] for c in cycles], "path": ["->".join(c) for c in cycles]})

    cycles = refs.groupBy("graph").applyInPandas(search, "graph string, title string, path string")
    at = last.select("graph", F.col("ref").alias("title"), F.col("last_index").alias("entry_index"))
    return _finding(cycles.join(at, ["graph", "title"], "left"), "filter-cycle", F.col("path"), F.col("path"))


def stale_blocks(entries: DataFrame, pages: DataFrame, now: datetime, threshold_days: int = 180) -> DataFrame:
    """Lines that say when a block was verified, if that is more than ``threshold_days`` ago; none for 0 days.

    The detail names the age in days and the nearest bullet in the six lines above. ``entries`` may be resolved already.
    """
    placed = entries if "page_file" in entries.columns else resolve(entries, pages)
    alive = placed.filter(~F.coalesce("exclude", F.lit(False)) & F.col("page_file").isNotNull())
    content = pages.select("graph", F.col("file").alias("page_file"), "content").filter(F.col("content").contains("verified::"))
    rows = alive.select("graph", "entry_index", "title", "page_file").join(content, ["graph", "page_file"])
    lines = F.split("content", "\n", -1)
    each = rows.select("graph", "entry_index", "title", lines.alias("lines"), F.posexplode(lines).alias("line", "text"))
    day = F.try_to_date(F.regexp_extract("text", VERIFIED, 1), "yyyy-MM-dd")
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(day.cast("timestamp"))).alias("age")
    dated = each.filter(F.col("text").rlike(VERIFIED)).withColumn("day", day).withColumn("age", age)
    old = dated.filter(F.col("day").isNotNull() & (F.col("age") > threshold_days * 86_400_000) & F.lit(threshold_days > 0))
    start = F.greatest(F.col("line") - 6, F.lit(0))
    above = F.transform(F.slice("lines", start + 1, F.col("line") - start), lambda x: T.strip_blank(F.regexp_extract(x, r"^\s*[-*]\s+(.*)\z", 1)))
    nearest = F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), above), lambda x: x.isNull() | (x != "")), -1)
    detail = F.concat_ws(" ", F.floor(F.col("age") / 86_400_000).cast("string"), F.substring(nearest, 1, EXCERPT))
    return _finding(old, "block-stale-verified", F.concat_ws("::", F.col("title"), F.col("day").cast("string"), F.col("line").cast("string")), detail)


def unknown_fields(raw_entries: DataFrame, known: list[str]) -> DataFrame:
    """Fields of entries that the schema doesn't have; ``raw_entries`` has ``keys``, an array of field names."""
    rows = raw_entries.select("graph", "entry_index", "title", F.explode(F.array_except("keys", F.array(*map(F.lit, known)))).alias("field"))
    return _finding(rows, "unknown-field", F.concat_ws("#", "title", "field"), F.col("field"))


def candidate_pages(neighbours: DataFrame, most: int = 25) -> DataFrame:
    """Pages near the manifest that aren't in it, the first ``most`` of a graph by title and one row that counts the rest."""
    order = Window.partitionBy("graph").orderBy("title")
    shown = neighbours.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    counts = neighbours.groupBy("graph").agg(F.count("*").alias("all")).filter(F.col("all") > most)
    rest = counts.select("graph", F.lit(None).cast("string").alias("title"), (F.col("all") - most).cast("string").alias("more"))
    return _finding(shown, "candidate-page", F.col("title"), index=None).unionByName(
        _finding(rest, "candidate-page", F.lit("__truncation_marker__"), F.col("more"), index=None)
    )


def audit(
    entries: DataFrame, pages: DataFrame, neighbours: DataFrame | None, now: datetime, threshold_days: int = 180, known_modes: list[str] | None = None,
    most_candidates: int = 25, raw_entries: DataFrame | None = None, known_fields: tuple[str, ...] = ENTRY_FIELDS, names: DataFrame | None = None,
) -> DataFrame:
    """All findings of all manifests. Entries are resolved once; ``raw_entries`` (with ``keys``) adds fields the schema doesn't have.

    ``names``: the pages without their content, if they can be had cheaper.
    """
    placed = cut_lineage(resolve(entries.select("graph", "entry_index", "title", "file", "exclude", "redact", "filters"), pages if names is None else names))
    parts = [entry_findings(placed), filter_findings(placed, known_modes), filter_cycles(placed), stale_blocks(placed, pages, now, threshold_days)]
    if raw_entries is not None:
        parts.append(unknown_fields(raw_entries, list(known_fields)))
    if neighbours is not None:
        parts.append(candidate_pages(neighbours, most_candidates))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*COLUMNS)


def ranked(findings: DataFrame) -> DataFrame:
    """Findings of a graph in order: severity, kind, then id as a reader sorts it."""
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = Window.partitionBy("graph").orderBy(severity, kind, F.collate("id", "UNICODE"), "id")
    return findings.withColumn("place", F.row_number().over(order))


def severity_counts(findings: DataFrame) -> DataFrame:
    """(``graph``, ``error``, ``warn``, ``info``)."""
    return findings.groupBy("graph").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def exit_code(findings: DataFrame) -> int:
    """2 with errors, 1 with warnings, else 0."""
    row = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]).first()
    return 2 if row["error"] else 1 if row["warn"] else 0
