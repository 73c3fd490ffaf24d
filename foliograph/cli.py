"""Commands: validate, audit, preview, apply, place, project and reconcile. Exit codes: 0 fine, 1 findings, 2 usage or errors."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph import sinks
from foliograph.operators import drift, manifest, patch, placement, projection, recall, reconcile, subgraph
from foliograph.operators import pages as P
from foliograph.session import build_session
from foliograph.sources import files


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return files.read_documents(spark, path)


def _graph(spark: SparkSession, raw: DataFrame, override: str | None) -> str | None:
    if override:
        return override
    row = raw.select(F.get_json_object("json", "$.graphPath").alias("g")).first()
    return row["g"] if row else None


def _entries(raw: DataFrame, graph: str) -> DataFrame:
    return manifest.valid_entries(raw).withColumn("graph", F.lit(graph))


def _show(rows: DataFrame, as_json: bool) -> None:
    for row in rows.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) if as_json else "  ".join(f"{k}={v}" for k, v in row.asDict().items() if v is not None))


def _issues(spark: SparkSession, raw: DataFrame, graph: str | None, skip_refs: bool) -> DataFrame:
    found = manifest.issues(raw).select("path", "message", "severity")
    if skip_refs or not graph:
        return found
    pages = files.read_pages(spark, graph)
    graphs = pages.select("graph").distinct()
    return found.unionByName(manifest.reference_issues(_entries(raw, graph), pages, graphs).select("path", "message", "severity"))


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = _raw(spark, a.manifest)
    found = _issues(spark, raw, _graph(spark, raw, a.graph), a.skip_refs)
    _show(found, a.json)
    return 0 if found.filter("severity = 'error'").isEmpty() else 1


def _near(spark: SparkSession, graph: str, entries: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    pages = files.read_pages(spark, graph)
    return pages, subgraph.neighbours(pages, entries, hops)


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = _raw(spark, a.manifest)
    graph = _graph(spark, raw, a.graph)
    entries = _entries(raw, graph)
    pages, near = _near(spark, graph, entries, a.hops)
    days = 0 if a.no_stale_verified else a.stale_verified_days
    modes = a.known_redact_modes.split(",") if a.known_redact_modes else None
    raw_rows = manifest.raw_entries(manifest.parse(raw)).select(F.lit(graph).alias("graph"), "entry_index", F.try_variant_get("e", "$.title", "string").alias("title"), "keys")
    found = drift.audit(entries, pages, None if a.no_candidates else near, datetime.now(timezone.utc), days, modes, a.max_candidates, raw_rows).persist()
    _show(drift.ranked(found).orderBy("graph", "place").drop("place"), a.json)
    return drift.exit_code(found)


class Refused(Exception):
    """What was given can't be worked with."""


def _patched(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    raw = _raw(spark, a.manifest)
    for row in files.refused_patches(_raw(spark, a.patch)).toLocalIterator():
        raise Refused(f"{a.patch}: {row['reason']}")
    parsed = manifest.raw_entries(manifest.parse(raw))
    name = F.lit(a.manifest)
    entries = parsed.select(name.alias("manifest"), "entry_index", F.try_variant_get("e", "$.title", "string").alias("title"), F.to_json("e").alias("entry"))
    ops = files.patch_operations(_raw(spark, a.patch)).withColumn("manifest", name)
    return raw, patch.apply_patch(entries, ops).persist()


def _rewritten(a: argparse.Namespace, result: DataFrame) -> dict:
    with open(a.manifest, encoding="utf-8") as f:
        document = json.load(f)
    document["entries"] = [json.loads(r["entry"]) for r in patch.patched_entries(result).orderBy("entry_index").toLocalIterator()]
    return document


def preview(spark: SparkSession, a: argparse.Namespace) -> int:
    raw, result = _patched(spark, a)
    for row in patch.preview_markdown(result).toLocalIterator():
        print(row["markdown"])
    after = spark.createDataFrame([(a.manifest, json.dumps(_rewritten(a, result)))], "manifest string, json string")
    found = _issues(spark, after, _graph(spark, raw, a.graph), a.skip_refs)
    _show(found, a.json)
    bad = not result.filter("what = 'error'").isEmpty() or not found.filter("severity = 'error'").isEmpty()
    return int(bad)


def apply(spark: SparkSession, a: argparse.Namespace) -> int:
    raw, result = _patched(spark, a)
    document = _rewritten(a, result)
    after = spark.createDataFrame([(a.manifest, json.dumps(document))], "manifest string, json string")
    found = _issues(spark, after, _graph(spark, raw, a.graph), a.skip_refs)
    errors = result.filter("what = 'error'").select("op_index", "op", "title", "message")
    _show(errors, a.json)
    _show(found, a.json)
    if not errors.isEmpty() or not found.filter("severity = 'error'").isEmpty():
        return 1
    if not a.dry_run:
        sinks.write_manifest(a.manifest, document)
        if a.log:
            sinks.append_log(patch.rationale_log(result, int(time.time())), a.log)
    return 0


def place(spark: SparkSession, a: argparse.Namespace) -> int:
    raw = _raw(spark, a.manifest)
    graph = _graph(spark, raw, a.graph)
    entries = _entries(raw, graph)
    pages, near = _near(spark, graph, entries, 1)
    meta = P.page_metadata(pages)
    wanted = spark.createDataFrame([(graph, t) for t in a.candidate], "graph string, title string") if a.candidate else near
    if not _issues(spark, raw, graph, True).filter("severity = 'error'").isEmpty():
        return 1
    rows = placement.propose(wanted, entries, meta, a.top_n).persist()
    left = placement.unplaced(wanted, meta, rows)
    if a.json:
        _show(placement.reasons(rows).orderBy("title", "rank"), True)
    else:
        for row in placement.proposal_markdown(rows, left).orderBy("title").toLocalIterator():
            print(row["markdown"])
    return 0


def project(spark: SparkSession, a: argparse.Namespace) -> int:
    if not a.pages and not a.seeds:
        return 2
    pages = files.read_pages(spark, a.graph)
    edges = P.outlinks(pages)
    around = None
    if a.pages:
        chosen = files.page_list(files.read_documents(spark, a.pages)).withColumn("graph", F.lit(a.graph))
    else:
        hops = subgraph.select_subgraph(edges, pages, files.seed_list(spark, a.graph, a.seeds), a.max_pages, a.max_hops, a.hub_outdegree, a.min_score)
        around = subgraph.boundary(edges, pages, hops)
        chosen = hops.select("graph", "title", F.lit(None).cast("string").alias("file"), F.concat(F.lit("hop-"), "hop").alias("group"), (F.col("hop") * 100_000).alias("ord"))
    folder = f"{a.vault}/{a.subfolder}" if a.subfolder else a.vault
    plan = projection.vault_plan(chosen, pages, a.label)
    print(f"{sinks.write_texts(plan, folder, apply=a.apply)} pages")
    shown = pages.join(chosen.select("graph", "title"), ["graph", "title"], "left_semi")
    lost = sinks.copy_assets(projection.asset_plan(shown, files.read_assets(spark, a.graph)), f"{a.graph}/assets", f"{a.vault}/assets", a.apply)
    if lost:
        print("missing assets: " + ", ".join(lost))
    if a.moc:
        text = projection.contents_page(chosen, a.moc, label=a.label).withColumn("vault_file", F.lit(f"{a.moc}.md"))
        sinks.write_texts(text, folder, apply=a.apply)
    if a.stubs and around is not None:
        print(f"{sinks.write_texts(projection.stub_plan(around, a.stub_min_refs, a.label), folder, apply=a.apply)} stubs")
    return 0


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _bridge(path: str) -> dict[str, str] | None:
    """Hash of each region as of the last run; None if there was none."""
    text = _text(path)
    if text is None:
        return None
    document = json.loads(text)
    entries = document.get("entries", {k: v for k, v in document.items() if k not in ("version", "page")})
    return {k: v["contentHash"] if isinstance(v, dict) else v for k, v in entries.items()}


def _save_page(page: str, sidecar: str, done: dict) -> None:
    sinks._replace(page, done["content"])
    entries = {k: {"contentHash": v} for k, v in done["bridge"].items()}
    sinks._replace(sidecar, json.dumps({"version": "region-bridge/v1", "page": os.path.basename(page), "entries": entries}, indent=2) + "\n")


def _projected(spark: SparkSession, a: argparse.Namespace) -> tuple[str | None, str | None, bool]:
    """The desired page, why its source is held back, and whether that says how well it is cited."""
    if a.desired:
        return _text(a.desired), None, False
    raw = _text(a.source)
    if raw is None:
        return None, None, False
    slugs = {}
    if a.manifest:
        for row in reconcile.slug_map(_entries(_raw(spark, a.manifest), "")).toLocalIterator():
            slugs[row["title"]] = row["slug"]
    checked = spark.createDataFrame([(raw,)], "content string").select(reconcile.faithfulness_gate(F.col("content"), a.faithfulness_min).alias("gate"), reconcile.is_grounded(F.col("content")).alias("grounded")).first()
    title = os.path.basename(a.source).removesuffix(".md").removesuffix(".mdx")
    return reconcile.stamp(reconcile.project_source(raw, slugs), title), checked["gate"], checked["grounded"]


def _reconcile_all(spark: SparkSession, a: argparse.Namespace) -> int:
    """Every published entry into a page of the output folder; 3 if a source is held back, 1 if one is missing."""
    raw = _raw(spark, a.manifest)
    graph = _graph(spark, raw, a.graph)
    entries = _entries(raw, graph).select("graph", "entry_index", "title", "file", "exclude")
    slugs = [r["slug"] for r in reconcile.slug_map(entries).select("slug").distinct().toLocalIterator()]
    there = [(graph, s, text, _bridge(f"{a.out_dir}/{s}.md.reconcile.json")) for s in slugs if (text := _text(f"{a.out_dir}/{s}.md")) is not None]
    targets = spark.createDataFrame(there, "graph string, slug string, content string, prior map<string,string>")
    done = reconcile.reconcile_manifest(entries, files.read_pages(spark, graph), targets, a.faithfulness_min).persist()
    os.makedirs(a.out_dir, exist_ok=True)
    lines = {r["page"]: r["line"] for r in reconcile.recall_of_targets(done).toLocalIterator()}
    held = lost = 0
    for row in done.orderBy("slug").toLocalIterator():
        held, lost = held + (row["gate"] is not None), lost + (row["error"] is not None)
        shown = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("content", "bridge", "graph") and v not in (None, [], False)}
        if row["slug"] in lines:
            shown["recall"] = lines[row["slug"]]
        print(json.dumps(shown, ensure_ascii=False) if a.json else "  ".join(f"{k}={v}" for k, v in shown.items()))
        if row["content"] is not None and not a.plan:
            page = f"{a.out_dir}/{row['slug']}.md"
            _save_page(page, page + ".reconcile.json", row.asDict(recursive=True))
    return 3 if held else int(lost > 0)


def reconcile_page(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.all:
        return _reconcile_all(spark, a) if a.manifest and a.out_dir else 2
    if not a.page or not (a.desired or a.source or a.check):
        return 2
    sidecar = a.sidecar or a.page + ".reconcile.json"
    prior = _bridge(sidecar)
    desired, gate, grounded = _projected(spark, a) if a.desired or a.source else (None, None, False)
    current = _text(a.page)
    if a.check:
        if current is None:
            return 2
        now, ahead = reconcile.bridge_of(current), reconcile.bridge_of(desired) if desired is not None else {}
        states = {k: "orphan" if k not in now else "hash-mismatch" if now[k] != h else "stale" if ahead.get(k, h) != h else "synced" for k, h in (prior or {}).items()}
        print(json.dumps(dict(sorted(states.items(), key=lambda x: reconcile.STATES.index(x[1])))))
        return int(any(s != "synced" for s in states.values()))
    if desired is None:
        return 2
    if gate is not None:
        print(json.dumps({"held back": gate}))
        return 3
    for item in sorted(reconcile.plan(desired, current or "", prior), key=lambda i: reconcile.VERDICTS.index(i["verdict"])):
        print(json.dumps(item))
    done = reconcile.apply(desired, current or "", prior)
    if not a.plan:
        _save_page(a.page, sidecar, done)
    if grounded:
        page = spark.createDataFrame([("", a.page, desired)], "graph string, page string, content string")
        for row in recall.recall_lines(recall.region_recall(page, ["page"], subdivide_root=True), ["page"]).toLocalIterator():
            print(row["line"])
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliograph")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for x in positional:
            c.add_argument(x)
        c.add_argument("--graph")
        c.add_argument("--json", action="store_true")
        return c

    c = command("validate", validate, "manifest")
    c.add_argument("--skip-refs", action="store_true")
    c = command("audit", audit, "manifest")
    c.add_argument("--hops", type=int, default=1)
    c.add_argument("--max-candidates", type=int, default=25)
    c.add_argument("--no-candidates", action="store_true")
    c.add_argument("--stale-verified-days", type=int, default=180)
    c.add_argument("--no-stale-verified", action="store_true")
    c.add_argument("--known-redact-modes")
    c = command("preview", preview, "manifest", "patch")
    c.add_argument("--skip-refs", action="store_true")
    c = command("apply", apply, "manifest", "patch")
    c.add_argument("--skip-refs", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--log")
    c = command("place", place, "manifest")
    c.add_argument("--candidate", action="append", default=[])
    c.add_argument("--top-n", type=int, default=3)
    c = command("project", project)
    for name in ("--vault", "--pages", "--seeds", "--subfolder", "--moc"):
        c.add_argument(name)
    usual = files.Settings()
    c.add_argument("--max-pages", type=int, default=usual.max_pages)
    c.add_argument("--max-hops", type=int, default=usual.max_hops)
    c.add_argument("--hub-outdegree", type=int, default=usual.hub_outdegree)
    c.add_argument("--min-score", type=float, default=usual.min_score)
    c.add_argument("--stubs", action="store_true")
    c.add_argument("--stub-min-refs", type=int, default=2)
    c.add_argument("--label", default=usual.origin_label)
    c.add_argument("--apply", action="store_true")
    c = command("reconcile", reconcile_page)
    for name in ("--desired", "--source", "--page", "--sidecar", "--manifest", "--out-dir"):
        c.add_argument(name)
    c.add_argument("--faithfulness-min", type=float)
    for name in ("--all", "--plan", "--check"):
        c.add_argument(name, action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session(app=f"foliograph {a.command}")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return a.run(spark, a)
    except Refused as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
