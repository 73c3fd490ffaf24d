"""Ordered edits of manifests.

Whether an edit succeeds depends on nothing but the edits of the same title before it, so the fold runs per
(manifest, title), for all titles of all manifests in parallel. Entries and values are JSON, so that fields the
schema doesn't know survive.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions import text as T

_OUT = (
    "manifest string, title string, what string, op_index int, op string, before string, after string, rationale string, message string, place string"
)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """States and edits of one title in order; rows of ``op`` null are the entries the manifest begins with."""
    manifest, title = rows["manifest"].iloc[0], rows["title"].iloc[0]
    rows = rows.sort_values(["op_index"], kind="stable")
    # The first entry of a title is the one edits find; others stay as they are.
    entries = [(r.place, json.loads(r.entry)) for r in rows[rows["op"].isna()].sort_values("place").itertuples()]
    out = []

    def log(r, what: str, before=None, after=None, message: str | None = None) -> None:
        text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
        out.append((manifest, title, what, int(r.op_index), r.op, text(before), text(after), r.rationale, message, None))

    for r in rows[rows["op"].notna()].itertuples():
        fail = None
        if not (r.rationale or "").strip():
            fail = "rationale is required"
        elif r.op not in ("add", "remove", "set", "unset"):
            fail = f"unknown op {r.op}"
        elif r.op == "add" and not title:
            fail = "entry.title is required"
        elif r.op == "add" and entries:
            fail = "title is in the manifest"
        elif r.op in ("set", "unset") and not r.field:
            fail = "field is required"
        elif r.op == "set" and r.field == "title":
            fail = "a title can't be set; remove and add"
        elif r.op == "unset" and r.field in ("title", "tier"):
            fail = f"{r.field} can't be unset"
        elif r.op != "add" and not entries:
            fail = "title is not in the manifest"
        if fail:
            log(r, "error", message=fail)
        elif r.op == "add":
            entry = json.loads(r.entry)
            entries = [(f"1{int(r.op_index):012d}", entry)]
            log(r, "change", after=entry)
        elif r.op == "remove":
            (_, before), *entries = entries
            log(r, "change", before=before)
        else:
            (place, before), *rest = entries
            after = dict(before)
            if r.op == "set":
                after[r.field] = json.loads(r.value) if r.value is not None else None
            else:
                after.pop(r.field, None)
            entries = [(place, after), *rest]
            log(r, "change", before=before, after=after)
    for place, entry in entries:
        out.append((manifest, title, "entry", None, None, None, json.dumps(entry, ensure_ascii=False), None, None, place))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
    return frame.astype({"op_index": "Int32"})


def apply_patch(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries, changes and errors after the edits, in one frame told apart by ``what``.

    ``entries``: (manifest, entry_index, title, entry as JSON); ``ops``: (manifest, op_index, op, title, field,
    value as JSON, entry as JSON, rationale), ``title`` of an 'add' being its entry's. A failed edit is an error
    row and the next goes on with what is there. ``place`` orders the entries: survivors as before, then added
    ones. Nothing is changed in place.
    """
    none = F.lit(None).cast("string")
    start = entries.select(
        "manifest", F.coalesce("title", F.lit("")).alias("title"), F.lit(-1).alias("op_index"), none.alias("op"), none.alias("field"), none.alias("value"), "entry",
        none.alias("rationale"), F.concat(F.lit("0"), F.lpad(F.col("entry_index").cast("string"), 12, "0")).alias("place"),
    )
    edits = ops.select(
        "manifest", F.coalesce("title", F.lit("")).alias("title"), F.col("op_index").cast("int").alias("op_index"), "op", "field", "value", "entry", "rationale", none.alias("place")
    )
    touched = edits.select("manifest", "title").distinct()
    still = start.join(touched, ["manifest", "title"], "left_anti")
    folded = start.join(touched, ["manifest", "title"], "left_semi").unionByName(edits).groupBy("manifest", "title").applyInPandas(_fold, _OUT)
    kept = still.select(
        "manifest", "title", F.lit("entry").alias("what"), F.lit(None).cast("int").alias("op_index"), none.alias("op"), none.alias("before"), F.col("entry").alias("after"),
        none.alias("rationale"), none.alias("message"), "place",
    )
    return folded.unionByName(kept)


def patched_entries(result: DataFrame) -> DataFrame:
    """(``manifest``, ``entry_index``, ``title``, ``entry``) after the edits."""
    rows = result.filter(F.col("what") == "entry")
    order = Window.partitionBy("manifest").orderBy("place", "title")
    return rows.select("manifest", (F.row_number().over(order) - 1).alias("entry_index"), "title", F.col("after").alias("entry"))


def affected_entries(result: DataFrame) -> DataFrame:
    """(``manifest``, ``entry_index``, ``title``, ``direct``, ``place``): entries that changed and are there, and those whose backlinks name a changed title.

    They are listed in the order of ``place``: what changed itself first, each in the order of the manifest.
    """
    changed = result.filter(F.col("what") == "change").select("manifest", "title").distinct()
    entries = patched_entries(result)
    direct = entries.join(changed, ["manifest", "title"], "left_semi").select("manifest", "entry_index", "title", F.lit(True).alias("direct"))
    links = entries.select("manifest", "entry_index", "title", F.explode(F.from_json(F.get_json_object("entry", "$.backlinks"), "array<string>")).alias("link"))
    ripple = links.join(changed.select("manifest", F.col("title").alias("link")), ["manifest", "link"], "left_semi").select("manifest", "entry_index", "title").distinct()
    ripple = ripple.join(direct.select("manifest", "entry_index"), ["manifest", "entry_index"], "left_anti")
    order = Window.partitionBy("manifest").orderBy(F.desc("direct"), "entry_index")
    return direct.unionByName(ripple.withColumn("direct", F.lit(False))).withColumn("place", F.row_number().over(order))


def rationale_log(result: DataFrame, epoch: int) -> DataFrame:
    """(``manifest``, ``key``, ``op``, ``title``, ``rationale``): what to append to the log of edits, one row per change."""
    rows = result.filter(F.col("what") == "change")
    key = F.concat_ws("-", F.lit("manifest-edit"), "op", T.key_slug(F.col("title")), F.lit(str(epoch)))
    return rows.select("manifest", key.alias("key"), "op", "title", "rationale")


def preview_markdown(result: DataFrame) -> DataFrame:
    """(``manifest``, ``markdown``): changes, errors and affected entries of every manifest as a report."""
    lines = F.when(
        F.col("what") == "change",
        F.concat(F.lit("- **"), "op", F.lit('** "'), "title", F.lit('": '), "rationale", F.lit("\n  - before: "), F.coalesce("before", F.lit("none")), F.lit("\n  - after: "), F.coalesce("after", F.lit("none"))),
    ).otherwise(F.concat(F.lit("- error in op "), F.col("op_index").cast("string"), F.lit(": "), "message"))
    rows = result.filter(F.col("what") != "entry").groupBy("manifest").agg(
        F.count_if(F.col("what") == "change").alias("changes"), F.count_if(F.col("what") == "error").alias("errors"), F.array_sort(F.collect_list(F.struct("op_index", lines.alias("line")))).alias("rows")
    )
    hit = affected_entries(result).groupBy("manifest").agg(F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("indirect"))
    head = F.format_string("# Patch preview\n\n%d changes, %d errors; %d entries changed, %d more linked to them.\n\n", "changes", "errors", F.coalesce("direct", F.lit(0)), F.coalesce("indirect", F.lit(0)))
    return rows.join(hit, "manifest", "left").select("manifest", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("markdown"))
