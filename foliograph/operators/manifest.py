"""Validation of publish manifests: one row per violation, from the raw JSON.

A manifest is read twice. The raw text becomes a VARIANT, so that wrong types and unknown fields are seen as
they are; only entries that pass every rule come out typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.operators.pages import resolve
from foliograph.sources import present

#: The schema of a manifest.
ROOT_FIELDS = ("$schema", "generatedAt", "graphPath", "entries")
ENTRY_FIELDS = ("title", "tier", "backlinks", "exclude", "redact", "file", "filters")
FILTER_KEYS = ("prepend", "append", "redact")
TIERS = ("seed", "1-hop", "2-hop", "n-hop")
REDACT_MODES = ("light",)
FILTER_TYPE = "array<struct<prepend:string,append:string,redact:string>>"
ISSUE = "array<struct<ord:int,path:string,message:string,severity:string>>"


def _kind(v: Column, path: str) -> Column:
    """Type of a field: null if it is absent, 'VOID' if it is null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _issue(when: Column, order: int, path: Column, message: str, severity: str = "error") -> Column:
    return F.when(when, F.struct(F.lit(order).alias("ord"), path.alias("path"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))


def _object(kind: Column) -> Column:
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def _array(kind: Column) -> Column:
    return F.coalesce(kind.startswith("ARRAY"), F.lit(False))


def parse(raw: DataFrame, key: str = "manifest", text: str = "json") -> DataFrame:
    """(``key``, ``v``, ``root``, ``keys``): manifests as variants; text that isn't JSON has a null variant."""
    return raw.select(F.col(key), F.try_parse_json(text).alias("v"), F.json_object_keys(text).alias("keys")).withColumn("root", F.schema_of_variant("v"))


def raw_entries(parsed: DataFrame, key: str = "manifest") -> DataFrame:
    """(``key``, ``entry_index``, ``e``, ``kind``, ``keys``): entries as they stand."""
    each = parsed.filter(_array(_kind(F.col("v"), "$.entries"))).select(
        key, F.posexplode(F.try_variant_get("v", "$.entries", "array<variant>")).alias("entry_index", "e")
    )
    return each.withColumn("kind", F.schema_of_variant("e")).withColumn("keys", F.json_object_keys(F.to_json("e")))


def _root_issues(parsed: DataFrame, key: str) -> DataFrame:
    v, ok = F.col("v"), _object(F.col("root"))
    at = lambda p: F.lit(p)
    path = _kind(v, "$.graphPath")
    date = _kind(v, "$.generatedAt")
    entries = ok & ~_array(_kind(v, "$.entries"))
    fixed = F.array_compact(
        F.array(
            _issue(~ok, 0, at("$"), "manifest is not an object"),
            _issue(ok & ~F.coalesce((path == "STRING") & (F.try_variant_get(v, "$.graphPath", "string") != ""), F.lit(False)), 1, at("$.graphPath"), "must be a non-empty string"),
            _issue(entries, 2, at("$.entries"), "must be an array"),
            _issue(ok & ~entries & date.isNotNull() & (date != "STRING"), 4, at("$.generatedAt"), "should be a string", "warning"),
        )
    )
    unknown = F.when(ok & ~entries, F.array_except("keys", F.array(*map(F.lit, ROOT_FIELDS))))
    extra = F.transform(F.coalesce(unknown, F.array().cast("array<string>")), lambda k: F.struct(F.lit(3).alias("ord"), F.concat(F.lit("$."), k).alias("path"), F.lit("unknown field").alias("message"), F.lit("warning").alias("severity")))
    return parsed.select(key, F.lit(-1).alias("entry_index"), F.explode(F.concat(fixed, extra)).alias("x"))


def _filter_issues(e: Column, at: Column) -> Column:
    """Issues of the filters of an entry; those of a filter by its number of keys first, then by key."""

    def of(f: Column, j: Column) -> Column:
        here = F.concat(at, F.lit(".filters["), j.cast("string"), F.lit("]"))
        kind = F.schema_of_variant(f)
        keys = F.json_object_keys(F.to_json(f))
        name = F.get(keys, F.lit(0))
        value = F.map_values(F.from_json(F.to_json(f), "map<string,string>"))
        types = F.array(*[_kind(f, f"$.{k}") for k in FILTER_KEYS])
        wrong = ~F.exists(types, lambda t: t == "STRING") | (F.get(value, F.lit(0)) == "")
        return F.coalesce(
            _issue(~_object(kind), 20, here, "filter is not an object"),
            _issue(F.size(keys) != 1, 21, here, "filter must have exactly one key"),
            _issue(~name.isin(*FILTER_KEYS), 24, here, "unknown filter"),
            _issue(F.coalesce(wrong, F.lit(True)), 22, F.concat(here, F.lit("."), name), "must be a non-empty string"),
        )

    rows = F.transform(F.try_variant_get(e, "$.filters", "array<variant>"), of)
    return F.filter(F.coalesce(rows, F.array().cast(ISSUE)), lambda x: x.isNotNull())


def _entry_issues(entries: DataFrame, key: str) -> DataFrame:
    e = F.col("e")
    at = F.concat(F.lit("$.entries["), F.col("entry_index").cast("string"), F.lit("]"))
    ok = _object(F.col("kind"))
    field = lambda name: F.concat(at, F.lit(f".{name}"))
    text = lambda name: F.try_variant_get(e, f"$.{name}", "string")
    kind = {name: _kind(e, f"$.{name}") for name in ENTRY_FIELDS}
    given = lambda name: ok & kind[name].isNotNull()
    title = F.coalesce((kind["title"] == "STRING") & (text("title") != ""), F.lit(False))
    tier = F.coalesce((kind["tier"] == "STRING") & text("tier").isin(*TIERS), F.lit(False))
    links = F.transform(F.try_variant_get(e, "$.backlinks", "array<variant>"), F.schema_of_variant)
    bad = F.array_position(F.transform(links, lambda t: t != "STRING"), F.lit(True))
    filters = _array(kind["filters"])
    legacy = kind["redact"].isNotNull() & (kind["redact"] == "STRING") & text("redact").isin(*REDACT_MODES)
    specs = F.from_json(F.to_json(F.try_variant_get(e, "$.filters", "variant")), FILTER_TYPE)
    by_filter = filters & F.exists(specs, lambda f: f["redact"].isNotNull() & (f["redact"] != ""))
    fixed = F.array_compact(
        F.array(
            _issue(~ok, 5, at, "entry is not an object"),
            _issue(ok & ~title, 6, field("title"), "must be a non-empty string"),
            _issue(ok & ~tier, 7, field("tier"), "must be one of " + ", ".join(TIERS)),
            _issue(given("backlinks") & ~_array(kind["backlinks"]), 8, field("backlinks"), "must be an array"),
            _issue(given("backlinks") & (bad > 0), 9, F.concat(field("backlinks"), F.lit("["), (bad - 1).cast("string"), F.lit("]")), "must be a string"),
            _issue(given("exclude") & (kind["exclude"] != "BOOLEAN"), 10, field("exclude"), "must be a boolean"),
            _issue(given("redact") & ~legacy, 11, field("redact"), "must be one of " + ", ".join(REDACT_MODES)),
            _issue(given("file") & (kind["file"] != "STRING"), 12, field("file"), "must be a string"),
            _issue(given("filters") & ~filters, 13, field("filters"), "must be an array"),
            _issue(ok & legacy & by_filter, 30, field("redact"), "redact and a redact filter exclude each other"),
        )
    )
    unknown = F.transform(
        F.coalesce(F.array_except("keys", F.array(*map(F.lit, ENTRY_FIELDS))), F.array().cast("array<string>")),
        lambda k: F.struct(F.lit(31).alias("ord"), F.concat(at, F.lit("."), k).alias("path"), F.lit("unknown field").alias("message"), F.lit("warning").alias("severity")),
    )
    inner = F.when(ok & filters, _filter_issues(e, at)).otherwise(F.array().cast(ISSUE))
    return entries.select(key, "entry_index", F.explode(F.concat(fixed, inner, unknown)).alias("x"))


def entries_of_rows(rows: DataFrame, key: str = "manifest", text: str = "json") -> DataFrame:
    """Entries as :func:`raw_entries` has them, from (``key``, entry_index, ``text``): one JSON document per entry."""
    return rows.select(key, "entry_index", F.try_parse_json(text).alias("e")).withColumn("kind", F.schema_of_variant("e")).withColumn("keys", F.json_object_keys(F.to_json("e")))


def issues(raw: DataFrame, key: str = "manifest", text: str = "json") -> DataFrame:
    """(``key``, ``entry_index``, ``ord``, ``path``, ``message``, ``severity``): all violations of all manifests.

    ``entry_index`` is -1 for the manifest itself. A title that several entries have gives one error that lists
    them.
    """
    parsed = parse(raw, key, text)
    return _root_issues(parsed, key).select(key, "entry_index", "x.*").unionByName(entry_issues(raw_entries(parsed, key), key))


def entry_issues(entries: DataFrame, key: str = "manifest") -> DataFrame:
    """The part of :func:`issues` that entries have, from raw entries; no manifest needs to be one document."""
    rows = _entry_issues(entries, key).select(key, "entry_index", "x.*")
    titles = entries.filter(_object(F.col("kind"))).select(key, "entry_index", F.try_variant_get("e", "$.title", "string").alias("title"))
    twice = titles.filter(present(F.col("title"))).groupBy(key, "title").agg(F.array_sort(F.collect_list("entry_index")).alias("at")).filter(F.size("at") > 1)
    listed = F.array_join(F.transform("at", lambda i: i.cast("string")), ", ")
    double = twice.select(
        key,
        F.lit(-1).alias("entry_index"),
        F.lit(40).alias("ord"),
        F.lit("$.entries").alias("path"),
        F.concat(F.lit('title "'), "title", F.lit('" at entries '), listed).alias("message"),
        F.lit("error").alias("severity"),
    )
    return rows.unionByName(double)


def valid_entries(raw: DataFrame, key: str = "manifest", text: str = "json") -> DataFrame:
    """Typed entries without an error of their own (titles that come twice are kept), known fields only.

    ``entry_index`` counts what is left, ``raw_index`` what was there. A manifest with an error at its root has none.
    """
    parsed = parse(raw, key, text)
    found = issues(raw, key, text).filter(F.col("severity") == "error")
    entries = raw_entries(parsed, key)
    good = entries.join(found.filter(F.col("entry_index") >= 0).select(key, "entry_index"), [key, "entry_index"], "left_anti")
    good = good.join(found.filter((F.col("entry_index") == -1) & (F.col("ord") < 3)).select(key), key, "left_anti")
    order = Window.partitionBy(key).orderBy("entry_index")
    get = lambda name, kind="string": F.try_variant_get("e", f"$.{name}", kind).alias(name)
    return good.select(
        key,
        (F.row_number().over(order) - 1).alias("entry_index"),
        F.col("entry_index").alias("raw_index"),
        get("title"),
        get("tier"),
        get("backlinks", "array<string>"),
        get("exclude", "boolean"),
        get("redact"),
        get("file"),
        F.from_json(F.to_json(F.try_variant_get("e", "$.filters", "variant")), FILTER_TYPE).alias("filters"),
    )


def reference_issues(entries: DataFrame, pages: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """(``graph``, ``entry_index``, ``path``, ``message``, ``severity``): entries whose page isn't there or isn't where they say.

    ``graphs``: (graph) of the graphs that exist; a manifest of another has a single error.
    """
    lost = None
    if graphs is not None:
        known = graphs.select("graph").distinct()
        lost = entries.select("graph").distinct().join(known, "graph", "left_anti").select(
            "graph", F.lit(-1).alias("entry_index"), F.lit("$.graphPath").alias("path"), F.lit("graph has no pages").alias("message"), F.lit("error").alias("severity")
        )
        entries = entries.join(known, "graph", "left_semi")
    placed = resolve(entries, pages)
    path = F.concat(F.lit("$.entries["), F.col("entry_index").cast("string"), F.lit("]"))
    absent = F.col("page_file").isNull()
    moved = ~absent & present(F.col("file")) & ~F.concat(F.lit("/"), "page_file").endswith(F.concat(F.lit("/"), "file"))
    rows = placed.filter(absent | F.coalesce(moved, F.lit(False))).select(
        "graph", "entry_index", path.alias("path"),
        F.when(absent, "no page").otherwise("page is in another file").alias("message"),
        F.when(absent, "error").otherwise("warning").alias("severity"),
    )
    return rows if lost is None else rows.unionByName(lost)
