"""From manifest and pages to what a site or a vault stores. Every sink has a plan first; writing is a step of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliograph.functions import text as T
from foliograph.functions.stages import staged
from foliograph.operators import transform as X
from foliograph.operators.pages import resolve
from foliograph.sources import present

#: Image types and the endings of their files.
ENDINGS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/webp": ".webp", "image/svg+xml": ".svg", "image/gif": ".gif"}
#: Fields of a published record taken from the page's properties, and the property each comes from.
RECORD_FIELDS = {
    "type": "type", "category": "category", "short": "short", "source": "source", "project": "project", "created": "created",
    "lastUpdated": "last-updated", "related": "related", "pageTags": "tags",
}
WITHOUT_BRACKETS = ("created", "lastUpdated")


def _prop(props: Column, key: str) -> Column:
    value = F.element_at(props, key)
    return F.when(value != "", value)


def published_entries(entries: DataFrame) -> DataFrame:
    """Entries that aren't excluded."""
    return entries.filter(~F.coalesce("exclude", F.lit(False)))


def hydrated_bodies(pages: DataFrame, cache: DataFrame | None, sidecars: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``props``, ``body`` and ``hydration`` ('cache', 'missing' or null).

    ``cache``: (graph, name, content) of the files anchors stand for; an anchor's body is the cached file's
    without its properties. Images become figures, or a note while they are missing. ``sidecars``: (graph,
    name, content) of their descriptions.
    """
    rows = staged(pages, pages.columns, props=T.properties(F.col("content")), body=T.property_body(F.col("content")))
    kind, doc = _prop(F.col("props"), "type"), _prop(F.col("props"), "tg-doc")
    if cache is None:
        return rows.withColumn("hydration", F.when(kind.isin("anchor", "image-anchor") & doc.isNotNull(), "missing"))
    ending = F.lit(".png")
    for mime, end in ENDINGS.items():
        ending = F.when(_prop(F.col("props"), "mime-type") == mime, end).otherwise(ending)
    stem = F.regexp_replace("file", r"\.[^.]*\z", "")
    image = kind == "image-anchor"
    name = F.when(doc.isNotNull() & (kind == "anchor"), F.col("file")).when(doc.isNotNull() & image, F.concat(stem, ending))
    rows = rows.withColumn("_name", name).withColumn("_image", F.coalesce(image & doc.isNotNull(), F.lit(False)))
    files = cache.select("graph", F.col("name").alias("_name"), F.col("content").alias("_cached"), F.lit(True).alias("_hit"))
    rows = rows.join(files, ["graph", "_name"], "left")
    if sidecars is None:
        rows = rows.withColumn("_note", F.lit(None).cast("string"))
    else:
        notes = sidecars.select("graph", F.col("name").alias("_name"), F.regexp_extract("content", r'(?m)^\s+composition:\s*"([^"]+)"', 1).alias("_note"))
        rows = rows.join(notes, ["graph", "_name"], "left")
    caption = _prop(F.col("props"), "caption")
    alt = F.coalesce(caption, F.nullif("_note", F.lit("")), F.concat(F.lit("Image: "), "title"))
    below = F.coalesce(F.concat(F.lit("<figcaption>"), T.escape_html(caption), F.lit("</figcaption>")), F.lit(""))
    figure = F.concat(
        F.lit('<figure>\n  <img src="/assets/kb/'), F.col("_name"), F.lit('" alt="'), T.escape_html(alt), F.lit('">\n  '), below, F.lit("\n</figure>\n")
    )
    pending = F.concat(F.lit("> Image `"), doc, F.lit("` is not there yet.\n"))
    hit = F.coalesce("_hit", F.lit(False))
    body = (
        F.when(F.col("_image") & hit, figure)
        .when(F.col("_image"), pending)
        .when(hit, T.without_leading_properties(F.col("_cached")))
        .otherwise(F.col("body"))
    )
    state = F.when(F.col("_name").isNotNull(), F.when(hit, "cache").otherwise("missing"))
    return rows.withColumn("hydration", state).withColumn("body", body).drop("_name", "_image", "_cached", "_hit", "_note")


def site_records(
    entries: DataFrame, pages: DataFrame, rules: dict[str, dict] | None = None, cache: DataFrame | None = None, sidecars: DataFrame | None = None, hooks: dict | None = None,
    render=None, names: DataFrame | None = None,
) -> DataFrame:
    """(``graph``, ``slug``, ``data``, ``body``, ``digest``, ``html``): what the site stores, the last entry of a slug.

    ``hooks``: legacy redact mode to a function (title column, body column) to column; ignored where a filter
    redacts. ``render``: body column to html column. ``names``: the pages without their content, if they can be had
    cheaper. Entries without a page are left out.
    """
    rules = rules or {}
    shown = published_entries(entries)
    placed = resolve(shown, pages if names is None else names).filter(F.col("page_file").isNotNull())
    full = hydrated_bodies(pages.select("graph", "title", "file", "content"), cache, sidecars)
    spliced = full.select("graph", "title", F.when(F.col("hydration") == "cache", F.col("body")).otherwise(T.without_leading_properties(F.col("body"))).alias("text"))
    rows = placed.join(full.select("graph", F.col("file").alias("page_file"), "props", "body", "hydration"), ["graph", "page_file"])
    keys = ["graph", "entry_index"]
    rows = rows.join(X.additions_of(shown, spliced, keys), keys, "left")
    body = X.filtered_body(F.col("body"), F.col("title"), F.col("filters"), F.col("additions"), rules)
    by_filter = F.exists(F.coalesce("filters", F.array()), lambda f: f["redact"].isNotNull())
    for mode, hook in (hooks or {}).items():
        body = F.when(~by_filter & (F.col("redact") == mode), hook(F.col("title"), body)).otherwise(body)
    rows = rows.withColumn("content", body)
    rows = rows.join(X.link_slugs(rows, shown, keys), keys, "left")
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("out", X.published_body(F.col("content"), F.coalesce("slugs", none)))
    fields = []
    for field, key in RECORD_FIELDS.items():
        value = _prop(F.col("props"), key)
        fields.append((F.regexp_replace(value, r"[\[\]]", "") if field in WITHOUT_BRACKETS else value).alias(field))
    links = F.when(F.size("backlinks") > 0, F.col("backlinks")).alias("backlinks")
    slug = T.route_slug(F.col("title"))
    data = F.struct("title", slug.alias("slug"), "tier", *fields, links)
    rows = rows.select("graph", "entry_index", slug.alias("slug"), data.alias("data"), F.col("out").alias("body"))
    last = rows.groupBy("graph", "slug").agg(F.max_by(F.struct("data", "body"), "entry_index").alias("r"))
    done = last.select("graph", "slug", "r.data", "r.body")
    html = render(F.col("body")) if render else F.col("body")
    return done.withColumn("digest", F.sha2(F.concat(F.to_json("data"), F.lit("\n"), "body"), 256)).withColumn("html", html)


#: The fields of a published record and whether each must be there; a site may give its own.
RECORD_SCHEMA = StructType(
    [StructField("title", StringType(), False), StructField("slug", StringType(), False), StructField("tier", StringType())]
    + [StructField(field, StringType()) for field in RECORD_FIELDS]
    + [StructField("backlinks", ArrayType(StringType()))]
)


def record_issues(records: DataFrame, schema: StructType = RECORD_SCHEMA, column: str = "data") -> DataFrame:
    """(``graph``, ``slug``, ``field``, ``message``): required fields that are missing or empty, and fields of another type, of each record."""
    have = {f.name: f.dataType for f in records.schema[column].dataType.fields}
    found = []
    for f in schema.fields:
        issue = lambda m: F.struct(F.lit(f.name).alias("field"), F.lit(m).alias("message"))  # noqa: E731, B023
        if f.name not in have:
            found.append(F.when(F.lit(not f.nullable), issue("is required")))
        elif have[f.name].simpleString() != f.dataType.simpleString():
            found.append(F.when(F.col(column)[f.name].isNotNull(), issue(f"must be {f.dataType.simpleString()}")))
        elif not f.nullable:
            value = F.col(column)[f.name]
            found.append(F.when(value.isNull() | (value.cast("string") == ""), issue("is required")))
    each = records.select("graph", "slug", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return each.select("graph", "slug", "x.field", "x.message")


def run_counts(entries: DataFrame, pages: DataFrame, cache: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(``graph``, ``included``, ``excluded``, ``missing``, ``hydrated``, ``unhydrated``): what a run did."""
    placed = resolve(entries, pages if names is None else names)
    state = hydrated_bodies(pages.select("graph", "title", "file", "content"), cache).select("graph", F.col("file").alias("page_file"), "hydration")
    out = F.coalesce("exclude", F.lit(False))
    there = F.col("page_file").isNotNull()
    return (
        placed.join(state, ["graph", "page_file"], "left")
        .groupBy("graph")
        .agg(
            F.count_if(~out & there).alias("included"),
            F.count_if(out).alias("excluded"),
            F.count_if(~out & ~there).alias("missing"),
            F.count_if(~out & (F.col("hydration") == "cache")).alias("hydrated"),
            F.count_if(~out & (F.col("hydration") == "missing")).alias("unhydrated"),
        )
    )


def site_frontmatter(title: Column, tier: Column, props: Column, backlinks: Column) -> Column:
    """The head of a page file of the site; keys in a fixed order, absent ones left out, ``short`` quoted twice."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), T.json_quote(value))
    rows = [F.lit("---"), line("title", title), F.concat(F.lit('slug: "'), T.route_slug(title), F.lit('"')), F.concat(F.lit('tier: "'), tier, F.lit('"'))]
    for field, key in RECORD_FIELDS.items():
        value = _prop(props, key)
        if field == "short":
            value = F.replace(value, F.lit('"'), F.lit('\\"'))
        elif field in WITHOUT_BRACKETS:
            value = F.regexp_replace(value, r"[\[\]]", "")
        rows.append(line(field, value))
    quoted = F.transform(backlinks, lambda b: F.concat(F.lit("  - "), T.json_quote(b)))
    rows.append(F.when(F.size(backlinks) > 0, F.array_join(F.concat(F.array(F.lit("backlinks:")), quoted), "\n")))
    return F.concat(F.array_join(F.array_compact(F.array(*rows)), "\n"), F.lit("\n---\n"))


def _yaml(value: Column) -> Column:
    return T.json_quote(F.regexp_replace(value, r"[\[\]]", ""))


def vault_page(props: Column, body: Column, title: Column, source: Column, label: str = "page graph") -> Column:
    """A whole page of the vault: head, a note on where it comes from, and the body. ``label`` names the origin."""
    tags = F.coalesce(_prop(props, "tags"), _prop(props, "pageTags"))
    session, uri = _prop(props, "source_session"), _prop(props, "grounding_uri")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), _yaml(value))
    head = F.array(
        F.lit("---"),
        line("title", title),
        line("type", _prop(props, "type")),
        line("category", _prop(props, "category")),
        line("created", _prop(props, "created")),
        line("updated", _prop(props, "last-updated")),
        line("tags", tags),
        line("grounding_uri", uri),
        line("source_page", source),
        line("source_session", session),
        F.lit(f'projected_from: "{label}"'),
        F.lit("---"),
    )
    note = F.array(
        F.lit("> [!info] Derived view, do not edit here"),
        F.lit(f"> Source of truth: {label}."),
        F.concat(F.lit("> - page: `"), source, F.lit("`")),
        F.concat(F.lit("> - session: `"), session, F.lit("`")),
        F.concat(F.lit("> - grounding: "), uri),
    )
    join = lambda a: F.array_join(F.array_compact(a), "\n")
    return F.concat(join(head), F.lit("\n"), join(note), F.lit("\n\n"), X.vault_body(body), F.lit("\n"))


def vault_plan(selection: DataFrame, pages: DataFrame, label: str = "page graph", names: DataFrame | None = None) -> DataFrame:
    """(``graph``, ``title``, ``vault_file``, ``missing``, ``text``) of the selected pages; missing ones have no text.

    ``selection``: (graph, title, group, and optionally file).
    """
    file = "file" if "file" in selection.columns else None
    placed = resolve(selection, pages if names is None else names, file=file)
    parts = staged(
        pages.select("graph", F.col("file").alias("page_file"), "content"),
        ["graph", "page_file"],
        props=T.properties(F.col("content")),
        body=T.property_body(F.col("content")),
    )
    rows = placed.join(parts, ["graph", "page_file"], "left")
    text = vault_page(F.col("props"), F.col("body"), F.col("title"), F.concat(F.lit("pages/"), "page_file"), label)
    return rows.select(
        "graph",
        "title",
        F.concat(T.vault_title(F.col("title")), F.lit(".md")).alias("vault_file"),
        F.col("page_file").isNull().alias("missing"),
        F.when(F.col("page_file").isNotNull(), text).alias("text"),
    )


def asset_plan(pages: DataFrame, assets: DataFrame | None) -> DataFrame:
    """(``graph``, ``asset``, ``state``): every image the pages embed, 'copied' or 'missing'. ``assets``: (graph, asset)."""
    wanted = pages.select("graph", F.explode(T.image_assets(F.col("content"))).alias("asset")).distinct()
    if assets is None:
        return wanted.withColumn("state", F.lit("missing"))
    there = assets.select("graph", "asset", F.lit("copied").alias("there")).distinct()
    return wanted.join(there, ["graph", "asset"], "left").select("graph", "asset", F.coalesce("there", F.lit("missing")).alias("state"))


def contents_page(members: DataFrame, title: str, group_titles: dict[str, str] | None = None, label: str = "page graph") -> DataFrame:
    """(``graph``, ``text``): a page that lists the vault's pages by group.

    ``members``: (graph, group, title, ord); groups and members come in the order of ``ord``. The group
    'default' has no heading unless ``group_titles`` names one.
    """
    names = F.lit(None).cast("string")
    for group, name in (group_titles or {}).items():
        names = F.when(F.col("group") == group, name).otherwise(names)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- [["), T.vault_title(F.col("title")), F.lit("]]")).alias("line")))), lambda x: x["line"])
    groups = members.groupBy("graph", "group").agg(F.min("ord").alias("ord"), rows.alias("rows"))
    head = F.when(names.isNotNull(), F.concat(F.lit("## "), names)).when(F.col("group") != "default", F.concat(F.lit("## "), "group"))
    text = F.concat(F.array_join(F.concat(F.array_compact(F.array(head)), F.col("rows")), "\n"), F.lit("\n"))
    parts = groups.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))).alias("parts"))
    top = F.concat(F.lit("---\ntitle: "), _yaml(F.lit(title)), F.lit(f'\ntype: "moc"\nprojected_from: "{label}"\n---\n\n# {title}\n\n'))
    return parts.select("graph", F.concat(top, F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("text"))


def stub_plan(boundary: DataFrame, min_refs: int = 2, label: str = "page graph") -> DataFrame:
    """(``graph``, ``title``, ``vault_file``, ``text``): a stub for every title at least ``min_refs`` selected pages link to."""
    refs = F.array_join(F.transform("referenced_by", lambda r: F.concat(F.lit("[["), T.vault_title(r), F.lit("]]"))), ", ")
    note = F.when(F.col("exists"), "The page is in the graph but outside this selection.").otherwise("The graph has no page of its own for this.")
    text = F.concat(
        F.lit("---\ntitle: "), _yaml(F.col("title")), F.lit(f'\ntype: "stub"\nprojected_from: "{label}"\n---\n\n> [!note] Outside this selection\n> Referenced by '),
        refs, F.lit(".\n> "), note, F.lit("\n"),
    )
    return boundary.filter(F.size("referenced_by") >= min_refs).select(
        "graph", "title", F.concat(T.vault_title(F.col("title")), F.lit(".md")).alias("vault_file"), text.alias("text")
    )


def title_map(titles: DataFrame) -> DataFrame:
    """(``graph``, ``title``, ``vault_title``) of titles that the vault writes differently."""
    return titles.select("graph", "title", T.vault_title(F.col("title")).alias("vault_title")).distinct().filter(F.col("title") != F.col("vault_title"))


def dependencies(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(``graph``, ``entry_index``, ``path``): files that each published entry was made from, additions included."""
    shown = published_entries(entries)
    own = resolve(shown, pages).select("graph", "entry_index", F.col("page_file").alias("path"))
    refs = shown.select("graph", "entry_index", F.explode("filters").alias("f")).select("graph", "entry_index", F.coalesce("f.prepend", "f.append").alias("title"))
    more = resolve(refs.filter(present(F.col("title"))), pages, file=None).select("graph", "entry_index", F.col("page_file").alias("path"))
    return own.unionByName(more).filter(F.col("path").isNotNull()).distinct()


def slug_collisions(entries: DataFrame) -> DataFrame:
    """(``graph``, ``slug``, ``entry_index``, ``n``): slugs that several published entries have, and the one that holds."""
    slugs = published_entries(entries).select("graph", "entry_index", T.route_slug(F.col("title")).alias("slug"))
    order = Window.partitionBy("graph", "slug").orderBy(F.desc("entry_index"))
    last = slugs.withColumn("k", F.row_number().over(order))
    return last.groupBy("graph", "slug").agg(F.max("entry_index").alias("entry_index"), F.max("k").alias("n")).filter(F.col("n") > 1)
