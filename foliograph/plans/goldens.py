"""Queries over written cases whose results are known by the contract, not computed by SQL: texts, filters, documents, reconciliation.

They read no table. Each case names what is applied to which input; the SQL lists the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.operators import drift, manifest, patch, placement, projection, reconcile, transform

_ID = "64fa1234-5678-9abc-def0-123456789abc"
_SLUGS = {"Foo Bar": "foo-bar"}


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


#: What is applied, by name.
FUNCTIONS = {
    "decode": T.decode_entities,
    "escape": T.escape_html,
    "links": lambda c: _joined(T.links(c)),
    "files": lambda c: _joined(T.file_candidates(c)),
    "slug": T.route_slug,
    "vault title": T.vault_title,
    "tags": lambda c: _joined(T.tags(c)),
    "assets": lambda c: _joined(T.image_assets(c)),
    "body": T.without_leading_properties,
    "property body": T.property_body,
    "properties": lambda c: _joined(F.transform(F.array_sort(F.map_entries(T.properties(c))), lambda p: F.concat(p["key"], F.lit("="), p["value"]))),
    "normalized": T.normalized,
    "log key": T.key_slug,
    "region id": T.region_slug,
    "file stem": T.file_stem,
    "site": lambda c: transform.published_body(c, F.create_map(*[F.lit(x) for kv in _SLUGS.items() for x in kv])),
    "vault": transform.vault_body,
    "quoted": T.json_quote,
}

#: Function, input and result.
TEXTS = (
    ("decode", "a &amp; b &sect; c &mdash; d &ndash; e", "a & b § c — d – e"),
    ("decode", "&amp;lt;", "&lt;"),
    ("decode", "x&nbsp;y&hellip;&middot;&gt;", "x y…·>"),
    ("escape", 'a & b < c > d "e"', "a &amp; b &lt; c &gt; d &quot;e&quot;"),
    ("links", "[[Foo]] text [[Bar|display]] [[Foo]] [[A &amp; B]]", "Foo|Bar|A & B"),
    ("links", "[[" + "x" * 250 + "]] [[Keep]]", "Keep"),
    ("files", 'a/b:c?d"e', 'a/b:c?d"e|a___b:c?d"e|a/b%3Ac?d"e|a/b:c%3Fd"e|a/b:c?d%22e'),
    ("slug", "Hello §World_x", "hello-sectionworld_x"),
    ("slug", "  Two   blanks - here  ", "two-blanks-here"),
    ("slug", "x" * 90, "x" * 80),
    ("vault title", "Weir / mill: what? <turns>", "Weir, mill - what turns"),
    ("vault title", "A\\B/C|D*", "A-B-CD"),
    ("tags", "tags:: alpha, beta, gamma", "alpha|beta|gamma"),
    ("tags", "tags:: [[a b]], [[c]]", "a b|c"),
    ("assets", "![](../assets/x.jpg) ![](./assets/y.png) ![a](assets/z.webp) ![](../../assets/nested.gif)", "x.jpg|y.png|z.webp|nested.gif"),
    ("assets", "![](/assets/x.jpg) ![](https://h/assets/y.jpg)", ""),
    ("body", "title:: X\ntype:: note\n\n- text", "- text"),
    ("body", "- text\nkey:: v", "- text\nkey:: v"),
    ("property body", "Title:: X\n\n- text", "- text"),
    ("properties", "a:: 1\nb:: two words \na:: 3\n\nc:: 4", "a=3|b=two words"),
    ("normalized", "a \t b\r\n\r\n\n  c  \n", "a b\nc"),
    ("log key", "Hub & Spoke: 2 of 3!", "hub-spoke-2-of-3"),
    ("region id", "The Keeper’s 'own' Notes", "the-keepers-own-notes"),
    ("file stem", "A___B.mdx", "A___B"),
    ("site", f"Real content\ncollapsed:: true\nid:: {_ID}\nlogseq.order-list-type:: number\nMore content", f'Real content <span data-block-id="{_ID}"></span>\nMore content'),
    ("site", "type:: note\nkept content", "type:: note\nkept content"),
    ("site", f"Some block\ntype:: note\nid:: {_ID}", f'Some block <span data-block-id="{_ID}"></span>\ntype:: note'),
    ("site", f"id:: {_ID}\nfirst content", "first content"),
    ("site", f"One\nid:: {_ID}\nid:: aa-1\n\nTwo\nid:: bb-2", f'One <span data-block-id="{_ID}"></span> <span data-block-id="aa-1"></span>\n\nTwo <span data-block-id="bb-2"></span>'),
    ("site", "Point one ((64fa1234-5678-9abc-def0-1234))", "Point one"),
    ("site", "Before {{query (and something)}} after", "Before  after"),
    ("site", "Intro\n- ## Heading", "Intro\n\n## Heading"),
    ("site", "  Line A\n    Line B\n  Line C", "Line A\n  Line B\nLine C"),
    ("site", "\t- Item\n\t- Item2", "- Item\n- Item2"),
    ("site", "flush\n  indented", "flush\nindented"),
    ("site", "[[Foo Bar|see here]] [[Foo Bar]]", "[see here](/kb/foo-bar/) [Foo Bar](/kb/foo-bar/)"),
    ("site", "[[Nope]]", '<span class="kb-unresolved" title="Not published">Nope</span>'),
    ("site", "![x](../assets/a.png)", "![x](/assets/kb/a.png)"),
    ("site", "\n\nA\n\n\n\nB\n\n", "A\n\nB"),
    ("vault", "- Decision\n  - first\n  - second\nend", "### Decision\n\n- first\n- second\nend"),
    ("vault", "- One\n  - a\n\n  - b\n- Two\n  - c", "### One\n\n- a\n\n- b\n\n### Two\n\n- c"),
    ("vault", "x:: y\ntext", "text"),
    ("vault", "![alt](../assets/a%20b.png)", "![[a b.png]]"),
    ("vault", "[[A/B: c|label]] and [[A/B]]", "[[A-B - c|label]] and [[A-B]]"),
    ("quoted", 'say "x"\n', '"say \\"x\\"\\n"'),
)


def r_golden_texts(spark: SparkSession, base: str) -> DataFrame:
    """Every function of page texts on written inputs."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text, _) in enumerate(TEXTS)], "n int, name string, text string")
    out = None
    for name, function in FUNCTIONS.items():
        part = rows.filter(F.col("name") == name).select("n", "name", function(F.col("text")).alias("result"))
        out = part if out is None else out.unionByName(part)
    return out


_MASK = {"mask": {"notice": "> Numbers removed.\n\n", "rules": [{"pattern": "SECRET-[A-Z]+", "replacement": "***"}, {"pattern": "Alice", "replacement": "A."}]}}
_ADDED = {"Pre": "pre", "Post": "post SECRET-B", "Gone": ""}
#: Body, filters as (prepend, append, redact) and result.
FILTERS = (
    ("host", ((("Pre"), None, None), (None, "Post", None)), "pre\n\nhost\n\npost SECRET-B"),
    ("host", (("Missing", None, None), ("Gone", None, None)), "host"),
    ("host", (("Self", None, None),), "host"),
    ("Value: SECRET-NUMBER paid to Alice", ((None, None, "mask"),), "> Numbers removed.\n\nValue: *** paid to A."),
    ("Value: SECRET-NUMBER", ((None, None, "none"),), "Value: SECRET-NUMBER"),
    ("Value: SECRET-NUMBER", ((None, None, "unheard of"),), "Value: SECRET-NUMBER"),
    ("x", ((None, "Post", None), (None, None, "mask")), "> Numbers removed.\n\nx\n\npost ***"),
    ("x SECRET-A", ((None, None, "mask"), (None, "Post", None)), "> Numbers removed.\n\nx ***\n\npost SECRET-B"),
)


def r_golden_filters(spark: SparkSession, base: str) -> DataFrame:
    """Filters of an entry applied in order."""
    kind = "n int, body string, filters array<struct<prepend:string,append:string,redact:string>>, additions map<string,string>"
    rows = spark.createDataFrame([(i, body, list(fs), _ADDED) for i, (body, fs, _) in enumerate(FILTERS)], kind)
    return rows.select("n", transform.filtered_body(F.col("body"), F.lit("Self"), F.col("filters"), F.col("additions"), _MASK).alias("result"))


_E = '{"title":"X","tier":"seed"%s}'
_M = '{"graphPath":"/g","entries":[%s]}'
#: A manifest and its violations as (path, severity).
DOCUMENTS = (
    ('"text"', (("$", "error"),)),
    ("not json", (("$", "error"),)),
    ('{"entries":[]}', (("$.graphPath", "error"),)),
    ('{"graphPath":"","entries":[]}', (("$.graphPath", "error"),)),
    ('{"graphPath":"/g"}', (("$.entries", "error"),)),
    ('{"graphPath":"/g","entries":"oops"}', (("$.entries", "error"),)),
    (_M % "", ()),
    ('{"graphPath":"/g","entries":[],"extra":1,"generatedAt":5}', (("$.extra", "warning"), ("$.generatedAt", "warning"))),
    (_M % '"x"', (("$.entries[0]", "error"),)),
    (_M % '{"title":"","tier":"foo"}', (("$.entries[0].title", "error"), ("$.entries[0].tier", "error"))),
    (_M % (_E % ',"redact":"heavy"'), (("$.entries[0].redact", "error"),)),
    (_M % (_E % ',"exclude":"yes"'), (("$.entries[0].exclude", "error"),)),
    (_M % (_E % ',"backlinks":["ok",42]'), (("$.entries[0].backlinks[1]", "error"),)),
    (_M % (_E % ',"backlinks":"A"'), (("$.entries[0].backlinks", "error"),)),
    (_M % (_E % ',"file":7,"color":"red"'), (("$.entries[0].file", "error"), ("$.entries[0].color", "warning"))),
    (_M % (_E % ',"filters":{}'), (("$.entries[0].filters", "error"),)),
    (_M % (_E % ',"filters":[{"prepend":"A","append":"B"},{},{"summarize":"x"}]'), (("$.entries[0].filters[0]", "error"), ("$.entries[0].filters[1]", "error"), ("$.entries[0].filters[2]", "error"))),
    (_M % (_E % ',"filters":[{"prepend":123},{"prepend":""},{"redact":""},"x"]'), (("$.entries[0].filters[0].prepend", "error"), ("$.entries[0].filters[1].prepend", "error"), ("$.entries[0].filters[2].redact", "error"), ("$.entries[0].filters[3]", "error"))),
    (_M % (_E % ',"filters":[{"redact":"host-defined"}]'), ()),
    (_M % (_E % ',"redact":"light","filters":[{"redact":"none"}]'), (("$.entries[0].redact", "error"),)),
    (_M % ", ".join([_E % "", _E % "", _E.replace('"X"', '"Y"') % ""]), (("$.entries", "error"),)),
)


def r_golden_documents(spark: SparkSession, base: str) -> DataFrame:
    """Violations of whole manifests, by their path."""
    rows = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DOCUMENTS)], "n int, json string")
    return manifest.issues(rows, "n").select("n", "path", "severity")


_BASE = (("Alpha", '{"title":"Alpha","tier":"seed"}'), ("Beta", '{"title":"Beta","tier":"1-hop","backlinks":["Alpha"]}'), ("Gamma", '{"title":"Gamma","tier":"1-hop","backlinks":["Alpha","Beta"]}'))
#: Edits as (op, title, field, value, entry, rationale), titles after them, errors, and affected titles in order.
EDITS = (
    ((("remove", "Beta", None, None, None, "r"), ("add", "Beta", None, None, '{"title":"Beta","tier":"2-hop"}', "r")), "Alpha,Gamma,Beta", 0, "Beta,Gamma"),
    ((("add", "Alpha", None, None, '{"title":"Alpha","tier":"seed"}', "r"), ("set", "Beta", "exclude", "true", None, "r")), "Alpha,Beta,Gamma", 1, "Beta,Gamma"),
    ((("set", "Alpha", "title", '"Z"', None, "r"), ("unset", "Alpha", "tier", None, None, "r"), ("set", "Alpha", "exclude", "true", None, "  ")), "Alpha,Beta,Gamma", 3, ""),
    ((("set", "Alpha", "exclude", "true", None, "r"),), "Alpha,Beta,Gamma", 0, "Alpha,Beta,Gamma"),
    ((("remove", "Alpha", None, None, None, "r"),), "Beta,Gamma", 0, "Beta,Gamma"),
    ((("unset", "Gamma", "backlinks", None, None, "r"), ("fold", "Gamma", None, None, None, "r"), ("remove", "Nobody", None, None, None, "r")), "Alpha,Beta,Gamma", 2, "Gamma"),
)


def r_golden_edits(spark: SparkSession, base: str) -> DataFrame:
    """Manifests after edits: their titles in order, how many edits failed, and which entries are affected."""
    entries = [(str(n), i, t, e) for n in range(len(EDITS)) for i, (t, e) in enumerate(_BASE)]
    ops = [(str(n), k, *op) for n, (edits, _, _, _) in enumerate(EDITS) for k, op in enumerate(edits)]
    result = patch.apply_patch(
        spark.createDataFrame(entries, "manifest string, entry_index int, title string, entry string"),
        spark.createDataFrame(ops, "manifest string, op_index int, op string, title string, field string, value string, entry string, rationale string"),
    )
    listed = lambda df, at: df.groupBy("manifest").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "title"))), lambda x: x["title"]), ",").alias("titles"))
    after = listed(patch.patched_entries(result), "entry_index")
    failed = result.groupBy("manifest").agg(F.count_if(F.col("what") == "error").alias("errors"))
    hit = listed(patch.affected_entries(result), "place").withColumnRenamed("titles", "affected")
    return after.join(failed, "manifest").join(hit, "manifest", "left").select(F.col("manifest").cast("int").alias("n"), "titles", "errors", F.coalesce("affected", F.lit("")).alias("affected"))


_PART = '## {0}\n<!-- projected: source="Mill#{1}" -->\n\n{2}\n'
_A, _B = _PART.format("Use", "use", "Use it well."), _PART.format("Parts", "parts", "Two parts.")
_FREE = "## Own\n\nMine.\n"
_ATTRIBUTE = '<SectionHeading level="2" id="x" text="X" projected source="Mill#x" />\n\nbody\n'
_FENCE = '<!-- region: box -->\n<!-- projected: source="Mill#box" -->\nin\n<!-- /region -->\n'
#: Desired page, page, bridge taken from, and what a plan says: verdicts by id and what was edited by hand.
PAGES = (
    (_A + _B, _A + _B, _A + _B, "parts=unchanged|use=unchanged", "", ""),
    (_A + _B, _A.replace("well", "otherwise") + _B, _A + _B, "parts=unchanged|use=regenerate", "use", ""),
    (_A.replace("well", "thus") + _B, _A + _B, _A + _B, "parts=unchanged|use=regenerate", "", ""),
    (_A, _A + _FREE, None, "use=unchanged", "", ""),
    (_A, _A + _B + _FREE, None, "parts=remove|use=unchanged", "", ""),
    (_A + _B, _FREE, None, "parts=create|use=create", "", ""),
    (_A + _B, _B + _FREE + _A, None, "parts=unchanged|use=unchanged", "", "parts|use"),
    (_ATTRIBUTE, _ATTRIBUTE.replace("body", "old"), None, "x=regenerate", "", ""),
    (_FENCE + _A, _FENCE.replace("in\n", "out\n") + _A, None, "box=regenerate|use=unchanged", "", ""),
)


def r_golden_pages(spark: SparkSession, base: str) -> DataFrame:
    """Plan and outcome of reconciling written pages; a second run finds nothing to do."""
    rows = [(str(n), want, have, None if was is None else reconcile.bridge_of(was)) for n, (want, have, was, _, _, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page string, desired string, current string, prior map<string,string>")
    verdicts = reconcile.plan_pages(pages).groupBy("page").agg(_joined(F.array_sort(F.collect_list(F.concat_ws("=", "id", "verdict")))).alias("verdicts"))
    done = reconcile.apply_pages(pages)
    again = reconcile.apply_pages(done.select("page", "content", "bridge").join(pages.select("page", "desired"), "page").select("page", "desired", F.col("content").alias("current"), F.col("bridge").alias("prior")))
    still = again.join(done.select("page", F.col("content").alias("before")), "page").select("page", (F.col("content") == F.col("before")).alias("settled"))
    rows = done.select("page", _joined(F.array_sort("hand_edited")).alias("edited"), _joined(F.array_sort("reordered")).alias("moved"), F.col("content").contains("Mine.").alias("own"))
    return rows.join(verdicts, "page").join(still, "page").select(F.col("page").cast("int").alias("n"), "verdicts", "edited", "moved", "own", "settled")


_BRIDGED = (("synced", _A, _A), ("hash-mismatch", _A.replace("well", "by hand"), _A), ("stale", _A, _A.replace("well", "anew")), ("orphan", _B, _A))


def r_golden_health(spark: SparkSession, base: str) -> DataFrame:
    """State of a bridged region for a page and a fresh projection, and the place it is shown at."""
    frame = lambda k: spark.createDataFrame([(x[0], x[k]) for x in _BRIDGED], "page string, content string")
    bridge = spark.createDataFrame([(x[0], i, h) for x in _BRIDGED for i, h in reconcile.bridge_of(_A).items()], "page string, id string, content_hash string")
    health = reconcile.bridge_health(frame(1), bridge, frame(2))
    return health.select("page", "id", "state", reconcile.shown_order("state", reconcile.STATES).cast("int").alias("place"))


#: How well a source says it is cited, the least asked for, and why it is held back.
GATES = (
    ("title:: X\ncitation-recall:: 0.82\n", 0.5, True, None), ("title:: X\ncitation-recall:: 0.4\n", 0.5, True, "recall 0.4 is below 0.5"),
    ("title:: X\n", 0.5, False, None), ("citation-recall:: none", 0.5, True, "recall can't be read"), ("citation-recall:: 0.1", None, True, None),
)


def r_golden_gates(spark: SparkSession, base: str) -> DataFrame:
    """Whether a source is grounded, and why it is held back."""
    out = None
    for n, (text, least, _, _) in enumerate(GATES):
        row = spark.createDataFrame([(n, text)], "n int, content string")
        part = row.select("n", reconcile.is_grounded(F.col("content")).alias("grounded"), reconcile.faithfulness_gate(F.col("content"), least).alias("gate"))
        out = part if out is None else out.unionByName(part)
    return out


def r_golden_cycles(spark: SparkSession, base: str) -> DataFrame:
    """Circles of filters, one finding each."""
    append = lambda t: [(None, t, None)]
    rows = [("two", "A", "B"), ("two", "B", "A"), ("three", "B", "C"), ("three", "C", "A"), ("three", "A", "B"), ("three", "X", "A"), ("none", "A", "B"), ("none", "B", "C"), ("self", "A", "A")]
    rows = [(g, i, t, False, append(ref)) for i, (g, t, ref) in enumerate(rows)] + [("none", 90, "C", False, None)]
    entries = spark.createDataFrame(rows, "graph string, entry_index int, title string, exclude boolean, filters array<struct<prepend:string,append:string,redact:string>>")
    return drift.filter_cycles(entries).select("graph", "id")


def r_golden_proposals(spark: SparkSession, base: str) -> DataFrame:
    """What proposals say for themselves, and why a candidate has none."""
    meta = spark.createDataFrame(
        [("g", "M", "s", ["t", "u"], ["C"]), ("g", "C", "s", ["t", "u"], ["M"]), ("g", "Alone", "none", [], []), ("g", "Silent", None, [], [])],
        "graph string, title string, category string, tags array<string>, wikilinks array<string>",
    )
    wanted = spark.createDataFrame([("g", t) for t in ("C", "Alone", "Silent", "Nobody")], "graph string, title string")
    ranked = placement.propose(wanted, spark.createDataFrame([("g", "M")], "graph string, title string"), meta)
    said = placement.reasons(ranked).select("title", F.col("score").cast("int").alias("score"), _joined(F.col("rationale")).alias("said"))
    return said.unionByName(placement.unplaced(wanted, meta, ranked).select("title", F.lit(None).cast("int").alias("score"), F.col("reason").alias("said")))


def r_golden_unknown_fields(spark: SparkSession, base: str) -> DataFrame:
    """Fields of entries that the schema doesn't have, as the audit reports them."""
    raw = spark.createDataFrame([("g", _M % (_E % ',"color":"red","file":"a.md"'))], "manifest string, json string")
    rows = manifest.raw_entries(manifest.parse(raw)).select(F.col("manifest").alias("graph"), "entry_index", F.try_variant_get("e", "$.title", "string").alias("title"), "keys")
    return drift.unknown_fields(rows, list(manifest.ENTRY_FIELDS)).select("graph", "id", "kind", "severity", "detail")


def r_golden_heads(spark: SparkSession, base: str) -> DataFrame:
    """The head of a page file of the site and a whole page of the vault."""
    rows = spark.createDataFrame([("Mill", "seed", "type:: note\nshort:: a \"b\"\ncreated:: [[2024-01-02]]\ntags:: x, y\n\n- text", ["Weir", "Hub"])], "title string, tier string, content string, backlinks array<string>")
    props, body = T.properties(F.col("content")), T.property_body(F.col("content"))
    site = projection.site_frontmatter(F.col("title"), F.col("tier"), props, F.col("backlinks"))
    vault = projection.vault_page(props, body, F.col("title"), F.lit("pages/Mill.md"), "the graph")
    return rows.select(F.explode(F.array(F.struct(F.lit("site").alias("what"), site.alias("text")), F.struct(F.lit("vault").alias("what"), vault.alias("text")))).alias("x")).select("x.*")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("r_golden_")}


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple], casts: str = "*") -> str:
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({columns})"


_SITE_HEAD = '---\ntitle: "Mill"\nslug: "mill"\ntier: "seed"\ntype: "note"\nshort: "a \\\\\\"b\\\\\\""\ncreated: "2024-01-02"\npageTags: "x, y"\nbacklinks:\n  - "Weir"\n  - "Hub"\n---\n'
_VAULT_PAGE = (
    '---\ntitle: "Mill"\ntype: "note"\ncreated: "2024-01-02"\ntags: "x, y"\nsource_page: "pages/Mill.md"\nprojected_from: "the graph"\n---\n'
    "> [!info] Derived view, do not edit here\n> Source of truth: the graph.\n> - page: `pages/Mill.md`\n\n- text\n"
)

SQL = {
    "r_golden_texts": _values("n, name, result", [(i, name, result) for i, (name, _, result) in enumerate(TEXTS)]),
    "r_golden_filters": _values("n, result", [(i, result) for i, (_, _, result) in enumerate(FILTERS)]),
    "r_golden_documents": _values("n, path, severity", [(i, *x) for i, (_, found) in enumerate(DOCUMENTS) for x in found]),
    "r_golden_edits": _values("n, titles, errors, affected", [(i, *x[1:]) for i, x in enumerate(EDITS)], "n, titles, errors::BIGINT AS errors, affected"),
    "r_golden_pages": _values("n, verdicts, edited, moved, own, settled", [(i, *x[3:], "Mine." in x[1], True) for i, x in enumerate(PAGES)]),
    "r_golden_health": _values("page, id, state, place", [("synced", "use", "synced", 4), ("hash-mismatch", "use", "hash-mismatch", 1), ("stale", "use", "stale", 3), ("orphan", "use", "orphan", 2)]),
    "r_golden_gates": _values("n, grounded, gate", [(i, *x[2:]) for i, x in enumerate(GATES)]),
    "r_golden_cycles": _values("graph, id", [("two", "filter-cycle:A->B"), ("three", "filter-cycle:A->B->C")]),
    "r_golden_proposals": _values(
        "title, score, said",
        [
            ("C", 30, 'Its category is "s".|Links to 1 page of this section.|1 page of this section link to it.|Shares 2 tags with this section.'),
            ("Alone", None, "category without overlap"), ("Silent", None, "no signal"), ("Nobody", None, "no metadata"),
        ],
    ),
    "r_golden_unknown_fields": _values("graph, id, kind, severity, detail", [("g", "unknown-field:X#color", "unknown-field", "info", "color")]),
    "r_golden_heads": _values("what, text", [("site", _SITE_HEAD), ("vault", _VAULT_PAGE)]),
}
