import pytest
from pyspark.sql import functions as F

from foliograph.operators import recall, reconcile
from foliograph.operators import regions as R
from foliograph.functions import text as T

PAGE = "# A\ntext\n## B\n- first\n\n<!-- region: c -->\ninside\n<!-- /region -->\n# D\n<!-- region: open -->\n"


def frame(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "page string, content string")


def test_regions(spark):
    got = {(r["id"], r["kind"], r["body_start"], r["body_end"], r["span_start"], r["span_end"]) for r in R.page_regions(frame(spark, PAGE), ["page"]).collect()}
    assert got == {("a", "heading", 1, 7, 0, 7), ("b", "heading", 3, 7, 2, 7), ("c", "fence", 6, 6, 5, 7), ("d", "heading", 9, 10, 8, 10)}


def test_region_forms(spark):
    text = '<SectionHeading level="3" id="x" text="T" />\n> **lead** line\n<Region name="r">\n\nbody\n\n</Region>\n<SectionHeading text="no id" />'
    rows = {r["id"]: r for r in R.page_regions(frame(spark, text), ["page"]).collect()}
    assert set(rows) == {"x", "r"} and rows["x"]["level"] == 3 and rows["x"]["preview"] == "lead** line" and rows["r"]["preview"] == "body"


def test_regions_of_nothing(spark):
    assert R.page_regions(frame(spark, "", None, "plain"), ["page"]).count() == 0


def verb(spark, text, region_id, make):
    rows = frame(spark, text).withColumn("rs", R.regions_of(T.lines_of(F.col("content"))))
    one = lambda name: F.filter("rs", lambda r: r["id"] == name)[0]
    return rows.select(make(F.col("content"), one(region_id), one).alias("r")).first()["r"]


def test_verbs(spark):
    text = "## A\nold\n## B\nb"
    assert verb(spark, text, "a", lambda c, r, _: R.replace_body(c, r, F.lit("new\nline"))) == "## A\nnew\nline\n## B\nb"
    assert verb(spark, text, "a", lambda c, r, _: R.insert_into_body(c, r, F.lit("more"))) == "## A\nold\n\nmore\n## B\nb"
    assert verb(spark, "## A\n## B", "a", lambda c, r, _: R.insert_into_body(c, r, F.lit("x"))) == "## A\nx\n## B"
    assert verb(spark, text, "a", lambda c, r, _: R.create_after(c, r, R.render_region("fence", F.lit("n"), F.lit("t")))) == '## A\nold\n\n<Region name="n">\n\nt\n\n</Region>\n\n## B\nb'
    assert verb(spark, text, "a", lambda c, r, one: R.move(c, r, one("b"), "after"))["content"] == "## B\nb\n## A\nold"
    assert verb(spark, "# A\n## B\nx", "a", lambda c, r, one: R.move(c, r, one("b"), "after"))["status"] == "refused"
    assert verb(spark, "## A\r\nold", "a", lambda c, r, _: R.replace_body(c, r, F.lit("n"))) == "## A\r\nn"


def test_rename_and_refs(spark):
    text = "<!-- region: a -->\nx\n<!-- /region -->\n## B"
    assert verb(spark, text, "a", lambda c, r, _: R.rename(c, r, F.lit("z")))["content"].startswith("<!-- region: z -->")
    assert verb(spark, text, "a", lambda c, r, _: R.rename(c, r, F.lit("b")))["reason"] == "id exists"
    assert verb(spark, text, "b", lambda c, r, _: R.rename(c, r, F.lit("q")))["status"] == "refused"
    assert verb(spark, text, "a", lambda c, r, _: R.rename(c, r, F.lit("no good")))["reason"] == "invalid id"
    row = frame(spark, "see #a and page/a not #a-b").select(R.rewrite_refs(F.col("content"), "a", "z").alias("r")).first()["r"]
    assert (row["content"], row["count"]) == ("see #z and page/z not #a-b", 2)


def scores(spark, text, **kw):
    return {r["region"]: (r["cited"], r["total"]) for r in recall.region_recall(frame(spark, text), ["page"], **kw).collect()}


BAND = "_(well-supported)_"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("\n".join([f"- c {BAND} [^a]"] * 3), {":root": (3, 3)}),
        (f"## Parent\n### Child\n- Claim {BAND} [^a]", {":root": (0, 0), "parent": (0, 0), "child": (1, 1)}),
        (f"- x {BAND} _(repaired)_ [^k]", {":root": (1, 1)}),
        ("- x _(unsupported)_ [^k]", {":root": (0, 0)}),
        (f"## Section\n- a {BAND} [^a]\n- b {BAND} [^b]\n- c {BAND} [^c]\n- d _(unverified: x)_", {":root": (0, 0), "section": (3, 4)}),
        ("nothing", {":root": (0, 0)}),
        ("", {":root": (0, 0)}),
    ],
)
def test_recall(spark, text, expected):
    assert scores(spark, text) == expected
    assert scores(spark, text.replace("\n", "\r\n")) == expected or "##" in text


def test_citations(spark):
    long = "a" * 40
    text = f"- x {BAND} [^missing]\n- y {BAND} [^k]\n- Citations\n  - [^k]: s finding:: 0\n  - [^k]: s finding:: {long}"
    row = recall.region_recall(frame(spark, text), ["page"]).first()
    assert (row["cited"], row["total"], row["recall"], row["finding_ids"]) == (2, 2, 1.0, [long])
    none = recall.region_recall(frame(spark, "x"), ["page"]).first()
    assert none["recall"] is None


def test_subdivided_root(spark):
    text = f"- Smith 2019 (paper, p)\n  - a {BAND} [^a]\n  - b {BAND} [^b]\n- Doe 2020\n  - c {BAND} [^c]\n  - d {BAND}\n- Citations\n- Doe 2020\n  - e {BAND}"
    got = {k: v for k, v in scores(spark, text, subdivide_root=True).items()}
    assert got == {":root": (0, 0), "src:smith-2019": (2, 2), "src:doe-2020": (1, 2), "src:doe-2020-2": (0, 1)}


def test_page_is_the_sum_of_its_regions(spark):
    text = f"- r {BAND}\n## A\n- a {BAND} [^1]\n### B\n- b {BAND} [^2]\n- c {BAND}"
    rows = frame(spark, text, "x")
    page = {r["page"]: (r["cited"], r["total"]) for r in recall.page_recall(rows, ["page"]).collect()}
    assert page == {"0": (2, 4), "1": (0, 0)}
    line = recall.recall_lines(recall.region_recall(rows, ["page"]), ["page"]).filter("page = '0'").first()["line"]
    assert line == "recall 2/4=0.50 · a 1/1=1.00 · b 1/2=0.50"


SOURCE = "# Definition\nwhat it is\n# Levels\none\ntwo"


def test_stamp_and_plan():
    want = reconcile.stamp(SOURCE, "Page")
    assert '<!-- projected: source="Page#definition" -->' in want and reconcile.stamp(want, "Page") == want
    assert [i["verdict"] for i in reconcile.plan(want, want)] == ["unchanged", "unchanged"]
    assert [i["verdict"] for i in reconcile.plan(want, "# My Notes\nfree")] == ["create", "create"]
    less = reconcile.stamp("# Definition\nwhat it is", "Page")
    assert {i["id"]: i["verdict"] for i in reconcile.plan(less, want)} == {"definition": "unchanged", "levels": "remove"}


def test_apply_is_idempotent_and_keeps_free_regions():
    want = reconcile.stamp(SOURCE, "Page")
    page = want.replace("what it is", "edited by hand") + "\n# My Notes\nfree text"
    prior = reconcile.bridge_of(want)
    done = reconcile.apply(want, page, prior)
    assert done["regenerated"] == ["definition"] and done["hand_edited"] == ["definition"] and "free text" in done["content"]
    again = reconcile.apply(want, done["content"], done["bridge"])
    assert again["content"] == done["content"] and again["unchanged"] == ["definition", "levels"] and not again["hand_edited"]
    fresh = reconcile.apply(want, "# My Notes\nfree text")
    assert fresh["created"] == ["definition", "levels"] and "free text" in fresh["content"]
    assert reconcile.apply(want, fresh["content"])["content"] == fresh["content"]


def test_apply_puts_regions_in_source_order():
    want = reconcile.stamp(SOURCE, "Page")
    a, b = (r.text for r in reconcile.projected_regions(want))
    swapped = f"{b}\n# Mine\nx\n{a}"
    done = reconcile.apply(want, swapped)
    assert done["reordered"] == ["definition", "levels"] and [r.id for r in reconcile.regions(done["content"])] == ["definition", "mine", "levels"]
    moved = reconcile.reorder(swapped, want)
    assert moved["moved"] == ["definition", "levels"] and moved["content"] == done["content"]
    assert reconcile.reorder(want, want) == {"content": want, "moved": []}


def test_pages_and_bridge(spark):
    want = reconcile.stamp(SOURCE, "Page")
    rows = spark.createDataFrame([("p", want, "# Mine\nx", None), ("q", want, want, reconcile.bridge_of(want))], "page string, desired string, current string, prior map<string,string>")
    assert reconcile.plan_pages(rows).count() == 4
    done = {r["page"]: r for r in reconcile.apply_pages(rows).collect()}
    assert done["p"]["first_run"] and not done["q"]["first_run"] and done["q"]["content"] == want
    hashes = reconcile.bridge_of(want)
    bridge = spark.createDataFrame([("q", "definition", hashes["definition"]), ("q", "levels", "0" * 16), ("q", "gone", "1" * 16)], "page string, id string, content_hash string")
    pages = spark.createDataFrame([("q", want)], "page string, content string")
    fresh = spark.createDataFrame([("q", want.replace("what it is", "new"))], "page string, content string")
    got = {r["id"]: r["state"] for r in reconcile.bridge_health(pages, bridge, fresh).collect()}
    assert got == {"definition": "stale", "levels": "hash-mismatch", "gone": "orphan"}
    text = spark.createDataFrame([('{"version":"region-bridge/v1","page":"q","entries":{"a":{"source":"s","contentHash":"h"}}}',), ('{"a":"h"}',), (None,)], "v string")
    assert [r[0] for r in text.select(reconcile.read_bridge(F.col("v"))).collect()] == [{"a": "h"}, {"a": "h"}, {}]


FORMS = (
    '<SectionHeading level="2" id="x" text="X" projected source="S#x" />\nold x\n<!-- region: note -->\n<!-- projected: source="S#note" -->\nold note\n<!-- /region -->\n# Own\nfree\n'
    '<Region name="box">\n<!-- projected: source="S#box" -->\nold box\n</Region>\nend'
)


def test_all_forms_of_regions_are_reconciled(spark):
    page = FORMS.replace("<!-- region", "# Gap\n<!-- region")
    assert reconcile.bridge_of(page).keys() == {"x", "note", "box"}
    done = reconcile.apply(page.replace("old", "new"), page, reconcile.bridge_of(page))
    assert done["regenerated"] == ["x", "note", "box"] and done["content"] == page.replace("old", "new")
    # The frame of regions and the reconciler give one answer.
    rows = R.page_regions(frame(spark, page), ["page"]).filter("source is not null").collect()
    assert {r["id"]: r["content_hash"] for r in rows} == reconcile.bridge_of(page)
    assert [(r.id, r.start, r.end) for r in reconcile.regions(page)] == [
        (r["id"], r["span_start"], r["span_end"] + 1) for r in R.page_regions(frame(spark, page), ["page"]).orderBy("span_start").collect()
    ]
    assert reconcile.stamp('<SectionHeading id="y" />\nb', "T").split("\n")[1] == '<!-- projected: source="T#y" -->'
    assert reconcile.stamp(page, "T").count("projected") == page.count("projected") + 2


def test_whole_manifests(spark):
    pages = spark.createDataFrame(
        [
            ("g", "Mill Race", "Mill Race.md", "title:: Mill Race\n\n- ## Definition\n  - See [[Weir]].\n- ## Levels\n  - Two."),
            ("g", "Weir", "Weir.md", "citation-recall:: 0.4\n\n- ## A\n  - text _(supported)_ [^k]"),
            ("g", "Hidden", "Hidden.md", "- ## Secret"),
        ],
        "graph string, title string, file string, content string",
    )
    entries = spark.createDataFrame(
        [("g", 0, "Mill Race", None, None), ("g", 1, "Hidden", None, True), ("g", 2, "Weir", None, False), ("g", 3, "Lost", None, None)],
        "graph string, entry_index int, title string, file string, exclude boolean",
    )
    first = {r["slug"]: r for r in reconcile.reconcile_manifest(entries, pages).collect()}
    assert set(first) == {"mill-race", "weir", "lost"} and first["lost"]["error"] and first["lost"]["content"] is None
    mill = first["mill-race"]
    assert mill["first_run"] and mill["created"] == ["definition", "levels"] and '<!-- projected: source="Mill Race#definition" -->' in mill["content"]
    assert "[Weir](/kb/weir/)" in mill["content"] and "title::" not in mill["content"] and first["weir"]["grounded"] and not mill["grounded"]
    targets = spark.createDataFrame([("g", "mill-race", mill["content"].replace("Two.", "Three."), mill["bridge"])], "graph string, slug string, content string, prior map<string,string>")
    again = reconcile.reconcile_manifest(entries, pages, targets, least=0.5)
    rows = {r["slug"]: r for r in again.collect()}
    assert rows["mill-race"]["regenerated"] == rows["mill-race"]["hand_edited"] == ["levels"] and rows["mill-race"]["content"] == mill["content"]
    assert rows["weir"]["gate"] == "recall 0.4 is below 0.5" and rows["weir"]["content"] is None
    assert tuple(reconcile.batch_summary(again).first())[1:] == (3, 1, 1, 1, 0)
    assert reconcile.recall_of_targets(reconcile.reconcile_manifest(entries, pages)).first()["line"] == "recall 1/1=1.00 · a 1/1=1.00"
    assert {r["slug"] for r in reconcile.slug_map(entries).collect()} == {"mill-race", "weir", "lost"}
    assert reconcile.reconcile_manifest(entries.limit(0), pages).count() == 0


def test_ids_in_use_are_skipped(spark):
    text = f"- Foo\n  - a {BAND} [^a]\n- Foo\n  - b {BAND}\n- Foo 2\n  - c {BAND}\n- Foo-2\n  - d {BAND} [^d]"
    got = scores(spark, text, subdivide_root=True)
    assert got == {":root": (0, 0), "src:foo": (1, 1), "src:foo-2": (0, 1), "src:foo-2-2": (0, 1), "src:foo-2-3": (1, 1)}
    order = recall.region_recall(frame(spark, f"## B\n- x {BAND}\n# A\n" + text), ["page"], subdivide_root=True).orderBy("place").collect()
    assert [r["region"] for r in order][0] == ":root"


def test_shown_orders(spark):
    rows = spark.createDataFrame([(s,) for s in ("synced", "orphan", "stale", "hash-mismatch")], "state string")
    assert [r["state"] for r in rows.orderBy(reconcile.shown_order("state", reconcile.STATES)).collect()] == list(reconcile.STATES)
