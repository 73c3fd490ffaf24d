import pytest
from pyspark.sql import functions as F

from foliograph.operators import projection
from foliograph.operators import transform as X

SLUGS = {"Foo Bar": "foo-bar"}
BLOCK = "64fa1234-5678-9abc-def0-123456789abc"


@pytest.mark.parametrize(
    "given, expected",
    [
        (f"Real content\ncollapsed:: true\nid:: {BLOCK}\nlogseq.order-list-type:: number\nMore content", f'Real content <span data-block-id="{BLOCK}"></span>\nMore content'),
        ("type:: note\nkept content", "type:: note\nkept content"),
        (f"Some block\ntype:: note\nid:: {BLOCK}", f'Some block <span data-block-id="{BLOCK}"></span>\ntype:: note'),
        (f"id:: {BLOCK}\nfirst content", "first content"),
        ("Point one ((64fa1234-5678-9abc-def0-1234))", "Point one"),
        ("a ((64fa1234-5678-9abc-def0-1234)) b", "ab"),
        ("Before {{query (and something)}} after", "Before  after"),
        ("Intro\n- ## Heading", "Intro\n\n## Heading"),
        ("  Line A\n    Line B\n  Line C", "Line A\n  Line B\nLine C"),
        ("\t- Item\n\t- Item2", "- Item\n- Item2"),
        ("flush\n  indented", "flush\nindented"),
        ("[[Foo Bar|see here]]", "[see here](/kb/foo-bar/)"),
        ("[[Nope]]", '<span class="kb-unresolved" title="Not published">Nope</span>'),
        ("![x](../assets/a.png)", "![x](/assets/kb/a.png)"),
        ("\n\nA\n\n\n\nB\n\n", "A\n\nB"),
        ("", ""),
    ],
)
def test_site_text(given, expected):
    assert X.site_text(given, SLUGS) == expected


def test_site_text_of_null():
    assert X.site_text(None, None) is None and X.vault_text(None) is None


@pytest.mark.parametrize(
    "given, expected",
    [
        ("- Decision\n  - first\nend", "### Decision\n\n- first\nend"),
        ("x:: y\ntext", "text"),
        ("![alt](../assets/a%20b+c.png)", "![[a b+c.png]]"),
        ("[[A/B: c|label]] and [[A/B]]", "[[A-B - c|label]] and [[A-B]]"),
    ],
)
def test_vault_text(given, expected):
    assert X.vault_text(given) == expected


def test_labels_are_promoted():
    assert X.promoted("- Decision\n  - first\n  - second\nend") == "\n### Decision\n\nfirst\nsecond\nend"
    assert X.promoted("- Decision [x]\n  - first") == "- Decision [x]\n  - first"


RULES = {"mask": {"notice": "note\n", "rules": [{"pattern": "SECRET-\\w+", "replacement": "***"}, {"pattern": "a", "replacement": "X", "global": False}]}}


def spec(**kw):
    return {"prepend": None, "append": None, "redact": None} | kw


def test_filters():
    extra = {"Pre": "\npre\n", "Post": "post", "Empty": "\n"}
    both = [spec(prepend="Pre"), spec(append="Post")]
    assert X.filtered("host", "T", both, extra, {}) == "pre\n\nhost\n\npost"
    for ref in ("Missing", "Empty", "T"):
        assert X.filtered("host", "T", [spec(prepend=ref)], extra | {"T": "self"}, {}) == "host"
    assert X.filtered("SECRET-1 aa", "T", [spec(redact="mask")], extra, RULES) == "note\n*** Xa"
    for mode in ("none", "other"):
        assert X.filtered("SECRET-1", "T", [spec(redact=mode)], extra, RULES) == "SECRET-1"
    assert X.filtered("h", "T", [spec(append="S"), spec(redact="mask")], {"S": "SECRET-9"}, RULES) == "note\nh\n\n***"
    assert X.filtered(None, "T", None, None, {}) is None


PAGES = "graph string, title string, file string, content string"
ENTRIES = "graph string, entry_index int, title string, tier string, backlinks array<string>, exclude boolean, redact string, file string, filters array<struct<prepend:string,append:string,redact:string>>"


def site(spark):
    pages = spark.createDataFrame(
        [
            ("g", "Foo Bar", "Foo Bar.md", "type:: note\ncreated:: [[2024-01-02]]\n\nsee [[Baz]] and [[Gone]] ![i](../assets/i.png)"),
            ("g", "Baz", "Baz.md", "x"),
            ("g", "Anchor", "Anchor.md", "type:: anchor\ntg-doc:: d\n\nthin"),
        ],
        PAGES,
    )
    entries = spark.createDataFrame(
        [
            ("g", 0, "Foo Bar", "seed", ["Baz"], None, None, None, [(None, "Baz", None)]),
            ("g", 1, "Baz", "1-hop", None, None, None, None, None),
            ("g", 2, "Anchor", "1-hop", None, None, None, None, None),
            ("g", 3, "Gone", "1-hop", None, None, None, None, None),
            ("g", 4, "Hidden", "1-hop", None, True, None, None, None),
        ],
        ENTRIES,
    )
    return pages, entries


def test_site_records(spark):
    pages, entries = site(spark)
    cache = spark.createDataFrame([("g", "Anchor.md", "a:: b\n\nfull text")], "graph string, name string, content string")
    rows = {r["slug"]: r for r in projection.site_records(entries, pages, RULES, cache).collect()}
    assert set(rows) == {"foo-bar", "baz", "anchor"}
    assert rows["foo-bar"]["data"]["created"] == "2024-01-02" and rows["foo-bar"]["data"]["backlinks"] == ["Baz"]
    assert rows["foo-bar"]["body"] == "see [Baz](/kb/baz/) and [Gone](/kb/gone/) ![i](/assets/kb/i.png)\n\nx"
    assert rows["anchor"]["body"] == "full text"
    counts = projection.run_counts(entries, pages, cache).first().asDict()
    assert counts == {"graph": "g", "included": 3, "excluded": 1, "missing": 1, "hydrated": 1, "unhydrated": 0}


def test_vault_and_assets(spark):
    pages, _ = site(spark)
    plan = {r["title"]: r for r in projection.vault_plan(spark.createDataFrame([("g", "Foo Bar"), ("g", "No")], "graph string, title string"), pages, "the graph").collect()}
    assert plan["No"]["missing"] and plan["No"]["text"] is None
    text = plan["Foo Bar"]["text"]
    assert text.startswith('---\ntitle: "Foo Bar"\ntype: "note"\ncreated: "2024-01-02"\n') and "![[i.png]]" in text and "`pages/Foo Bar.md`" in text
    assets = projection.asset_plan(pages, spark.createDataFrame([], "graph string, asset string")).collect()
    assert [(r["asset"], r["state"]) for r in assets] == [("i.png", "missing")]


def test_contents_and_stubs(spark):
    rows = spark.createDataFrame([("g", "default", "A/B", 0), ("g", "x", "C", 1)], "graph string, group string, title string, ord int")
    text = projection.contents_page(rows, "Map", {"x": "Ex"}).first()["text"]
    assert "- [[A-B]]\n\n## Ex\n- [[C]]\n" in text
    edge = spark.createDataFrame([("g", "T", True, ["A", "B"]), ("g", "U", False, ["A"])], "graph string, title string, exists boolean, referenced_by array<string>")
    stubs = projection.stub_plan(edge).collect()
    assert [s["title"] for s in stubs] == ["T"] and "[[A]], [[B]]" in stubs[0]["text"]


def test_frontmatter(spark):
    row = spark.createDataFrame([("T x", "seed", {"type": "note", "short": 'a "b"'}, ["L"])], "t string, tier string, p map<string,string>, b array<string>")
    text = row.select(projection.site_frontmatter(F.col("t"), F.col("tier"), F.col("p"), F.col("b")).alias("r")).first()["r"]
    assert text == '---\ntitle: "T x"\nslug: "t-x"\ntier: "seed"\ntype: "note"\nshort: "a \\\\\\"b\\\\\\""\nbacklinks:\n  - "L"\n---\n'


def test_filters_a_host_adds():
    shout = {"shout": lambda body, value, title, additions, rules: body.upper() + value}
    filters = [{"prepend": None, "append": None, "redact": None, "shout": "!"}, {"prepend": "A", "append": None, "redact": None}]
    assert X.filtered("x", "T", filters, {"A": "a"}, {}, shout) == "a\n\nX!"
    assert X.filtered("x", "T", filters, {"A": "a"}, {}) == "a\n\nx"


def test_record_issues(spark):
    rows = spark.createDataFrame([("g", "a", ("A", "a", 1)), ("g", "", ("B", "", None)), ("g", "n", (None, "n", None))], "graph string, slug string, data struct<title:string,slug:string,tier:int>")
    got = {(r["slug"], r["field"], r["message"]) for r in projection.record_issues(rows).collect()}
    assert got == {("a", "tier", "must be string"), ("", "slug", "is required"), ("n", "title", "is required")}
    bare = spark.createDataFrame([("g", "a", ("A",))], "graph string, slug string, data struct<title:string>")
    assert [r["field"] for r in projection.record_issues(bare).collect()] == ["slug"]
