from datetime import datetime

from foliograph.operators import orphans

META = "page_id long, graph_path string, wikilinks array<string>, read_at timestamp, loaded_at timestamp, ref string, kind string"
PAGES = "page_id long, graph_path string, title string, file string, created_at timestamp, deleted_at timestamp, loaded_at timestamp, raw_content string, name string"
ENTRIES = "entry_id long, graph_path string, title string, file string, filters array<struct<prepend:string,append:string,redact:string>>, generated_at timestamp, loaded_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def tables(spark):
    pages = [
        (1, "g", "A", "A.md", day(1), None, day(1), None, "x"),
        (1, "g", "A", "A.md", day(1), None, day(1), None, "x"),
        (2, "g", "Gone", "Gone.md", day(1), None, day(1), None, "x"),
        (2, "g", "Gone", "Gone.md", day(1), day(5), day(6), None, "x"),
        (3, "g", "Late", "Late.md", day(20), None, day(20), None, "x"),
        (4, "h", "Other", "Other.md", day(1), None, day(1), None, "x"),
        (5, "g", "Again", "x.md", day(1), day(3), day(4), None, "x"),
        (6, "g", "Again", "y.md", day(8), None, day(8), None, "x"),
        (7, "g", None, None, None, None, None, None, None),
    ]
    meta = [
        (1, "g", ["Gone", "Late", "Other", "Again", "A", "2024-01-01", "", None, "Gone"], day(10), day(10), "r", "k"),
        (1, "g", ["Gone", "Late", "Other", "Again", "A", "2024-01-01", "", None, "Gone"], day(10), day(11), "r", "k"),
        (2, "g", None, day(10), day(10), "r", "k"),
        (3, "g", ["A"], day(10), day(10), "r", "k"),
        (4, None, ["A"], day(10), day(10), "r", "k"),
        (6, "g", ["Late"], None, day(10), "r", "k"),
        (None, "g", ["Nope"], day(10), day(10), "r", "k"),
    ]
    entries = [
        (1, "g", "A", None, [("Gone", None, None), (None, "Nope", None), (None, None, "x")], day(10), day(10)),
        (2, "g", "Whatever", "A.md", None, day(10), day(10)),
        (3, "g", "A", "none.md", [], day(10), day(10)),
        (4, "g", "Again", None, None, day(2), None),
        (5, "g", "Again", "", None, day(6), day(10)),
    ]
    return spark.createDataFrame(meta, META), spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(pages, PAGES)


def every(meta, entries):
    return orphans.page_references(meta).unionByName(orphans.entry_references(entries))


def test_direct(spark):
    meta, entries, pages = tables(spark)
    got = [tuple(r) for r in orphans.direct_orphans(every(meta, entries), orphans.page_targets(pages)).select("src_table", "record_id", "field", "ref", "state").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        ("page_metadata", 1, "wikilinks", "Gone", "deleted"),
        ("page_metadata", 1, "wikilinks", "Late", "late"),
        ("page_metadata", 1, "wikilinks", "Other", "missing"),
        ("page_metadata", 4, "wikilinks", "A", "missing"),
        ("page_metadata", 6, "wikilinks", "Late", "late"),
        ("publish_entries", 1, "filters", "Gone", "deleted"),
        ("publish_entries", 1, "filters", "Nope", "missing"),
        ("publish_entries", 3, "file", "none.md", "missing"),
        ("publish_entries", 5, "title", "Again", "deleted"),
    }


def test_cascade(spark):
    meta, entries, pages = tables(spark)
    got = {tuple(r) for r in orphans.orphan_cascade(every(meta, entries), orphans.page_targets(pages)).collect()}
    # Page 1 is a direct orphan; page 3 and the entries that name page 1 inherit from it.
    assert {("page_metadata", 1, "direct", 0), ("page_metadata", 3, "inherited", 1), ("publish_entries", 2, "inherited", 1)} <= got
    assert len(got) == len({x[:2] for x in got})


def test_cascade_follows_long_chains(spark):
    day, long = datetime(2024, 1, 1), 67
    rows = [("page_metadata", i, "g", "wikilinks", "title", f"P{i + 1}", day) for i in range(long)]
    references = spark.createDataFrame(rows, "src_table string, record_id long, scope string, field string, kind string, ref string, at timestamp")
    targets = spark.createDataFrame([(i, "g", "title", f"P{i}", day, None) for i in range(long)], "page_id long, scope string, kind string, name string, created_at timestamp, deleted_at timestamp")
    got = {r["record_id"]: r["round"] for r in orphans.orphan_cascade(references, targets).collect()}
    assert got == {i: long - 1 - i for i in range(long)}


def test_totals(spark):
    meta, entries, pages = tables(spark)
    rows = orphans.orphan_totals(orphans.direct_orphans(every(meta, entries), orphans.page_targets(pages))).collect()
    assert {(r["src_table"], r["month"], r["state"]): r["refs"] for r in rows}[("publish_entries", "2024-01", "missing")] == 2


def test_empty_tables(spark):
    meta, entries, pages = tables(spark)
    nothing = every(meta.limit(0), entries.limit(0))
    assert orphans.direct_orphans(nothing, orphans.page_targets(pages)).count() == 0
    assert orphans.orphan_cascade(nothing, orphans.page_targets(pages.limit(0))).count() == 0
    all_missing = orphans.direct_orphans(every(meta, entries), orphans.page_targets(pages.limit(0)))
    assert {r["state"] for r in all_missing.collect()} == {"missing"}
