from datetime import datetime, timezone

import pandas as pd
import pytest

from foliograph.operators import drift, placement, subgraph
from foliograph.operators import pages as P
from foliograph.plans import pages as queries

PAGES = "graph string, title string, file string, content string"
ENTRIES = "graph string, entry_index int, title string, tier string, exclude boolean, redact string, file string, filters array<struct<prepend:string,append:string,redact:string>>"


def pages_of(spark, texts):
    return spark.createDataFrame([("g", t, f"{t}.md", c) for t, c in texts.items()], PAGES)


def entries_of(spark, *rows):
    full = [("g", i, *(r if isinstance(r, tuple) else (r, {}))) for i, r in enumerate(rows)]
    return spark.createDataFrame([(g, i, t, "seed", kw.get("exclude"), kw.get("redact"), kw.get("file"), kw.get("filters")) for g, i, t, kw in full], ENTRIES)


def pre(x):
    return (x, None, None)


def app(x):
    return (None, x, None)


@pytest.fixture(scope="module")
def graph(spark):
    return pages_of(
        spark,
        {
            "Seed": "title:: Seed\nrelated:: [[Near]]\n\n- links [[Near]] and [[Hub]] and [[Ghost]] [[2024-01-01]]",
            "Near": "title:: Near\n\n- back to [[Seed]], out to [[Far]]",
            "Far": "title:: Far\n\n- terminal",
            "Hub": "\n".join(f"- [[H{i}]]" for i in range(50)),
        },
    )


def seeds(spark, *titles):
    return spark.createDataFrame([("g", t, i) for i, t in enumerate(titles)], "graph string, title string, seed_order int")


def test_outlinks(spark):
    rows = P.outlinks(pages_of(spark, {"Me": "title:: Me\nrelated:: [[A]] [[B]]\n\n- body links [[B]] and [[C]] and [[Me]]"})).collect()
    assert {(r["dst"], r["weight"]) for r in rows} == {("A", 2), ("B", 2), ("C", 1)}


def test_subgraph(spark, graph):
    edges = P.outlinks(graph)
    got = subgraph.select_subgraph(edges, graph, seeds(spark, "Seed"))
    assert {(r["title"], r["hop"], r["score"]) for r in got.collect()} == {("Seed", 0, float("inf")), ("Near", 1, 2.0), ("Far", 2, 1.0)}
    around = {r["title"]: (r["exists"], r["referenced_by"]) for r in subgraph.boundary(edges, graph, got).collect()}
    assert around == {"Ghost": (False, ["Seed"]), "Hub": (True, ["Seed"])}


def test_subgraph_caps_and_ties(spark, graph):
    edges = P.outlinks(graph)
    assert subgraph.select_subgraph(edges, graph, seeds(spark, "Seed"), max_pages=2).count() == 2
    assert subgraph.select_subgraph(edges, graph, seeds(spark, "Nobody")).count() == 0
    tie = pages_of(spark, {"S": "- [[B]] [[A]] [[C]]", "A": "", "B": "", "C": ""})
    got = subgraph.select_subgraph(P.outlinks(tie), tie, seeds(spark, "S"), max_pages=3)
    assert {r["title"] for r in got.collect()} == {"S", "B", "A"}
    twice = subgraph.select_subgraph(P.outlinks(tie), tie, seeds(spark, "S", "S"))
    assert {r["score"] for r in twice.filter("hop = 1").collect()} == {2.0}
    assert subgraph.select_subgraph(P.outlinks(tie.limit(0)), tie.limit(0), seeds(spark, "S")).count() == 0


def test_queries_take_every_seed(spark, tmp_path):
    day = datetime(2024, 1, 1)
    text = {f"S{i}": f"- [[T{i}]] [[Both]]" for i in range(30)} | {f"T{i}": "" for i in range(30)} | {"Both": ""}
    rows = [(i, "g", t, f"{t}.md", c, day, None, day) for i, (t, c) in enumerate(text.items())]
    kinds = "page_id long, graph_path string, title string, file string, raw_content string, created_at timestamp, deleted_at timestamp, loaded_at timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "graph_pages.parquet"))
    named = [f"S{i}" for i in range(30)] + ["S3"]
    entries = [(i, "g", i, t, "seed", None, False, None, None, None, day) for i, t in enumerate(named)] + [(99, "g", 31, "T5", "leaf", None, False, None, None, None, day)]
    kinds = "entry_id long, graph_path string, entry_index int, title string, tier string, backlinks array<string>, exclude boolean, redact string, file string, filters array<struct<prepend:string,append:string,redact:string>>, loaded_at timestamp"
    spark.createDataFrame(entries, kinds).write.parquet(str(tmp_path / "publish_entries.parquet"))
    orders = sorted((r["title"], r["seed_order"]) for r in queries._seeds(spark, str(tmp_path)).collect())
    assert orders == sorted((t, i) for i, t in enumerate(named))
    assert {r["title"] for r in queries.r_subgraph(spark, str(tmp_path)).collect()} == set(named)
    around = {r["title"]: r["refs"] for r in queries.r_boundary(spark, str(tmp_path)).collect()}
    assert around == {f"T{i}": 1 for i in range(30)} | {"Both": 30}


def test_resolve(spark):
    pages = spark.createDataFrame([("g", "A/B", "A___B.md", ""), ("g", "Q?", "Q%3F.md", ""), ("g", "X", "X.md", "")], PAGES)
    wanted = spark.createDataFrame([("g", "A/B", None), ("g", "Q?", None), ("g", "X", "no.md"), ("g", "Y", "X.md"), ("h", "X", None), ("g", "X", None), ("g", "X", None)], "graph string, title string, file string")
    got = P.resolve(wanted, pages).collect()
    assert len(got) == 7
    assert {(r["graph"], r["title"], r["file"], r["page_file"]) for r in got} == {
        ("g", "A/B", None, "A___B.md"), ("g", "Q?", None, "Q%3F.md"), ("g", "X", "no.md", None), ("g", "Y", "X.md", "X.md"), ("h", "X", None, None), ("g", "X", None, "X.md"),
    }


def test_alive_pages_uses_the_last_delivery(spark):
    rows = [
        (1, "g", "T", "T.md", "old", datetime(2024, 1, 1), None, datetime(2024, 1, 1), "x"),
        (1, "g", "T", "T.md", "old", datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1), "x"),
        (2, "g", "T", "T.md", None, datetime(2024, 4, 1), None, datetime(2024, 5, 1), "x"),
    ]
    raw = spark.createDataFrame(rows, "page_id long, graph_path string, title string, file string, raw_content string, created_at timestamp, deleted_at timestamp, loaded_at timestamp, graph string")
    got = P.alive_pages(raw).collect()
    assert [(r["title"], r["page_id"], r["content"]) for r in got] == [("T", 2, "")]
    assert P.alive_pages(raw.limit(0)).count() == 0


def test_drift_kinds(spark):
    pages = pages_of(spark, {"Alpha": "[[Beta]] [[Gamma]]", "Beta": "", "Gamma": "", "Old": "- about §6.2\n  verified:: [[2025-01-01]]"})
    entries = entries_of(
        spark,
        "Alpha",
        "Lost",
        ("Old", {}),
        ("P", {"filters": [pre("Alpha"), app("Nobody"), app("Hidden"), app("P")]}),
        ("Hidden", {"exclude": True}),
        ("R", {"redact": "light", "filters": [(None, None, "odd")]}),
    )
    near = subgraph.neighbours(pages, entries, 1)
    found = drift.audit(entries, pages, near, datetime(2026, 5, 1, tzinfo=timezone.utc), known_modes=["none"])
    ids = {r["id"] for r in found.collect()}
    assert {"source-missing:Lost", "filter-self-reference:P#3", "filter-reference-broken:P#1:Nobody", "filter-reference-broken:P#2:Hidden"} <= ids
    assert {"filter-redact-conflict:R", "filter-redact-mode-unknown:R#0:odd", "candidate-page:Beta", "candidate-page:Gamma"} <= ids
    stale = [r for r in found.collect() if r["kind"] == "block-stale-verified"]
    assert len(stale) == 1 and "§6.2" in stale[0]["detail"] and int(stale[0]["detail"].split()[0]) > 180
    assert drift.exit_code(found) == 2
    first = drift.ranked(found).orderBy("place").first()
    assert first["kind"] == "source-missing"
    assert drift.severity_counts(found).first()["info"] == 2


def test_stale_limits(spark):
    pages = pages_of(spark, {"A": "verified:: [[2026-04-01]]\nverified:: 2020-99-01"})
    now = datetime(2026, 5, 1, tzinfo=timezone.utc)
    assert drift.stale_blocks(entries_of(spark, "A"), pages, now).count() == 0
    assert drift.stale_blocks(entries_of(spark, "A"), pages, now, 0).count() == 0
    assert drift.stale_blocks(entries_of(spark, ("A", {"exclude": True})), pages, now, 1).count() == 0


def test_candidates_are_cut_with_a_marker(spark):
    near = spark.createDataFrame([("g", f"C{i}", 1) for i in range(5)], "graph string, title string, hop int")
    ids = [r["id"] for r in drift.candidate_pages(near, 2).collect()]
    assert sorted(ids) == ["candidate-page:C0", "candidate-page:C1", "candidate-page:__truncation_marker__"]


def test_cycles(spark):
    mutual = drift.filter_cycles(entries_of(spark, ("A", {"filters": [app("B")]}), ("B", {"filters": [app("A")]})))
    assert [r["id"] for r in mutual.collect()] == ["filter-cycle:A->B"]
    chain = drift.filter_cycles(entries_of(spark, ("B", {"filters": [app("C")]}), ("C", {"filters": [pre("A")]}), ("A", {"filters": [app("B")]}), ("X", {"filters": [app("A")]})))
    assert [r["id"] for r in chain.collect()] == ["filter-cycle:A->B->C"]
    assert drift.filter_cycles(entries_of(spark, ("A", {"filters": [app("A"), app("Z")]}))).count() == 0


def test_cycle_search_reports_back_edges_only():
    refs = pd.DataFrame({"title": ["A", "B", "C", "B"], "ref": ["B", "C", "A", "A"]})
    assert drift._cycles(refs) == [["A", "B", "C"], ["A", "B"]]


META = "graph string, title string, category string, tags array<string>, wikilinks array<string>"


@pytest.mark.parametrize(
    "candidate, member, score",
    [
        (("s", [], []), ("s", [], []), 20),
        ((None, [], ["M", "N"]), ("s", [], []), 10),
        ((None, [], []), ("s", [], ["C"]), 6),
        ((None, ["a", "b"], []), ("s", ["a", "b"], []), 2),
        (("s", ["a", "b"], ["M"]), ("s", ["a", "b"], ["C"]), 20 + 5 + 6 + 2),
    ],
)
def test_placement_scores(spark, candidate, member, score):
    meta = spark.createDataFrame([("g", "C", *candidate), ("g", "M", *member), ("g", "N", *member)], META)
    got = placement.propose(spark.createDataFrame([("g", "C")], "graph string, title string"), entries_of(spark, "M", "N"), meta).collect()
    assert [(r["section"], r["score"]) for r in got] == [("s", score)]


def test_placement_ties_and_reasons(spark):
    meta = spark.createDataFrame([("g", "C", None, [], ["Z1", "A1"]), ("g", "Z1", "Zebra", [], []), ("g", "A1", "Apple", [], []), ("g", "D", "cat", [], []), ("g", "E", None, [], [])], META)
    wanted = spark.createDataFrame([("g", t) for t in "CDEF"], "graph string, title string")
    got = placement.propose(wanted, entries_of(spark, "Z1", "A1"), meta)
    assert [(r["section"], r["rank"]) for r in got.orderBy("rank").collect()] == [("Apple", 1), ("Zebra", 2)]
    left = {r["title"]: r["reason"] for r in placement.unplaced(wanted, meta, got).collect()}
    assert left == {"D": "category without overlap", "E": "no signal", "F": "no metadata"}
    text = {r["title"]: r["markdown"] for r in placement.proposal_markdown(got, placement.unplaced(wanted, meta, got)).collect()}
    assert "1. **Apple** (score 5)" in text["C"] and "Links to 1 page of" in text["C"] and "no signal" in text["E"]


def test_neighbours_are_found_by_file_names(spark):
    pages = spark.createDataFrame(
        [("g", "A/B", "A___B.md", "[[2024-01-01]] [[C: d]] [[Lost]] [[" + "x" * 250 + "]]"), ("g", "2024-01-01", "2024-01-01.md", ""), ("g", "other", "C%3A d.md", "[[E]]"), ("g", "E", "E.md", "")],
        "graph string, title string, file string, content string",
    )
    start = spark.createDataFrame([("g", "A/B")], "graph string, title string")
    near = subgraph.neighbours(pages, start, 2)
    assert {(r["title"], r["hop"]) for r in near.collect()} == {("2024-01-01", 1), ("C: d", 1), ("E", 2)}
    assert subgraph.neighbours(pages.limit(0), start, 1).count() == 0


def test_listed_orders(spark):
    chosen = spark.createDataFrame([("g", "b", 1, 2.0), ("g", "a", 1, 2.0), ("g", "_", 1, 2.0), ("g", "z", 0, 1.0), ("g", "c", 1, 3.0)], "graph string, title string, hop int, score double")
    assert [r["title"] for r in subgraph.ranked_pages(chosen).orderBy("place").collect()] == ["z", "c", "_", "a", "b"]
    edge = spark.createDataFrame([("g", "b", 1), ("g", "A", 1), ("g", "c", 5)], "graph string, title string, refs int")
    assert [r["title"] for r in subgraph.ranked_boundary(edge).orderBy("place").collect()] == ["c", "A", "b"]


def test_audit_reports_unknown_fields(spark):
    pages = pages_of(spark, {"Alpha": ""})
    raw = spark.createDataFrame([("g", 0, "Alpha", ["title", "tier", "colour"])], "graph string, entry_index int, title string, keys array<string>")
    found = drift.audit(entries_of(spark, "Alpha"), pages, None, datetime(2026, 5, 1, tzinfo=timezone.utc), raw_entries=raw).collect()
    assert [(r["id"], r["severity"]) for r in found] == [("unknown-field:Alpha#colour", "info")]
