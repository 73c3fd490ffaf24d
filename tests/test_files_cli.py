import json
import os

import pytest

from foliograph import cli, sinks
from foliograph.sources import files
from foliograph.streaming import file_stream, merge_by_key, page_stream, run_batches
from pyspark.sql import functions as F


@pytest.fixture
def graph(tmp_path):
    pages = tmp_path / "g" / "pages"
    (pages / "sub").mkdir(parents=True)
    (tmp_path / "g" / "assets").mkdir()
    (tmp_path / "g" / "assets" / "i.png").write_bytes(b"x")
    (pages / "A___B.md").write_text("type:: note\n\nsee [[C]] ![i](../assets/i.png) ![j](../assets/j.png)")
    (pages / "C.MD").write_text("c")
    (pages / "D.md").write_text("verified:: [[2001-01-01]]")
    (pages / "sub" / "E.md").write_text("e")
    (pages / "notes.txt").write_text("no")
    return tmp_path


def document(path, content):
    path.write_text(json.dumps(content))
    return str(path)


def test_read_pages(spark, graph):
    rows = {r["file"]: r["title"] for r in files.read_pages(spark, str(graph / "g")).collect()}
    assert rows == {"A___B.md": "A/B", "C.MD": "C", "D.md": "D", "sub/E.md": "sub/E"}
    assert files.list_pages(spark, str(graph / "g")).count() == 3
    assert files.read_pages(spark, str(graph / "none")).count() == 0
    assert [r["asset"] for r in files.read_assets(spark, str(graph / "g")).collect()] == ["i.png"]
    assert files.read_assets(spark, str(graph / "none")).count() == 0
    assert files.read_cache(spark, "g", str(graph / "none")).count() == 0
    assert [r["title"] for r in files.seed_list(spark, "g", " A ; ;B").orderBy("seed_order").collect()] == ["A", "B"]


def test_page_list(spark, graph):
    path = document(graph / "pages.json", [{"title": "A"}, {"title": "B", "group": "x", "tier": "t"}])
    rows = files.page_list(files.read_documents(spark, path)).orderBy("ord").collect()
    assert [(r["title"], r["group"], r["tier"]) for r in rows] == [("A", "default", "projected"), ("B", "x", "t")]


def test_commands(spark, graph, capsys):
    g = str(graph / "g")
    good = document(graph / "m.json", {"graphPath": g, "entries": [{"title": "A/B", "tier": "seed"}]})
    bad = document(graph / "bad.json", {"graphPath": g, "entries": [{"title": "Nope", "tier": "seed"}, {"title": "D", "tier": "odd"}]})
    assert cli.main(["validate", good]) == 0
    assert cli.main(["validate", bad]) == 1
    stale = document(graph / "s.json", {"graphPath": g, "entries": [{"title": "D", "tier": "seed"}]})
    assert cli.main(["audit", stale, "--no-candidates"]) == 1
    assert cli.main(["audit", stale, "--no-candidates", "--no-stale-verified"]) == 0
    assert cli.main(["place", good, "--candidate", "C", "--json"]) == 0
    edit = document(graph / "p.json", {"operations": [{"op": "set", "title": "A/B", "field": "exclude", "value": True, "rationale": "r"}]})
    assert cli.main(["preview", good, edit]) == 0
    assert cli.main(["apply", good, edit, "--dry-run"]) == 0 and "exclude" not in open(good).read()
    assert cli.main(["apply", good, edit, "--log", str(graph / "log")]) == 0 and json.load(open(good))["entries"][0]["exclude"] is True
    assert spark.read.parquet(str(graph / "log")).count() == 1
    assert cli.main(["apply", good, document(graph / "q.json", {"operations": [{"op": "remove", "title": "Z", "rationale": "r"}]})]) == 1
    assert cli.main(["apply", good, document(graph / "r.json", {"operations": {"op": "remove"}})]) == 2
    assert cli.main(["project", "--graph", g]) == 2


def test_project_and_reconcile(spark, graph, capsys):
    g, vault = str(graph / "g"), str(graph / "vault")
    assert cli.main(["project", "--graph", g, "--vault", vault, "--seeds", "A/B"]) == 0 and not os.path.exists(vault)
    assert cli.main(["project", "--graph", g, "--vault", vault, "--seeds", "A/B", "--moc", "Map", "--apply"]) == 0
    assert {"A-B.md", "Map.md", "assets"} <= set(os.listdir(vault)) and os.listdir(f"{vault}/assets") == ["i.png"]
    assert "j.png" in capsys.readouterr().out
    want, page = graph / "want.md", graph / "page.md"
    want.write_text('# A\n<!-- projected: source="S#a" -->\ntext')
    page.write_text("# Mine\nx")
    run = ["reconcile", "--desired", str(want), "--page", str(page)]
    assert cli.main([*run, "--plan"]) == 0 and page.read_text() == "# Mine\nx"
    assert cli.main(run) == 0 and "text" in page.read_text() and cli.main([*run, "--check"]) == 0
    page.write_text(page.read_text().replace("text", "edited"))
    assert cli.main([*run, "--check"]) == 1
    batch = ["reconcile", "--all", "--manifest", document(graph / "all.json", {"graphPath": g, "entries": [{"title": "A/B", "tier": "seed"}, {"title": "Lost", "tier": "seed"}]})]
    assert cli.main(batch) == 2
    assert cli.main([*batch, "--out-dir", str(graph / "all"), "--plan"]) == 1 and os.listdir(graph / "all") == []
    assert cli.main([*batch, "--out-dir", str(graph / "all")]) == 1 and sorted(os.listdir(graph / "all")) == ["ab.md", "ab.md.reconcile.json"]
    source = graph / "Src.md"
    source.write_text("citation-recall:: 0.2\n\n- ## One\n  - text")
    single = ["reconcile", "--source", str(source), "--page", str(graph / "one.md")]
    assert cli.main([*single, "--faithfulness-min", "0.5"]) == 3 and cli.main(single) == 0 and "Src#one" in (graph / "one.md").read_text()


def test_sinks(spark, graph):
    rows = spark.createDataFrame([("a.md", "x"), ("b.md", None)], "vault_file string, text string")
    target = str(graph / "out")
    assert sinks.write_texts(rows, target) == 1 and not os.path.exists(target)
    assert sinks.write_texts(rows, target, apply=True) == 1 and os.listdir(target) == ["a.md"]
    sinks.write_records(rows, str(graph / "store"))
    assert spark.read.parquet(str(graph / "store")).count() == 2
    assert sinks.report_json(rows.limit(1)).first()["value"] == '{"vault_file":"a.md","text":"x"}'


def test_streams(spark, graph):
    box, table = str(graph / "box"), str(graph / "table")
    rows = [(1, "old", 1), (1, "new", 2), (2, "x", 1)]
    spark.createDataFrame(rows, "page_id long, raw_content string, n int").write.parquet(box)
    stream = page_stream(spark, box, "page_id long, raw_content string, n int")
    run_batches(stream, lambda df, n: merge_by_key(df.sparkSession, df, table, ["page_id"], "n", n), str(graph / "cp")).awaitTermination()
    spark.createDataFrame([(2, "y", 5)], "page_id long, raw_content string, n int").write.mode("append").parquet(box)
    run_batches(stream, lambda df, n: merge_by_key(df.sparkSession, df, table, ["page_id"], "n", n), str(graph / "cp")).awaitTermination()
    got = {r["page_id"]: r["raw_content"] for r in spark.read.parquet(f"{table}/v1").collect()}
    assert got == {1: "new", 2: "y"}
    seen = []
    run_batches(file_stream(spark, str(graph / "g" / "pages")), lambda df, n: seen.extend(r["path"] for r in df.select(F.element_at(F.split("path", "/"), -1).alias("path")).collect()), str(graph / "cp2")).awaitTermination()
    assert {"A___B.md", "C.MD", "D.md"} <= set(seen)
