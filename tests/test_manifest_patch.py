import json

import pytest

from foliograph.operators import manifest, patch

OK = {"title": "A", "tier": "seed"}


def found(spark, document):
    text = document if isinstance(document, str) else json.dumps(document)
    rows = manifest.issues(spark.createDataFrame([("m", text)], "manifest string, json string")).collect()
    return sorted((r["path"], r["severity"]) for r in rows)


def with_entry(**kw):
    return {"graphPath": "/g", "entries": [OK | kw]}


def with_filter(f):
    return with_entry(filters=[f])


@pytest.mark.parametrize(
    "document, expected",
    [
        ({"graphPath": "/g", "entries": [OK]}, []),
        ('"text"', [("$", "error")]),
        ("{bad", [("$", "error")]),
        ({"entries": []}, [("$.graphPath", "error")]),
        ({"graphPath": "/g"}, [("$.entries", "error")]),
        ({"graphPath": "/g", "entries": "oops"}, [("$.entries", "error")]),
        ({"graphPath": "/g", "entries": [], "x": 1, "generatedAt": 5}, [("$.generatedAt", "warning"), ("$.x", "warning")]),
        ({"graphPath": "/g", "entries": [7]}, [("$.entries[0]", "error")]),
        (with_entry(title=""), [("$.entries[0].title", "error")]),
        (with_entry(tier="foo"), [("$.entries[0].tier", "error")]),
        (with_entry(redact="heavy"), [("$.entries[0].redact", "error")]),
        (with_entry(exclude="yes"), [("$.entries[0].exclude", "error")]),
        (with_entry(backlinks=["ok", 42, 43]), [("$.entries[0].backlinks[1]", "error")]),
        (with_entry(backlinks="x"), [("$.entries[0].backlinks", "error")]),
        (with_entry(file=3), [("$.entries[0].file", "error")]),
        (with_entry(zz=1), [("$.entries[0].zz", "warning")]),
        (with_entry(filters={}), [("$.entries[0].filters", "error")]),
        (with_filter(5), [("$.entries[0].filters[0]", "error")]),
        (with_filter({"prepend": "a", "append": "b"}), [("$.entries[0].filters[0]", "error")]),
        (with_filter({}), [("$.entries[0].filters[0]", "error")]),
        (with_filter({"summarize": "x"}), [("$.entries[0].filters[0]", "error")]),
        (with_filter({"prepend": 123}), [("$.entries[0].filters[0].prepend", "error")]),
        (with_filter({"prepend": ""}), [("$.entries[0].filters[0].prepend", "error")]),
        (with_filter({"redact": ""}), [("$.entries[0].filters[0].redact", "error")]),
        (with_filter({"redact": "host-defined"}), []),
        (with_entry(redact="light", filters=[{"redact": "x"}]), [("$.entries[0].redact", "error")]),
        ({"graphPath": "/g", "entries": [OK, OK, {"title": "B", "tier": "seed"}]}, [("$.entries", "error")]),
    ],
)
def test_rules(spark, document, expected):
    assert found(spark, document) == expected


def test_valid_entries_keep_duplicates_and_drop_the_rest(spark):
    doc = {"graphPath": "/g", "entries": [OK, {"title": "", "tier": "seed"}, OK | {"filters": [{"append": "B"}]}]}
    rows = manifest.valid_entries(spark.createDataFrame([("m", json.dumps(doc))], "manifest string, json string")).orderBy("entry_index").collect()
    assert [(r["entry_index"], r["raw_index"], r["title"]) for r in rows] == [(0, 0, "A"), (1, 2, "A")]
    assert rows[1]["filters"][0]["append"] == "B"


BASE = [
    {"title": "Alpha", "tier": "seed"},
    {"title": "Beta", "tier": "1-hop", "backlinks": ["Alpha"]},
    {"title": "Gamma", "tier": "1-hop", "backlinks": ["Alpha", "Beta"]},
]


def patched(spark, *ops):
    entries = spark.createDataFrame([("m", i, e["title"], json.dumps(e)) for i, e in enumerate(BASE)], "manifest string, entry_index int, title string, entry string")
    rows = []
    for i, o in enumerate(ops):
        entry = o.get("entry")
        rows.append(("m", i, o["op"], o.get("title") or (entry or {}).get("title"), o.get("field"), json.dumps(o["value"]) if "value" in o else None, json.dumps(entry) if entry else None, o.get("rationale", "why")))
    schema = "manifest string, op_index int, op string, title string, field string, value string, entry string, rationale string"
    return patch.apply_patch(entries, spark.createDataFrame(rows, schema))


def titles(result):
    return [r["title"] for r in patch.patched_entries(result).orderBy("entry_index").collect()]


def test_remove_then_add(spark):
    result = patched(spark, {"op": "remove", "title": "Beta"}, {"op": "add", "entry": {"title": "Beta", "tier": "2-hop"}})
    assert titles(result) == ["Alpha", "Gamma", "Beta"]
    assert result.filter("what = 'error'").count() == 0


def test_a_failed_edit_does_not_stop_the_next(spark):
    result = patched(spark, {"op": "add", "entry": {"title": "Alpha", "tier": "seed"}}, {"op": "set", "title": "Beta", "field": "exclude", "value": True})
    assert [r["op_index"] for r in result.filter("what = 'error'").collect()] == [0]
    change = result.filter("what = 'change'").first()
    assert json.loads(change["after"])["exclude"] is True and "exclude" not in json.loads(change["before"])


@pytest.mark.parametrize(
    "op",
    [
        {"op": "set", "title": "Alpha", "field": "title", "value": "X"},
        {"op": "unset", "title": "Alpha", "field": "tier"},
        {"op": "remove", "title": "Alpha", "rationale": "  "},
        {"op": "remove", "title": "Nobody"},
        {"op": "set", "title": "Alpha", "field": "", "value": 1},
        {"op": "add", "entry": {"tier": "seed"}},
        {"op": "rename", "title": "Alpha"},
    ],
)
def test_refused(spark, op):
    result = patched(spark, op)
    assert result.filter("what = 'error'").count() == 1 and titles(result) == ["Alpha", "Beta", "Gamma"]


def test_affected(spark):
    got = {(r["title"], r["direct"]) for r in patch.affected_entries(patched(spark, {"op": "set", "title": "Alpha", "field": "exclude", "value": True})).collect()}
    assert got == {("Alpha", True), ("Beta", False), ("Gamma", False)}
    removed = patched(spark, {"op": "remove", "title": "Alpha"})
    assert {r["title"] for r in patch.affected_entries(removed).collect()} == {"Beta", "Gamma"}
    assert "0 entries changed, 2 more" in patch.preview_markdown(removed).first()["markdown"]
    assert patch.rationale_log(removed, 5).first()["key"] == "manifest-edit-remove-alpha-5"
