import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    for path in (ROOT / "foliograph").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("foliograph.llm") for n in names), path
