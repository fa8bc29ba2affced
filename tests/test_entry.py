"""The driver's contract, and that the log library needs none of the training-text operators."""

from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_go_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    logs = set(entry.logs.queries())
    assert logs == set(entry.logs.oracle_sql()) and len(logs) >= 45


def test_nothing_else_imports_the_training_text_operators():
    for path in [*(ROOT / "dirlog").rglob("*.py"), ROOT / "bench.py"]:
        if (ROOT / "dirlog/llm") in path.parents:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("dirlog.llm") or n == "corpus_pipeline" for n in names), path


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["account", "ops", "etime_total", "etime_avg", "share"] and df.count() == 15
