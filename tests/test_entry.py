"""The registry: its names, and what is left of it without the corpus subpackage."""

import importlib.util

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_subpackage(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("datagauge.llm") else found(name, *a))
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert {"duplicate_clusters", "audit_priority"} <= set(names) and set(entry.oracle_sql()) <= set(names)
