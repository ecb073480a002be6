"""The driver's entry points, with and without the training-data subpackage; registered queries have SQL of their columns."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"search_hybrid", "scenario_groups", "bm25_topk"} <= set(entry.oracle_sql())


def test_queries_without_the_training_data_subpackage(monkeypatch):
    """Deleting the folder and the pipeline's module leaves the rest importable."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.split(".")[:2] == ["citeloom", "llm"] or name == "corpus_pipeline":
                raise ModuleNotFoundError(name)

    real = importlib.util.find_spec
    gone = lambda name, package=None: None if name.startswith("citeloom.llm") or name == "corpus_pipeline" else real(name, package)
    monkeypatch.setattr(importlib.util, "find_spec", gone)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    for name in [m for m in sys.modules if m.startswith("citeloom") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    again = importlib.import_module("__spark_entry__")
    assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in again.queries())
    assert "search_hybrid" in again.queries() and set(again.oracle_sql()) <= set(again.queries())
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("citeloom.llm.common")
