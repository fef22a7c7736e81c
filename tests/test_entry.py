import importlib
import sys

import __spark_entry__ as entry
from docloom.plans import registry


def test_queries_and_sql_go_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"markdown_inventory", "logistic_regression"}


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_rest_imports_without_the_optional_parts(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("docloom.llm") or m == "corpus_pipeline"]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("docloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name.split(".queries")[0])

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(registry.queries())
