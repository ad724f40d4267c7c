import importlib.util
import sys

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("tessera.llm", "corpus_pipeline")) else real(n, *a))
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert "j07_ivf_search" in entry.oracle_sql()
    assert "tessera.plans.catalogue" in sys.modules
