"""The entry without the training-data operators."""

from __future__ import annotations

import importlib
import sys

from codeprint.plans import catalogue


def test_entry_without_the_training_data_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it now raises
    try:
        entry = importlib.reload(__spark_entry__)
        assert entry.queries().keys() == catalogue.QUERIES.keys() and entry.oracle_sql().keys() == catalogue.ORACLES.keys()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
