"""The entry module with and without the operators for training text."""

from __future__ import annotations

import importlib
import sys

import pytest

from harborlane.plans import catalog


@pytest.fixture
def fresh():
    import __spark_entry__

    yield lambda: importlib.reload(__spark_entry__)
    importlib.reload(__spark_entry__)


@pytest.mark.parametrize("absent", ["corpus_pipeline", "harborlane.llm", "public_tokenizers"])
def test_the_rest_is_registered_without_them(fresh, monkeypatch, absent):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("harborlane.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    found = fresh()
    assert set(found.queries()) == set(catalog.queries())
    assert set(found.oracle_sql()) == set(catalog.oracle_sql())
