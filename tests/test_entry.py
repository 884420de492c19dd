import importlib.util
import sys

import __spark_entry__ as E
from driftrank.plans import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"user_idx", "rank", "item_idx", "score", "source", "user_type", "reason"}


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.QUERIES) <= set(qs)


def test_entry_works_without_the_optional_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "driftrank.llm", None)
    spec = importlib.util.spec_from_file_location("entry_alone", E.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(catalog.QUERIES)
    assert set(alone.oracle_sql()) == set(catalog.SQL)
