"""Every registered query with SQL equals its DuckDB twin (sf0.001); the rest run."""

import pytest

from logsift.plans.catalog import _entries

from conftest import SF_SMALL
from oracle import compare, duck

ENTRIES = _entries()
WITH_SQL = [n for n, (_, sql) in ENTRIES.items() if sql]
ROWS_ONLY = [n for n, (_, sql) in ENTRIES.items() if not sql]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_duckdb(spark, con, name):
    fn, sql = ENTRIES[name]
    n, problems = compare(spark, name, fn, sql, SF_SMALL, con)
    assert not problems, problems
    assert n > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert ENTRIES[name][0](spark, SF_SMALL).count() > 0


def test_entry(spark):
    import importlib.util
    import os
    p = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", p)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert df.columns == mod.entry(spark).columns
    assert set(mod.oracle_sql()) <= set(mod.queries())
