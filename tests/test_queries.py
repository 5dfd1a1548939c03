"""Every query against its SQL on the smallest tables, and the contract of the entry module."""

import importlib.util
import pathlib

import pytest
from compare import connect, differences
from paths import SMALL

ROOT = pathlib.Path(__file__).resolve().parents[1]
spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_module)

# Operators for training data have tests of their own.
QUERIES = {name: q for name, q in entry_module.queries().items() if not name.startswith(("op", "pipeline"))}
SQL = {name: sql for name, sql in entry_module.oracle_sql().items() if name in QUERIES}
WITHOUT_SQL = {"lookback_linear_forecast"}


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, SMALL), connection, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_forecast_shape(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) == 5 * 7
    assert all(row["forecast"] is not None for row in rows)


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns[:2] == ["Date", "Ticker"]
    assert frame.count() > 0
