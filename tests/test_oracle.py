"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tessera import catalog
from conftest import SMALL
from oracle import compare, duck

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    rows_only = set(catalog.queries()) - set(catalog.oracle_sql())

    assert not rows_only


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, name, SMALL, con)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 100 and set(df.columns) == {"i", "j", "v"}
