"""Every registered query with a DuckDB twin returns the same rows."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare

from conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    ok, msg = compare(sdf.collect(), sdf.columns, duck.execute(ORACLES[name]).df())
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["feature", "category", "target_class", "count"]
