"""Every registered query at the smallest scale, against DuckDB where it has SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF).toArrow()
    if name in ORACLE:
        assert differences(got, db.sql(ORACLE[name]).to_arrow_table()) == []
    else:
        assert got.num_columns > 0
