"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from tests.comparing import duck, duck_rows, spark_rows
from tidelog.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    assert name in ORACLES
    assert got == duck_rows(con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
