import pytest

from logloom import catalog

from .sql_twins import connection, of_frame, of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"explained"}))  # test_signals explains whole logs
def test_query_against_sql(spark, con, name):
    got = of_frame(catalog.queries()[name](spark, SF))
    if name in catalog.oracle_sql():  # others are tested against values worked out by hand
        assert got == of_sql(con, catalog.oracle_sql()[name])
    else:
        assert got[1]


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 10
