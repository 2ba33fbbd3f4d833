"""Every query with SQL gives the SQL's rows."""

import pytest

import oracle
from cloakline.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose right answer is no rows.
EMPTY = {"placeholder_collisions"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    sql = catalogue.oracle_sql()[name]
    assert oracle.compare(spark, con, name, catalogue.queries()[name], sql, SF) is None
    assert con.execute(f"SELECT count(*) FROM ({sql})").fetchall()[0][0] > 0 or name in EMPTY


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() == 200
