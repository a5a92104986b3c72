"""Every query of the library against its SQL on the smallest tables; the others give rows of a stable schema."""

import pytest
from oracle import connect, rows_of, sql_rows

from plumbago.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    got = rows_of(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == sql_rows(con, ORACLE_SQL[name])
    else:
        assert got[1]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
