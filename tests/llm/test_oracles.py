"""Queries of the subpackage against their SQL on the smallest tables."""

import sys

import pytest

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
from oracle import connect, rows_of, sql_rows  # noqa: E402

from plumbago.llm import entries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query(name, spark):
    assert rows_of(entries.QUERIES[name](spark, SF)) == sql_rows(connect(SF), entries.ORACLE_SQL[name])
