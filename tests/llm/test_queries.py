"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from chronolake.llm import queries

from ..test_entry import SF, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    names, want = rows_of_sql(entry.oracle_sql()[name])
    assert columns == names and sorted((list(r) for r in df.select(*columns).collect()), key=str) == want


def test_all_are_registered():
    found = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in entry.queries()
