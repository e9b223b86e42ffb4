"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronolake import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def rows_of_sql(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([_plain(r[i]) for i in order] for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([_plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    assert rows or name == "result_upsert"
    if name in entry.oracle_sql():
        names, want = rows_of_sql(entry.oracle_sql()[name])
        assert columns == names and rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
