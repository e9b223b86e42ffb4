"""The star in a database that runs inside the session's virtual machine."""

import random

import pytest

from chronolake.operators.series import bucket_average
from chronolake.sources import star

URL = "jdbc:derby:memory:star"


@pytest.fixture(scope="module")
def database(spark):
    rnd = random.Random(3)
    try:
        connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(URL + ";create=true")
    except Exception as e:
        pytest.skip(f"no embedded database: {e}")
    run = connection.createStatement()
    for sql in (
        "CREATE TABLE channels (id INT, channel_name VARCHAR(20), unit VARCHAR(9))", "CREATE TABLE test_runs (id BIGINT, run_code VARCHAR(20))",
        "CREATE TABLE sensor_readings (test_run_id BIGINT, channel_id INT, time TIMESTAMP, value DOUBLE)",
        "INSERT INTO channels VALUES (1, 'THRUST', 'N'), (2, 'it''s', 'bar')", "INSERT INTO test_runs VALUES (7, 'r7'), (8, 'r8'), (9, 'none')",
    ):
        run.execute(sql)
    for _ in range(300):
        second = rnd.randint(0, 7200)
        run.execute(f"INSERT INTO sensor_readings VALUES ({rnd.choice([7, 8])}, {rnd.choice([1, 2])}, {{ts '2024-01-01 {second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}'}}, {rnd.randint(0, 50) / 2})")
    return {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def rows(df):
    return sorted((r.test_run_id, r.test_run_code, r.channel_name, r.unit, r.x_ms, round(r.y, 9)) for r in df.collect())


def test_buckets_are_made_by_the_database(spark, database):
    whole = star.star_series(*(t.toDF(*[c.lower() for c in t.columns]) for t in star.jdbc_tables(spark, URL, database)))
    span = star.jdbc_span(spark, URL, database)
    assert span == tuple(whole.selectExpr("min(x_ms)", "max(x_ms)").first())
    got = star.jdbc_buckets(spark, URL, database, 300_000.0, span, slices=4)
    assert rows(got) == rows(bucket_average(whole, 300_000.0)) and got.rdd.getNumPartitions() == 4
    assert "GROUP BY" in got._jdf.queryExecution().toString() and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    one = star.jdbc_buckets(spark, URL, database, 60_000.0, star.jdbc_span(spark, URL, database, ["it's"], [8]), ["it's"], [8])
    assert rows(one) == rows(bucket_average(whole.where("channel_name = \"it's\" AND test_run_id = 8"), 60_000.0)) and one.count() > 20
    assert star.jdbc_span(spark, URL, database, ["none"]) is None
