import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from chronolake.functions.formula import CalculatedChannel
from chronolake.operators import series as ops
from chronolake.plans.query import SeriesRequest, run
from chronolake.schema import SERIES


def frame(spark, values, run=1, channel="A"):
    return spark.createDataFrame([(run, "r", channel, "u", float(k) * 1000, float(v)) for k, v in enumerate(values)], SERIES)


def triangles(ys, points):
    """The positions that largest triangles choose, read straight."""
    n = len(ys)
    if points <= 0 or points >= n:
        return list(range(n))
    out, width, a = [0], (n - 2) / (points - 2) if points > 2 else float(n), 0
    for i in range(points - 2):
        lo, hi, to = int(i * width) + 1, int((i + 1) * width) + 1, min(int((i + 2) * width) + 1, n)
        mx, my = sum(range(hi, to)) / (to - hi), sum(ys[hi:to]) / (to - hi)
        area = [abs((a - mx) * (ys[j] - ys[a]) - (a - j) * (my - ys[a])) for j in range(lo, hi)]
        a = lo + area.index(max(area))
        out.append(a)
    return [*out, n - 1]


@pytest.mark.parametrize("n, points", [(1, 2), (5, 2), (5, 10), (10, 3), (20, 10), (50, 10), (100, 10), (100, 33), (333, 50)])
def test_lttb(spark, n, points):
    rnd = random.Random(n)
    ys = [rnd.uniform(-5, 5) for _ in range(n)]
    got = sorted(int(r.x_ms // 1000) for r in ops.lttb(frame(spark, ys), points).collect())
    assert got == sorted(set(triangles(ys, points)))


def test_lttb_many_series(spark):
    rnd = random.Random(0)
    data = {(r, c): [rnd.random() for _ in range(rnd.randint(1, 80))] for r in (1, 2) for c in "AB"}
    df = None
    for (r, c), ys in data.items():
        df = frame(spark, ys, r, c) if df is None else df.union(frame(spark, ys, r, c))
    got = {}
    for row in ops.lttb(df, 12).collect():
        got.setdefault((row.test_run_id, row.channel_name), []).append(int(row.x_ms // 1000))
    assert {k: sorted(v) for k, v in got.items()} == {k: triangles(ys, 12) for k, ys in data.items()}


def test_buckets_start_at_epoch_zero(spark):
    rows = ops.bucket_average(frame(spark, [1, 3, 5, 7]), 1500.0).collect()
    assert sorted((r.x_ms, r.y) for r in rows) == [(0.0, 2.0), (1500.0, 5.0), (3000.0, 7.0)]


def test_head_meta_counts_hint(spark):
    df = frame(spark, [5, 4, 3])
    assert sorted(r.y for r in ops.head(df, 2).collect()) == [4.0, 5.0]
    m = ops.meta(df).first()
    assert (m.n, m.min_y, m.max_y, m.first_ms, m.last_ms, m.unit) == (3, 3.0, 5.0, 0.0, 2000.0, "u")
    assert ops.detail_hint(df, 3).first().downsampled and not ops.detail_hint(df, 4).first().downsampled


def test_payload(spark):
    row = ops.payload(frame(spark, [5, 4, 3])).first()
    assert row.x_ms == [0.0, 1000.0, 2000.0] and row.y == [5.0, 4.0, 3.0]


def test_empty(spark):
    empty = spark.createDataFrame([], SERIES)
    for out in (ops.bucket_average(empty, 10.0), ops.lttb(empty, 5), ops.head(empty, 2), ops.meta(empty), ops.payload(empty), ops.from_start(empty), ops.decimate(empty, 1.0)):
        assert out.count() == 0


def test_request_plans(spark):
    df = frame(spark, range(2000))
    out, plan = run(df, SeriesRequest(resolution_px=10))
    assert plan["strategy"] == "aggregate" and 500 <= out.count() <= 501
    out, plan = run(df, SeriesRequest(mode="detail", resolution_px=150))
    assert plan == plan | {"strategy": "raw_lttb", "cap": 600} and out.count() == 600
    out, plan = run(df, SeriesRequest(mode="raw", limit=7, channels=["x|A"]))
    assert plan["strategy"] == "raw" and out.count() == 7
    spec = CalculatedChannel("D", ["A"], formula="A * 2")
    out, _ = run(df, SeriesRequest(mode="raw", calculated=[spec], calc_stage="raw"))
    assert out.count() == 4000


def test_scan_prunes(spark, tmp_path):
    from chronolake.sinks.lake import read_series, write_series

    path = str(tmp_path / "lake")
    write_series(frame(spark, [1, 2, 3]).union(frame(spark, [9, 9], channel="B/x y")), path)
    write_series(frame(spark, [7, 8], channel="A"), path)  # replaces one series only
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    got = read_series(spark, path, [1], ["A"], 1000.0)
    plan = got._jdf.queryExecution().toString()
    pushed = re.findall(r"PushedFilters: (.*?)ReadSchema", plan, re.S)
    assert [r.y for r in got.collect()] == [8.0]
    assert any(all(re.search(f, p) for f in (r"EqualTo\(test_id,1|In\(test_id", r"EqualTo\(channel_name,A|In\(channel_name", r"GreaterThanOrEqual\(x_ms,1000")) for p in pushed), pushed
    assert read_series(spark, path, [5]).count() == 0 and "parquet" not in read_series(spark, path, [5])._jdf.queryExecution().toString().lower()
    assert read_series(spark, path, channels=["B/x y"]).count() == 2


def test_lake_of_short_tests(spark, tmp_path, monkeypatch):
    """Very many short tests are few files; replaced and deleted series are gone, also after small parts are merged; writers do not lose each other's parts."""
    from chronolake.sinks import lake

    path = str(tmp_path / "lake")
    many = spark.range(2000).selectExpr("id AS test_run_id", "concat('r', id) AS test_run_code", "explode(array('A', 'B')) AS channel_name", "'u' AS unit").selectExpr("*", "explode(array(0D, 1000D, 2000D)) AS x_ms").withColumn("y", F.rand(1))
    lake.write_series(many, path)
    assert len(list((tmp_path / "lake").glob("parts/*/*.parquet"))) <= 8 and lake.read_series(spark, path).count() == 12_000
    new = many.where("test_run_id = 3 AND channel_name = 'A'").withColumn("y", F.lit(7.0))
    other = many.where("test_run_id = 5").withColumn("test_run_id", F.lit(9000).cast("long"))
    threads = [threading.Thread(target=lake.write_series, args=(df, path)) for df in (new, other)]
    [t.start() for t in threads], [t.join() for t in threads]
    lake.delete_tests(spark, path, [17, 18])

    def check():
        assert lake.read_series(spark, path).count() == 12_000 + 6 - 12
        assert [r.y for r in lake.read_series(spark, path, [3], ["A"]).collect()] == [7.0] * 3
        assert [lake.read_series(spark, path, [t]).count() for t in (3, 17, 18, 19, 9000)] == [6, 0, 0, 6, 6]

    check()
    lake.merge_small(spark, path)
    check()
    assert len(lake._state(lake.CommitLog(spark, path))[1]["parts"]) == 1
    assert lake.expire(spark, path, 1) > 0
    check()


def test_a_batch_is_written_once(spark, tmp_path):
    from chronolake.sinks import lake

    path = str(tmp_path / "lake")
    write = lambda number, values: lake.write_series(frame(spark, values), path, replace=False, batch=("s", number))
    assert [write(0, [1]), write(0, [1]), write(1, [2, 3]), write(0, [9])] == [True, False, True, False]
    assert sorted(r.y for r in lake.read_series(spark, path).collect()) == [1.0, 2.0, 3.0]
