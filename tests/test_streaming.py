from pyspark.sql import functions as F

from chronolake.streaming.overview import bucket_average_stream


def test_windows_close(spark, tmp_path):
    rows = [(1, "A", f"2024-01-01 0{h}:{m}:00", float(h)) for h in range(5) for m in ("10", "40")]
    source = spark.createDataFrame(rows, "test_run_id long, channel_name string, time string, y double").withColumn("time", F.to_timestamp("time"))
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = bucket_average_stream(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("overview").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.x_ms, r.y, r.n) for r in spark.table("overview").collect())
    assert got == [(1704067200000.0 + h * 3_600_000, float(h), 2) for h in range(3)]


def test_a_stream_that_fails_and_restarts_equals_the_batch(spark, tmp_path, monkeypatch):
    """Files come in two lots; the stream fails between its two writes of a batch, and late rows come last."""
    from chronolake.operators.series import bucket_average
    from chronolake.schema import SERIES
    from chronolake.sinks.lake import read_series
    from chronolake.streaming import ingest

    folder, lake, sums, checkpoint = (str(tmp_path / n) for n in ("in", "lake", "sums", "check"))
    rows = [(r, f"r{r}", c, "u", 600_000.0 * k, float(k * r)) for r in (1, 2) for c in "AB" for k in range(24)]
    lots = [rows[:30], rows[30:50], rows[50:]]  # times of later lots lie before those of earlier ones
    put = lambda k: spark.createDataFrame(lots[k], SERIES).coalesce(1).write.mode("append").parquet(folder)
    go = lambda: ingest.stream_into_lake(ingest.read_stream(spark, folder, SERIES, 1), lake, sums, checkpoint, "s")
    put(0)
    go().awaitTermination(60)
    put(1)
    add, failed = ingest.add_sums, []

    def fails_once(*args):
        if not failed:
            failed.append(True)
            raise OSError("the driver is lost")
        return add(*args)

    monkeypatch.setattr(ingest, "add_sums", fails_once)
    try:
        go().awaitTermination(60)
    except Exception as e:
        assert "the driver is lost" in str(e)
    assert failed and read_series(spark, lake).count() == 50 and sum(r.n for r in ingest.overview(spark, sums).collect()) == 30
    put(2)
    go().awaitTermination(60)
    go().awaitTermination(60)  # nothing is new
    plain = lambda df: sorted((r.test_run_id, r.channel_name, r.x_ms, r.y) for r in df.collect())
    assert plain(read_series(spark, lake)) == sorted((r, c, x, y) for r, _, c, _, x, y in rows)
    assert plain(ingest.overview(spark, sums)) == plain(bucket_average(spark.createDataFrame(rows, SERIES), 3_600_000.0))


def test_sums_are_put_together(spark, tmp_path, monkeypatch):
    from chronolake.schema import SERIES
    from chronolake.streaming import ingest

    monkeypatch.setattr(ingest, "MOST_FOLDERS", 2)
    path = str(tmp_path / "sums")
    for k in range(4):
        assert ingest.add_sums(spark.createDataFrame([(1, "r", "A", "u", 10.0, float(k)), (1, "r", "A", "u", 20.0, None)], SERIES), path, 100.0, ("s", k))
        assert not ingest.add_sums(spark.createDataFrame([(1, "r", "A", "u", 10.0, 9.0)], SERIES), path, 100.0, ("s", k))
    assert [(r.x_ms, r.y, r.n) for r in ingest.overview(spark, path).collect()] == [(0.0, 1.5, 4)]
