import csv
import io
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from chronolake.functions import units
from chronolake.schema import SERIES
from chronolake.sinks import export
from chronolake.sources import arrow_ipc, star, tabular


def write(path, text):
    path.write_text(text)
    return str(path)


def test_template_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "timestamp_utc,thrust_n,ok,note\n2024-01-01T00:00:00.000Z,1.5,true,x\n2024-01-01T00:00:00.010Z,2,false,y\nbad,3,true,z\n")
    df = tabular.read_wide(spark, path)
    wide, name, relative = tabular.normalize_time(df)
    assert (name, relative) == ("timestamp_utc", False)
    rows = tabular.unpivot(wide, tabular.select_channels(tabular.numeric_columns(wide, {"x_ms"})), 1, "run").collect()
    assert sorted((r.x_ms, r.y) for r in rows) == [(1704067200000.0, 1.5), (1704067200010.0, 2.0)]


def test_header_units():
    assert tabular.header_units(["time_s", "THRUST (N)", "P[psi]", "P (bar)", "plain"], {"time_s"}) == ({"THRUST (N)": "THRUST", "P[psi]": "P", "P (bar)": "P_2"}, {"THRUST": "N", "P": "psi", "P_2": "bar"})


@pytest.mark.parametrize("low, high, unit, relative, padded", [(0, 60, "s", True, False), (0, 1262304060, "s", False, True), (1.7e12, 1.7e12 + 5, "ms", False, False), (1.7e15, 1.7e15 + 2e11, "us", False, False), (1.7e15, 1.7e15 + 5, "ns", False, False), (1.7e18, 1.7e18, "ns", False, False)])
def test_time_scale(low, high, unit, relative, padded):
    s = tabular.time_scale(low, high)
    assert (s.unit, s.relative, s.padded) == (unit, relative, padded)


def test_padded_epoch_and_anchor(spark):
    times = [0.0] * 40 + [1262304000 + 0.1 * k for k in range(600)]
    df = spark.createDataFrame([(t, 1.0) for t in times], "TIME double, THRUST double")
    wide, _, relative = tabular.normalize_time(df)
    low, high = wide.agg(F.min("x_ms"), F.max("x_ms")).first()
    assert not relative and wide.count() == 600 and low == 1262304000000.0 and round(high - low) == 59900
    elapsed = spark.createDataFrame([(0.5, 1.0), (0.6, 2.0)], "time_s double, a double")
    anchored, _, relative = tabular.normalize_time(elapsed, t0_utc=datetime(2024, 1, 1, tzinfo=timezone.utc))
    assert relative and [round(r.x_ms, 3) for r in anchored.orderBy("x_ms").collect()] == [1704067200000.0, 1704067200100.0]


def test_channel_selection():
    pick = tabular.select_channels
    assert pick(["a", "b", "c"], exclude=["b"], rename={"a": "x"}) == {"a": "x", "c": "c"}
    assert pick(["a", "b"], mode="include", include=["x"], rename={"a": "x"}, require=["x"]) == {"a": "x"}
    with pytest.raises(ValueError, match="required"):
        pick(["a"], require=["zz"])
    with pytest.raises(ValueError, match="no channels"):
        pick(["a"], mode="include", include=["q"])


def test_probe_and_validate(spark):
    df = spark.createDataFrame([(0.0, 1.0, None, "s"), (1.0, 2.0, None, "s")], "time_s double, a double, b double, c string")
    p = tabular.probe(df, {"a": "N"})
    assert p == {"rows": 2, "time_candidates": ["time_s"], "channels": [{"name": "a", "n": 2}], "unit_coverage": "ok"}
    assert tabular.validate(df)["ok"] and not tabular.validate(df.select("a"))["ok"]
    assert tabular.validate(df.limit(1))["warnings"]
    with pytest.raises(ValueError, match="time column"):
        tabular.normalize_time(df.select("a"))


def test_arrow_files(spark, tmp_path):
    schema = pa.schema([pa.field("time_s", pa.float64()), pa.field("thrust", pa.float64(), metadata={"unit": "N"})])
    table = pa.table({"time_s": [0.0, 1.0], "thrust": [5.0, 6.0]}, schema=schema)
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(str(tmp_path / "a.arrows"), schema) as w:
        w.write_table(table)
    feather.write_feather(table, str(tmp_path / "v2.feather"))
    feather.write_feather(table, str(tmp_path / "v1.feather"), version=1)
    for name in ("a.arrow", "a.arrows", "v2.feather", "v1.feather"):
        rows = tabular.read_wide(spark, str(tmp_path / name)).orderBy("time_s").collect()
        assert [(r.time_s, r.thrust) for r in rows] == [(0.0, 5.0), (1.0, 6.0)], name
    both = arrow_ipc.read_arrow(spark, str(tmp_path / "a.arrow"), str(tmp_path / "a.arrows"))
    assert both.count() == 4 and arrow_ipc.field_units(schema) == {"thrust": "N"}
    found = {r.path.rsplit("/", 1)[1]: r.format for r in tabular.scan_folder(spark, str(tmp_path)).collect()}
    assert found == {"a.arrow": "arrow", "a.arrows": "arrow", "v1.feather": "arrow", "v2.feather": "arrow"}


def test_formats():
    assert tabular.detect_format("/x/A.PQ") == "parquet"
    with pytest.raises(ValueError):
        tabular.detect_format("a.txt")


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "run", "Thrust", "N", 1704067200000.0, 10.5), (1, "run", "Thrust", "N", 1704067200100.0, 11.0), (1, "run", "P", None, 1704067200.25, 12.25), (1, "run", "P", None, 0.0, float("nan"))], SERIES)
    rows = sorted((r.time_utc, r.channel, r.value, r.unit) for r in export.long_rows(df).collect())
    assert rows == [("2024-01-01T00:00:00.100000Z", "Thrust", 11.0, "N"), ("2024-01-01T00:00:00.250000Z", "P", 12.25, ""), ("2024-01-01T00:00:00Z", "Thrust", 10.5, "N")]
    export.export_series(df, str(tmp_path / "c"), "csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert {r["channel"] for r in csv.DictReader(io.StringIO(text))} >= {"Thrust"}
    export.export_series(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    table = export.from_arrow_ipc(export.arrow_ipc(df))
    assert table.num_rows == 4 and table.column("channel_name").to_pylist() == ["P", "P", "Thrust", "Thrust"]
    assert export.json_rows(df).count() == 4


def test_units(spark):
    assert units.check("(x - 32) * 5/9 + 273") is None
    for bad in ("x ** 2", "y + 1", "__import__('os')", "1 / (x - 1)", "x +"):
        with pytest.raises(ValueError):
            units.check(bad)
    df = spark.createDataFrame([(0.0, " c"), (32.0, "F"), (5.0, "K"), (6.0, "m"), (None, "C")], "y double, unit string")
    out = df.select(units.preferred_value(F.col("y"), F.col("unit"), [units.TEMPERATURE]).alias("y"), units.preferred_unit(F.col("unit"), [units.TEMPERATURE]).alias("u")).collect()
    assert [(r.y, r.u) for r in out] == [(273.0, "K"), (273.0, "K"), (5.0, "K"), (6.0, "m"), (None, "K")]


def test_star_names():
    assert star.safe_identifier("test_runs") == "test_runs"
    for bad in ("a;b", "1a", "", None):
        with pytest.raises(ValueError):
            star.safe_identifier(bad)
    assert star.overlay_targets("both", {"a": "x", "b": "y"}) == [("a", "x"), ("b", "y")]
    assert star.overlay_targets("a", {"a": "x"}, database="z") == [("a", "z")]


def test_batches_of_an_arrow_file_are_many_partitions(spark, tmp_path):
    import pyarrow as pa

    from chronolake.sources import arrow_ipc

    table = pa.table({"time_s": pa.array(range(4000), pa.float64()), "v": pa.array(range(4000), pa.int64())})
    with pa.OSFile(str(tmp_path / "many.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=100)
    with pa.OSFile(str(tmp_path / "none.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema):
        pass
    df = arrow_ipc.read_arrow(spark, str(tmp_path / "many.arrow"), str(tmp_path / "none.arrow"))
    assert df.rdd.getNumPartitions() == -(-40 // arrow_ipc.BATCHES) and sorted(r.v for r in df.collect()) == list(range(4000))
