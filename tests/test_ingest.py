import json

import pytest
from pyspark.sql import functions as F

from chronolake import __main__ as commands
from chronolake.catalog.store import Catalog
from chronolake.functions.formula import CalculatedChannel
from chronolake.plans import catalog_query, ingest
from chronolake.plans.query import SeriesRequest
from chronolake.sinks import export
from chronolake.sinks import lake as lake_sink
from chronolake.sinks.lake import read_series, write_series

T0 = 1_700_000_000


def csv(tmp_path, name="run.csv", rows=10):
    path = tmp_path / name
    lines = ["time,THRUST (N),P [psi],label"] + [f"{T0 + k},{k * 1.5},{'' if k == 3 else 100 - k},x" for k in range(rows)]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture()
def place(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog")), str(tmp_path / "lake")


def rule(**more):
    return ingest.clean_rule({"name": "r", "rename": {"P": "pressure"}, "require": ["THRUST"], "parameters": {"site": "A", "mass": 2}} | more)


def test_ingest_and_read_back(spark, tmp_path, place):
    catalog, lake = place
    by_rule = catalog.create_rule("hot", "threshold", "THRUST", {"op": ">=", "value": 9}, default_label="burn")
    part = {"channels": ["THRUST"], "op": ">", "value": 3}
    definition = {"name": "d", "nodes": [{"id": "a", "name": "outer", "start": part, "end": part}, {"id": "b", "parent_id": "a", "name": "inner", "start": part | {"value": 6}, "end": part | {"value": 6}}]}
    calculated = [CalculatedChannel("double", ["THRUST"], formula="A * 2"), CalculatedChannel("four", ["double"], formula="A * 2")]
    path = csv(tmp_path)
    test = ingest.ingest(catalog, lake, path, rule(calculated=calculated, range_rules=[by_rule["rule_id"]], definitions=[definition]))
    assert test["status"] == "ready" and test["duration_s"] == 9.0 and test["run_code"] == "run" and test["rule"] == "r"
    entries = {r.channel_name: r for r in catalog.channel_entries(test["test_id"]).collect()}
    assert {n: (r.unit, r.point_count) for n, r in entries.items()} == {"THRUST": ("N", 10), "pressure": ("psi", 9), "double": (None, 10), "four": (None, 10)}
    got = catalog_query.catalog_series(catalog, lake, test["test_id"], ["four", "nothing"]).orderBy("x_ms").collect()
    assert [(r.x_ms, r.y) for r in got] == [((T0 + k) * 1000.0, k * 6.0) for k in range(10)]
    ranges = {r.name: r for r in catalog.list_ranges(test["test_id"]).collect()}
    source = ranges["Source"].range_id
    assert (ranges["Source"].start_ms, ranges["Source"].end_ms) == (T0 * 1000.0, (T0 + 9) * 1000.0)
    assert ranges["burn"].parent_range_id == source and ranges["burn"].start_ms == (T0 + 6) * 1000.0
    assert ranges["outer"].parent_range_id == source and ranges["inner"].parent_range_id == ranges["outer"].range_id
    meta = json.loads(open(ingest.write_meta(catalog, lake, test["test_id"])).read())
    assert meta["parameters"] == {"site": "A", "mass": 2.0} and len(meta["channels"]) == 4 and len(meta["ranges"]) == 4
    # unchanged: not read again; changed: once more, without doubled rows
    assert ingest.ingest(catalog, lake, path, rule())["created_at"] == test["created_at"]
    csv(tmp_path, rows=12)
    again = ingest.ingest(catalog, lake, path, rule())
    assert again["test_id"] == test["test_id"] and again["duration_s"] == 11.0 and catalog.list_tests().count() == 1
    assert [r.name for r in catalog.list_ranges(test["test_id"]).collect()] == ["Source"]
    assert catalog_query.artifact_series(catalog, lake, test["artifact_id"], ["THRUST"]).count() == 12
    assert catalog_query.artifact_series(catalog, lake, test["artifact_id"], ["none"]).count() == 0
    catalog.delete_test(test["test_id"], lake)
    assert catalog.get_test(test["test_id"]) is None and read_series(spark, str(tmp_path / "lake"), [test["test_id"]]).count() == 0


def test_many_files_and_errors(spark, tmp_path, place):
    catalog, lake = place
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\nx,y\n")
    out = ingest.ingest_many(catalog, lake, [csv(tmp_path, "a.csv"), str(bad), str(tmp_path / "x.doc"), csv(tmp_path, "b.csv")], rule())
    assert [bool(r["error"]) for r in out] == [False, True, True, False] and catalog.counts().first().asDict() == {"tests": 2, "channels": 4}
    with pytest.raises(ValueError, match="no values"):
        ingest.ingest(catalog, lake, csv(tmp_path, "c.csv"), rule(calculated=[CalculatedChannel("none", ["missing"], formula="A")]))
    assert catalog.artifact_of(str(tmp_path / "c.csv")) is None
    first = out[0]["test_id"]
    with pytest.raises(ValueError, match="none of the channels"):
        catalog_query.catalog_series(catalog, lake, first, ["nothing"])
    with pytest.raises(ValueError, match="there is no"):
        catalog_query.catalog_series(catalog, lake, 5)
    catalog.write("tests", catalog.read("tests").withColumn("status", F.lit("ingesting")))
    with pytest.raises(ValueError, match="not ready"):
        catalog_query.catalog_series(catalog, lake, first)


def test_many_files_in_one_write(spark, tmp_path, place, monkeypatch):
    """Files with the same columns are one part of the lake, each by its own time scale; results are those of one by one."""
    catalog, lake = place
    paths = [csv(tmp_path, f"run {k}.csv", 5 + k) for k in range(4)]
    lines = (tmp_path / "run 3.csv").read_text().split("\n")
    (tmp_path / "run 3.csv").write_text("\n".join([lines[0], *(f"{int(line.split(',')[0]) * 1000},{line.split(',', 1)[1]}" for line in lines[1:] if line)]) + "\n")  # in ms
    other = csv(tmp_path, "other.csv")
    (tmp_path / "other.csv").write_text((tmp_path / "other.csv").read_text().replace("THRUST", "F"))
    bad, gone = tmp_path / "bad.csv", str(tmp_path / "gone.csv")
    bad.write_text("a,b\n1,2\n")
    written = []
    monkeypatch.setattr(ingest, "write_series", lambda *a: written.append(a) or write_series(*a))
    both = ingest.clean_rule({"name": "r", "parameters": {"site": "A"}, "calculated": []})
    got = ingest.ingest_many(catalog, lake, [*paths, other, str(bad), gone], both)
    assert [g["error"] is None for g in got] == [True] * 5 + [False] * 2 and len(written) == 2
    alone = Catalog(spark, str(tmp_path / "catalog2"))
    for g, path in zip(got, paths, strict=False):
        test = ingest.ingest(alone, str(tmp_path / "lake2"), path, both)
        mine = catalog.get_test(g["test_id"])
        assert {k: mine[k] for k in test if k != "created_at"} == {k: test[k] for k in test if k != "created_at"}
        rows = lambda c, at: sorted(map(str, catalog_query.catalog_series(c, at, test["test_id"]).collect()))  # noqa: B023, E731
        assert rows(catalog, lake) == rows(alone, str(tmp_path / "lake2"))
        assert [r.source for r in catalog.list_ranges(g["test_id"]).collect()] == ["source"] and catalog.list_parameters(g["test_id"]).first().value_text == "A"
    written.clear()
    assert [g["test_id"] for g in ingest.ingest_many(catalog, lake, paths, both)] == [g["test_id"] for g in got[:4]] and not written  # all known


def test_units_of_field_metadata(spark, tmp_path, place):
    """Units in the fields of Parquet and Arrow files become those of the channels, renamed ones too; a header's unit goes before them."""
    import pyarrow as pa
    from pyarrow import parquet

    catalog, lake = place
    fields = [pa.field("time_s", pa.float64()), pa.field("thrust_n", pa.float64(), metadata={b"unit": b"N"}), pa.field("P [psi]", pa.float64(), metadata={b"unit": b"bar"}), pa.field("free", pa.float64())]
    table = pa.table([pa.array([1.0, 2.0, 3.0])] * 4, schema=pa.schema(fields))
    parquet.write_table(table, tmp_path / "a.parquet")
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    for name in ("a.parquet", "b.arrow"):
        test = ingest.ingest(catalog, lake, str(tmp_path / name), ingest.clean_rule({"name": "r", "rename": {"thrust_n": "thrust"}}))
        assert {r.channel_name: r.unit for r in catalog.channel_entries(test["test_id"]).collect()} == {"thrust": "N", "P": "psi", "free": None}
        assert {r.unit for r in read_series(spark, lake, [test["test_id"]], ["thrust"]).collect()} == {"N"}


def test_update_test_and_icons(spark, tmp_path, place):
    catalog, lake = place
    one = ingest.ingest(catalog, lake, csv(tmp_path), rule())["test_id"]
    assert catalog.update_test(one, run_code=" new ", notes="n", icon="star")["run_code"] == "new"
    assert [(r.notes, r.icon) for r in catalog.list_tests().collect()] == [("n", "star")]
    catalog.update_test(one, icon="")
    assert [(r.run_code, r.icon) for r in catalog.list_tests().collect()] == [("new", None)]
    for wrong in ({"test_id": 5}, {"test_id": one, "run_code": " "}):
        with pytest.raises(ValueError):
            catalog.update_test(**wrong)
    for _ in range(5):
        catalog.update_test(one, notes="again")
    assert len(list((tmp_path / "catalog" / "tests").iterdir())) <= 4


@pytest.mark.parametrize("raw", [{}, {"name": "x", "mode": "some"}, {"name": "x", "mode": "include"}, {"name": "x", "rename": {"a": "c", "b": "c"}}, {"name": "x", "time_unit": "h"}])
def test_wrong_rules(raw):
    with pytest.raises(ValueError):
        ingest.clean_rule(raw)


def test_files_as_they_are(spark, tmp_path):
    path = csv(tmp_path)
    assert ingest.file_test(spark, path)["duration_s"] == 9.0
    assert ingest.file_channels(spark, path) == [{"channel_name": "THRUST", "unit": "N"}, {"channel_name": "P", "unit": "psi"}]
    rows = ingest.file_series(spark, path, ["P"], limit=4).collect()
    assert [r.y for r in rows] == [100.0, 99.0, 98.0, 96.0]
    with pytest.raises(ValueError):
        ingest.file_series(spark, path, ["none"])


def test_several_sources(spark):
    rows = [(r, f"run-{r}", c, "u", float(k * 1000), float(k)) for r in (1, 2) for c in ("a", "b") for k in range(50)]
    series = spark.createDataFrame(rows, "test_run_id long, test_run_code string, channel_name string, unit string, x_ms double, y double")
    out, answer = catalog_query.overview_envelope({"x": series, "y": series.where("test_run_id = 1")}, SeriesRequest(max_points=10))
    assert answer["strategy"] == "aggregate" and answer["meta"].count() == 4 and answer["hint"].first().downsampled
    got = [(r.x_ms, r.source) for r in out.collect()]
    assert got == sorted(got) and {s for _, s in got} == {"x", "y"}
    assert catalog_query.strategy_summary(["raw", "aggregate"]) == "mixed" and catalog_query.strategy_summary([]) == "raw"
    assert [r.y for r in catalog_query.first_rows(series, 3).collect()] == [0.0, 0.0, 0.0]


def test_frames(spark, place):
    catalog, lake = place
    wide = spark.createDataFrame([(float(T0 + k), k * 1.0, "x") for k in range(5)], "time double, `A [V]` double, label string")
    test = ingest.ingest_frame(catalog, lake, wide, "bench 1", rule(require=["A"]))
    assert test["source_type"] == "frame" and test["duration_s"] == 4.0
    assert ingest.ingest_frame(catalog, lake, wide.limit(3), "bench 1", rule(require=[]))["test_id"] == test["test_id"]
    got = catalog_query.catalog_series(catalog, lake, test["test_id"])
    assert got.count() == 3 and got.first().unit == "V"
    for wrong in (wide.drop("time"), wide.drop("A [V]"), wide.limit(0)):
        with pytest.raises(ValueError):
            ingest.ingest_frame(catalog, lake, wrong, "wrong", rule(require=[]))


def test_commands(spark, tmp_path, capsys):
    where = ["--catalog", str(tmp_path / "c"), "--lake", str(tmp_path / "l")]
    (tmp_path / "rule.json").write_text(json.dumps({"name": "r", "exclude": ["P"]}))
    assert commands.main([*where, "ingest", csv(tmp_path, "my run.csv"), str(tmp_path / "none.csv"), "--rule", str(tmp_path / "rule.json")], spark) == 1
    first, second = map(json.loads, capsys.readouterr().out.splitlines())
    assert first["error"] is None and second["error"]
    assert commands.main([*where, "list"], spark) == 0 and json.loads(capsys.readouterr().out)["run_code"] == "my run"
    start = "2023-11-14T22:13:22Z"
    assert commands.main([*where, "export", str(first["test_id"]), str(tmp_path / "out"), "--from", start, "--format", "parquet"], spark) == 0
    path = capsys.readouterr().out.strip()
    assert path.endswith("/my_run") and spark.read.parquet(path).count() == 8
    assert [export.safe_filename(x, ".csv") for x in ("a/b c", "..", "x.CSV")] == ["a_b_c.csv", "export.csv", "x.CSV"]


def test_tasks_of_a_lake_write_follow_its_rows(spark, tmp_path, monkeypatch):
    """Adaptive execution does not merge the ranges of a write, however well their rows compress."""
    monkeypatch.setattr(lake_sink, "ROWS_PER_TASK", 1000)
    rows = spark.range(20_000).selectExpr("1L AS test_run_id", "'r' AS test_run_code", "'A' AS channel_name", "'u' AS unit", "id * 10.0D AS x_ms", "1.0D AS y").repartition(4)
    write_series(rows, str(tmp_path / "lake"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "lake/parts/*")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 15 and max(sizes) <= 3000
    assert read_series(spark, str(tmp_path / "lake"), [1]).agg(F.countDistinct("x_ms")).first()[0] == 20_000


def test_rows_are_not_sorted_to_be_summed_up(spark):
    """Sums over all rows of a series hash them: only what is left, a row for each unit, code or time, may be sorted."""
    from chronolake.functions.formula import align

    rows = spark.range(100).selectExpr("1L AS test_run_id", "if(id < 50, 'r', 'q') AS test_run_code", "'A' AS channel_name", "if(id = 7, 'V', null) AS unit", "id % 5 * 10.0D AS x_ms", "id * 1.0D AS y").repartition(3)
    for made in (ingest.channel_rows(rows, "/lake"), align(rows, ["A"])):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        aggregates = [line for line in plan.split("\n") if "Aggregate" in line]
        assert "HashAggregate" in aggregates[-1], plan
    assert [(r.unit, r.point_count, r.start_ms, r.end_ms) for r in ingest.channel_rows(rows, "/lake").collect()] == [("V", 100, 0.0, 40.0)]
    assert sorted((r.x_ms, r.v0, r.test_run_code) for r in align(rows, ["A"]).collect()) == [(k * 10.0, 95.0 + k, "q") for k in range(5)]
