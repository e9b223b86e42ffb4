import threading

import pytest
from pyspark.sql import functions as F

from chronolake.catalog import store
from chronolake.catalog.store import Catalog
from chronolake.functions import definitions


def test_register_replace_delete(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.read("tests").count() == 0
    make = lambda i, code: spark.createDataFrame([(i, code)], "test_id long, run_code string")
    channel = lambda i, n: spark.createDataFrame([(i, n, 3)], "test_id long, channel_name string, point_count long")
    parameter = spark.createDataFrame([(1, "p", "x", None), (1, "q", None, 2.5)], "test_id long, key string, value_text string, value_num double")
    c.register(make(1, "a"), channel(1, "T"), parameter)
    c.register(make(2, "b"), channel(2, "T"), parameter.limit(0))
    c.register(make(1, "a2"), channel(1, "U"), parameter)
    assert {(r.test_id, r.run_code) for r in c.read("tests").collect()} == {(1, "a2"), (2, "b")}
    assert {(r.test_id, r.channel_name) for r in c.read("channels").collect()} == {(1, "U"), (2, "T")}
    assert store.parameter_map(c.read("parameters")).first().parameters == {"p": "x", "q": "2.5"}
    c.delete_test(1)
    assert [r.test_id for r in c.read("tests").collect()] == [2] and c.read("parameters").count() == 0
    assert [r.test_id for r in c.latest_tests(5).collect()] == [2]


def test_all_tests_are_listed(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.write("tests", spark.range(10_050).select(F.col("id").alias("test_id"), F.timestamp_seconds("id").alias("created_at")))
    assert c.list_tests().count() == 10_050 and c.latest_tests(10_020).count() == 10_020
    assert sorted(r.test_id for r in c.list_tests(2).collect()) == [10_048, 10_049]


def test_large_tables_are_several_files(spark, tmp_path):
    """A large table is written by several tasks, a small one is one file."""
    c = Catalog(spark, str(tmp_path / "cat"))
    files = lambda: len([f for f in c.read("results").inputFiles()])
    rows = spark.range(40_000).select(F.col("id").alias("test_id"), F.lit(None).cast("long").alias("range_id"), F.lit("a").alias("analysis_name"), F.lit("k").alias("key"),
                                      F.lit(None).cast("string").alias("value_text"), F.lit(1.0).alias("value_num"))
    c.put_results(rows.limit(10))
    assert files() == 1
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    try:
        for size in sizes:
            spark.conf.set(size, "16k")
        c.put_results(rows)
    finally:
        for size in sizes:
            spark.conf.unset(size)
    found = c.read("results").agg(F.count("*").alias("n"), F.countDistinct("result_id").alias("ids"), F.max("result_id").alias("top")).first()
    assert files() > 1 and tuple(found) == (40_000, 40_000, 40_000)


def test_results(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    schema = "result_id long, test_id long, range_id long, analysis_name string, key string, value_text string, value_num double"
    c.put_results(spark.createDataFrame([(None, 1, None, "a", "k", None, 1.0), (None, 1, 7, "a", "k", None, 2.0)], schema))
    c.put_results(spark.createDataFrame([(None, 1, None, "a", "k", None, 9.0), (None, 2, None, "a", "k", None, 3.0)], schema))
    rows = {(r.test_id, r.range_id): r.value_num for r in c.read("results").collect()}
    assert rows == {(1, None): 9.0, (1, 7): 2.0, (2, None): 3.0}
    assert sorted(r.result_id for r in c.read("results").collect()) == [1, 2, 3]
    assert store.filter_results(c.read("results"), 1, "a").count() == 2


def test_append_ids_and_growing_schema(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.append("range_rules", spark.createDataFrame([("a", "edge")], "name string, kind string"), "rule_id")
    c.append("range_rules", spark.createDataFrame([("b", "edge")], "name string, kind string"), "rule_id")
    assert {(r.rule_id, r.name, r.config) for r in c.read("range_rules").collect()} == {(1, "a", None), (2, "b", None)}


def test_many_new_rows_are_numbered_by_several_tasks(spark):
    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.lpad(((F.col("id") * 7) % n).cast("string"), 4, "0")).alias("key"), F.lit(None).cast("long").alias("result_id"))
    old = spark.createDataFrame([(40,), (3,)], "result_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = store.with_ids(rows, old, "result_id").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.key, r.result_id) for r in got) == [(f"k{k:04}", 41 + k) for k in range(n)]
    assert len({r.task for r in got}) > 1
    assert store.with_ids(rows.limit(0), old.limit(0), "result_id").count() == 0


def test_tags_and_ids(spark):
    df = spark.createDataFrame([([" Hot ", "hot", "", "Cold"],)], "tags array<string>")
    assert df.select(store.clean_tags(F.col("tags")).alias("t")).first().t == ["Hot", "Cold"]
    row = spark.range(1).select(store.artifact_id(F.lit("csv"), F.lit("/a")).alias("a")).withColumn("t", store.test_id(F.col("a"))).first()
    assert len(row.a) == 16 and row.t == int(row.a[:12], 16)


def test_ranges_in_the_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    early = c.create_range(1, "early", 1000, 2000, tags=["x"], parameters={"load": 2, "who": "me"})
    assert early["parent_range_id"] is None and [(p["key"], p["value_num"], p["value_text"]) for p in early["parameters"]] == [("load", 2.0, None), ("who", None, "me")]
    spans = spark.createDataFrame([(1, 0.0, 10_000.0), (2, 0.0, 5.0)], "test_run_id long, start_ms double, end_ms double")
    assert c.ensure_source_ranges(spans).count() == 2 and c.ensure_source_ranges(spans).count() == 0
    source = c.list_ranges(1).where("source = 'source'").first()["range_id"]
    assert c.get_range(early["range_id"])["parent_range_id"] == source  # adopted
    inner = c.create_range(1, "inner", 1200, 1500, parent_range_id=early["range_id"])
    outside = c.create_range(1, "outside", 9000, 12_000)
    assert inner["parent_range_id"] == early["range_id"] and outside["parent_range_id"] is None
    for wrong in ({"start_ms": 500, "end_ms": 1500, "parent_range_id": early["range_id"]}, {"start_ms": 1, "end_ms": 2, "parent_range_id": 99}, {"start_ms": 3, "end_ms": 2}, {"start_ms": 1, "end_ms": 2, "source": "source"}):
        with pytest.raises(ValueError):
            c.create_range(1, "wrong", wrong.pop("start_ms"), wrong.pop("end_ms"), **wrong)
    with pytest.raises(ValueError):
        c.create_range(2, "wrong", 1200, 1500, parent_range_id=early["range_id"])
    assert c.update_range(inner["range_id"], name="new", end_ms=1600.0, parameters={"a": "b"})["parameters"][0]["key"] == "a"
    assert c.get_range(inner["range_id"])["end_ms"] == 1600.0
    assert c.update_range(inner["range_id"], parent_range_id=None)["parent_range_id"] == source
    assert c.update_range(source, end_ms=1.0, label="all")["end_ms"] == 10_000.0
    for wrong in ((inner["range_id"], {"end_ms": 1.0}), (inner["range_id"], {"parent_range_id": inner["range_id"]}), (source, {"parent_range_id": 1}), (99, {}), (inner["range_id"], {"parent_range_id": early["range_id"], "end_ms": 3000.0})):
        with pytest.raises(ValueError):
            c.update_range(wrong[0], **wrong[1])
    c.update_range(inner["range_id"], parent_range_id=early["range_id"])
    c.delete_range(early["range_id"])
    assert c.get_range(inner["range_id"])["parent_range_id"] == source and c.get_range(early["range_id"]) is None
    for wrong in (source, 99):
        with pytest.raises(ValueError):
            c.delete_range(wrong)
    assert [r.start_ms for r in c.list_ranges(1).collect()] == [0.0, 1200.0, 9000.0]


def test_stored_rules(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    series = spark.createDataFrame([(r, "r", "T", "u", k * 100.0, float(v)) for r in (1, 2) for k, v in enumerate([0, 5, 0, 6, 0][: 5 - 2 * (r - 1)])], "test_run_id long, test_run_code string, channel_name string, unit string, x_ms double, y double")
    rule = c.create_rule("hot", "threshold", "T", {"op": ">", "value": 1}, default_label="burn", default_color="red")
    assert sorted((r.test_id, r.name, r.color) for r in c.apply_rule(rule["rule_id"], series).collect()) == [(1, "burn 1", "red"), (1, "burn 2", "red"), (2, "burn", "red")]
    assert [r.name for r in c.list_rules().collect()] == ["hot"] and c.get_rule(5) is None
    for wrong in (("x", "sometimes", "T", {}), ("x", "edge", "T", "[]")):
        with pytest.raises(ValueError):
            c.create_rule(*wrong)
    with pytest.raises(ValueError):
        c.apply_rule(9, series)


def test_definitions_are_checked():
    part = {"channels": ["T"], "op": ">", "value": "3"}
    node = lambda i, parent=None: {"id": i, "name": i, "parent_id": parent, "start": part, "end": {"expression": "T2 between 1..4"}}
    clean = definitions.clean_definition({"name": "d", "nodes": [node("a", "b"), node("b")]})
    assert [n["id"] for n in definitions.parents_first(clean["nodes"])] == ["b", "a"]
    assert clean["nodes"][0]["start"] == {"channels": ["T"], "formula": "A", "op": ">", "expression": "T > 3", "occurrence": "first", "edge": "none", "value": 3.0}
    assert clean["nodes"][0]["end"]["channels"] == ["T2"] and clean["nodes"][0]["end"]["value_b"] == 4.0
    for nodes in ([node("a", "b"), node("b", "a")], [node("a", "a")], [node("a", "x")], [node("a"), node("a")], [{"id": "a"}], [node("a") | {"start": {}}], [node("a") | {"start": part | {"op": "~"}}],
                  [node("a") | {"start": part | {"value": "much"}}], [node("a") | {"start": part | {"occurrence": "never"}}], [node("a") | {"start": part | {"edge": "up"}}], [node("a") | {"start": part | {"op": "between"}}]):
        with pytest.raises(ValueError):
            definitions.clean_definition({"name": "d", "nodes": nodes})
    with pytest.raises(ValueError):
        definitions.clean_definition({"nodes": []})


@pytest.mark.parametrize(
    "text, want",
    [
        ("THRUST >= 40", (["THRUST"], ">=", 40.0, None)), ("P.x-1<-2.5e1", (["P.x-1"], "<", -25.0, None)), ("tot between 1 to 4", (["tot"], "between", 1.0, 4.0)),
        ("tot OUTSIDE 1,4", (["tot"], "outside", 1.0, 4.0)), ("T2 between -1..4.5", (["T2"], "between", -1.0, 4.5)), ("T2 between 1 4", (["T2"], "between", 1.0, 4.0)),
        ("between a_to_b", None), ("T2 between a_to_b", None), ("A > 3", None), ("T2 > x", None), ("T2 between 1", None), ("SMOOTH(T2, 3) > 1", None), ("", None), ("T2", None), ("T2 > 1 2", None),
    ],
)
def test_expressions(text, want):
    found = definitions.from_expression(text)
    assert ((found["channels"], found["op"], found["value"], found.get("value_b")) if found else None) == want


def test_two_writers(spark, tmp_path):
    """Writers in threads lose no row and give no id twice; a change that fails leaves no trace."""
    root = str(tmp_path / "cat")
    made, failed = [], []

    def write(name):
        c = Catalog(spark, root)
        for k in range(3):
            try:
                made.append((name, k, c.create_rule(f"{name}{k}", "edge", "T", {"threshold": k})["rule_id"]))
            except Exception as e:  # seen below
                failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [t.start() for t in threads], [t.join() for t in threads]
    c = Catalog(spark, root)
    assert not failed and c.log.versions() == list(range(1, 7))
    assert sorted(r.name for r in c.list_rules().collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert sorted(i for *_, i in made) == [1, 2, 3, 4, 5, 6] and {(r.name, r.rule_id) for r in c.list_rules().collect()} == {(f"{n}{k}", i) for n, k, i in made}
    before, folders = c.log.latest(), set((tmp_path / "cat").glob("*/*"))

    @store.changes
    def half(self):
        self.write("range_rules", self.read("range_rules").limit(0))
        assert self.list_rules().count() == 0
        raise KeyError("stop")

    with pytest.raises(KeyError):
        half(c)
    assert c.log.latest() == before and set((tmp_path / "cat").glob("*/*")) == folders and c.list_rules().count() == 6


def test_overtaken_changes_and_ids_of_deleted_rows(spark, tmp_path):
    c, other = (Catalog(spark, str(tmp_path / "cat")) for _ in range(2))
    first = c.create_range(1, "a", 0, 5)["range_id"]
    seen = []

    @store.changes
    def slow(self):
        seen.append(self.read("ranges").count())
        if len(seen) == 1:
            other.create_range(1, "b", 1, 2)  # wins the version that this change has begun to try for
        return self.create_range(1, "c", 2, 3)["range_id"]

    assert slow(c) == first + 2 and seen == [1, 2]
    c.delete_range(first + 2)
    assert c.create_range(1, "d", 3, 4)["range_id"] == first + 3  # an id is not given again
    assert sorted(r.name for r in other.list_ranges().collect()) == ["a", "b", "d"]
    assert not c.log.commit(1, {}) and c.log.read(1)["ids"] == {"ranges": first}


def test_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 2)
    c = Catalog(spark, str(tmp_path / "cat"))
    for k in range(4):
        c.append("parameters", spark.createDataFrame([(k, "k", "v", None)], "test_id long, key string, value_text string, value_num double"))
        assert len(c.log.latest()[1]["tables"]["parameters"]) <= 2 and c.read("parameters").count() == k + 1
    kept = {f for v in c.log.versions()[-store.KEPT :] for f in c.log.read(v)["tables"]["parameters"]}
    assert {f"parameters/{p.name}" for p in (tmp_path / "cat" / "parameters").iterdir()} <= kept | {"parameters/.crc"}
