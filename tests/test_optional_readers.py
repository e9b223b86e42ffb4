"""HDF5 and TDMS through small stand-ins of their libraries, which are not installed: what the readers do with what the libraries give."""

import json
import sys
from datetime import datetime, timezone

import pytest

from chronolake.catalog.store import Catalog
from chronolake.plans import catalog_query, ingest
from chronolake.sources import hdf5, tabular, tdms

STAND_IN = '''
import json
import numpy as np

class Node:
    def __init__(self, name, parent, attrs):
        self.name, self.parent, self.attrs = name, parent, attrs

class Dataset(Node):
    def __init__(self, name, parent, row):
        super().__init__(name, parent, row.get("attrs", {}))
        self.data = np.array(row["data"])
        self.shape, self.dtype = self.data.shape, self.data.dtype
    def __getitem__(self, at):
        return self.data[at]

class File:
    def __init__(self, path):
        self.rows = json.load(open(path))
    def __enter__(self):
        return self
    def __exit__(self, *error):
        return False
    def __contains__(self, name):
        return name in self.rows and "data" in self.rows[name]
    def __getitem__(self, name):
        at = Node("/", None, {})
        parts = name.split("/")
        for k in range(1, len(parts)):
            path = "/".join(parts[:k])
            at = Node("/" + path, at, self.rows.get(path, {}).get("attrs", {}))
        return Dataset("/" + name, at, self.rows[name])
    def visititems(self, f):
        for name, row in self.rows.items():
            f(name, self[name] if "data" in row else Node(name, None, {}))

# the other library
class Channel:
    def __init__(self, name, row):
        self.name, self.row, self.properties = name, row, {k: np.datetime64(v) if k == "wf_start_time" else v for k, v in row.get("properties", {}).items()}
    def __len__(self):
        return len(self.row["data"])
    def __getitem__(self, at):
        if self.row.get("broken"):
            raise ValueError("broken")
        return self.row["data"][at]
    def time_track(self):
        return self.row["track"]

class Group(dict):
    def __init__(self, name, rows):
        super().__init__({k: Channel(k, v) for k, v in rows.items()})
        self.name = name
    def channels(self):
        return list(self.values())

class TdmsFile(dict):
    @classmethod
    def open(cls, path):
        return cls({k: Group(k, v) for k, v in json.load(open(path)).items()})
    def __enter__(self):
        return self
    def __exit__(self, *error):
        return False
    def groups(self):
        return list(self.values())
'''


@pytest.fixture(scope="module")
def stand_ins(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("libraries")
    for name in ("h5py", "nptdms"):
        (folder / f"{name}.py").write_text(STAND_IN)
        spark.sparkContext.addPyFile(str(folder / f"{name}.py"))
    sys.path.insert(0, str(folder))
    yield
    sys.path.remove(str(folder))
    for name in ("h5py", "nptdms"):
        sys.modules.pop(name, None)


def test_missing_libraries(spark, tmp_path, monkeypatch):
    for name, read in (("h5py", hdf5.read_hdf5), ("nptdms", tdms.read_tdms)):
        monkeypatch.setitem(sys.modules, name, None)
        with pytest.raises(ValueError, match=name):
            read(spark, str(tmp_path / "x"))


def h5(tmp_path, **attrs):
    rows = {
        "telemetry": {"attrs": attrs}, "telemetry/TIME": {"data": [0.0, 0.5, 1.0], "attrs": {"units": "seconds"}}, "telemetry/P": {"data": [1.0, 2.0, 3.0], "attrs": {"unit": "psi"}},
        "telemetry/label": {"data": ["a", "b", "c"]}, "other/short": {"data": [1.0]},
    }
    path = tmp_path / "f.h5"
    path.write_text(json.dumps(rows))
    return str(path)


def test_hdf5(spark, tmp_path, stand_ins, monkeypatch):
    path = h5(tmp_path, StartTime="2024-01-01T00:00:00Z")
    assert [(d["path"], d["is_time"], d["is_channel"], d["unit"]) for d in hdf5.datasets(path)] == [
        ("telemetry/TIME", True, False, "seconds"), ("telemetry/P", False, True, "psi"), ("telemetry/label", False, False, None), ("other/short", False, True, None)]
    monkeypatch.setattr(hdf5, "ROWS", 2)
    assert [tuple(r) for r in hdf5.read_hdf5(spark, path).orderBy("time").collect()] == [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]
    assert hdf5.time_facts(path) == {"unit": "s", "start_s": 1704067200.0}
    catalog, lake = Catalog(spark, str(tmp_path / "c")), str(tmp_path / "lake")
    test = ingest.ingest(catalog, lake, path)
    got = catalog_query.catalog_series(catalog, lake, test["test_id"], ["telemetry/P"]).orderBy("x_ms").collect()
    assert [(r.x_ms, r.y, r.unit) for r in got] == [(1704067200000.0 + 500 * k, 1.0 + k, "psi") for k in range(3)]
    for wrong in ("none", "telemetry/label"):
        with pytest.raises(ValueError):
            hdf5.read_hdf5(spark, path, wrong)
    assert [hdf5.time_unit(u) for u in ("Sec", "nanoseconds", "ms", "µs", "usec", "h", None)] == ["s", "ns", "ms", "us", "us", None, None]
    assert [hdf5.start_seconds(v) for v in (b"1970-01-01T00:00:10", "soon", 1.7e18, 1.7e12, 5, None)] == [10.0, None, 1.7e9, 1.7e9, 5.0, None]


def test_tdms(spark, tmp_path, stand_ins):
    path = tmp_path / "f.tdms"
    start = {"wf_start_time": "2024-01-01T00:00:00"}
    path.write_text(json.dumps({"g": {
        "a": {"data": [1.0, 2.0, 3.0], "track": [0.0, 0.5], "properties": start | {"unit_string": "N"}}, "b": {"data": [4.0, None], "properties": {"wf_increment": 2.0}},
        "c": {"data": [5.0], "properties": start}, "bad": {"data": [1.0], "broken": True, "track": []},
    }}))
    t0 = datetime(2024, 1, 2, tzinfo=timezone.utc)
    got = sorted(tuple(r) for r in tdms.read_tdms(spark, str(path), t0_utc=t0).collect())
    day = 1704067200000.0
    assert got == [("g/a", "N", day, 1.0), ("g/a", "N", day + 500, 2.0), ("g/b", None, day + 86_400_000, 4.0), ("g/c", None, day, 5.0)]
    catalog, lake = Catalog(spark, str(tmp_path / "c")), str(tmp_path / "lake")
    test = ingest.ingest(catalog, lake, str(path), ingest.clean_rule({"name": "r", "mode": "include", "include": ["g/a", "cc"], "rename": {"g/c": "cc"}}))
    assert {r.channel_name for r in catalog.channel_entries(test["test_id"]).collect()} == {"g/a", "cc"} and test["source_type"] == "tdms"
    assert catalog_query.artifact_series(catalog, lake, test["artifact_id"]).count() == 3
    with pytest.raises(ValueError):
        tdms.read_tdms(spark, str(path), ["none"])
    assert tabular.detect_format("x.TDMS") == "tdms"
