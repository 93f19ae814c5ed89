"""The vector matrix source: round trips, pruned columns and parts, refused and torn writes."""

import json
from pathlib import Path

import numpy as np
import pytest

from brindle.sources import matrix as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<double>").repartition(4)


def rows_of(n):
    return [(f"v{k:05d}é", [k / 7, -1.0 * k, 1e-8 * k]) for k in range(n)]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    M.write_matrix(frame(spark, rows_of(3000)), path, ranges=4)
    got = [(r["id"], list(r["v"])) for r in M.read_matrix(spark, path).collect()]
    assert sorted(got) == [(i, [float(np.float32(x)) for x in v]) for i, v in rows_of(3000)]
    found = M.manifest(path)
    assert found["size"] == 3 and found["rows"] == 3000 and len(found["parts"]) > 1
    assert all(a["last"] < b["first"] for a, b in zip(found["parts"], found["parts"][1:], strict=False))
    assert {p.name for p in (tmp_path / "m").iterdir()} == {"manifest.json", *(f"{p['name']}.{k}" for p in found["parts"] for k in ("ids", "f32"))}


def test_pruning(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    M.write_matrix(frame(spark, rows_of(500)), path, ranges=4)
    parts = M.manifest(path)["parts"]
    for p in parts:
        (tmp_path / "m" / f"{p['name']}.f32").unlink()
    assert M.read_matrix(spark, path, "id string").count() == 500  # rows are not read for ids
    M.write_matrix(frame(spark, rows_of(500)), path, overwrite=True, ranges=4)
    parts = M.manifest(path)["parts"]
    for p in parts[1:]:
        (tmp_path / "m" / f"{p['name']}.f32").unlink()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        first = parts[0]["first"]
        assert [r["id"] for r in M.read_matrix(spark, path).where(f"id = '{first}'").collect()] == [first]  # other parts are not read
        assert M.read_matrix(spark, path).where(f"id <= '{parts[0]['last']}' and id > '{first}'").count() == parts[0]["rows"] - 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("bad", [("x", [1.0, 2.0]), ("x", None), ("x", [1.0, float("nan"), 0.0]), ("x", [1e300, 0.0, 0.0]), ("v00001é", [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0])])
def test_refused_writes_leave_what_was_there(spark, tmp_path, bad):
    path = f"file://{tmp_path}/m"
    M.write_matrix(frame(spark, rows_of(40)), path)
    before = M.manifest(path)
    with pytest.raises(Exception, match="vector|id"):
        M.write_matrix(frame(spark, [*rows_of(60), bad]), path, overwrite=True)
    assert M.manifest(path) == before and M.read_matrix(spark, path).count() == 40
    assert len(list((tmp_path / "m").iterdir())) == 1 + 2 * len(before["parts"])


def test_overwrite_and_append(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    M.write_matrix(frame(spark, rows_of(40)), path)
    with pytest.raises(Exception, match="there is a matrix"):
        M.write_matrix(frame(spark, rows_of(10)), path)
    M.write_matrix(frame(spark, rows_of(10)), path, overwrite=True)
    assert M.read_matrix(spark, path).count() == 10


def test_torn_parts_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    with pytest.raises(Exception, match="no matrix"):
        M.read_matrix(spark, path).count()
    M.write_matrix(frame(spark, rows_of(40)), path)
    file = next((tmp_path / "m").glob("*.f32"))
    file.write_bytes(file.read_bytes()[:-4])
    with pytest.raises(Exception, match="not what was written"):
        M.read_matrix(spark, path).collect()


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    M.write_matrix(frame(spark, []), path, size=8)
    assert M.read_matrix(spark, path).collect() == [] and json.loads((Path(tmp_path) / "m" / "manifest.json").read_text())["size"] == 8
