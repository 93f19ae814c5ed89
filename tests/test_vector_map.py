"""Neighbour descent and the plane map: recall against all pairs, neighbourhoods kept on the plane, later vectors, odd input."""

import numpy as np
import pytest

from brindle.operators import neighbours as N
from brindle.operators import vector_map as M
from brindle.plans import ingest


def unit(rows):
    x = np.array([v for _, v in rows], float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def true_lists(x, k=15):
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 9)
    return np.argsort(d, 1, kind="stable")[:, :k]


def sheet(n=600):
    """A bent sheet in 64 dimensions."""
    r = np.random.default_rng(1)
    t = r.random((n, 2)) * [3, 1]
    flat = np.zeros((n, 64))
    flat[:, 0], flat[:, 1], flat[:, 2], flat[:, 3] = np.cos(t[:, 0] * 2), np.sin(t[:, 0] * 2), t[:, 1] * 1.5, t[:, 0] * 0.5
    turn = np.linalg.qr(r.standard_normal((64, 64)))[0]
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(flat @ turn + 0.01 * r.standard_normal((n, 64)) + turn[5])]


def kept(xy, true):
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d, 9e9)
    near = np.argsort(d, 1)[:, :15]
    return np.mean([len(set(a) & set(b)) / 15 for a, b in zip(near, true, strict=True)])


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, true, place = unit(rows), true_lists(unit(rows)), {i: k for k, (i, _) in enumerate(rows)}
    got = {}
    for r in ingest.neighbour_graph(spark, sf).collect():
        got.setdefault(place[r["id"]], []).append((r["rank"], place[r["other"]], r["d"]))
    assert all(sorted(k for k, _, _ in g) == list(range(1, 16)) for g in got.values()) and len(got) == len(rows)
    assert all(abs(d - np.linalg.norm(x[i] - x[o])) < 1e-5 for i, g in got.items() for _, o, d in g)
    recall = np.mean([len({o for _, o, _ in got[i]} & set(true[i])) / 15 for i in range(len(rows))])
    print("recall", recall)
    assert recall >= 0.95


def test_map_keeps_neighbourhoods_and_places_later_vectors(spark):
    rows = sheet()
    true = true_lists(unit(rows))
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    made, placed = M.built(frame)
    xy = np.array([(r["x"], r["y"]) for r in sorted(placed.collect())])
    x = unit(rows)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    print("kept", kept(xy, true), "by components", kept(u[:, :2] * s[:2], true))
    assert kept(xy, true) > 0.65 and kept(xy, true) > kept(u[:, :2] * s[:2], true) + 0.05
    assert xy.min() == 0 and xy.max() == 1 and len(xy) == len(rows)
    later = {r["id"]: (r["x"], r["y"]) for r in made.placed(spark.createDataFrame([(5, [v * 3 + 1e-4 for v in rows[17][1]]), (9000, rows[40][1]), (9001, [-v for v in rows[3][1]]), (9002, [0.0] * 64), (9003, None)], "id long, v array<double>")).collect()}
    assert np.linalg.norm(np.array(later[5]) - xy[17]) < 0.05 and np.linalg.norm(np.array(later[9000]) - xy[40]) < 0.05
    assert 9002 not in later and 9003 not in later


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_few_vectors(spark, n):
    rows = [(i, [float(i + 1), float(i * i), 1.0]) for i in range(n)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    placed = {r["id"]: (r["x"], r["y"]) for r in M.built(frame)[1].collect()}
    assert set(placed) == set(range(n)) and all(0 <= v <= 1 for xy in placed.values() for v in xy)
    if n in (1, 2):
        assert placed == ({0: (0.5, 0.5)} if n == 1 else {0: (0.25, 0.5), 1: (0.75, 0.5)})
    lists = {}
    for r in N.graph(frame).collect():
        lists.setdefault(r["id"], []).append(r["other"])
    assert all(len(v) == n - 1 for v in lists.values()) and (n < 2 or set(lists) == set(range(n)))


def test_equal_vectors(spark):
    placed = M.built(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "id long, v array<double>"))[1].collect()
    assert len(placed) == 40 and all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in placed)
