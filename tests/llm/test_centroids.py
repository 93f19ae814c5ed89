"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import math

import pytest

from brindle.llm import centroids
from brindle.llm.common import table


def plain(rows):
    """vec_id, cluster, distance by full comparisons, and the centroids."""
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(use, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at))

    for _ in range(5):
        owner = [nearest(v)[1] for _, v in use]
        for k in range(len(at)):
            if mine := [v for (_, v), o in zip(use, owner, strict=True) if o == k]:
                at[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in use]
    total = sum(d for _, d, _ in found)
    return sorted(((i, k, d, sum(x for _, x, c in found if c == k), total, hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def digest(df):
    return sorted((tuple(r) for r in centroids.centroid_digest(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_table(spark, sf):
    df = table(spark, sf, "embeddings")
    assert digest(df) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 7, 120])
def test_odd_rows(spark, n):
    point = lambda i: [((i * 7919 + j * 104729) % 41 - 20) / (3.0 if i % 5 else 256.0) for j in range(64)]
    rows = [(i, point(i // 3)) for i in range(n)]
    rows += [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 65), (5, [0.5] * 63 + [None]), (6, [0.5] * 63 + [float("nan")]), (7, [float("-inf")] + [0.0] * 63)]
    if n > 7:
        rows += [(None, point(3)), (8, [3000.0] * 64), (8, [3000.0] * 64), (9, [-30000.0] * 64)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, owner int, id string, n int").repartition(3)
    assert digest(df) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_very_large_components_have_a_place(spark):
    df = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64), (3, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert {r["vec_id"]: r["distance"] for r in centroids.centroid_digest(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_rounds_compare_only_what_changed(spark):
    """With nothing changed a round neither compares nor moves."""
    import numpy as np

    v, at = np.arange(12).reshape(6, 2), np.array([[0, 1], [10, 11]])
    owner, distance = centroids._owners(v, np.full(6, -1), np.zeros(6, np.int64), at, np.arange(2))
    again = centroids._owners(v, owner, distance, at, np.array([], np.int64))
    assert (again[0] == owner).all() and (again[1] == distance).all()
    moved = np.array([[0, 1], [4, 5]])
    full = centroids._owners(v, np.full(6, -1), np.zeros(6, np.int64), moved, np.arange(2))
    delta = centroids._owners(v, owner, distance, moved, np.array([1]))
    assert (full[0] == delta[0]).all() and (full[1] == delta[1]).all()
