"""Centroid clustering by delta Lloyd: rounds touch only what the last round changed, in exact integers.

Every round writes each vector with its owner and distance, and beside them signed transfers: what the vectors that moved take
from their old centroid and bring to their new one, summed within each task. The global sums grow by these transfers alone. In
the next round a vector whose owner stayed where it was is compared with the changed centroids only; a vector whose owner moved
is compared with all. This gives the same owners as a full comparison, ties to the smaller number included. The work is one
narrow pass a round: vectors are never shuffled, a task holds one batch, and only k centroids and k sums come to the driver.

Rules for odd input: a vector counts if it has DIMENSIONS components, none null or non-finite; others give no row. Components
beyond 2^19 count as that, so that squares fit into 64 bits. Each repeated row is a vector of its own, a null id is hashed as
an empty one, and equal hashes go by components. Fewer vectors than K give as many centroids; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import forgotten, written

#: Components of a vector, steps of a unit, centroids, rounds, and the seed of the first centroids.
DIMENSIONS, STEPS, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Largest component, in units: (2 * 2^19 * 256)^2 * 64 is below 2^63.
LARGEST = float(1 << 19)
#: Vectors compared at once, and the bound below which float64 products of components are exact.
BATCH, EXACT = 8192, 1 << 22

_STATE = "id long, v array<int>, owner int, distance long, sums array<long>, n long"


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """id and v: the usable vectors as integers, floor(STEPS * x)."""
    x = F.col(vector_column)
    fine = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double")))
    return df.where(x.isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(held(c) * STEPS).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[tuple[int, ...]]:
    """The k vectors with the smallest hashes of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    best = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [tuple(r["v"]) for r in best]


def _distances(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, int64."""
    if v.size and max(int(np.abs(v).max()), int(np.abs(to).max())) <= EXACT:
        a, b = v.astype(np.float64), to.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(v), len(to)), np.int64)
    for i, c in enumerate(to):
        d = v - c
        out[:, i] = (d * d).sum(1)
    return out


def _owners(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. owner is -1 where there is none yet; changed are the numbers of the changed centroids, ascending."""
    owner, distance = owner.copy(), distance.copy()
    if not len(changed):
        return owner, distance
    anew = (owner < 0) | np.isin(owner, changed)
    if anew.any():
        d = _distances(v[anew], centroids)
        owner[anew] = d.argmin(1)
        distance[anew] = d.min(1)
    rest = np.flatnonzero(~anew)
    if len(rest):
        d = _distances(v[rest], centroids[changed])
        least, number = d.min(1), changed[d.argmin(1)]
        better = (least < distance[rest]) | ((least == distance[rest]) & (number < owner[rest]))
        owner[rest[better]], distance[rest[better]] = number[better], least[better]
    return owner, distance


def _round(centroids: list[tuple[int, ...]], changed: list[int]):  # noqa: ANN202
    """One round over batches of the state; the task's transfers come last, as rows with sums and n but no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, new = np.array(centroids, np.int64), np.array(changed, np.int64)
        k, width = at.shape
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                part = whole.slice(lo, BATCH)
                v = np.asarray(part.column("v").flatten(), np.int64).reshape(-1, width)
                old = part.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
                owner, distance = _owners(v, old, part.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), at, new)
                moved = np.flatnonzero(owner != old)
                np.add.at(sums, owner[moved], v[moved])
                np.add.at(counts, owner[moved], 1)
                left = moved[old[moved] >= 0]
                np.subtract.at(sums, old[left], v[left])
                np.subtract.at(counts, old[left], 1)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("v"), pa.array(owner.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=["id", "v", "owner", "distance", "sums", "n"]
                )
        some = np.flatnonzero((sums != 0).any(1) | (counts != 0))
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(some.astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(counts[some])], names=["id", "v", "owner", "distance", "sums", "n"]
            )

    return run


def _transfers(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Signed changes of count and sums by centroid: at most k rows."""
    sums = [F.sum(F.col("sums")[i]) for i in range(width)]
    rows = state.where(F.col("n").isNotNull()).groupBy("owner").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect()
    return {r["owner"]: (r["n"], r["sums"]) for r in rows}


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """id, v, owner and distance of every vector after the rounds and a last assignment; and the centroids."""
    centroids = first_centroids(vectors, k, seed)
    state = vectors.select("id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    if not centroids:
        return state.limit(0), centroids
    width, changed = len(centroids[0]), list(range(len(centroids)))
    counts, sums = [0] * len(centroids), [[0] * width for _ in centroids]
    before = None
    for turn in range(rounds + 1):
        every = written(state.mapInArrow(_round(centroids, changed), _STATE))
        state = every.where(F.col("n").isNull()).select("id", "v", "owner", "distance")
        if before is not None:
            forgotten(before)
        before = every
        if turn == rounds:
            break
        for c, (n, total) in _transfers(every, width).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], total, strict=True)]
        now = [tuple(s // n for s in total) if n else old for n, total, old in zip(counts, sums, centroids, strict=True)]
        changed = [c for c, (a, b) in enumerate(zip(now, centroids, strict=True)) if a != b]
        centroids = now
        if not changed:
            break
    return state, centroids


def centroid_digest(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    state, centroids = clustered(whole_vectors(df, "vec_id", "embedding"))
    by = state.groupBy("owner").agg(F.sum("distance").alias("s")).collect()  # k rows at most
    inertia = sum(r["s"] for r in by)
    named = [(r["owner"], r["s"], inertia, hashlib.sha256(",".join(map(str, centroids[r["owner"]])).encode()).hexdigest()) for r in by]
    facts = df.sparkSession.createDataFrame(named, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "owner").select(F.col("id").alias("vec_id"), F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
