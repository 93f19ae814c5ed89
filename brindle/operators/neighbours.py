"""The graph of nearest neighbours by neighbour descent: neighbours of neighbours are likely neighbours.

Vectors are made unit length, so distance is that of cosine. A first graph comes from random projections: along each of them the
vectors are ordered, and those in one stretch of STRETCH are compared. Then rounds: every vector is shown to the others in the
neighbourhoods it belongs to (its lists in both directions, at most twice K + SPARE of them, chosen by a hash), and a pair is kept
where it is nearer than the farthest that one of them has. The rounds end when hardly a list changes. Neighbourhoods are dealt
into parts of about HUBS; a round moves each vector, as it stands in the table, once to each part with a neighbourhood of its own,
2 (K + SPARE) + 1 times at most. A task holds the vectors of a part, and the driver holds nothing.

Odd input: vectors that are null, empty, without length or not finite have no neighbours; ids must differ; all vectors are of one
size; fewer than K others give shorter lists; equal distances go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import forgotten, materialised

#: Neighbours of a vector, those kept on the way besides, random projections, vectors of a stretch, most rounds, and the share of changed places that ends them.
K, SPARE, PROJECTIONS, STRETCH, ROUNDS, SETTLED = 15, 15, 4, 64, 8, 0.01
#: Neighbourhoods of a part, and pairs after which a task keeps the nearest.
HUBS, MOST_FOUND = 32_768, 400_000
_PAIR = "id long, other long, d double"


def _pairs(ids: np.ndarray, v: np.ndarray, k: int, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that met: each one's k nearest others, where they are nearer than far."""
    d = np.sqrt(np.maximum(2.0 - 2.0 * (v @ v.T), 0.0)).round(6)
    d[ids[:, None] == ids[None, :]] = np.inf
    if d.shape[1] > k:
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
    else:
        near = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    got = np.take_along_axis(d, near, 1)
    keep = np.isfinite(got) if far is None else np.isfinite(got) & (got < far[:, None])
    row = np.nonzero(keep)[0]
    return ids[row], ids[near[keep]], got[keep]


def _out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], names=["id", "other", "d"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _with_length(vectors: DataFrame) -> DataFrame:
    """id, x (as it stands) and its length n, of the vectors (id, v) that have a length."""
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", F.col("v").alias("x"), length.alias("n"))
    return rows.where((F.col("n") > 0) & (F.col("n") < F.lit(float("inf"))))


def _unit(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.transform(F.col("x").cast("array<double>"), lambda x: x / F.col("n")).alias("v"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id and v of unit length, of the vectors (id, v) that have a length."""
    return _unit(_with_length(vectors))


def _projected(seed: int):  # noqa: ANN202
    """Adds each vector's place along a random direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), batch.num_rows)
            at = v @ np.random.default_rng(seed).standard_normal(v.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(at)], names=["id", "v", "at"])

    return run


def _stretches(k: int):  # noqa: ANN202
    """Compares ordered vectors within stretches that overlap by half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, ids, vs = STRETCH // 2, np.empty(0, np.int64), None

        def compared(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, vs
            while len(ids) >= STRETCH or (last and len(ids) > 1):
                yield _out([_pairs(ids[:STRETCH], vs[:STRETCH], k)])
                ids, vs = ids[half:], vs[half:]

        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), batch.num_rows)
                ids, vs = np.concatenate([ids, batch.column("id").to_numpy()]), v if vs is None else np.concatenate([vs, v])
                yield from compared(False)
        yield from compared(True)

    return run


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("d", "other")
    # pairs move once, by id, for both the least of equal pairs and the ranks
    return pairs.repartition("id").groupBy("id", "other").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each one's k nearest of pairs that may be equal, by distance and then id."""
    ids, other, d = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((d, other, ids))
    ids, other, d = ids[order], other[order], d[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (other[1:] != other[:-1])
    ids, other, d = ids[new], other[new], d[new]
    order = np.lexsort((other, d, ids))
    ids, other, d = ids[order], other[order], d[order]
    stay = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[stay], other[stay], d[stay]


def _met(k: int):  # noqa: ANN202
    """Compares the members of each neighbourhood; rows come by part: a member once, with all of the part's hubs it is near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def compared() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            ids, far, length = (rows.column(c).to_numpy() for c in ("id", "far", "n"))
            x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            lists = rows.column("hubs").combine_chunks()
            hub, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            order = np.lexsort((ids[row], hub))
            hub, row = hub[order], row[order]
            found, n = [], 0
            for some in np.split(row, np.flatnonzero(np.diff(hub)) + 1):
                if len(some) > 1:
                    found.append(_pairs(ids[some], x[some].astype(np.float64) / length[some, None], k, far[some]))
                    n += len(found[-1][0])
                if n > MOST_FOUND:
                    yield _out([_best(found, k)])
                    found, n = [], 0
            if n:
                yield _out([_best(found, k)])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            for lo, hi in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(parts)]))(np.flatnonzero(np.diff(parts)) + 1), strict=True):
                if lo == hi:
                    continue
                if held and parts[lo] != now:
                    yield from compared()
                    held.clear()
                now = parts[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compared()

    return run


def graph(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """id, other, d, rank: the k nearest others of each vector (id, v), by the distance of their unit vectors."""
    rows, wanted, k = materialised(_with_length(vectors)), k, k + SPARE
    units = _unit(rows)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // HUBS))
    first = None
    for p in range(PROJECTIONS):
        placed = units.mapInArrow(_projected(p), "id long, v array<double>, at double")
        pairs = placed.repartitionByRange("at", "id").sortWithinPartitions("at", "id").mapInArrow(_stretches(k), _PAIR)
        first = pairs if first is None else first.unionByName(pairs)
    lists = materialised(_nearest(first, k))
    places = lists.count()
    for turn in range(rounds):
        both = lists.select(F.col("id").alias("hub"), F.col("other").alias("id")).unionByName(lists.select(F.col("other").alias("hub"), "id"))
        w = Window.partitionBy("hub").orderBy(F.xxhash64("hub", "id", F.lit(turn)), "id")
        members = both.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * k).select("hub", "id").unionByName(units.select(F.col("id").alias("hub"), "id"))
        # a list that is not full takes any distance
        far = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).alias("far"))
        known = rows.join(far, "id", "left").select("id", "x", "n", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        # a vector goes to a part once, with all of the part's neighbourhoods that it belongs to
        part = F.pmod(F.xxhash64("hub"), F.lit(parts)).cast("int").alias("part")
        sent = members.repartition("id").groupBy("id", part).agg(F.collect_list("hub").alias("hubs")).join(known, "id")
        met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_met(k), _PAIR)
        merged = materialised(_nearest(lists.select("id", "other", "d").unionByName(met), k))
        changed = merged.join(lists.select("id", "other"), ["id", "other"], "left_anti").count()
        forgotten(lists)
        lists = merged
        if changed <= SETTLED * places:
            break
    return lists.where(F.col("rank") <= wanted)
