"""A plane map of vectors: a layout over the graph of their nearest neighbours, and the place of later vectors on it.

Places begin at the two main components, and move over EPOCHS rounds: along every edge of the graph the ends draw near, the more
the closer they are; each point is pushed off by a few others, which differ from round to round. A round is a join of edges with
places and a sum for each point; vectors take no part in it. Bounds are saved, so that later vectors, placed among their nearest
saved ones, come onto the same map. One or two vectors have a fixed layout.

Odd input: vectors without neighbours (null, without length) are not placed; ids must differ; all vectors are of one size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import vector as V
from brindle.operators import neighbours as N
from brindle.operators import search as S
from brindle.sources.tables import forgotten, materialised

#: Rounds of the layout, points that push one off in a round, width of the first layout, the longest step, its part taken, and the weight of a push.
EPOCHS, PUSHED, WIDTH, STEP, PART, PUSH = 30, 8, 10.0, 4.0, 0.5, 0.25
#: The curve of closeness on the plane for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.895
#: Saved vectors that place a later one.
PLACED_BY = 5


@dataclass
class Map:
    """Saved vectors (id, v), their places before scaling (id, x, y), and the bounds of these."""

    vectors: DataFrame
    raw: DataFrame
    bounds: tuple[float, float, float, float]

    def scaled(self, raw: DataFrame) -> DataFrame:
        lx, hx, ly, hy = map(F.lit, self.bounds)
        return raw.select("id", V.on_axis(F.col("x"), lx, hx).alias("x"), V.on_axis(F.col("y"), ly, hy).alias("y"))

    def placed(self, vectors: DataFrame) -> DataFrame:
        """id, x and y (0 to 1, clipped) of later vectors (id, v): the mean of their nearest saved ones, by closeness. None where none is alike."""
        near = S.dense(self.vectors, vectors.select((-1 - F.col("id")).alias("query_id"), "v"), PLACED_BY)  # later vectors may bear saved ids
        rows = near.join(self.raw, "id").groupBy("query_id")
        w = F.col("score") ** 8
        mean = rows.agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))
        return self.scaled(mean.select((-1 - F.col("query_id")).alias("id"), "x", "y"))


def _components(units: DataFrame) -> DataFrame:
    """id, x, y: the first layout, WIDTH wide."""
    rows = units.select("id", array_to_vector("v").alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    low, high = p.agg(F.min(F.least(F.col("p")[0], F.col("p")[1])), F.max(F.greatest(F.col("p")[0], F.col("p")[1]))).first()
    scale = WIDTH / max(high - low, 1e-9)
    # equal vectors begin a little apart
    shake = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000 - 0.5) * 1e-3
    return p.select("id", (F.col("p")[0] * scale + shake(1)).alias("x"), (F.col("p")[1] * scale + shake(2)).alias("y"))


def edge_weights(lists: DataFrame) -> DataFrame:
    """a, b (a before b) and w: how strong an edge is, by the distances of its ends' lists, from either side."""
    by = Window.partitionBy("id")
    rows = lists.withColumn("least", F.min("d").over(by)).withColumn("mean", F.avg("d").over(by))
    w = F.exp(-(F.col("d") - F.col("least")) / F.greatest(F.col("mean") - F.col("least"), F.lit(1e-3)))
    sides = rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), w.alias("w"))
    return sides.groupBy("a", "b").agg((1 - F.product(1 - F.col("w"))).alias("w"))


def layout(edges: DataFrame, start: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """id, x, y after all rounds. edges: a, b, w; start: id, x, y."""
    order = Window.partitionBy("part").orderBy("id")
    dealt = materialised(start.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)).cast("int")).withColumn("i", F.row_number().over(order)))
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}  # 256 rows
    n, before, starts = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        starts.append((part, before - 1))
        before += sizes[part]
    numbered = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(starts, "part int, s long")), "part")
    # numbers without gaps: a round's strangers are found by them
    at = materialised(numbered.select("id", (F.col("s") + F.col("i")).alias("i"), "x", "y"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = materialised(both.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("a"))))
    held = lambda c: F.greatest(F.lit(-STEP), F.least(F.lit(STEP), c))
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        a, b = at.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        d2 = dx * dx + dy * dy
        pull = F.when(d2 > 0, -2 * CURVE_A * CURVE_B * F.pow(d2, CURVE_B - 1) / (1 + CURVE_A * F.pow(d2, CURVE_B))).otherwise(0.0)
        drawn = both.join(a, "a").join(b, "b").select(F.col("a").alias("id"), (F.col("w") * held(pull * dx)).alias("fx"), (F.col("w") * held(pull * dy)).alias("fy"))
        shifts = [1 + (7919 * (epoch * PUSHED + s) + 104729 * s * s) % max(1, n - 1) for s in range(PUSHED)]
        stranger = at.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(*((F.col("i") + s) % n for s in shifts))).alias("i"))
        push = 2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * F.pow(d2, CURVE_B)))
        pushed = stranger.join(at.select("i", F.col("x").alias("bx"), F.col("y").alias("by")), "i").select(F.col("a").alias("id"), (PUSH * held(push * dx)).alias("fx"), (PUSH * held(push * dy)).alias("fy"))
        forces = drawn.unionByName(pushed).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        moved = at.join(forces, "id", "left")
        step = lambda f: rate * PART * held(F.coalesce(f, F.lit(0.0)))
        now = materialised(moved.select("id", "i", (F.col("x") + step("fx")).alias("x"), (F.col("y") + step("fy")).alias("y")))
        forgotten(at)
        at = now
    return at.select("id", "x", "y")


def built(vectors: DataFrame) -> tuple[Map, DataFrame]:
    """The map of vectors (id, v) and their places (id, x, y)."""
    units = materialised(N.unit_vectors(vectors))
    few = [r["id"] for r in units.select("id").orderBy("id").limit(3).collect()]
    if len(few) <= 2:
        places = [(i, 0.5 if len(few) == 1 else 0.25 + 0.5 * k, 0.5) for k, i in enumerate(few)]
        raw = units.sparkSession.createDataFrame(places, "id long, x double, y double")
        made = Map(units, raw, (0.0, 1.0, 0.0, 1.0))
        return made, made.scaled(raw)
    raw = materialised(layout(edge_weights(N.graph(units)), _components(units)))
    b = raw.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    made = Map(units, raw, tuple(map(float, b)))
    return made, made.scaled(raw)


def nearest_saved(queries: DataFrame, saved: DataFrame) -> DataFrame:
    """query_id and the id of the saved vector (id, v) of another id that is most alike by cosine; of equals the least id. Queries are a stated set."""
    return S.dense(saved, queries, 1).select("query_id", "id")
