"""What screens show of the tables: totals, buckets by day, facets, hits on a map, searches over fields."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import materialised

#: Points of a cell at the finest width, about, and how often a width is halved at most.
CROWD, MOST_LEVELS = 4, 12


def totals(df: DataFrame, **sums: Column) -> DataFrame:
    """One row of sums; 0 for an empty table."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))


def day_bucket(at: Column, today: Column) -> Column:
    """today, yesterday or earlier, by the difference of days."""
    d = F.datediff(today, at)
    return F.when(d <= 0, "today").when(d == 1, "yesterday").otherwise("earlier")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value and count of the values of several columns; arrays count each of their values."""
    kinds = dict(df.dtypes)
    plain = [F.struct(F.lit(c).alias("field"), F.array(F.col(c).cast("string")).alias("values")) for c in columns if not kinds[c].startswith("array")]
    listed = [F.struct(F.lit(c).alias("field"), F.col(c).cast("array<string>").alias("values")) for c in columns if kinds[c].startswith("array")]
    out = df.select(F.explode(F.array(*plain, *listed)).alias("x")).select("x.field", F.explode("x.values").alias("value"))
    return out.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def searched(df: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Rows one of whose fields holds the text; case does not count, a blank text keeps all."""
    want = text.strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(want))) if want else df


def hits_on_map(hits: DataFrame, points: DataFrame, top: int = 10) -> DataFrame:
    """The best hits with their point (id, x, y), marked by the surest stage that ranked them; hits without a point go.

    hits: query_id, id, rerank_rank, dense_rank, rrf_rank (null where a stage did not rank them).
    """
    marker = F.when(F.col("rerank_rank").isNotNull(), "rerank").when(F.col("dense_rank").isNotNull(), "dense").otherwise("rrf")
    rank = F.coalesce("rerank_rank", "dense_rank", "rrf_rank")
    rows = hits.select("query_id", "id", marker.alias("marker"), rank.alias("rank")).join(points.select("id", "x", "y"), "id")
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def one_dataset(points: DataFrame, dataset_id: Column) -> DataFrame:
    """One row: whether all points are of the dataset (true for none), and how many there are."""
    return points.agg(F.coalesce(F.bool_and(F.col("dataset_id") == dataset_id), F.lit(True)).alias("ok"), F.count("*").alias("n"))


def _meetings(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Points of a with all points of b in their own and the eight cells around: all that lie within the width are among them."""
    cell = lambda df, x, y: df.withColumn("cx", F.floor(F.col(x) / width)).withColumn("cy", F.floor(F.col(y) / width))
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = cell(a, "x", "y").withColumn("c", around).drop("cx", "cy").select("*", "c.cx", "c.cy").drop("c")
    return left.join(cell(b, "bx", "by"), ["cx", "cy"])


def nearest_within(a: DataFrame, b: DataFrame, radius: float, tolerance: float = 0.0, distance: Callable[[Column, Column], Column] | None = None, most: float | None = None, apart: bool = False) -> DataFrame:
    """For each point of a (id, x, y) the nearest of b (id, x, y, priority) within the radius: id, near_id, d.

    Points no further than the tolerance beyond the nearest compete by priority (higher first), then distance, then id. distance:
    of two differences, the straight one if none is given; most: the largest that counts, the radius if none is given; apart: a
    point is not near to its own id. Cells are as wide as the radius for few points, finer for many: a point that finds one close
    enough for certain is done, the others go on to cells of twice the width. Pairs are only counted into minima.
    """
    distance = distance or (lambda x, y: F.sqrt(x * x + y * y))
    most = radius if most is None else most
    points = b.select(F.col("id").alias("near_id"), F.col("x").alias("bx"), F.col("y").alias("by"), "priority")
    d = F.round(distance(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), 8)
    # about CROWD points a cell, were they spread evenly over the square that holds them
    facts = b.agg(F.count("*").alias("n"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    side = max(facts[1] or 0.0, facts[2] or 0.0)
    fine = side * math.sqrt(CROWD / max(1, facts["n"]))
    level = max(0, min(MOST_LEVELS, math.ceil(math.log2(radius / fine)))) if 0 < fine < math.inf else 0
    if tolerance > 0:  # a width must hold the tolerance, too
        level = max(0, min(level, math.floor(math.log2(radius / (2 * tolerance)))))
    waiting, out = a.select("id", "x", "y"), []
    for k in range(level, -1, -1):
        width = radius / 2**k
        pairs = _meetings(waiting, points, width).withColumn("d", d).where(F.col("d") <= most)
        if apart:
            pairs = pairs.where("id <> near_id")
        # what is surely the whole neighbourhood of this width, in distances of the given kind; one rounding step is left out
        sure = distance(F.lit(width), F.lit(0.0)) - 2e-8
        best = pairs.groupBy("id", "priority").agg(F.min("d").alias("d"))
        least = best.groupBy("id").agg(F.min("d").alias("least"))
        if k:
            least = least.where(F.col("least") + tolerance <= sure)
        chosen = best.join(least, "id").where(F.col("d") <= F.col("least") + tolerance).groupBy("id").agg(F.coalesce(F.max_by("d", "priority"), F.min("d")).alias("d"), F.max("priority").alias("priority"))
        chosen = materialised(chosen)
        again = waiting.join(chosen.withColumnRenamed("d", "chosen_d").withColumnRenamed("priority", "chosen_p"), "id")
        ties = _meetings(again, points, width).where(d == F.col("chosen_d")).where(F.col("priority").eqNullSafe(F.col("chosen_p")))
        if apart:
            ties = ties.where("id <> near_id")
        out.append(ties.groupBy("id", F.col("chosen_d").alias("d")).agg(F.min("near_id").alias("near_id")).select("id", "near_id", "d"))
        if k:
            waiting = materialised(waiting.join(chosen, "id", "left_anti"))
    return reduce(DataFrame.unionByName, out)


def effective_model(events: DataFrame, spans: DataFrame) -> DataFrame:
    """request_id and model: that of the newest event that names one, else that of the span."""
    named = F.when(F.btrim(F.coalesce("model", F.lit(""))) != "", F.col("model"))
    e = events.groupBy("request_id").agg(F.max_by(named, F.when(named.isNotNull(), F.col("seq"))).alias("a"))
    s = spans.groupBy("request_id").agg(F.max("model").alias("b"))
    return e.join(s, "request_id", "full_outer").select("request_id", F.coalesce("a", "b").alias("model"))


def paired(text: Column, assets: Column, mark: str = "<PIC>") -> Column:
    """The parts of a text between marks, each with the asset that follows it (structs text, asset)."""
    return F.transform(F.arrays_zip(F.split(text, mark).alias("t"), F.array_distinct(assets).alias("a")), lambda x: F.struct(x["t"].alias("text"), x["a"].alias("asset")))


def contract(df: DataFrame, json_lists: list[str], vector: str = "embedding") -> DataFrame:
    """Records as a contract shows them: JSON lists decoded (anything else is an empty list), a vector as its dimension."""
    from brindle.operators.bundle import decoded_strings

    shown = [decoded_strings(F.col(c)).alias(c) if c in json_lists else F.col(c) for c in df.columns if c != vector]
    return df.select(*shown, F.coalesce(F.when(F.col(vector).isNotNull(), F.size(vector)), F.lit(0)).alias("dimension"))


def mapped(cases: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """case_id and the names of its assets that have one, in order of first occurrence, each once, at most so many.

    cases: case_id, asset_ids; names: asset_id, name.
    """
    rows = cases.select("case_id", F.posexplode("asset_ids").alias("at", "asset_id")).join(names, "asset_id")
    first = rows.groupBy("case_id", "name").agg(F.min("at").alias("at"))
    lists = first.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x"))
    kept = F.transform(F.slice("x", 1, most), lambda x: x["name"])
    return cases.select("case_id").join(lists, "case_id", "left").select("case_id", F.coalesce(kept, F.array().cast("array<string>")).alias("names"))


def split_facts(text: Column) -> Column:
    """Facts of a field, split at commas of both kinds and line ends; trimmed, distinct, not empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,，\n]"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
