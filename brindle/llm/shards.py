"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Each row is a point (language, source, size). Languages and sources are ordered by name, sizes by their logarithm, and each
dimension is scaled so that all rows together span 0 to 1; the widest dimension of a node is the one with the largest
deviation of its bytes. Rows with equal texts are one group: they stand at one point, that of the group's least language and
source, and go to one shard. Only a group of more than GROUP_SHARE of a shard's bytes may be divided.

Every level of the tree halves all its nodes at once: one histogram per node and dimension gives the widest dimension and the
slice its weighted median falls into; two finer histograms, of a hash of the text and of another one (in a large group, of
doc_id), place the cut inside that slice. So equal values are cut only where they must be, and one value that holds a third of
all bytes still splits evenly. Only histograms of a fixed number of slices come to the driver. A dimension with over NAMED names
is sliced by the running sum of bytes over all its names in order, found by a distributed sort: a slice then holds about
1 / SLICES of all bytes, or one name.

Rules for odd input: a null text has size 1 and the checksum of the empty text; null metadata is a value of its own, before
all others; repeated rows get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import whole_text, written

#: Number of shards (a power of two), slices of a histogram, and rows that one counting task numbers.
SHARDS, SLICES, ROWS_A_BLOCK = 16, 4096, 50_000
#: Names of a dimension that each get a slice, and the part of a shard's bytes up to which a group of equal texts stays whole.
NAMED, GROUP_SHARE = SLICES // 2, 0.01
DIMENSIONS, NAMES = ("lang", "source", "log_size"), ("lang", "source")


@dataclass
class Split:
    """A node's cut: rows at (dimension, text slice, row slice) below the cut go left."""

    dimension: str
    at: tuple[int, int, int]


def _slices(df: DataFrame, name: str) -> DataFrame:
    """name and slice (from 1, rising with the name) of every value of a dimension: a slice each, or by the running sum of bytes."""
    values = written(df.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("size").alias("n")).repartitionByRange(name).withColumn("part", F.spark_partition_id()))
    parts = values.groupBy("part").agg(F.count("*").alias("names"), F.sum("n").alias("bytes")).orderBy("part").collect()  # a row for each range
    names, total, starts = 0, 0, []
    for r in parts:
        starts.append((r["part"], names, total))
        names, total = names + r["names"], total + r["bytes"]
    before = Window.partitionBy("part").orderBy(name)
    at = values.join(F.broadcast(df.sparkSession.createDataFrame(starts, "part int, names long, bytes long")), "part")
    rank = F.col("names") + F.row_number().over(before)
    by_bytes = 1 + F.floor((F.col("bytes") + F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) * (SLICES - 2) / max(1, total))
    return at.select(name, (rank if names <= NAMED else by_bytes).cast("int").alias("slice"))


def points(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates, each a slice number; the slices of names are in the names' order."""
    text = whole_text().cast("binary")
    size = (F.octet_length(text) + 1).cast("long")
    has = set(df.columns)
    named = written(df.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), *((F.col(c) if c in has else F.lit(None)).cast("string").alias(c) for c in NAMES)))
    key = ["h", "text_crc32", "size"]
    groups = named.groupBy(*key).agg(F.min(F.struct(*NAMES)).alias("m"), F.count("*").alias("copies")).where("copies > 1")
    # equal texts: few numbers a row, and a group that holds many rows is divided by Spark's skew join
    rows = named.join(groups, key, "left")
    most = (named.agg(F.sum("size")).first()[0] or 0) / shards * GROUP_SHARE
    placed = written(rows.select("doc_id", "size", "text_crc32", "h", (F.coalesce("copies", F.lit(1)) * F.col("size") > most).alias("large"), *(F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(c)).alias(c) for c in NAMES)))
    for c in NAMES:
        slices = _slices(placed, c).withColumnRenamed(c, "_name")
        placed = placed.join(slices, F.col(c) == F.col("_name"), "left").withColumn(c, F.coalesce("slice", F.lit(0))).drop("_name", "slice")
    pick = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLICES)).cast("int")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        *NAMES,
        F.least(F.floor(F.log2("size") * (SLICES // 40)), F.lit(SLICES - 1)).cast("int").alias("log_size"),
        pick("h", F.lit(2)).alias("fine"),
        F.when(F.col("large"), pick("doc_id", F.lit(3))).otherwise(pick("h", F.lit(4))).alias("row"),
    )


def _cut(rows: list[tuple[int, int]], below: float) -> tuple[int, float]:
    """The slice in which the running sum of (slice, bytes) passes below, and the sum before that slice."""
    done = 0.0
    rows = sorted(rows)
    for place, n in rows:
        if done + n > below:
            return place, done
        done += n
    return rows[-1][0], done - rows[-1][1]


def _scale(dimension: str, places: set[int]) -> dict[int, float]:
    """The slices of all rows as numbers from 0 to 1: names by their rank, sizes as they are."""
    rows = sorted(places)
    values = range(len(rows)) if dimension in NAMES else [p - rows[0] for p in rows]
    return {p: v / max(1, values[-1]) for p, v in zip(rows, values, strict=True)}


def _spread(rows: list[tuple[int, int]], scale: dict[int, float]) -> float:
    """How wide a node is in a dimension: the standard deviation of its bytes."""
    total = sum(n for _, n in rows)
    mean = sum(scale[p] * n for p, n in rows) / total
    return (sum((scale[p] - mean) ** 2 * n for p, n in rows) / total) ** 0.5


def _goes_right(split: Split) -> Column:
    a, b, c = split.at
    d = F.col(split.dimension)
    return (d > a) | ((d == a) & ((F.col("fine") > b) | ((F.col("fine") == b) & (F.col("row") >= c))))


def grow_tree(pts: DataFrame, shards: int = SHARDS) -> list[dict[int, Split]]:
    """The cuts of every level. pts must have been written: it is read three times a level."""
    levels: list[dict[int, Split]] = []
    scales: dict[str, dict[int, float]] = {}
    for _ in range(shards.bit_length() - 1):
        at = pts.withColumn("node", shard_of(levels))
        dims = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("place")) for d in DIMENSIONS)))
        wide = at.select("node", "size", dims.alias("x")).groupBy("node", "x.d", "x.place").agg(F.sum("size").alias("n")).collect()
        by: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for r in wide:
            by.setdefault(r["node"], {}).setdefault(r["d"], []).append((r["place"], r["n"]))
        scales = scales or {d: _scale(d, {p for dims_of in by.values() for p, _ in dims_of[d]}) for d in DIMENSIONS}
        chosen: dict[int, tuple[str, int, float]] = {}
        for k, dims_of in by.items():
            d = max(DIMENSIONS, key=lambda d: (_spread(dims_of[d], scales[d]), d))
            place, before = _cut(dims_of[d], sum(n for _, n in dims_of[d]) / 2)
            chosen[k] = (d, place, sum(n for _, n in dims_of[d]) / 2 - before)

        def histogram(column: str, where: dict[int, Column], at: DataFrame = at) -> dict[int, list[tuple[int, int]]]:
            cond = F.lit(False)
            for k, c in where.items():
                cond = F.when(F.col("node") == k, c).otherwise(cond)
            out: dict[int, list[tuple[int, int]]] = {}
            for r in at.where(cond).groupBy("node", column).agg(F.sum("size").alias("n")).collect():
                out.setdefault(r["node"], []).append((r[column], r["n"]))
            return out

        inside = {k: F.col(d) == place for k, (d, place, _) in chosen.items()}
        fine = {k: _cut(rows, chosen[k][2]) for k, rows in histogram("fine", inside).items()}
        inside = {k: c & (F.col("fine") == fine[k][0]) for k, c in inside.items()}
        cuts: dict[int, Split] = {}
        for k, rows in histogram("row", inside).items():
            left = chosen[k][2] - fine[k][1]
            place, before = _cut(rows, left)
            n = dict(rows)[place]
            cuts[k] = Split(chosen[k][0], (chosen[k][1], fine[k][0], place + (left - before > n / 2)))
        levels.append(cuts)
    return levels


def shard_of(levels: list[dict[int, Split]], node: int = 0) -> Column:
    """The node that a point falls into: one decision tree, each cut written once."""
    if not levels:
        return F.lit(node)
    left = shard_of(levels[1:], 2 * node)
    if node not in levels[0]:
        return left
    return F.when(_goes_right(levels[0][node]), shard_of(levels[1:], 2 * node + 1)).otherwise(left)


def numbered(df: DataFrame, group: str, key: str, name: str, rows: int) -> DataFrame:
    """Adds gapless numbers from 0 within each group, without one task for a group.

    Rows are dealt into blocks by a hash of the key; numbers run within a block and go on from the blocks before it.
    """
    blocks = max(1, -(-rows // ROWS_A_BLOCK))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(key, F.lit(9)), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_block").orderBy(key, *[c for c in df.columns if c not in (group, key)])) - 1
    return dealt.withColumn("_at", within).join(starts, [group, "_block"]).withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_block", "_start", "_at", "_n")


def shard_documents(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; sizes of shards are near equal.

    Texts are read once, for size and checksum; all later work is on a few numbers per row.
    """
    pts = written(points(df, shards))
    rows = pts.count()
    levels = grow_tree(pts, shards) if rows else []
    leaf = pts.select("doc_id", "size", "text_crc32", shard_of(levels).alias("shard"))
    return numbered(leaf, "shard", "doc_id", "slot", rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
