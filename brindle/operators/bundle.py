"""Bundles of an index: rows as JSON lines, vectors, joins with integrity, digests, validation.

Digests over many rows are sums of row hashes or digests of digests, so no task holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import materialised


def json_lines(df: DataFrame) -> DataFrame:
    """One compact JSON text per row, keys sorted, nulls written."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines, sorted within and across files."""
    rows = df.orderBy(*order)
    json_lines(rows).write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines go. A line that is no object fails the read, or is left out where not strict."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    held = lines.select("value", F.from_json("value", schema).alias("row"), F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$").alias("object"))
    bad = ~F.col("object") | F.try_parse_json("value").isNull()
    if strict:
        held = held.withColumn("row", F.when(bad, F.raise_error(F.lit("a line is no JSON object"))).otherwise(F.col("row")))
    else:
        held = held.where(~bad)
    return held.select("row.*")


def malformed_lines(lines: DataFrame) -> Column:
    """A condition on value: the line is not blank and no JSON object."""
    return (F.btrim("value") != "") & (~F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") | F.try_parse_json("value").isNull())


def vector_issue(vector: Column, dimension: int) -> Column:
    """Why a vector may not be written: dimension or not finite; null where it may."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.size(vector) != dimension, "dimension").when(~finite, "not-finite")


def decoded_vector(text: Column) -> Column:
    """A JSON list of finite numbers as doubles; null for anything else."""
    v = F.from_json(text, T.ArrayType(T.DoubleType()))
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def decoded_strings(text: Column) -> Column:
    """A JSON list of strings; an empty list for anything else."""
    return F.coalesce(F.from_json(text, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def denormalised(children: DataFrame, parents: DataFrame, documents: DataFrame) -> DataFrame:
    """Children with their parent's and document's columns; orphan tells which side is missing (parent, document), or is null."""
    p = parents.select("parent_id", F.col("title").alias("parent_title"), F.lit(True).alias("_p"))
    d = documents.select("document_id", F.col("name").alias("document_name"), "product", F.lit(True).alias("_d"))
    rows = children.join(p, "parent_id", "left").join(d, "document_id", "left")
    return rows.withColumn("orphan", F.when(F.col("_p").isNull(), "parent").when(F.col("_d").isNull(), "document")).drop("_p", "_d")


def inverted(children: DataFrame) -> DataFrame:
    """asset_id with the sorted ids of the parents and children that show it."""
    rows = children.select("child_id", "parent_id", F.explode("asset_ids").alias("asset_id"))
    return rows.groupBy("asset_id").agg(F.array_sort(F.collect_set("parent_id")).alias("parents"), F.array_sort(F.collect_set("child_id")).alias("children"))


def first_product(images: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """image_id and product: that of the first related parent that has one, else of the first such child.

    images: image_id, parent_ids, child_ids; parents and children: id, product.
    """

    def first(ids: str, other: DataFrame, name: str) -> DataFrame:
        rows = images.select("image_id", F.posexplode(ids).alias("at", "id")).join(other.where("product is not null"), "id")
        return rows.groupBy("image_id").agg(F.min_by("product", "at").alias(name))

    out = images.select("image_id").join(first("parent_ids", parents, "a"), "image_id", "left").join(first("child_ids", children, "b"), "image_id", "left")
    return out.select("image_id", F.coalesce("a", "b").alias("product"))


def content_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and two digests of them that do not depend on their order; equal rows count each time."""
    value = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    a, b = F.xxhash64(value), F.xxhash64(F.lit(1), value)
    return rows.agg(F.count("*").alias("n"), F.sum(a.cast("decimal(20,0)")).alias("sum"), F.bit_xor(b).alias("xor"))


#: Children of a node of a digest tree, and levels of nodes: enough for 2^40 different rows.
CHILDREN, LEVELS = 1024, 4


def tree_digest(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: the number of rows and the root of a hash tree over all columns of the rows in their order.

    A leaf stands for one different row and its number of copies, at its place in the order (nulls first; equal keys by digest).
    A node is the digest of its CHILDREN children's digests, LEVELS times over. Places are counted within ranges and added up over
    ranges, so the root is one whatever the partitions, no task holds more than a range, and a change of order changes it.
    """
    field = lambda c: F.coalesce(F.concat(F.lit("v"), F.sha2(F.col(c).cast("string"), 256)), F.lit("n"))
    one = rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), F.sha2(F.concat_ws(",", *(field(c) for c in sorted(rows.columns))), 256).alias("d"))
    keys = [f"k{i}" for i in range(len(order))] + ["d"]
    leaves = one.groupBy(*keys).agg(F.count("*").alias("copies"))
    ranges = materialised(leaves.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    level = ranges.withColumn("i", within).join(F.broadcast(starts), "part").select((F.col("start") + F.col("i")).alias("i"), F.concat_ws(":", "d", F.col("copies").cast("string")).alias("d"))
    for _ in range(LEVELS):
        nodes = level.groupBy(F.floor(F.col("i") / CHILDREN).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x"))
        level = nodes.select("i", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ","), 256).alias("d"))
    n = ranges.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    return n.join(level.select("d"), F.lit(True), "left").select("n", F.coalesce("d", F.sha2(F.lit(""), 256)).alias("root"))


def ordered_digest(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """group and the digest of its rows' digests in order. A group's digests are gathered, 64 characters a row; for groups of
    bounded size (the rows of one document, one question set)."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.sha2(value, 256).alias("d")))).alias("x"))
    return lists.select(group, F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), "\n"), 256).alias("digest"))


def validation(artifacts: DataFrame, manifest: DataFrame, rows: DataFrame, key: str, dimension: int) -> DataFrame:
    """Issues of a bundle, one row each: code and subject.

    artifacts and manifest: name, sha256, n_rows; rows: key and embedding. Missing and changed files, wrong counts, repeated
    keys, and vectors of wrong size or with values that are not finite.
    """
    both = manifest.select("name", F.col("sha256").alias("want"), F.col("n_rows").alias("n_want")).join(artifacts, "name", "left")
    code = F.when(F.col("sha256").isNull(), "missing-file").when(F.col("want") != F.col("sha256"), "checksum").when(F.col("n_want") != F.col("n_rows"), "row-count")
    files = both.select(code.alias("code"), F.col("name").alias("subject")).where("code is not null")
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate-id").alias("code"), F.col(key).cast("string").alias("subject"))
    wrong = rows.select(vector_issue(F.col("embedding"), dimension).alias("code"), F.col(key).cast("string").alias("subject")).where("code is not null")
    return files.unionByName(twice).unionByName(wrong)


def newest(generations: DataFrame, group: str, order: str, keep: int) -> DataFrame:
    """The newest rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return generations.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables under a new folder and a manifest (name, n_rows, digest) last, which makes the bundle whole.

    A folder that has a manifest is returned unchanged; one without is what a lost job left, and is written anew.
    """
    spark = next(iter(tables.values())).sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return spark.read.parquet(f"{path}/manifest")
    parts = None
    for name in sorted(tables):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        saved = spark.read.parquet(f"{path}/{name}")
        row = content_digest(saved, saved.columns).select(F.lit(name).alias("name"), F.col("n").alias("n_rows"), F.concat_ws(":", F.col("sum").cast("string"), F.col("xor").cast("string")).alias("digest"))
        parts = row if parts is None else parts.unionByName(row)
    parts.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a whole bundle, by name; a table whose rows are not those of the manifest fails the read."""
    manifest = {r["name"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row a table
    out = {}
    for name, want in manifest.items():
        out[name] = spark.read.parquet(f"{path}/{name}")
        got = content_digest(out[name], out[name].columns).first()
        if (got["n"], f"{got['sum']}:{got['xor']}") != (want["n_rows"], want["digest"]):
            raise ValueError(f"bundle table changed: {name}")
    return out
