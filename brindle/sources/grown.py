"""Tables that grow columns: each change of schema is a generation of files, and one read gives them all under the newest schema.

Old files are never rewritten. A column that a generation does not have is filled by its rule, an expression over that generation's
columns (a default, or a back-fill from others); without a rule it is null. Values that were written stay, nulls among them, so
reading twice or after further generations gives the same rows. Types may widen (int to long, float to double); others fail the read.

Odd input: a folder without generations fails the read; empty generations count for the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the generations that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    whole = [p.getName() for p in names if p.getName().startswith("generation=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole)


def add_generation(rows: DataFrame, path: str) -> None:
    """Writes rows as the next generation. A write that broke off leaves no generation, and its number is used again."""
    number = max(generations(rows.sparkSession, path), default=-1) + 1
    rows.write.mode("overwrite").parquet(f"{path}/generation={number}")


def read_generations(spark: SparkSession, path: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """All rows under the newest schema, and after it columns that only older generations have."""
    parts = [spark.read.parquet(f"{path}/generation={n}") for n in generations(spark, path)]
    if not parts:
        raise ValueError(f"there are no generations in {path}")
    columns = {}
    for part in reversed(parts):
        for f in part.schema:
            columns.setdefault(f.name, f.dataType)
    out = None
    for part in parts:
        has = set(part.columns)
        for f in part.schema:
            if f.dataType != columns[f.name] and (f.dataType.typeName(), columns[f.name].typeName()) not in {("integer", "long"), ("float", "double"), ("short", "integer"), ("short", "long"), ("byte", "integer"), ("integer", "double")}:
                raise ValueError(f"column {f.name} changed from {f.dataType.simpleString()} to {columns[f.name].simpleString()}")
        value = lambda c: F.col(f"`{c}`") if c in has else (rules or {}).get(c, F.lit(None))  # noqa: B023, E731
        same = part.select(*(value(c).cast(t).alias(c) for c, t in columns.items()))
        out = same if out is None else out.unionByName(same)
    return out
