"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class and as a list.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the folder of a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.fullmatch(r"brindle-[0-9a-f]{32}", name.rpartition("/")[2]):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batches_of_bytes(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring items of at most limit bytes together (a larger item stands alone)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def slices_of_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of one column's strings, cut before any of them becomes a Python object."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in batches_of_bytes(sizes.tolist(), limit):
        yield batch.slice(lo, hi - lo)


def spare(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
