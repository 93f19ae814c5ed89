"""Reading tables, and writing intermediate tables that all executors can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task gets at most, on the average, before work on texts.
PART_BYTES = 8 << 20


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows dealt by their key into parts of PART_BYTES, as many as there are cores at least.

    A file of one row group is one task however large it is, so a table of any size is dealt out. By a key no task sorts its
    rows first, as it would to deal them in turn, and what is grouped or joined by the key later need not move again.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder (spark.checkpoint.dir) and read again: later plans start from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the folder of a table that materialised() made and that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if re.fullmatch(r"brindle-[0-9a-f]{32}", name.rpartition("/")[2]):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
