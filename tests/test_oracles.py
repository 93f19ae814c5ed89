"""Every query with SQL against DuckDB on the same tables; the others against plain Python."""

import os
from collections import Counter

import duckdb
import pytest

from brindle.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted(columns), Counter(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, sf, name):
    got = catalogue.queries()[name](spark, sf)
    want = db.execute(catalogue.oracle_sql()[name])
    columns, rows = [d[0] for d in want.description], want.fetchall()
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, rows)


def test_redacted_identifiers(spark):
    from pyspark.sql import functions as F

    from brindle.functions import text as T

    row = spark.createDataFrame([("order 1234567890 and 12345678, again 1234567890, short 123",)], "text string").select(T.redacted(F.col("text"))).first()[0]
    assert "1234567890" not in row and "12345678," not in row and row.count("[已脱敏:c775e7b757]") == 2 and "short 123" in row


def test_stream_matches_batch(spark, sf, tmp_path):
    from brindle.streaming import events as E

    batch = spark.read.parquet(f"{sf}/events.parquet")
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    stream = E.windowed_counts(E.read_events(spark, str(folder), batch.schema))
    done = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("windows").collect()}
    want = {(r["start"], r["event_type"], r["n"]) for r in catalogue.queries()["tumbling_counts"](spark, sf).collect()}
    assert got == want
