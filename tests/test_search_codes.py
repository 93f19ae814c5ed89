"""Lexical search with codes, numbers and ideographs, on literal fixtures and against the formula in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import codes as K
from brindle.functions import text as T
from brindle.operators import search as S

DOCS = [(1, "E03 pump blocked"), (2, "code e03 means overheating"), (3, "the pump is loud"), (4, "Err_020 door"), (5, "ERR-02 fan 7.5 amps"), (6, "clean the filter every month"), (7, "清洁滤网")]
QUERIES = [(100, "E03"), (101, "pump e03 alarm"), (102, "err02"), (103, "fan 7.5"), (104, "滤网清洁"), (105, "filter"), (106, "x1000-b")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")


def test_tokens(spark):
    row = spark.createDataFrame([("E03, e03-b a pump 7.5 or 12. 清洁滤网机 水", None)], "text string, none string").select(T.tokens(F.col("text")), T.tokens(F.col("none")), K.exact_terms(F.col("text"))).first()
    assert list(row[0]) == ["e03", "e03-b", "pump", "7.5", "or", "12", "清洁", "洁滤", "滤网", "网机", "水"] and row[1] == [] and set(row[2]) == {"E03", "e03-b"}


def test_codes_make_hits(tables):
    found = {(r["query_id"], r["id"]): r["score"] for r in S.bm25(*tables).collect()}
    assert set(found) == {(100, 1), (100, 2), (101, 1), (101, 2), (102, 5), (103, 5), (104, 7)}
    # distinct tokens of the seven documents
    lengths = [3, 4, 4, 3, 5, 5, 4]
    idf = lambda df: math.log(1 + (7 - df + 0.5) / (df + 0.5))
    weight = lambda dl: 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / (sum(lengths) / 7)))
    assert found[102, 5] == 3.0 and found[100, 2] == pytest.approx(3.0 + idf(2) * weight(4), abs=1e-5)
    assert found[101, 1] == pytest.approx(3.0 + 2 * idf(2) * weight(3), abs=1e-5)


def test_codes_make_overlap(tables):
    found = {(r["query_id"], r["id"]): r["score"] for r in S.overlap(*tables).collect()}
    assert set(found) == {(100, 1), (100, 2), (101, 1), (101, 2), (103, 5), (104, 7)}
    assert found[100, 2] == pytest.approx(4 + 2.5 + math.log(2), abs=1e-5) and found[101, 1] == pytest.approx(8 / 3 + 2.5 + math.log(3), abs=1e-5)
