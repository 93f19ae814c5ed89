"""Loops, lists, branches, grown tables and rule tables on literal and odd rows."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import gates as G
from brindle.operators import rounds as R
from brindle.sources import grown


def test_loops_carry_only_unfinished_rows(spark):
    seen = []

    def step(rows):
        seen.append(rows.count())
        return rows.withColumn("n", F.col("n") - 1)

    rows = spark.createDataFrame([(1, 0), (2, 3), (3, 30), (4, None), (5, 1)], "id long, n int")
    got = {r["id"]: (r["n"], r["round"], r["finished"]) for r in R.looped(rows, step, F.col("n") <= 0, 5).collect()}
    assert got == {1: (0, 0, True), 2: (0, 3, True), 3: (25, 5, False), 4: (None, 5, False), 5: (0, 1, True)}
    assert seen == [4, 3, 3, 2, 2]
    assert R.looped(rows.limit(0), step, F.col("n") <= 0).count() == 0 and len(seen) == 5


def test_iteration_and_branches(spark):
    rows = spark.createDataFrame([(1, ["b", "a", None]), (2, []), (None, ["x"]), (4, None)], "id long, items array<string>")
    got = {r["id"]: r["items"] for r in R.iterated(rows, "id", "items", lambda d: d.where(F.coalesce("item", F.lit("")) != "a").withColumn("item", F.upper("item"))).collect()}
    assert got == {1: ["B", None], 2: [], None: ["X"], 4: []}
    named = R.switched(rows, [(F.size("items") > 1, lambda d: d.select("id", F.lit("many").alias("k"))), (F.size("items") == 1, lambda d: d.select("id", F.lit("one").alias("k")))], lambda d: d.select("id", F.lit("none").alias("k")))
    assert {r["id"]: r["k"] for r in named.collect()} == {1: "many", None: "one", 2: "none", 4: "none"}


def test_results_and_categories(spark):
    row = spark.createDataFrame([(None, "  ", "x", " Technical. ", "other")], "a string, b string, c string, said string, odd string")
    got = row.select(R.first_filled(F.col("a"), F.col("b"), F.col("c")), R.categorised(F.col("said"), ["general", "technical"], "mixed"), R.categorised(F.col("odd"), ["general"], "mixed"), R.categorised(F.col("a"), ["general"], "mixed")).first()
    assert tuple(got) == ("x", "technical", "mixed", "mixed")


def test_topic_rules(spark):
    asked = [("怎么改地址 和付款", 0), ("改地址", 1), ("物流 invoice", 2), ("发票", 3), ("坏了", 4), (None, 4)]
    want = [G.TOPIC_RULES[0][1], G.TOPIC_RULES[1][1], G.TOPIC_RULES[2][1], G.TOPIC_RULES[3][1], G.TOPIC_OTHERWISE, G.TOPIC_OTHERWISE]
    got = spark.createDataFrame(asked, "q string, k int").select(G.missing_information(F.col("q"))).collect()
    assert [list(r[0]) for r in got] == want


def test_grown_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no generations"):
        grown.read_generations(spark, path)
    grown.add_generation(spark.createDataFrame([(1, "a", 5), (2, None, None)], "id long, name string, n int"), path)
    grown.add_generation(spark.createDataFrame([], "id long, name string, n long, owner string"), path)
    grown.add_generation(spark.createDataFrame([(3, "c", 2**40, None)], "id long, name string, n long, owner string"), path)
    rules = {"owner": F.coalesce("name", F.lit("nobody"))}
    want = [(1, "a", 5, "a"), (2, None, None, "nobody"), (3, "c", 2**40, None)]
    for _ in range(2):
        assert sorted(tuple(r) for r in grown.read_generations(spark, path, rules).collect()) == want
    (tmp_path / "t" / "generation=3").mkdir()  # a write that broke off
    assert grown.generations(spark, path) == [0, 1, 2]
    grown.add_generation(spark.createDataFrame([(4, "d")], "id long, extra string"), path)
    assert {r["id"]: r["extra"] for r in grown.read_generations(spark, path, rules).collect()} == {1: None, 2: None, 3: None, 4: "d"}
    grown.add_generation(spark.createDataFrame([("5",)], "id string"), path)
    with pytest.raises(ValueError, match="changed from"):
        grown.read_generations(spark, path)
