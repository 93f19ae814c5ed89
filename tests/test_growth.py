"""Work in proportion to the rows: what the joins of a plan give, counted on tables that once met themselves."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import assets as A
from brindle.operators import search as S
from brindle.operators import views as U


@pytest.fixture
def join_rows(spark):
    """Runs a query and gives its rows with the most rows that one of its joins gave."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def below(plan):
        own = plan.metrics().get("numOutputRows")
        yield own.get().value() if "Join" in plan.nodeName() and own.isDefined() else 0
        for k in range(plan.children().size()):
            yield from below(plan.children().apply(k))

    def run(df):
        rows = df.collect()
        return rows, max(below(df._jdf.queryExecution().executedPlan()))

    yield run
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_pictures_of_one_stem_are_no_pairs(spark, join_rows):
    ids = spark.range(400)
    insights = ids.select(F.col("id").alias("insight_id"), F.when(F.col("id") < 200, "AA").otherwise(" ").alias("sha256"), F.lit("img/same.PNG").alias("file_name"), F.when(F.col("id") == 399, "lone").alias("image_id"))
    candidates = ids.select(F.col("id").alias("asset_id"), F.lit(1).alias("document_id"), F.lit("aa").alias("sha256"), F.when(F.col("id") == 7, "lone.png").when(F.col("id") > 300, "none.png").otherwise("Same.png").alias("source_name"))
    rows, most = join_rows(A.matched(insights, candidates))
    assert len(rows) == 400 and {r["strategy"] for r in rows} == {"ambiguous"} and most <= 401
    # equal rows of one picture are one picture; two stems may name the same one, or two
    few = spark.createDataFrame([(1, None, "x.png", "y"), (2, None, "x.png", None), (3, None, "x.png", "z")], "insight_id long, sha256 string, file_name string, image_id string")
    pics = spark.createDataFrame([(5, 2, "d", "x.png"), (5, 1, "d", "x.gif"), (5, 3, "d", "y.png"), (6, 1, "d", "z.png")], "asset_id long, document_id long, sha256 string, source_name string")
    assert {r["insight_id"]: (r["strategy"], r["asset_id"], r["document_id"]) for r in A.matched(few, pics).collect()} == {1: ("stem", 5, 1), 2: ("stem", 5, 1), 3: ("ambiguous", None, None)}


def test_texts_are_scored_where_they_are(spark, join_rows, monkeypatch):
    words = F.array(*(F.concat(F.lit("w"), F.chr(97 + F.pmod(F.hash(F.col("id"), F.lit(k)), F.lit(20)))) for k in range(12)))
    corpus = spark.range(300).select("id", F.concat(F.array_join(words, " "), F.when(F.col("id") % 30 == 0, " E07").otherwise("")).alias("text"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.array_join(words, " "), F.when(F.col("id") % 8 == 0, " e07").otherwise("")).alias("text"))
    rows, most = join_rows(S.bm25(corpus, queries, 7))
    assert len(rows) == 280 and most <= 300  # no row for each pair of a text and a query
    same = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    named = corpus.withColumn("id", F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 3, "0")))
    by_name, twice = same(S.bm25(named, queries, 7)), same(S.bm25(corpus.unionByName(corpus), queries, 7))
    monkeypatch.setattr(S, "MOST_ASKED", 0)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows) == same(S.bm25(corpus, queries, 7))
    assert by_name == same(S.bm25(named, queries, 7)) and twice == same(S.bm25(corpus.unionByName(corpus), queries, 7))


def test_nearest_points_of_a_crowd(spark, join_rows):
    at = lambda seed: (F.pmod(F.hash("id", F.lit(seed)), F.lit(10_000)) / 10_000) ** 2
    p = spark.range(300).select("id", at(1).alias("x"), at(2).alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("priority")).cache()
    points = [tuple(r) for r in p.collect()]
    square = lambda a, b: round((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, 8)
    want = {a[0]: min((square(a, b), b[0]) for b in points if a[0] != b[0]) for a in points}
    rows, most = join_rows(U.nearest_within(p, p, 0.25, distance=lambda x, y: x * x + y * y, apart=True))
    assert {r["id"]: (r["d"], r["near_id"]) for r in rows} == {k: v for k, v in want.items() if v[0] <= 0.25}
    assert most < 15_000  # of 90,000 pairs
    for tolerance in (0.02,):
        want = {}
        for a in points:
            d = [(round(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5, 8), -1 if b[3] is None else b[3], b[0]) for b in points]
            want[a[0]] = min((-x[1], x[0], x[2]) for x in d if x[0] <= min(d)[0] + tolerance)[1:]
        assert {r["id"]: (r["d"], r["near_id"]) for r in U.nearest_within(p, p, 0.25, tolerance).collect()} == want


def test_a_long_table_is_cut_in_time_with_its_lines(spark):
    import time

    from brindle.functions import text as T

    rows = spark.range(1).select(F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(12_000)), lambda k: F.concat(F.lit("line "), k.cast("string")))).alias("text"))
    begin = time.monotonic()
    pieces = rows.select(T.table_pieces(F.col("text")).alias("p")).first()["p"]
    assert time.monotonic() - begin < 10
    assert pieces == [f"line 0\nline {k}" for k in range(1, 12_001)]
    few = spark.createDataFrame([(" a \n\nb\r\nc",), ("only",), ("",), (None,)], "text string")
    assert [r["p"] for r in few.select(T.table_pieces(F.col("text")).alias("p")).collect()] == [["a\nb", "a\nc"], ["only"], [""], [None]]


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    from brindle.sources import tables

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.sha2(F.concat(F.col("id").cast("string"), k.cast("string")), 256)), " ")
    for n in (500, 2000):
        spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/{n}.parquet")
    monkeypatch.setattr(tables, "PART_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(tables, "SMALL_BYTES", 1 << 16, raising=False)
    few, many = (tables.spread(tables.table(spark, str(tmp_path), str(n))) for n in (500, 2000))
    # four times the rows are four times the parts, so none holds more
    assert many.rdd.getNumPartitions() > 3 * few.rdd.getNumPartitions() > 12
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most(many) < 2 * most(few) and many.count() == 2000
    assert "RoundRobin" not in many._jdf.queryExecution().toString()


def test_codes_are_read_of_hit_texts_alone(spark, monkeypatch):
    corpus = spark.range(50).select("id", (F.col("id") % 5).alias("parent_id"), F.concat(F.lit("E0"), (F.col("id") % 10).cast("string")).alias("text"))
    hits = spark.createDataFrame([(1, 3, 0.1, None, None, 1)], "query_id long, id long, rrf double, lex_score double, dense_score double, place int")
    queries = spark.createDataFrame([(1, "show E03")], "query_id long, text string")
    for found in (S.code_gate(hits.select("query_id", "id"), corpus, queries), S.scored_parents(hits, corpus, queries)):
        text = found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert text.index("regexp_extract_all") < text.rindex("join")  # above the join of hits and texts
        assert found.count() == 1


def _moves(df):
    """Shuffles of a plan, but for the one that deals the rows out; broadcasts are none."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x in lines if "Exchange" in x and "Broadcast" not in x and "REPARTITION" not in x]


def test_sums_of_dealt_texts_move_no_row(spark, monkeypatch):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.lit("w"), F.chr(97 + F.pmod(F.hash("id", k), F.lit(20))))), " ")
    corpus = spark.range(300).select("id", F.lit("about w").alias("title"), words.alias("text"))
    queries = spark.range(12).select(F.col("id").alias("query_id"), words.alias("text"))
    found = S.fields_bm25(corpus.repartition(9, "id"), queries, ["title", "text"], lambda t: S.T.all_of(F.lower(t), "[a-z]{2,}"))
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(found) == same(S.fields_bm25(corpus, queries, ["title", "text"], lambda t: S.T.all_of(F.lower(t), "[a-z]{2,}")))
    assert not [x for x in _moves(found) if "query_id" in x]


def test_a_vector_goes_once_to_a_part(spark, join_rows, monkeypatch):
    from brindle.operators import neighbours as N

    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.pmod(F.hash("id", k), F.lit(1000)) / 500 - 1).cast("float")).alias("v"))
    plain = sorted((r["id"], r["rank"], r["other"], r["d"]) for r in N.graph(rows).collect())
    assert len(plain) == 300 * N.K
    seen = []

    def counted(df):
        found, most = join_rows(df)
        seen.append(most)
        return spark.createDataFrame(found, df.schema)

    monkeypatch.setattr(N, "materialised", counted)
    monkeypatch.setattr(N, "MOST_FOUND", 500, raising=False)
    assert sorted((r["id"], r["rank"], r["other"], r["d"]) for r in N.graph(rows).collect()) == plain
    assert 0 < max(seen) <= 300 * spark.sparkContext.defaultParallelism
