"""Literal cases: codes, search with a code gate, the verifier, slots, sessions, sections, routing, streams and files."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import codes as K
from brindle.functions import lists as N
from brindle.functions import text as T
from brindle.operators import assets as A
from brindle.operators import chunking as C
from brindle.operators import conversation as M
from brindle.operators import gates as G
from brindle.operators import keyed as Y
from brindle.operators import lifecycle as L
from brindle.operators import search as S
from brindle.operators import verify as V


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("err 2", "ERR 02"), ("ERR_020", "ERR 020"), ("no-cf", "NO CF"), ("Full  cf", "FULL CF"), ("e-03", "E03"), ("ab123", "AB123"), ("abcd12", None), ("E3", None), ("Err CF", "ERR CF")])
def test_one_form_of_a_code(spark, raw, want):
    assert one(spark, K.normalized_code(F.col("x")), x=raw) == want


def test_codes_in_order(spark):
    text = "E03 then Err 2, err02 (no cf) AB-123; wxyE03 A1-b2 Err 020"
    assert one(spark, K.codes(F.col("x")), x=text) == ["E03", "ERR 02", "NO CF", "AB123", "ERR 020"]
    assert one(spark, K.search_forms(F.col("x")), x="Err 2") == ["ERR 02", "ERR02", "ERR_02"]
    assert one(spark, K.other_codes(F.col("x")), x="E03 DCB107-x9 xe0312") == ["dcb107-x9", "xe0312"]


def corpus(spark):
    rows = [(1, 10, "Pump E03", "error E03 shows when the pump is blocked"), (2, 10, "Pump", "for E03 clean the pump filter"), (3, 11, "Door", "the door is open"), (4, 12, "Camera", "Err 02 lens error of the camera"), (5, 13, "Camera", "Err 020 card error of the camera")]
    return spark.createDataFrame(rows, "id long, parent_id long, title string, text string").withColumn("text", F.concat_ws(" ", "title", "text"))


@pytest.fixture(scope="module")
def searched(spark):
    q = spark.createDataFrame([(1, "pump E03"), (2, "quantum banana"), (3, "pump Z99 blocked"), (4, "ERR_02 camera"), (5, "err 020")], "query_id long, text string")
    vectors = corpus(spark).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    asked = q.where("query_id = 3").select("query_id", F.array(F.lit(1.0), F.lit(1.0)).alias("v"))
    return S.explained(corpus(spark), q, vectors, asked)


def test_search_with_codes(searched):
    found = {(r["query_id"], r["rank"]): r for r in searched["parent"].collect()}
    assert found[1, 1]["parent_id"] == 10 and sorted(found[1, 1]["matched"]) == [1, 2] and found[1, 1]["lexical"] > 0
    assert found[4, 1]["parent_id"] == 12 and found[5, 1]["parent_id"] == 13
    assert {k[0] for k in found} == {1, 4, 5}
    rejected = {r["query_id"]: r["reason"] for r in searched["rejected"].collect()}
    assert rejected == {2: "below-threshold", 3: "codes-missing"}


def test_search_filters_before_statistics(spark):
    c = corpus(spark).withColumn("product", F.when(F.col("id") < 3, "pump").otherwise("other")).withColumn("dataset_id", F.lit("d"))
    q = spark.createDataFrame([(1, "clean the pump")], "query_id long, text string")
    out = S.explained(c, q, products=["pump"], datasets=[], rerank=lambda query, text: F.length(text))
    assert {r["id"] for r in out["lexical"].collect()} == {1, 2} and out["rerank"].where("rerank > 0").count() == 2


CASES = [
    ("1. 断电\n2. 拆盖\n3. 清洁", "manual", "断电后清洁，再拆盖", "safety-step-order-mismatch"),
    ("冒烟时严禁继续使用", "manual", "可以继续使用", "contradicts-prohibition"),
    ("是否维修以检测为准", "policy", "我们免费维修，24小时内赔付", "unsupported-service-commitment"),
    ("符合条件可免费维修", "policy", "符合条件可免费维修", None),
    ("清洗 2\\~3 cycles", "manual", "清洗 3次", None),
    ("疑似 e03", "vision", "已经确认是 e03", "visual-observation-promoted"),
    ("turn e03 off", "manual", "turn e05 off", "unsupported-number-or-model"),
]


@pytest.mark.parametrize(("support", "kind", "claim", "issue"), CASES)
def test_claims_against_evidence(spark, support, kind, claim, issue):
    claims = spark.createDataFrame([("a", "c", claim, ["e"])], "answer_id string, claim_id string, text string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("a", "e", kind, "", support, 0.9, 0.5)], "answer_id string, evidence_id string, source_type string, title string, text string, confidence double, score double")
    found = V.claim_issues(claims, evidence).first()["issues"]
    assert (issue in found) if issue else found == [], found
    assert V.claim_issues(claims, evidence, enhanced=False).first()["issues"] == []


@pytest.mark.parametrize(("term", "support", "want"), [("15分钟", "wait10-15minutes", True), ("99分钟", "wait10-15minutes", False), ("7月", "2026-07-23", True), ("23日", "2026-07-23", True), ("2026年", "2026-07-23", True), ("8月", "7/21-7/23", False)])
def test_measured_values(spark, term, support, want):
    assert one(spark, V.measure_supported(F.col("t"), F.col("s")), t=term, s=support) is want


def test_slots(spark):
    rows = [("a", 1, "error_code", "E03", "explicit_user"), ("a", 2, "error_code", "E30", "explicit_user"), ("b", 1, "error_code", "E03", "explicit_user"), ("b", 2, "error_code", "E09", "ocr"), ("c", 1, "product", "pump", "explicit_user"), ("c", 1, "model", "M1", "explicit_user"), ("c", 2, "product", "door", "explicit_user"), ("c", 3, "model", "M2", "vlm")]
    state = {(r["conv_id"], r["turn"], r["slot"]): (r["active"], r["changes"]) for r in M.slot_states(spark.createDataFrame(rows, "conv_id string, turn int, slot string, value string, kind string")).collect()}
    assert state["a", 2, "error_code"] == ("E30", 2) and state["b", 2, "error_code"] == ("E03", 1) and state["c", 3, "model"] == ("M2", 2)
    turns = spark.createDataFrame([("a", 1, "user", "错误码是 E03"), ("a", 2, "user", "不是E03，而是E30"), ("a", 3, "user", "型号：DCB-107 显示 Err 2")], "conv_id string, turn int, role string, text string")
    said = {(r["turn"], r["slot"]): r["value"] for r in M.said_slots(turns).collect()}
    assert said == {(1, "error_code"): "E03", (2, "error_code"): "E30", (3, "model"): "DCB-107", (3, "error_code"): "ERR 02"}


def test_sessions_and_summaries(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    saves = spark.createDataFrame([("s", t, ["p1"]), ("s", t + timedelta(seconds=10), []), ("s", t + timedelta(seconds=20), ["p2"]), ("s", t + timedelta(seconds=321), [])], "session_id string, at timestamp, products array<string>")
    out = [(r["products"], r["switched"], r["n_saves"]) for r in M.session_memory(saves, "300 seconds").orderBy("at").collect()]
    assert out == [(["p1"], False, 1), (["p1"], False, 2), (["p2"], True, 3), ([], False, 1)]


def test_sections_rename_and_drop(spark):
    text = "# A\n## B\nbody\n\n# C\n# D"
    d = spark.createDataFrame([(1, "doc", text), (2, "only", None)], "id long, title string, text string")
    got = [(r["id"], r["section"], r["title"], r["text"]) for r in C.sections(d, C.blocks(F.col("text"))).orderBy("id", "section").collect()]
    assert got == [(1, 0, "B", "body"), (2, 0, "only", "only")]
    assert C.cut("x" * 600) == ["x" * 520, "x" * 150] and C.cut("") == [""]
    for profile in ("general", "manual", "qa", "table", "picture"):
        assert C.chunks(C.sections(d, C.blocks(F.col("text"))), profile).count() >= 2
    with pytest.raises(ValueError):
        C.chunks(d, "other")


@pytest.mark.parametrize(("text", "want"), [("洗衣机报错 E03", "technical"), ("我要退款", "customer_service"), ("机器冒烟了，要退款", "mixed"), ("帮我改写这段话", "general"), ("煤炭的发热量是多少", "general"), ("插头发热", "technical"), ("质量问题要退货退款", "customer_service")])
def test_routes(spark, text, want):
    assert one(spark, G.route(F.col("x"), F.lit(False)), x=text) == want


def test_budget_skips_and_goes_on(spark):
    turns = spark.createDataFrame([("c", 1, "a" * 40), ("c", 2, "b" * 400), ("c", 3, "c" * 40), ("c", 4, "")], "conv_id string, ordinal int, text string")
    asked = spark.createDataFrame([("c", "d" * 20, "")], "conv_id string, text string, summary string")
    taken = {r["ordinal"]: r["taken"] for r in M.prompt_window(turns, asked, 40).collect()}
    assert taken == {1: True, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("text", ["", "abcdefgh", "数字一二三", "ab一cd二efgh 三", "   x" * 30])
def test_truncation_against_the_rule(spark, text):
    def cost(x):
        wide = sum("一" <= c <= "鿿" for c in x)
        return wide + -(-(len(x) - wide) // 4)

    for budget in (0, 1, 2, 3, 7):
        best = max(k for k in range(len(text) + 1) if cost(text[:k]) <= budget)
        assert one(spark, T.within_budget(F.col("x"), budget), x=text) == text[:best].rstrip(" \t\n\r"), budget


def test_versions_and_assets(spark):
    docs = spark.createDataFrame([("A", "v-a", None), ("B", "v-b", None)], "document_id string, active string, published string")
    children = spark.createDataFrame([(1, "A", "v-a"), (2, "B", "v-b")], "child_id long, document_id string, version string")
    first = Y.published(docs, F.lit("v-a"))
    both = Y.published(first, F.lit("v-b"))
    seen = lambda d: {r["child_id"] for r in L.visible(children, d.withColumn("enabled", F.lit(True))).collect()}
    assert seen(first) == {1} and seen(both) == {1, 2}
    assert {r["child_id"] for r in L.replaced(children, children.where("document_id = 'A'").withColumn("child_id", F.lit(9).cast("long")), "document_id").collect()} == {9, 2}
    insights = spark.createDataFrame([(1, "AA", "x/other.png", None), (2, "", "x/Fig-1.png", None), (3, None, "dup.png", None), (4, None, "none.png", None)], "insight_id int, sha256 string, file_name string, image_id string")
    pics = spark.createDataFrame([("p1", "d", "aa", "zzz.png"), ("p2", "d", "bb", "fig1.jpg"), ("p3", "d", "cc", "dup.png"), ("p4", "d", "dd", "DUP.jpg")], "asset_id string, document_id string, sha256 string, source_name string")
    got = {r["insight_id"]: (r["strategy"], r["asset_id"]) for r in A.matched(insights, pics).collect()}
    assert got == {1: ("sha256", "p1"), 2: ("stem", "p2"), 3: ("ambiguous", None), 4: ("unmatched", None)}


@pytest.mark.parametrize(("op", "other", "want"), [("=", 3, [3]), ("≠", 3, [1, 2]), (">", 1, [2, 3]), ("≥", 2, [2, 3]), ("<", 2, [1]), ("≤", 2, [1, 2]), ("in", [1, 9], [1]), ("not in", [1, 9], [2, 3]), ("not empty", None, [1, 2, 3]), ("empty", None, [])])
def test_list_filters(spark, op, other, want):
    assert one(spark, N.filtered(F.array(*map(F.lit, (1, 2, 3))), op, other), x=1) == want


def test_assignments(spark):
    xs = F.array(F.lit(1), F.lit(2))
    got = [one(spark, N.assigned(xs, op, v), x=1) for op, v in (("append", F.lit(3)), ("extend", xs), ("remove_first", None), ("remove_last", None), ("clear", None))]
    assert got == [[1, 2, 3], [1, 2, 1, 2], [2], [1], None]
    assert one(spark, N.assigned(F.lit(6.0), "/=", F.lit(0.0)), x=1) is None and one(spark, N.assigned(F.lit(6.0), "*=", F.lit(2.0)), x=1) == 12.0


def test_streamed_units(spark, tmp_path):
    from brindle.streaming import requests as R

    rows = [("a", 1, "One. Two! Th", False), ("a", 2, "ree? rest", True), ("b", 1, "half", False)]
    spark.createDataFrame(rows, "answer_id string, seq long, delta string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("answer_id string, seq long, delta string, last boolean").parquet(str(tmp_path / "in"))
    done = R.buffered_units(stream).writeStream.format("memory").queryName("units").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = [(r["answer_id"], r["place"], r["unit"]) for r in spark.table("units").orderBy("answer_id", "place").collect()]
    assert got == [("a", 0, "One. Two!"), ("a", 1, " Three?"), ("a", 2, " rest")]


def test_files(spark, tmp_path):
    from brindle.operators import bundle as B
    from brindle.sources import files as S_

    (tmp_path / "q.csv").write_bytes("﻿id,question\n1,\"two\nlines\"\n2,中文\n".encode())
    assert [(r["id"], r["question"]) for r in S_.read_questions(spark, str(tmp_path / "q.csv")).collect()] == [("1", "two\nlines"), ("2", "中文")]
    (tmp_path / "g.csv").write_bytes("id,question\n1,中文问题\n".encode("gb18030"))
    assert S_.read_questions(spark, str(tmp_path / "g.csv")).first()["question"] == "中文问题"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# H\ntext", encoding="utf-8")
    (tmp_path / "t" / "b.bin").write_bytes(b"\x00\x01")
    assert [(r["title"], r["markdown"], r["text"]) for r in S_.read_texts(spark, str(tmp_path / "t")).collect()] == [("a", True, "# H\ntext")]
    rows = spark.createDataFrame([(2, "b", None), (1, "a", [1.0])], "id long, name string, v array<double>")
    B.write_json_lines(rows, str(tmp_path / "out"), ["id"])
    assert [r["id"] for r in B.read_json_lines(spark, str(tmp_path / "out"), rows.schema).orderBy("id").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"id":1,"name":"x"}\n[1]\n\n{oops\n')
    assert B.read_json_lines(spark, str(tmp_path / "bad.jsonl"), rows.schema, strict=False).count() == 1
    with pytest.raises(Exception, match="no JSON object"):
        B.read_json_lines(spark, str(tmp_path / "bad.jsonl"), rows.schema).collect()
    S_.write_submission(spark.createDataFrame([("x", 'say "hi"', 2), ("y", "one", 1)], "id string, ret string, pos int"), str(tmp_path / "sub"))
    assert [r["id"] for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "sub")).collect()] == ["y", "x"]
    sse = spark.createDataFrame([("data: {\"a\":1}",), (": ping",), ("data: [DONE]",)], "value string")
    assert [r["event"]["a"] for r in S_.decoded_events(sse, "a int").collect()] == [1]


def test_bundles_are_written_once(spark, tmp_path):
    from brindle.operators import bundle as B

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    path = str(tmp_path / "v1")
    first = {r["name"]: tuple(r) for r in B.write_bundle({"children": rows, "parents": rows.limit(1)}, path).collect()}
    again = {r["name"]: tuple(r) for r in B.write_bundle({"children": rows.limit(0)}, path).collect()}
    assert first == again and first["children"][1] == 2
    assert B.read_bundle(spark, path)["children"].count() == 2
    rows.limit(1).write.mode("overwrite").parquet(f"{path}/children")
    with pytest.raises(ValueError, match="children"):
        B.read_bundle(spark, path)
