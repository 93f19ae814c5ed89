"""Routing and gates: which path a question takes, what is missing, whether evidence covers it, whether a version may go out.

All are column expressions over one row per request, or one join with a small table of names. Vocabularies are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import codes as K
from brindle.functions import text as T


@dataclass(frozen=True)
class Routing:
    """Terms of the routing ladder; another language brings its own."""

    service: tuple[str, ...] = ("退款", "退货", "换货", "运费", "物流", "发票", "订单", "投诉", "售后", "保修", "维修费用", "免费维修", "免费更换", "赔付", "赔偿", "签收", "下单", "支付", "付款方式", "收货地址", "refund", "return", "shipping", "invoice", "warranty")
    technical: tuple[str, ...] = ("报错", "故障", "异常", "清洁", "安装", "拆卸", "连接", "充电", "错误码", "滤网", "电池", "按钮", "error", "install", "clean", "connect", "setup")
    mixed: tuple[str, ...] = ("报错", "故障", "异常", "错误码", "安装", "拆卸", "清洁", "连接", "设置", "充电", "滤网", "电池", "按钮", "error", "install", "clean", "connect", "setup")
    dispute: tuple[str, ...] = ("详情页", "描述不符", "实际不支持", "质量问题", "型号发错", "收到后发现", "要求退货退款")
    risk: tuple[str, ...] = ("冒烟", "火花", "起火", "漏电", "触电", "焦味", "焦糊味", "烧焦", "异味", "爆炸", "发烫", "烫手", "过热", "鼓包", "短路", "拆机", "拆开", "自行维修", "自己维修", "高温", "烫得厉害", "烫伤", "进水", "smoke", "fire", "electric shock", "disassemble")
    heat: str = "发热(?!量)"
    heat_context: tuple[str, ...] = ("产品", "设备", "机器", "电器", "家电", "插头", "插座", "充电器", "电源", "电源线", "外壳", "机身", "电池", "通电", "运行", "使用", "还能用", "继续用")
    order: tuple[str, ...] = ("订单号", "订单编号", "订单标识", "单号")
    domain: tuple[str, ...] = ("产品", "商品", "设备", "机器", "型号", "说明书", "手册", "官方参数")
    follow_up: tuple[str, ...] = ("继续使用", "还能使用", "能继续用", "还可以用", "继续操作")
    alarm: tuple[str, ...] = ("报警", "报错", "错误", "故障码", "指示灯", "error", "alarm")


NAME = r"(?<![A-Za-z0-9-])(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]+(?![A-Za-z0-9-])"


def names(text: Column) -> Column:
    """Distinct names with letters and digits, upper case."""
    return F.array_distinct(F.transform(T.all_of(text, NAME), F.upper))


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return T.any_term(text, list(terms))


def high_risk(text: Column, words: Routing = Routing()) -> Column:
    """A risk term, or heat of a thing in use."""
    return _any(text, words.risk) | (F.lower(text).rlike(words.heat) & _any(text, words.heat_context))


def route(text: Column, has_product: Column, words: Routing = Routing()) -> Column:
    """mixed, customer_service, technical or general; the first rule that holds decides."""
    named = ((F.size(names(text)) > 0) | K.has_display_code(text)) & ~_any(text, words.order)
    service, risk = _any(text, words.service), high_risk(text, words)
    technical = _any(text, words.technical) | named | has_product | _any(text, words.domain) | risk | _any(text, words.follow_up)
    return (
        F.when(service & risk, "mixed")
        .when(service & _any(text, words.dispute) & ~named, "customer_service")
        .when(service & (_any(text, words.mixed) | named | risk), "mixed")
        .when(service, "customer_service")
        .when(technical, "technical")
        .otherwise("general")
    )


def plan(route_: Column, has_images: Column) -> Column:
    """Tasks of a route in order (task, agent, depends_on): images first, then the domains, then the check."""
    first = F.when(has_images, F.array(F.lit("vision-1"))).otherwise(F.array().cast("array<string>"))
    task = lambda name, agent, on: F.struct(F.lit(name).alias("task"), F.lit(agent).alias("agent"), on.alias("depends_on"))
    knows, serves = route_.isin("technical", "mixed"), route_.isin("customer_service", "mixed")
    domain = F.filter(F.array(F.when(knows, "knowledge-1"), F.when(serves, "service-1")), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    tasks = F.array(F.when(has_images, task("vision-1", "multimodal", empty)), F.when(knows, task("knowledge-1", "knowledge", first)), F.when(serves, task("service-1", "customer-service", first)), task("verify-1", "verifier", domain))
    return F.filter(tasks, lambda x: x.isNotNull())


def products_of(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, products, retrieval_products, matched_aliases, confidence: the longest strong alias in a query names its products.

    queries: query_id, text; aliases: alias (lower case), product, strong, compatible (array). Weak aliases decide nothing.
    Queries are cut into the alias lengths that occur, so the join is by equality.
    """
    lengths = [r[0] for r in aliases.select(F.length("alias")).distinct().collect()]  # at most the longest alias
    low = F.lower(F.col("text"))

    def parts(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*map(parts, sorted(lengths)))))
    hits = queries.select("query_id", F.explode(grams).alias("alias")).join(aliases, "alias")
    best = hits.groupBy("query_id").agg(F.max(F.when(F.col("strong"), F.length("alias"))).alias("longest"), F.array_sort(F.collect_set("alias")).alias("all"))
    decisive = hits.join(best, "query_id").where(F.col("strong") & (F.length("alias") == F.col("longest")))
    order = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    named = decisive.groupBy("query_id").agg(F.array_sort(F.collect_set("product"), order).alias("products"), F.array_sort(F.collect_set("alias")).alias("decisive"), F.array_sort(F.collect_set(F.struct("product", "compatible"))).alias("pairs"))
    none = F.array().cast("array<string>")
    found = queries.select("query_id").join(best, "query_id", "left").join(named, "query_id", "left")
    products = F.coalesce("products", none)
    also = F.array_distinct(F.flatten(F.transform(products, lambda p: F.concat(F.array(p), F.flatten(F.transform(F.filter("pairs", lambda x: x["product"] == p), lambda x: x["compatible"]))))))
    confidence = F.when(F.size(products) == 0, 0.0).when(F.size(products) > 1, 0.86).otherwise(0.97)
    return found.select("query_id", products.alias("products"), F.when(F.size(products) > 0, also).otherwise(none).alias("retrieval_products"), F.coalesce("decisive", "all", none).alias("matched_aliases"), confidence.alias("confidence"))


def expanded(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id and text with the spellings of its codes and what its terms stand for. terms: source, target, position."""
    low = F.lower(F.col("text"))
    lists = terms.agg(F.array_sort(F.collect_list(F.struct("position", "source", "target"))).alias("terms"))  # a small table
    found = F.transform(F.filter("terms", lambda t: F.contains(low, t["source"])), lambda t: t["target"])
    parts = F.array_distinct(F.filter(F.concat(F.array(F.btrim("text")), K.search_forms(F.col("text")), found), lambda x: x != ""))
    return queries.crossJoin(F.broadcast(lists)).select("query_id", F.array_join(parts, " ").alias("text"))  # one row


def missing_fields(text: Column, route_: Column, slots: Column, has_product: Column, words: Routing = Routing()) -> Column:
    """Fields that a question still needs, in their order. slots: struct of product, model, error_code, order_identifier."""
    technical, service = route_.isin("technical", "mixed"), route_.isin("customer_service", "mixed")
    alarm = _any(text, words.alarm) | K.has_display_code(text)
    mine = F.array_except(names(text), names(F.coalesce(slots["product"], F.lit(""))))
    model, error = F.upper(F.coalesce(slots["model"], F.lit(""))), F.upper(F.coalesce(slots["error_code"], F.lit("")))
    models = F.filter(mine, lambda x: (x != model) & (x != error))
    errors = F.filter(F.array_union(mine, K.display_codes(text)), lambda x: x != model)
    fields = F.array(
        F.when(technical & slots["product"].isNull() & ~has_product, "product"),
        F.when(technical & slots["model"].isNull() & ((alarm & (F.size(models) == 0)) | (~alarm & ~has_product)), "model"),
        F.when(technical & alarm & slots["error_code"].isNull() & (F.size(errors) == 0), "error_code"),
        F.when(service & _any(text, words.order) & slots["order_identifier"].isNull(), "order_identifier"),
    )
    return F.filter(fields, lambda x: x.isNotNull())


def codes_supported(text: Column, slot_code: Column, support: Column) -> Column:
    """Whether every code of the question and the slot stands in the evidence; null where none is asked for."""
    asked = F.filter(F.array_union(K.codes(text), F.array(K.normalized_code(slot_code))), lambda x: x.isNotNull())
    return F.when(F.size(asked) > 0, F.size(F.array_except(asked, K.codes(support))) == 0)


def coverage(route_: Column, risk: Column, missing: Column, n_manual: Column, n_policy: Column, code_conflict: Column, disambiguate: Column, round_: Column, needs_domain: Column, rounds: int = 3) -> Column:
    """Status and final route of a request (struct): covered, clarifiable, general allowed, or handed off."""
    out = lambda status, final: F.struct(F.lit(status).alias("status"), F.lit(final).alias("final_route"))
    done = (risk == "high") | (round_ >= rounds)
    must = (F.size(missing) > 0) & (disambiguate | F.array_contains(missing, "order_identifier"))
    enough = F.when(route_ == "technical", n_manual > 0).when(route_ == "customer_service", n_policy > 0).otherwise((n_manual > 0) & (n_policy > 0))
    final = F.when(route_ == "technical", "technical_knowledge").otherwise(route_)
    hand_off, ask = out("unsafe_uncovered", "safe_handoff"), out("clarifiable", "evidence_clarification")
    return (
        F.when((route_ == "general") & needs_domain, hand_off)
        .when(route_ == "general", out("general_allowed", "general_llm"))
        .when(must & done, hand_off)
        .when(must, ask)
        .when(enough & ~code_conflict, F.struct(F.lit("covered").alias("status"), final.alias("final_route")))
        .when(done, hand_off)
        .when(F.size(missing) > 0, ask)
        .otherwise(hand_off)
    )


#: Order in which missing fields are asked for.
PRIORITY = ["product", "model", "error_code", "symptom", "attempted_action", "order_identifier", "service_request"]


def asked_field(missing: Column) -> Column:
    """The missing field to ask for: the first by priority, else the first; symptom where none is missing."""
    first = F.get(F.filter(F.array(*map(F.lit, PRIORITY)), lambda f: F.array_contains(missing, f)), F.lit(0))
    return F.coalesce(first, F.get(missing, F.lit(0)), F.lit("symptom"))


#: Terms of a service question, what to ask for then, and what to ask for otherwise.
TOPIC_RULES = [
    (("付款", "支付方式"), ["订单号", "订单状态（未付款/已付款/已发货）"]),
    (("收货地址", "改地址"), ["订单号", "订单物流状态", "新的收货地址"]),
    (("物流", "配送", "送达", "加急"), ["订单号", "收货地区", "当前物流状态"]),
    (("发票",), ["订单号或其他购买凭证", "购买渠道"]),
]
TOPIC_OTHERWISE = ["订单号", "签收时间", "商品使用情况", "问题证据"]


def missing_information(question: Column, rules: list[tuple[tuple[str, ...], list[str]]] = TOPIC_RULES, otherwise: list[str] = TOPIC_OTHERWISE) -> Column:
    """What a service question leaves open: the list of the first rule of whose terms it holds one, in the rules' order."""
    listed = lambda items: F.array(*map(F.lit, items))
    out = listed(otherwise)
    for terms, items in reversed(rules):
        out = F.when(T.any_term(question, list(terms)), listed(items)).otherwise(out)
    return out


def should_fall_back(confidence: Column, passed: Column, left_ms: Column) -> Column:
    return (confidence < 0.58) | ~passed | (left_ms < 1000)


def guard_reason(mode: Column, available: Column, fall_back: Column) -> Column:
    """Why the guard path answers; null where it does not."""
    return F.when(available & (mode == "champion_guarded"), "guarded").when(available & (mode == "legacy_only"), "legacy-only").when(available & fall_back, "fallback")


def answer_acceptable(question: Column, answer: Column, route_: Column, generic: list[str], service: list[str], seen: Column) -> Column:
    """Whether the guard path's answer keeps the question's names and codes and is no form letter (three service terms)."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\s+", "")
    kept = (F.size(F.array_except(K.codes(question), K.codes(answer))) == 0) & (F.size(F.array_except(names(question), names(answer))) == 0)
    form = F.exists(F.array(*map(F.lit, generic)), lambda t: F.contains(plain, t))
    n = sum((F.contains(plain, F.lit(t)).cast("int") for t in service), F.lit(0))
    return ~seen & (~route_.isin("technical", "mixed") | (kept & ~form & (n < 3)))


def provider_failure(status: Column, code: Column, message: Column, timeout: Column, transport: Column) -> Column:
    """Public code and whether a retry helps (struct); the first rule that holds decides."""
    c, m = F.replace(F.lower(F.coalesce(code, F.lit(""))), F.lit("-"), F.lit("_")), F.lower(F.coalesce(message, F.lit("")))
    out = lambda name, again: F.struct(F.lit(name).alias("code"), F.lit(again).alias("retryable"))
    return (
        F.when(timeout, out("provider_timeout", True))
        .when(F.contains(c, F.lit("embedding_count_mismatch")) | F.contains(m, F.lit("embedding-count-mismatch")), out("embedding_incomplete", False))
        .when(F.contains(m, F.lit("workspace")) & m.rlike("denied|mismatch"), out("workspace_denied", False))
        .when(c.isin("arrearage", "insufficient_balance", "billing_error"), out("billing_error", False))
        .when(status.isin(401, 403) | c.isin("invalid_api_key", "authentication_error", "unauthorized"), out("authentication_error", False))
        .when((status == 429) | c.isin("rate_limit", "rate_limit_exceeded"), out("rate_limit", True))
        .when(transport | (status >= 500), out("provider_unavailable", True))
        .otherwise(out("invalid_provider_response", False))
    )


def release_gate(score: Column, run_id: Column, run_found: Column, run_approved: Column, required: float = 0.88375) -> Column:
    """Status and reason of a candidate version (struct)."""
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(score.isNull(), out("awaiting_approval", "frozen_result_missing"))
        .when(score < required, out("rejected", "frozen_score_regression"))
        .when(run_id.isNull(), out("awaiting_approval", "evaluation_approval_missing"))
        .when(~run_found, out("awaiting_approval", "evaluation_run_missing"))
        .when(run_approved, out("approved", "all_gates_passed"))
        .otherwise(out("awaiting_approval", "evaluation_approval_missing"))
    )


def publish_refusals(cases: DataFrame, runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (dataset_id, version, run_id) with the reason why they may not be published; null where they may.

    cases: case_id, dataset_id, locked; runs: run_id, version, status, passed, case_ids.
    """
    locked = cases.where("locked").groupBy("dataset_id").agg(F.collect_set("case_id").alias("needed"))
    run = runs.select("run_id", F.col("version").alias("run_version"), "status", "passed", "case_ids")
    rows = candidates.join(locked, "dataset_id", "left").join(run, "run_id", "left")
    reason = (
        F.when(F.col("needed").isNull(), None)
        .when(F.col("run_id").isNull() | F.col("run_version").isNull(), "no-run")
        .when(F.col("run_version") != F.col("version"), "other-version")
        .when((F.col("status") != "approved") | ~F.col("passed"), "not-approved")
        .when(F.size(F.array_except("needed", "case_ids")) > 0, "cases-not-covered")
    )
    return rows.select("dataset_id", "version", "run_id", reason.alias("refusal"))


def may_activate(active: DataFrame, candidate: DataFrame, behaviour: list[str]) -> DataFrame:
    """dataset_id and may_activate: the artifacts (dataset_id, name, sha256) that shape answers are all there and equal.

    Datasets without an active version may always go on.
    """
    want = F.col("name").isin(behaviour)
    a = active.where(want).select("dataset_id", "name", F.col("sha256").alias("old"))
    same = candidate.where(want).join(a, ["dataset_id", "name"]).groupBy("dataset_id").agg(F.count_if(F.col("old") == F.col("sha256")).alias("n"))
    had = active.select("dataset_id").distinct().withColumn("had", F.lit(True))
    rows = candidate.select("dataset_id").distinct().join(had, "dataset_id", "left").join(same, "dataset_id", "left")
    return rows.select("dataset_id", (F.col("had").isNull() | (F.coalesce("n", F.lit(0)) == len(behaviour))).alias("may_activate"))
