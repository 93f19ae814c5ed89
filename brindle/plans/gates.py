"""Queries over routing, gates and confidences; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import scores as S
from brindle.operators import gates as G
from brindle.plans.registry import register
from brindle.plans.texts import codes_sql
from brindle.sources.tables import table

QUERIES: dict = {}
query = register(QUERIES)

#: Terms for the invented prose of the test tables, in place of the fixed ones.
WORDS = G.Routing(service=("the", "los"), technical=("tion", "ouch"), mixed=("tion",), dispute=("queo",), risk=("smoke", "fire", "wher"), heat="hot", heat_context=("on",), order=("orderid",), domain=("domain",), follow_up=("again",), alarm=("ed",))


def _like(terms) -> str:  # noqa: ANN001
    return "regexp_matches(lower(text), '" + "|".join(terms) + "')"


_NAMES = "list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda x: regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]')), lambda x: upper(x)))"
_DISPLAY = "regexp_matches(regexp_replace(text, '([A-Za-z0-9]+)', '⟦\\1⟧', 'g'), '(?i)⟦(?:ERR(?:⟧[ \\t\\n\\r_-]*⟦)?(?:[0-9]{1,3}|CF)|NO(?:⟧[ \\t\\n\\r_-]*⟦)?CF|FULL(?:⟧[ \\t\\n\\r_-]*⟦)?CF)⟧')"
_ROUTED = f"""with t as (select conv_id, turn, text, {_like(WORDS.service)} as s, ({_like(WORDS.risk)} or (regexp_matches(lower(text), 'hot') and {_like(WORDS.heat_context)})) as r,
 (len({_NAMES}) > 0 or {_DISPLAY}) and not {_like(WORDS.order)} as n, {_like(WORDS.technical)} as k, {_like(WORDS.mixed)} as m, {_like(WORDS.dispute)} as d, {_like(WORDS.domain + WORDS.follow_up)} as o from conversations),
r as (select *, case when s and r then 'mixed' when s and d and not n then 'customer_service' when s and (m or n or r) then 'mixed' when s then 'customer_service' when k or n or o or r then 'technical' else 'general' end as route from t)"""


@query(_ROUTED + " select conv_id, turn, r as risk, route from r")
def intent_route(spark, sf):  # noqa: ANN001, ANN201
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", G.high_risk(t, WORDS).alias("risk"), G.route(t, F.lit(False), WORDS).alias("route"))


@query(_ROUTED + " select conv_id, turn, concat_ws(',', case when turn % 2 = 0 then 'multimodal' end, case when route in ('technical', 'mixed') then 'knowledge' end, case when route in ('customer_service', 'mixed') then 'customer-service' end, 'verifier') as agents, (case when route = 'mixed' then 2 when route = 'general' then 0 else 1 end)::int as n_waited from r")
def task_plan(spark, sf):  # noqa: ANN001, ANN201
    tasks = G.plan(G.route(F.col("text"), F.lit(False), WORDS), F.col("turn") % 2 == 0)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tasks.alias("tasks"))
    return rows.select("conv_id", "turn", F.array_join("tasks.agent", ",").alias("agents"), F.size(F.element_at("tasks", -1)["depends_on"]).alias("n_waited"))


_ALIASES = "(values ('the', 'p1', true, ['p9']), ('tion', 'p2', true, []), ('ouch', 'P2', true, []), ('queo', 'p3', true, ['p1']), ('on', 'p4', false, [])) as a(alias, product, strong, compatible)"


def _aliases(spark):  # noqa: ANN001, ANN202
    rows = [("the", "p1", True, ["p9"]), ("tion", "p2", True, []), ("ouch", "P2", True, []), ("queo", "p3", True, ["p1"]), ("on", "p4", False, [])]
    return spark.createDataFrame(rows, "alias string, product string, strong boolean, compatible array<string>")


@query(
    f"""with h as (select item_id as query_id, alias, product, strong from benchmark, {_ALIASES} where contains(lower(text), alias)), b as (select query_id, max(length(alias)) filter (where strong) as longest from h group by 1),
d as (select h.* from h join b using (query_id) where strong and length(alias) = longest),
p as (select query_id, count(distinct product) as n from d group by 1)
select item_id as query_id, coalesce((select string_agg(q.product, ',' order by lower(q.product), q.product) from (select distinct product from d where d.query_id = item_id) q), '') as products,
 coalesce((select string_agg(q.alias, ',' order by q.alias) from (select distinct alias from d where d.query_id = item_id) q), (select string_agg(q.alias, ',' order by q.alias) from (select distinct alias from h where h.query_id = item_id) q), '') as aliases,
 (case coalesce(n, 0) when 0 then 0 when 1 then 0.97 else 0.86 end)::double as confidence from benchmark left join p on p.query_id = item_id"""
)
def product_route(spark, sf):  # noqa: ANN001, ANN201
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.products_of(q, _aliases(spark)).select("query_id", F.array_join("products", ",").alias("products"), F.array_join("matched_aliases", ",").alias("aliases"), "confidence")


@query("select item_id as query_id, concat_ws(' ', trim(text), 'ERR 07', 'ERR07', 'ERR_07', case when contains(lower(text), 'the') then 'article' end, case when contains(lower(text), 'tion') then 'noun ending' end) as text from (select item_id, text || ' err-7' as text from benchmark) where not regexp_matches(text, '(?i)err[^-]')")
def query_expansion(spark, sf):  # noqa: ANN001, ANN201
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" err-7")).alias("text")).where("not rlike(text, '(?i)err[^-]')")
    terms = spark.createDataFrame([("tion", "noun ending", 2), ("the", "article", 1), ("zzzz", "none", 3)], "source string, target string, position int")
    return G.expanded(q, terms)


_MISSING = f"""with t as (select conv_id, turn, text, turn % 3 as k, case turn % 3 when 0 then 'technical' when 1 then 'mixed' else 'customer_service' end as route, {_NAMES} as n, {_like(WORDS.alarm)} or {_DISPLAY} as alarm,
 {codes_sql('text')} as codes, turn % 5 = 0 as has_p, turn % 7 = 0 as has_m, turn % 4 = 0 as has_o from conversations)
select conv_id, turn, concat_ws(',', case when k < 2 and not has_p then 'product' end, case when k < 2 and not has_m and ((alarm and len(list_filter(n, lambda x: x <> 'E03')) = 0) or (not alarm)) then 'model' end, case when k > 0 and {_like(WORDS.order)} and not has_o then 'order_identifier' end) as missing from t"""


@query(_MISSING)
def missing_fields(spark, sf):  # noqa: ANN001, ANN201
    turn = F.col("turn")
    slots = F.struct(F.when(turn % 5 == 0, "pump").alias("product"), F.when(turn % 7 == 0, "M1").alias("model"), F.lit("E03").alias("error_code"), F.when(turn % 4 == 0, "o1").alias("order_identifier"))
    route = F.when(turn % 3 == 0, "technical").when(turn % 3 == 1, "mixed").otherwise("customer_service")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(G.missing_fields(F.col("text"), route, slots, F.lit(False), WORDS), ",").alias("missing"))


_COVER = """with c as (select event_id as id, ['general', 'technical', 'customer_service', 'mixed'][1 + event_id % 4] as route, case when event_id % 5 = 0 then 'high' else 'low' end as risk, event_id % 3 as missing, event_id % 7 > 2 as manual, event_id % 11 > 4 as policy,
 event_id % 13 = 0 as conflict, event_id % 2 = 0 as ask, event_id % 6 as round, event_id % 17 = 0 as domain from events),
s as (select *, risk = 'high' or round >= 3 as done, missing > 0 and (ask or missing = 2) as must, case route when 'technical' then manual when 'customer_service' then policy else manual and policy end as enough from c)"""


@query(
    _COVER
    + """ select id, case when route = 'general' and domain then 'unsafe_uncovered' when route = 'general' then 'general_allowed' when must and done then 'unsafe_uncovered' when must then 'clarifiable' when enough and not conflict then 'covered'
 when done then 'unsafe_uncovered' when missing > 0 then 'clarifiable' else 'unsafe_uncovered' end as status,
 case when route = 'general' and domain then 'safe_handoff' when route = 'general' then 'general_llm' when must and done then 'safe_handoff' when must then 'evidence_clarification'
 when enough and not conflict then case route when 'technical' then 'technical_knowledge' else route end when done then 'safe_handoff' when missing > 0 then 'evidence_clarification' else 'safe_handoff' end as final_route,
 case missing when 1 then 'model' when 2 then 'order_identifier' else 'symptom' end as field from s"""
)
def coverage_gate(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    route = F.get(F.array(*map(F.lit, ["general", "technical", "customer_service", "mixed"])), (i % 4).cast("int"))
    missing = F.when(i % 3 == 1, F.array(F.lit("model"))).when(i % 3 == 2, F.array(F.lit("order_identifier"))).otherwise(F.array().cast("array<string>"))
    gate = G.coverage(route, F.when(i % 5 == 0, "high").otherwise("low"), missing, (i % 7 > 2).cast("int"), (i % 11 > 4).cast("int"), i % 13 == 0, i % 2 == 0, i % 6, i % 17 == 0)
    return table(spark, sf, "events").select(i.alias("id"), gate.alias("g"), G.asked_field(missing).alias("field")).select("id", "g.status", "g.final_route", "field")


@query(f"with t as (select doc_id as id, {codes_sql('text')} as held, list_distinct(['E0' || (doc_id % 10), 'ERR 0' || (doc_id % 4)]) as asked, doc_id % 10 as a, doc_id % 4 as b, {codes_sql(chr(39) + 'E01 E03 err 2' + chr(39) + ' || text')} as support from documents) select id, list_has_all(support, asked) as supported from t")
def code_support(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    question = F.concat(F.lit("why E0"), (i % 10).cast("string"), F.lit("?"))
    return table(spark, sf, "documents").select(i.alias("id"), G.codes_supported(question, F.concat(F.lit("err"), (i % 4).cast("string")), F.concat(F.lit("E01 E03 err 2"), "text")).alias("supported"))


@query(
    """select event_id as id, case when k = 0 then 'provider_timeout' when k = 1 then 'embedding_incomplete' when k = 2 then 'workspace_denied' when k = 3 then 'billing_error' when k = 4 then 'authentication_error' when k = 5 then 'rate_limit' when k in (6, 7) then 'provider_unavailable' else 'invalid_provider_response' end as code,
 k in (0, 5, 6, 7) as retryable from (select event_id, event_id % 9 as k from events)"""
)
def provider_failures(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("event_id") % 9
    status = F.when(k == 4, 401).when(k == 5, 429).when(k == 6, 503).otherwise(200)
    code = F.when(k == 1, "Embedding-Count-Mismatch").when(k == 3, "Arrearage").otherwise("other")
    message = F.when(k == 2, "Workspace access DENIED").otherwise("denied")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), G.provider_failure(status, code, message, k == 0, k == 7).alias("f")).select("id", "f.code", "f.retryable")


@query(
    """select event_id as id, case when value is null or event_id % 6 = 0 then 'frozen_result_missing' when value / 100 < 0.88375 then 'frozen_score_regression' when event_id % 4 = 0 then 'evaluation_approval_missing' when event_id % 5 = 0 then 'evaluation_run_missing' when event_id % 3 = 0 then 'all_gates_passed' else 'evaluation_approval_missing' end as reason,
 event_id % 6 > 0 and (value < 50 or event_id % 3 = 0) as falls_back, case when event_id % 3 = 0 then null when event_id % 3 = 1 then 'guarded' when value < 50 then 'fallback' end as guard from events where value is not null"""
)
def eval_gate(spark, sf):  # noqa: ANN001, ANN201
    i, v = F.col("event_id"), F.col("value")
    gate = G.release_gate(F.when(i % 6 > 0, v / 100), F.when(i % 4 > 0, i), i % 5 > 0, i % 3 == 0)
    fall = (i % 6 > 0) & G.should_fall_back(F.when(v < 50, 0.5).otherwise(0.6), i % 3 > 0, F.lit(2000))
    guard = G.guard_reason(F.when(i % 3 == 1, "champion_guarded").otherwise("new"), i % 3 > 0, v < 50)
    return table(spark, sf, "events").where("value is not null").select(i.alias("id"), gate["reason"].alias("reason"), fall.alias("falls_back"), guard.alias("guard"))


@query(
    """with c as (select source as dataset_id, doc_id::varchar as case_id from documents where doc_id % 4 = 0), n as (select dataset_id, list(case_id) as needed from c group by 1),
r as (select s as dataset_id, k, k % 5 as kind from (select source as s, row_number() over (order by source) as k from (select distinct source from documents)))
select r.dataset_id, case when needed is null then null when kind = 0 then 'no-run' when kind = 1 then 'other-version' when kind = 2 then 'not-approved' when kind = 3 then 'cases-not-covered' end as refusal from r left join n using (dataset_id)"""
)
def publish_approval(spark, sf):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    cases = d.select(F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("dataset_id"), (F.col("doc_id") % 4 == 0).alias("locked"))
    names = d.select(F.col("source").alias("dataset_id")).distinct()
    kind = F.row_number().over(Window.orderBy("dataset_id")) % 5  # a handful of names
    cand = names.withColumn("kind", kind).withColumn("run_id", F.when(F.col("kind") > 0, F.concat(F.lit("r"), "dataset_id"))).withColumn("version", F.lit("v2"))
    runs = cand.where("kind > 0").join(cases.where("locked").groupBy("dataset_id").agg(F.collect_set("case_id").alias("all")), "dataset_id", "left")
    runs = runs.select("run_id", F.when(F.col("kind") == 1, "v1").otherwise("v2").alias("version"), F.when(F.col("kind") == 2, "failed").otherwise("approved").alias("status"), F.lit(True).alias("passed"), F.when(F.col("kind") == 3, F.array(F.lit("x"))).otherwise(F.coalesce("all", F.array().cast("array<string>"))).alias("case_ids"))
    return G.publish_refusals(cases, runs, cand).select("dataset_id", "refusal")


@query("with a as (select source as dataset_id, lang as name, count(*) as n, count(*) filter (where doc_id % 10 < 9) as m from documents group by 1, 2), b as (select dataset_id, count(*) filter (where n = m and name in ('en', 'fr')) as same, sum(m) = 0 as new from a group by 1) select dataset_id, same = 2 or new as may_activate from b")
def bundle_activation(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("lang").alias("name"), "doc_id")
    digest = lambda df: df.groupBy("dataset_id", "name").agg(F.count("*").cast("string").alias("sha256"))
    return G.may_activate(digest(d.where("doc_id % 10 < 9")), digest(d), ["en", "fr"])


@query("""select event_id as id, round(least(0.99::double, 0.5::double + least(0.4::double, 8 * v) + 0.05::double * v), 4) as hit, round(least(0.95::double, 0.5::double + v / 20), 4) as simple, least(1.0::double, least(0.88::double, 0.42::double + least(0.42::double, 8 * v))) as q,
 round(least(0.93::double, greatest(0.15::double, 0.4::double * v + 0.33::double * v + least(0.12::double, greatest(0, length(props) - 20) / 900.0::double * 0.12::double) + 0.07::double)), 4) as guard,
 round(least(0.92::double, greatest(0.32::double, 0.68::double * least(1, v) + 0.32::double * (0.52::double + least(0.14::double, greatest(0, length(props) - 20) / 900.0::double * 0.14::double) + 0.04::double))), 4) as general from (select *, abs(value) / 977 as v from events where value is not null)""")
def confidences(spark, sf):  # noqa: ANN001, ANN201
    v = F.abs("value") / 977
    return table(spark, sf, "events").where("value is not null").select(F.col("event_id").alias("id"), S.hit_confidence(v, v).alias("hit"), S.overlap_confidence(v).alias("simple"), S.quality(F.lit(None).cast("double"), v).alias("q"), S.guard_confidence(v, v, F.col("props")).alias("guard"), S.general_confidence(F.col("props"), v, F.lit(False)).alias("general"))


@query(
    """with r as (select user_id, least(1.0::double, greatest(0.0::double, value / 100)) as q, row_number() over (partition by user_id order by ts, event_id) as k from events where value is not null),
a as (select user_id, count(*) as n, max(q) filter (where k = 1) as first, sum(q / k) / sum(1.0::double / k) as mean from r where k <= 5 group by 1)
select user_id, round(mean, 6) as mean, round(least(0.97::double, greatest(0.2::double, 0.35::double * first + 0.35::double * mean + 0.2::double * least(1.0::double, n / 5.0::double) + 0.04::double * (2 / 3.0::double) + 0.06::double)), 4) as confidence from a"""
)
def evidence_confidences(spark, sf):  # noqa: ANN001, ANN201
    """Five ranked qualities of each user."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    r = table(spark, sf, "events").where("value is not null").select("user_id", S.between(F.col("value") / 100, 0.0, 1.0).alias("q"), rank.alias("k")).where("k <= 5")
    lists = r.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("qs"))
    return lists.select("user_id", F.round(S.harmonic_mean(F.col("qs")), 6).alias("mean"), S.evidence_confidence(F.col("qs"), F.lit(2)).alias("confidence"))
