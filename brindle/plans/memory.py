"""Queries over conversation state: slots, turns, summaries, prompt windows, sessions; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import conversation as C
from brindle.plans.registry import register
from brindle.sources.tables import table

QUERIES: dict = {}
query = register(QUERIES)

#: Patterns for the invented prose of the test tables.
PATTERNS = {"model": "the([a-z]+)", "error_code": "(on[a-z]{2,})", "symptom": "(hand[a-z ]{2,20})", "attempted_action": "(inan[a-z]+)", "order_identifier": "(?<![A-Za-z0-9_])([a-z]{3}ou)(?![A-Za-z0-9_])"}

_OBSERVED = """with e as (select user_id as conv_id, event_id as turn, case event_type when 'view' then 'product' when 'click' then 'model' when 'error' then 'error_code' else 'symptom' end as slot, (event_id % 3)::varchar as value, event_id % 5 < 3 as explicit from events),
r as (select conv_id, turn, slot, case when explicit then value end as said, case when not explicit then value end as seen from e),
h as (select *, coalesce(last_value(said ignore nulls) over w, last_value(seen ignore nulls) over w) as held from r window w as (partition by conv_id, slot order by turn rows between unbounded preceding and 1 preceding)),
m as (select *, case when slot = 'product' and said is not null and held <> said then 1 else 0 end as reset from h),
p as (select *, case when slot in ('product', 'model', 'error_code') then sum(reset) over (partition by conv_id order by turn rows unbounded preceding) else 0 end as epoch from m),
a as (select *, coalesce(last_value(said ignore nulls) over w, last_value(seen ignore nulls) over w) as active, last_value(said ignore nulls) over w is not null as by_user from p window w as (partition by conv_id, slot, epoch order by turn rows unbounded preceding)),
n as (select *, case when lag(active) over w is null or lag(active) over w <> active or lag(epoch) over w <> epoch then 1 else 0 end as new from a window w as (partition by conv_id, slot order by turn))
select conv_id, turn, slot, active, case when by_user then 'explicit_user' else 'seen' end as kind, (sum(new) over (partition by conv_id, slot order by turn rows unbounded preceding))::bigint as changes from n"""


@query(_OBSERVED)
def slot_fold(spark, sf):  # noqa: ANN001, ANN201
    slot = F.when(F.col("event_type") == "view", "product").when(F.col("event_type") == "click", "model").when(F.col("event_type") == "error", "error_code").otherwise("symptom")
    obs = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), slot.alias("slot"), (F.col("event_id") % 3).cast("string").alias("value"), F.when(F.col("event_id") % 5 < 3, "explicit_user").otherwise("ocr").alias("kind"))
    return C.slot_states(obs)


@query(
    """with u as (select * from conversations where role = 'user') select * from (select conv_id, turn, 'model' as slot, upper(regexp_extract(text, 'the([a-z]+)', 1)) as value from u union all select conv_id, turn, 'symptom', trim(regexp_extract(text, '(hand[a-z ]{2,20})', 1)) from u
 union all select conv_id, turn, 'attempted_action', trim(regexp_extract(text, '(inan[a-z]+)', 1)) from u union all select conv_id, turn, 'order_identifier', upper(regexp_extract(text, '\\b([a-z]{3}ou)\\b', 1)) from u) where value <> ''"""
)
def slot_extract(spark, sf):  # noqa: ANN001, ANN201
    return C.said_slots(table(spark, sf, "conversations"), PATTERNS).where("slot <> 'error_code'").select("conv_id", "turn", "slot", "value")


_FIELD = "['product', 'model', 'error_code', 'order_identifier', 'symptom'][1 + event_id % 5]"


@query(
    f"""with t as (select event_id as id, {_FIELD} as field, case event_id % 4 when 0 then 'ab' || event_id when 1 then 'x1 设备' when 2 then 'please rewrite' else 'err2' end as text from events)
select id, case field when 'product' then case when text = 'x1 设备' then text end when 'model' then case when regexp_full_match(text, '[A-Za-z]+[0-9]+') then upper(text) end
 when 'error_code' then case when text = 'err2' then 'ERR 02' when regexp_full_match(text, 'ab[0-9]{{2,3}}') then upper(text) when regexp_full_match(text, 'ab[0-9]+') then upper(text) end when 'order_identifier' then case when regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9-]{{3,63}}') then upper(text) end else text end as value,
 not (id % 7 = 0) and text = 'please rewrite' as switched from t"""
)
def pending_fill(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    field = F.get(F.array(*map(F.lit, ["product", "model", "error_code", "order_identifier", "symptom"])), (i % 5).cast("int"))
    text = F.when(i % 4 == 0, F.concat(F.lit("ab"), i.cast("string"))).when(i % 4 == 1, "x1 设备").when(i % 4 == 2, "please rewrite").otherwise("err2")
    return table(spark, sf, "events").select(i.alias("id"), C.pending_value(field, text).alias("value"), C.topic_switched(field, text, i % 7 == 0, F.lit(True), F.contains(text, F.lit("rewrite"))).alias("switched"))


@query(
    """with r as (select user_id as conv_id, event_type as owner_id, (event_id // 2)::varchar as request_id, ts as "at", event_id from events), f as (select request_id, arg_min(conv_id, ("at", conv_id, owner_id)) as conv_id, arg_min(owner_id, ("at", conv_id, owner_id)) as owner_id, min("at") as "at" from r group by 1),
o as (select conv_id, arg_min(owner_id, ("at", request_id)) as first from f group by 1), x as (select f.*, owner_id <> case when conv_id % 2 = 0 then 'click' else first end as refused, case when conv_id % 2 = 0 then 10 else 0 end as past from f join o using (conv_id))
select conv_id, request_id, case when not refused then past + row_number() over (partition by conv_id, refused order by "at", request_id) end as ordinal, refused from x"""
)
def turn_begin(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events")
    requests = e.select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("owner_id"), F.floor(F.col("event_id") / 2).cast("string").alias("request_id"), F.col("ts").alias("at"))
    owners = e.where("user_id % 2 = 0").select(F.col("user_id").alias("conv_id"), F.lit("click").alias("owner_id"), F.lit(10).alias("last_ordinal")).distinct()
    return C.begun_turns(requests, owners)


@query('''with s as (select (event_id // 4) as request_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status, ts as "at" from events) select request_id::varchar as request_id, case when bool_or(status = 'completed') then 'completed' else arg_max(status, ("at", status)) end as status, min("at") filter (where status = 'completed') as completed_at from s group by 1''')
def turn_states(spark, sf):  # noqa: ANN001, ANN201
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return C.final_states(table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).cast("string").alias("request_id"), status.alias("status"), F.col("ts").alias("at")))


@query('''with s as (select conv_id, turn % 4 as through, turn as "at", text from conversations) select conv_id, substr(trim(arg_max(text, (through, "at"))), 1, 4000) as summary, max(through) as through from s group by 1''')
def rolling_summary(spark, sf):  # noqa: ANN001, ANN201
    return C.newest_summaries(table(spark, sf, "conversations").select("conv_id", F.col("text").alias("summary"), (F.col("turn") % 4).alias("through"), F.col("turn").alias("at")))


_COST = "(length(regexp_replace(text, '[^一-鿿]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0))::bigint"


@query(
    f"""with recursive t as (select conv_id, turn, {_COST} as cost, row_number() over (partition by conv_id order by turn desc) as k from conversations),
s as (select conv_id, least(greatest(0, least(50, 200 - cost)), 10) + cost as start from (select conv_id, {_COST} as cost from conversations where turn = 0)),
w as (select t.conv_id, turn, cost, k, s.start + cost <= 200 as taken, s.start + case when s.start + cost <= 200 then cost else 0 end as used from t join s using (conv_id) where k = 1
 union all select t.conv_id, t.turn, t.cost, t.k, w.used + t.cost <= 200, w.used + case when w.used + t.cost <= 200 then t.cost else 0 end from w join t on t.conv_id = w.conv_id and t.k = w.k + 1)
select conv_id, turn as ordinal, cost, taken from w"""
)
def budget_window(spark, sf):  # noqa: ANN001, ANN201
    t = table(spark, sf, "conversations")
    asked = t.where("turn = 0").select("conv_id", "text", F.lit("forty characters of a summary, and so on").alias("summary"))
    return C.prompt_window(t.select("conv_id", F.col("turn").alias("ordinal"), "text"), asked, 200)


@query(
    """with s as (select user_id as session_id, ts as "at", event_id, case when event_type = 'view' then [] else [event_type, (event_id % 3)::varchar] end as products from events qualify row_number() over (partition by user_id, ts order by event_id) = 1),
l as (select *, sum(case when "at" - x < interval 1 day then 0 else 1 end) over (partition by session_id order by "at" rows unbounded preceding) as life from (select *, lag("at") over (partition by session_id order by "at") as x from s)),
k as (select *, last_value(case when len(products) > 0 then products end ignore nulls) over (partition by session_id, life order by "at" rows between unbounded preceding and 1 preceding) as before from l)
select session_id, "at", array_to_string(case when len(products) > 0 then products else coalesce(before, []) end, ',') as products, coalesce(len(products) > 0 and not list_has_any(products, before), false) as switched, (row_number() over (partition by session_id, life order by "at"))::int as n_saves from k"""
)
def session_ttl(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.min_by(F.struct("event_type", "event_id"), "event_id").alias("x"))
    products = F.when(F.col("x.event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("x.event_type", (F.col("x.event_id") % 3).cast("string")))
    return C.session_memory(e.select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), products.alias("products")), "1 day").withColumn("products", F.array_join("products", ","))


@query("select event_id as session_id from events where event_id % 4 > 0 and event_id % 3 = 0 and not (event_id % 5 = 1)")
def memory_relevant(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    e = table(spark, sf, "events")
    now = F.lit("2024-01-02").cast("timestamp")
    mem = e.select(i.alias("session_id"), F.when(i % 3 == 0, "me").otherwise("you").alias("owner_id"), F.array(F.lit("p1"), F.lit("p2")).alias("products"), F.when(i % 4 == 0, now).otherwise(now + F.expr("interval 1 second")).alias("expires_at"))
    asked = e.select(i.alias("session_id"), F.when(i % 5 == 0, F.array(F.lit("p2"))).when(i % 5 == 1, F.array(F.lit("p3"))).otherwise(F.array().cast("array<string>")).alias("products"))
    return C.relevant(mem, asked, now, F.lit("me")).select("session_id")


@query("with t as (select conv_id, turn as ordinal, case when role = 'user' then text end as u, case when role = 'assistant' then text else ' ' end as a from conversations) select conv_id, 2 * ordinal as place, 'user' as role, u as text from t where trim(coalesce(u, '')) <> '' union all select conv_id, 2 * ordinal + 1, 'assistant', a from t where trim(a) <> ''")
def turn_entries(spark, sf):  # noqa: ANN001, ANN201
    t = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.when(F.col("role") == "user", F.col("text")).alias("user_text"), F.when(F.col("role") == "assistant", F.col("text")).otherwise(" ").alias("assistant_text"))
    return C.entries(t)


@query("select conv_id, right(string_agg(role || ': ' || text, chr(10) order by turn), 300) as tail from conversations group by 1")
def transcript_tails(spark, sf):  # noqa: ANN001, ANN201
    return C.transcript_tail(table(spark, sf, "conversations"), 300)


@query("select 'turns' as name, count(*) as n from conversations where conv_id not in (select conv_id from conversations where turn = 7) union all select 'roles', count(*) from (select distinct conv_id, role from conversations where conv_id not in (select conv_id from conversations where turn = 7))")
def cascade_delete(spark, sf):  # noqa: ANN001, ANN201
    t = table(spark, sf, "conversations")
    left = C.without({"turns": t, "roles": t.select("conv_id", "role").distinct()}, "conv_id", t.where("turn = 7"))
    count = lambda n: left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("turns").unionByName(count("roles"))


@query("select doc_id as id, 'source: ' || source || case when doc_id % 2 = 0 then chr(10) || 'language: ' || lang else '' end as slots, case doc_id % 3 when 0 then '技术处理' || chr(10) || lang || chr(10) || chr(10) || '售后建议' || chr(10) || source when 1 then source else lang end as answer, 'image/png' as mime, 4::int as size, 3::int as n from documents")
def answer_parts(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    route = F.when(i % 3 == 0, "mixed").when(i % 3 == 1, "customer_service").otherwise("technical")
    urls = C.data_urls(F.array(*(F.lit("data:image/png;base64,QUJD"),) * 4))
    return table(spark, sf, "documents").select(i.alias("id"), C.slot_text([("source", F.col("source")), ("empty", F.lit(" ")), ("language", F.when(i % 2 == 0, F.col("lang")))]).alias("slots"), C.composed(route, F.col("lang"), F.col("source")).alias("answer"), urls[0]["mime"].alias("mime"), urls[0]["size"].alias("size"), F.size(urls).alias("n"))
