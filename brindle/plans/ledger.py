"""Queries over conversations, events and the star schema; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import conversation as C
from brindle.plans.registry import register
from brindle.sources.tables import table

QUERIES: dict = {}
query = register(QUERIES)


@query("select conv_id, arg_max(role, turn) as last_role, max(turn) as last_turn, max(turn) + 1 as next_turn, count(*) as n_turns from conversations group by 1")
def turn_latest(spark, sf):  # noqa: ANN001, ANN201
    return C.latest_turn(table(spark, sf, "conversations"))


@query("select conv_id, turn, last_value(nullif(regexp_extract(text, '[0-9]+(?:\\.[0-9]+)?'), '') ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as slot from conversations")
def slot_last_active(spark, sf):  # noqa: ANN001, ANN201
    return C.last_active(table(spark, sf, "conversations"), T.NUMBER)


@query(
    """with r as (select conv_id, turn, role, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as said from conversations), l as (select *, lag(said) over (partition by conv_id order by turn) as before from r)
select conv_id, turn, len(said)::bigint as n_numbers, len(list_filter(said, lambda x: not list_contains(coalesce(before, []), x)))::bigint as n_unsupported from l where role = 'assistant'"""
)
def verify_numbers(spark, sf):  # noqa: ANN001, ANN201
    return C.unsupported_numbers(table(spark, sf, "conversations"))


@query("select role, count(*) as n, sum(length(text))::bigint as n_chars, count(distinct conv_id) as n_conversations from conversations group by 1")
def conv_summary(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("conv_id").alias("n_conversations"))


@query("select conv_id, max(turn) as last_turn from conversations group by 1 order by 2 desc, 1 desc limit 20 offset 20")
def conv_paging(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), F.desc("conv_id")).offset(20).limit(20)


@query("select event_type, count(*) as n, round(avg(greatest(0, value)), 3) as mean, round(min(greatest(0, value)), 3) as least, round(max(greatest(0, value)), 3) as most from events group by 1")
def event_metrics(spark, sf):  # noqa: ANN001, ANN201
    v = F.greatest(F.lit(0.0), F.col("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 3).alias("mean"), F.round(F.min(v), 3).alias("least"), F.round(F.max(v), 3).alias("most"))


@query("select user_id, count(*) filter (where event_type = 'error') as n_errors, count(*) as n from events group by 1")
def downgrade_count(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count("*").alias("n"))


@query("select user_id, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def first_and_last_event(spark, sf):  # noqa: ANN001, ANN201
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minutes then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g) select user_id, k::bigint as session, count(*) as n, round(sum(value), 4) as total from s group by 1, 2"""
)
def session_rollup(spark, sf):  # noqa: ANN001, ANN201
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = (F.col("ts") - F.lag("ts").over(w)) <= F.expr("interval 30 minutes")
    marked = table(spark, sf, "events").withColumn("new", F.when(near, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_counts(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("select date_trunc('hour', ts) - k * interval 1 hour as start, count(*) as n from events, (select unnest(range(2)) as k) group by 1")
def sliding_counts(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@query("select event_type, sum(cast(props ->> 'k' as bigint))::bigint as total, count(*) filter (where props ->> 'k' is not null) as n from events group by 1")
def props_rollup(spark, sf):  # noqa: ANN001, ANN201
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


@query("select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def rel_join_inner(spark, sf):  # noqa: ANN001, ANN201
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, 'with' as kind from customer where c_custkey in (select o_custkey from orders) union all select c_custkey, 'without' from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def rel_semi_and_anti(spark, sf):  # noqa: ANN001, ANN201
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("with").alias("kind")).unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("without").alias("kind")))


@query("select o_orderstatus, o_orderpriority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority)::bigint as level from orders group by cube (o_orderstatus, o_orderpriority)")
def rel_cube(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def rel_rollup(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 2) as moving, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as place from orders")
def rel_window_frames(spark, sf):  # noqa: ANN001, ANN201
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.row_number().over(w).alias("place"))


@query("select c_nationkey as k, 'both' as kind from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select c_nationkey, 'only' from (select c_nationkey from customer except select s_nationkey from supplier)")
def rel_set_operations(spark, sf):  # noqa: ANN001, ANN201
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("only")))


@query("select e.event_id, p.event_id as purchase_id from events e asof join (select event_id, user_id, ts from (select *, row_number() over (partition by user_id, ts order by event_id desc) as r from events where event_type = 'purchase') where r = 1) p on e.user_id = p.user_id and e.ts >= p.ts where e.event_type = 'view'")
def rel_asof(spark, sf):  # noqa: ANN001, ANN201
    """The newest purchase of the same user at each view: one window over both kinds, no join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase"))
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).where("event_type = 'view' and purchase_id is not null").select("event_id", "purchase_id")
