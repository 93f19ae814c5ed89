"""Queries over evaluation, pictures and screens; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import assets as A
from brindle.operators import evaluation as E
from brindle.operators import views as U
from brindle.plans.registry import register
from brindle.sources.tables import spread, table

QUERIES: dict = {}
query = register(QUERIES)

#: Cases: documents divisible by 4 look for two documents; the results are the next six documents with their texts.
_CASES = """with k as (select doc_id as case_id, case when doc_id % 12 = 0 then [] else [doc_id + 2, doc_id + 900000] end as targets, ['tion', 'the'] as required, ['ouch'] as forbidden, doc_id % 8 = 0 as locked from documents where doc_id % 4 = 0),
r as (select k.case_id, d.doc_id - k.case_id as rank, d.doc_id as id, d.text from k join documents d on d.doc_id - k.case_id between 1 and 5),
g as (select k.case_id, min(rank) filter (where list_contains(targets, id)) as rank, count(id) as n, coalesce(string_agg(text, chr(10) order by r.rank), '') as context from k left join r using (case_id) group by 1),
c as (select k.case_id, case when len(targets) > 0 then g.rank is not null else n > 0 end as hit, g.rank, len(list_filter(required, lambda f: contains(context, f)))::int as required_hits, 2::int as required_total, len(list_filter(forbidden, lambda f: contains(context, f)))::int as forbidden_hits, locked from k join g using (case_id)),
p as (select *, hit and required_hits = required_total and forbidden_hits = 0 as passed from c)"""


def _cases(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").select("doc_id", "text")
    none = F.array().cast("array<bigint>")
    cases = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 12 == 0, none).otherwise(F.array(F.col("doc_id") + 2, F.col("doc_id") + 900000)).alias("targets"), F.array(F.lit("tion"), F.lit("the")).alias("required"), F.array(F.lit("ouch")).alias("forbidden"), (F.col("doc_id") % 8 == 0).alias("locked"))
    near = d.select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"), "doc_id", "text").select((F.col("doc_id") - F.col("rank")).alias("case_id"), F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("id"), "text")
    return E.case_results(cases, near.join(cases.select("case_id"), "case_id", "left_semi"))


@query(_CASES + " select * from p")
def eval_cases(spark, sf):  # noqa: ANN001, ANN201
    return _cases(spark, sf)


@query(_CASES + " select round(count(*) filter (where hit) / greatest(1, count(*))::double, 6) as recall, round(coalesce(sum(1.0::double / rank), 0) / greatest(1, count(*)), 6) as mrr, round(sum(required_hits) / sum(required_total)::double, 6) as fact_coverage, round(sum(forbidden_hits) / greatest(1, count(*))::double, 6) as forbidden_rate, count(*) filter (where locked and not passed) as locked_failures, false as passed from p")
def eval_fact_coverage(spark, sf):  # noqa: ANN001, ANN201
    m = E.run_metrics(_cases(spark, sf))
    return m.select(*(F.round(c, 6).alias(c) for c in ("recall", "mrr", "fact_coverage", "forbidden_rate")), "locked_failures", "passed")


@query("select doc_id::varchar as id, case when doc_id % 10 = 0 then 'missing' when doc_id % 10 = 1 then 'extra' when doc_id % 10 = 2 and upper(source) <> source then 'question' when doc_id % 10 = 3 then 'answer' end as issue from documents where doc_id % 10 < 4 and not (doc_id % 10 = 2 and upper(source) = source)")
def snapshot_verify(spark, sf):  # noqa: ANN001, ANN201
    """Two snapshots of the same answers: trailing blanks make no difference, other changes do."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("question"), F.col("text").alias("answer"), (F.col("doc_id") % 10).alias("k"))
    saved = E.snapshot(d.where("k <> 1"))
    now = d.where("k <> 0").withColumn("question", F.when(F.col("k") == 2, F.upper("question")).otherwise(F.col("question"))).withColumn("answer", F.when(F.col("k") == 3, F.concat(F.lit("x"), "answer")).otherwise(F.concat("answer", F.lit("  \r\n"))))
    return E.snapshot_differences(saved, E.snapshot(now))


@query("select count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) as total from events")
def report_counters(spark, sf):  # noqa: ANN001, ANN201
    return E.report_counts(table(spark, sf, "events"), "event_type", ["click", "error"])


@query("select case when doc_id % 7 = 0 then ' ' else (doc_id // 2)::varchar end as id, 'what is ' || doc_id as question, 1::int as n_links, case when doc_id % 7 = 0 then 'empty-id' when count(*) over (partition by case when doc_id % 7 = 0 then ' ' else (doc_id // 2)::varchar end) > 1 then 'duplicate-id' end as issue from documents")
def question_table(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(F.when(i % 7 == 0, " ").otherwise(F.floor(i / 2).cast("string")).alias("id"), F.concat(F.lit('"what is '), i.cast("string"), F.lit(' https://a.example/x.png https://a.example/x.png"')).alias("question"))
    return E.questions(rows).select("id", "question", F.size("links").alias("n_links"), "issue")


@query("select doc_id as id, case doc_id % 4 when 0 then 'a' || chr(10) || '<PIC>' || chr(10) || '<PIC>' when 1 then 'a <PIC> b <PIC> c ' when 2 then 'a  b  c' else 'a <PIC> b  c ' end as text, (case doc_id % 4 when 2 then 0 when 3 then 1 else 2 end)::int as n from documents")
def placeholders(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, "a ").when(k == 1, "a <PIC> b <PIC> c <PIC>").when(k == 2, "a <PIC> b <PIC> c").otherwise("a <PIC> b <PIC> c <PIC>")
    pics = F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("p1"), F.lit("p1 "))).otherwise(F.array(F.lit("p1"), F.lit("p2"), F.lit(" ")))
    out = E.with_placeholders(answer, pics)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), out["text"].alias("text"), F.size(out["assets"]).alias("n"))


@query(
    """with i as (select p_partkey as insight_id, case when p_partkey % 3 = 0 then sha256(p_name) else '' end as d, regexp_replace(lower(p_brand || '-' || p_size % 5), '[^a-z0-9]+', '', 'g') as s from part),
c as (select p_partkey as asset_id, p_size as document_id, sha256(p_name) as d, regexp_replace(lower(p_brand || '-' || p_size), '[^a-z0-9]+', '', 'g') as s from part),
a as (select insight_id, count(*) as n, min((asset_id, document_id)) as x from i join c on i.d = c.d where i.d <> '' group by 1), b as (select insight_id, count(*) as n, min((asset_id, document_id)) as x from i join c on i.s = c.s group by 1)
select i.insight_id, case when a.n = 1 then a.x[1] when a.n is null and b.n = 1 then b.x[1] end as asset_id, case when a.n = 1 then 'sha256' when a.n > 1 then 'ambiguous' when b.n = 1 then 'stem' when b.n > 1 then 'ambiguous' else 'unmatched' end as strategy from i left join a using (insight_id) left join b using (insight_id)"""
)
def asset_match_cascade(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    name = lambda n: F.concat(F.lit("img/"), "p_brand", F.lit("-"), n.cast("string"), F.lit(".PNG"))
    insights = p.select(F.col("p_partkey").alias("insight_id"), F.when(F.col("p_partkey") % 3 == 0, F.upper(F.sha2("p_name", 256))).otherwise(" ").alias("sha256"), name(F.col("p_size") % 5).alias("file_name"), F.lit(None).cast("string").alias("image_id"))
    candidates = p.select(F.col("p_partkey").alias("asset_id"), F.col("p_size").alias("document_id"), F.sha2("p_name", 256).alias("sha256"), name(F.col("p_size")).alias("source_name"))
    return A.matched(insights, candidates).select("insight_id", "asset_id", "strategy")


@query(
    """with p as (select *, 'hint ' || p_type as hint, case when p_size % 2 = 0 then p_name else '' end as summary from part where p_partkey % 5 > 0), c as (select *, case when summary <> '' then summary else hint end as caption from p),
e as (select *, trim(p_brand || chr(10) || hint || chr(10) || caption || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 't1；t2') as body from c)
select p_partkey as asset_id, p_name || '.v1' as image_name, caption, 'a' || chr(10) || 'b' as ocr_text, sha256(body) as content_hash, 'image-' || substr(sha256('d|' || p_type || '|' || p_partkey || '|' || sha256(body)), 1, 24) as id, greatest(1, p_size - 10)::int as page_number from e"""
)
def insight_rows(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    strings = lambda *x: F.array(*map(F.lit, x))
    rows = p.select(F.lit("d").alias("dataset_id"), F.col("p_type").alias("document_id"), F.col("p_partkey").alias("asset_id"), F.lit("").alias("image_id"), F.concat(F.lit("x/"), "p_name", F.lit(".v1.png")).alias("file_name"), F.col("p_brand").alias("manual_name"), F.concat(F.lit("hint "), "p_type").alias("chapter_hint"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("visual_summary"), F.lit(" ").alias("visual_meaning"), strings("a ", "b", "a").alias("visible_text"), strings("t1", "", "t2").alias("search_terms"), F.lit(None).cast("array<string>").alias("applicable_questions"), F.lit(None).cast("string").alias("retrieval_text"), F.when(F.col("p_partkey") % 5 > 0, "0.5").otherwise("1.5").alias("confidence"), (F.col("p_size") - 10).alias("page_number"))
    return A.normalised(rows).select("asset_id", "image_name", "caption", "ocr_text", "content_hash", "id", "page_number")


@query("select p_partkey as asset_id from part where p_partkey % 3 > 0 and p_partkey % 4 > 0")
def image_fallback(spark, sf):  # noqa: ANN001, ANN201
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise(" ").alias("caption"), F.lit(None).cast("string").alias("ocr_text"), F.lit("").alias("retrieval_text"))
    return A.fallback_rows(a, a.where("asset_id % 4 = 0")).select("asset_id")


@query("select event_id as id, case event_id % 3 when 0 then 'ok' when 1 then 'empty' else 'invalid_response' end as status, case when event_id % 3 = 0 then 'seen ' || event_type || chr(10) || 'read' else 'read' end as text, case when event_id % 3 = 0 then 'E1,AB-7,' else '' end || 'X9' as codes, case when event_id % 3 = 0 then 0.25 else 0.5 end::double as confidence, case when event_id % 2 = 0 then event_type end as shown, event_id % 2 = 0 as citable from events")
def visual_contexts(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit('note {"text":"seen '), "event_type", F.lit('","codes":["e1"],"labels":{"model":"ab-7","place":"left"},"confidence":0.25} end'))).when(i % 3 == 1, "{}").otherwise("no json")
    ocr = A.read_output(raw)
    seen = A.read_output(F.lit('{"text":"read","codes":["x9"],"confidence":0.5}'))
    rows = table(spark, sf, "events").select("event_id", "event_type", ocr.alias("o"), seen.alias("s"))
    both = A.merged_context(F.col("o"), F.col("s"))
    kind = F.when(i % 2 == 0, "vision").otherwise("ocr")
    return rows.select(i.alias("id"), F.col("o.status").alias("status"), both["text"].alias("text"), F.array_join(both["codes"], ",").alias("codes"), both["confidence"].alias("confidence"), A.masked(F.col("event_type"), kind, F.lit(False)).alias("shown"), A.may_cite(kind, F.lit(True), F.lit(False)).alias("citable"))


@query("select l_orderkey as query_id, l_suppkey as parent_id, p_partkey as asset_id from (select distinct l_orderkey, l_suppkey, l_partkey % 5 as product from lineitem) join part on p_partkey % 5 = product and p_size % 10 + 1 = l_suppkey group by all")
def image_gate(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("parent_id"), (F.col("l_partkey") % 5).alias("product"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_partkey") % 5).alias("product"), F.array((F.col("p_size") % 10 + 1).cast("long")).alias("parent_ids"))
    return A.images_of(e, p)


@query("select 'day' as field, case when date_diff('day', ts::date, date '2024-01-03') <= 0 then 'today' when date_diff('day', ts::date, date '2024-01-03') = 1 then 'yesterday' else 'earlier' end as value, count(*) as n from events group by 1, 2 union all select 'event_type', event_type, count(*) from events where contains(lower(event_type || chr(10) || props), 'e') group by 2 union all select 'k', event_type, count(*) from events where contains(lower(event_type || chr(10) || props), 'e') group by 2 union all select 'k', (event_id % 3)::varchar, count(*) from events where contains(lower(event_type || chr(10) || props), 'e') group by 2")
def facet_counts(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events")
    days = e.select(F.lit("day").alias("field"), U.day_bucket(F.col("ts"), F.lit("2024-01-03").cast("date")).alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    found = U.searched(e, ["event_type", "props"], " E ").withColumn("k", F.array("event_type", (F.col("event_id") % 3).cast("string")))
    return days.unionByName(U.facets(found, ["event_type", "k"]))


@query("select sum(n_chars)::bigint as chars, sum(case when lang = 'en' then 1 else 0 end)::bigint as english, bool_and(source = 'src1') as ok, count(*) as n from documents")
def dashboard_totals(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    t = U.totals(d, chars=F.col("n_chars"), english=(F.col("lang") == "en").cast("int"))
    return t.crossJoin(U.one_dataset(d.withColumn("dataset_id", F.col("source")), F.lit("src1")))  # one row each


@query("select user_id as query_id, event_id as id, marker, rank, x, place from (select *, row_number() over (partition by user_id order by rank, event_id)::int as place from (select user_id, event_id, case event_id % 3 when 0 then 'rerank' when 1 then 'dense' else 'rrf' end as marker, event_id % 7 as rank, value as x from events where event_id % 4 > 0)) where place <= 10")
def map_hits(spark, sf):  # noqa: ANN001, ANN201
    e, i = table(spark, sf, "events"), F.col("event_id")
    hits = e.select(F.col("user_id").alias("query_id"), i.alias("id"), F.when(i % 3 == 0, i % 7).alias("rerank_rank"), F.when(i % 3 < 2, i % 7).alias("dense_rank"), (i % 7).alias("rrf_rank"))
    return U.hits_on_map(hits, e.where("event_id % 4 > 0").select(i.alias("id"), F.col("value").alias("x"), F.col("value").alias("y"))).drop("y")


@query(
    """with p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, vec_id % 3 as priority from embeddings), d as (select a.id, b.id as near_id, b.priority, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 8) as d from p a, p b),
m as (select *, min(d) over (partition by id) as least from d where d <= 0.05) select id, near_id, d from m where d <= least + 0.01 qualify row_number() over (partition by id order by priority desc, d, near_id) = 1"""
)
def nearest_by_priority(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("vec_id") % 3).alias("priority"))
    return U.nearest_within(p, p, 0.05, 0.01)


@query("select (event_id // 4)::varchar as request_id, coalesce(arg_max(event_type, event_id) filter (where event_type <> 'view'), 'span') as model from events group by 1")
def effective_models(spark, sf):  # noqa: ANN001, ANN201
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).cast("string").alias("request_id"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("model"), F.col("event_id").alias("seq"))
    return U.effective_model(e, e.select("request_id").distinct().withColumn("model", F.lit("span")))


@query(
    """with d as (select doc_id as id, string_split(regexp_replace(text, ' (?:de|the|and) ', '<PIC>', 'g'), '<PIC>') as p, case when lang = source then [lang] else [lang, source] end as a from documents)
select id, k::int as place, case when k < len(p) then sha256(p[k + 1]) end as digest, a[k + 1] as asset from d, unnest(range(greatest(len(p), len(a)))) as u(k)"""
)
def text_and_assets(spark, sf):  # noqa: ANN001, ANN201
    """Whole texts cut at their marks (here: some small words), each part with its asset; equal assets count once."""
    parts = U.paired(F.regexp_replace("text", " (?:de|the|and) ", "<PIC>"), F.array("lang", "source", "lang"))
    rows = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.posexplode(parts).alias("place", "x"))
    return rows.select("id", "place", F.sha2("x.text", 256).alias("digest"), F.col("x.asset").alias("asset"))


@query(
    """select p_partkey as id, case p_partkey % 5 when 0 then '' when 1 then '' else array_to_string(string_split(p_name, ' '), '|') end as tags, case when p_partkey % 3 = 0 then 0 else p_size % 7 end::int as dimension,
 array_to_string(list_filter(list_transform(string_split(p_brand || ',' || p_type || ',' || p_name, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as facts from part"""
)
def contract_views(spark, sf):  # noqa: ANN001, ANN201
    """Parts as records of a contract: JSON lists of their names' words, objects and broken lists as empty ones, vectors as sizes, facts split at commas of both kinds."""
    k = F.col("p_partkey")
    tags = F.when(k % 5 == 0, "no list").when(k % 5 == 1, F.to_json(F.struct("p_name"))).otherwise(F.to_json(F.split("p_name", " ")))
    vector = F.when(k % 3 > 0, F.slice(F.array_repeat(F.lit(0.5), 7), F.lit(1), F.col("p_size") % 7))
    facts = U.split_facts(F.concat(F.lit(" "), "p_brand", F.lit(" , "), "p_type", F.lit("，\n"), "p_name", F.lit(",,")))
    rows = table(spark, sf, "part").select(k.alias("id"), tags.alias("tags"), vector.alias("embedding"), facts.alias("f"))
    return U.contract(rows, ["tags"]).select("id", F.array_join("tags", "|").alias("tags"), "dimension", F.array_join("f", "|").alias("facts"))


@query("with a as (select l_orderkey as case_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, p_brand as name from lineitem join part on p_partkey = l_partkey where p_size > 10), f as (select case_id, name, min(pos) as pos from a group by 1, 2), k as (select *, row_number() over (partition by case_id order by pos) as r from f) select o.case_id, coalesce(string_agg(name, ',' order by r) filter (where r <= 2), '') as names from (select distinct l_orderkey as case_id from lineitem) o left join k using (case_id) group by 1")
def mapped_assets(spark, sf):  # noqa: ANN001, ANN201
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("asset_ids"))
    names = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("asset_id"), F.col("p_brand").alias("name"))
    return U.mapped(lines, names, 2).select("case_id", F.array_join("names", ",").alias("names"))


@query("select l_orderkey as parent_id, count(*) as n_children, sum(l_quantity)::bigint as total, count(*) filter (where l_returnflag = 'R') as n_off from lineitem group by 1")
def children_counts(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("parent_id")).agg(F.count("*").alias("n_children"), F.sum("l_quantity").cast("long").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("n_off"))
