"""Queries over files and request events; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans.registry import register
from brindle.sources import files as S
from brindle.sources.tables import table
from brindle.streaming import requests as R

QUERIES: dict = {}
query = register(QUERIES)

_TYPES = "(['retrieval.completed', 'generation.completed', 'answer.delta', 'ocr.completed', 'run.completed'])[1 + event_id % 5]"
_EVENTS = f"(select (event_id // 10)::varchar as request_id, {_TYPES} as type, case when event_type = 'error' then 'failed' else 'completed' end as status, ts as t, case when event_id % 3 = 0 then 'hybrid' when event_id % 3 = 1 then 'lexical' else '' end as mode, value as latency_ms, event_id, event_type from events)"


def _events(spark, sf):  # noqa: ANN001, ANN202
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ["retrieval.completed", "generation.completed", "answer.delta", "ocr.completed", "run.completed"])), (i % 5).cast("int"))
    return table(spark, sf, "events").select(F.floor(i / 10).cast("string").alias("request_id"), kind.alias("type"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("at"), F.when(i % 3 == 0, "hybrid").when(i % 3 == 1, "lexical").otherwise("").alias("mode"), F.col("value").alias("latency_ms"), "event_id")


_FOLD = f"""with e as {_EVENTS} select request_id, min(t) as first_event, min(t) filter (where type = 'answer.delta') as first_delta, arg_max(mode, t) filter (where type = 'retrieval.completed' and mode <> '') as mode, count(latency_ms) filter (where type = 'generation.completed') as n_calls,
 round(avg(greatest(0.0::double, latency_ms)) filter (where type = 'generation.completed'), 3) as mean_latency, count(*) filter (where type in ('ocr.completed', 'vlm.completed', 'generation.completed') and status = 'failed') as downgrades, min(t) filter (where type in ('run.completed', 'run.failed')) as finished from e group by 1"""


@query(_FOLD)
def request_folds(spark, sf):  # noqa: ANN001, ANN201
    return R.request_fold(_events(spark, sf))


@query(f"with f as ({_FOLD}) select coalesce(mode, 'none') as mode, count(*) as n, sum(downgrades)::bigint as downgrades from f group by 1")
def request_registry(spark, sf):  # noqa: ANN001, ANN201
    return R.registry(R.request_fold(_events(spark, sf)))


@query(f"with e as {_EVENTS}, n as (select *, row_number() over w as s, lead(event_id) over w is null as last from e window w as (partition by request_id order by t, event_id)) select request_id, s::int as sequence, '{{\"sequence\":' || s || ',\"type\":\"' || type || '\",\"payload\":\"' || mode || '\",\"terminal\":' || last || '}}' as value from n")
def event_line_rows(spark, sf):  # noqa: ANN001, ANN201
    return S.event_lines(_events(spark, sf).withColumn("payload", F.col("mode")))


@query("with u as (select conv_id, turn, list_filter(string_split(regexp_replace(text, '([。！？!?；;\\n])', '\\1⟪', 'g'), '⟪'), lambda x: x <> '') as u from conversations) select conv_id || ':' || turn as answer_id, sha256(array_to_string(list_filter(u, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' or not contains(x, 'tion')), '')) as emitted, sha256(array_to_string(list_filter(u, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '' and contains(x, 'tion')), '')) as withheld from u")
def sentences_released(spark, sf):  # noqa: ANN001, ANN201
    a = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "text")
    return R.released(a, lambda u: ~F.contains(u, F.lit("tion"))).select("answer_id", F.sha2("emitted", 256).alias("emitted"), F.sha2("withheld", 256).alias("withheld"))


@query("select doc_id as id, case k when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/markdown' when 3 then 'text/plain' end as kind, case when k = 4 then 'extension' when k = 5 then 'empty' when k = 6 then 'content' when k = 3 then 'mismatch' end as refusal from (select doc_id, doc_id % 7 as k from documents)")
def upload_checks(spark, sf):  # noqa: ANN001, ANN201
    k = F.col("doc_id") % 7
    name = F.when(k == 0, "a.pdf").when(k == 1, "a.PNG").when(k == 2, "a.md").when(k == 3, "a.txt").when(k == 4, "a.exe").otherwise("a.jpg")
    content = F.when(k == 0, F.concat(F.lit("%PDF-1.7"), "source")).when(k == 1, F.lit("")).when(k == 5, F.lit("")).otherwise(F.col("source"))
    png = F.unhex(F.lit("89504E470D0A1A0A00"))
    body = F.when(k == 1, png).otherwise(content.cast("binary"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S.sniffed(name, body).alias("kind"), S.refusal(name, F.when(k == 3, "image/png"), body).alias("refusal"))


@query("select sha256(text) as digest, substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' as place, min(lpad(doc_id::varchar, 9, '0') || '.txt') as name, 'text/plain' as kind, octet_length(encode(text))::bigint as n_bytes from documents group by text")
def content_store(spark, sf):  # noqa: ANN001, ANN201
    files = table(spark, sf, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    return S.stored(files)


@query("with s as (select source as product, lang as section from documents group by all), k as (select substr(sha256(source || '|' || lang || '|' || doc_id), 1, 24) as child_id, substr(sha256(source || '|' || lang), 1, 24) as parent_id, doc_id, source, lang from documents where lang <> 'de') select 'parent' as kind, substr(sha256(product || '|' || section), 1, 24) as id, product as body from s where section <> 'de' union all select 'child', child_id, doc_id::varchar from k union all select 'asset', substr(sha256(source || '|' || (doc_id // 2)), 1, 24), 'c ' || source from documents group by source, doc_id // 2")
def corpus_import(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    sections = d.where("lang <> 'de'").select(F.col("source").alias("product"), F.col("lang").alias("section"), F.lit("t").alias("title"), F.lit("x").alias("text")).distinct()
    chunks = d.select(F.col("source").alias("product"), F.col("lang").alias("section"), F.col("doc_id").cast("string").alias("place"), F.col("doc_id").cast("string").alias("text"))
    captions = d.select(F.col("source").alias("product"), F.col("lang").alias("section"), F.floor(F.col("doc_id") / 2).cast("string").alias("file"), F.concat(F.lit("c  "), "source").alias("caption"))
    p, c, a = S.imported(sections, chunks, captions)
    row = lambda df, kind, key, body: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(body).alias("body"))
    return row(p, "parent", "parent_id", "product").unionByName(row(c, "child", "child_id", "text")).unionByName(row(a, "asset", "asset_id", "caption"))
