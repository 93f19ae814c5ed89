"""Queries over comparisons, assignments, filters and small rules of workflows; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import lists as L
from brindle.operators import assets as A
from brindle.operators import conversation as C
from brindle.operators import evaluation as E
from brindle.operators import gates as G
from brindle.operators import ingest as I
from brindle.plans.registry import register
from brindle.sources import files as S
from brindle.sources.tables import spread, table

QUERIES: dict = {}
query = register(QUERIES)

_COMPARED = {
    "eq": ("source", "=", "s1", "source = 's1'"),
    "ne": ("source", "≠", "s1", "source <> 's1'"),
    "gt": ("n_chars", ">", 900, "n_chars > 900"),
    "ge": ("n_chars", "≥", 900, "n_chars >= 900"),
    "lt": ("n_chars", "<", 900, "n_chars < 900"),
    "le": ("n_chars", "≤", 900, "n_chars <= 900"),
    "holds": ("text", "contains", "tion", "contains(text, 'tion')"),
    "lacks": ("text", "not contains", "tion", "not contains(text, 'tion')"),
    "begins": ("text", "start with", "The", "starts_with(text, 'The')"),
    "ends": ("text", "end with", ".", "ends_with(text, '.')"),
    "blank": ("text", "empty", None, "text = ''"),
    "filled": ("text", "not empty", None, "text <> ''"),
    "among": ("lang", "in", ["en", "fr"], "lang in ('en', 'fr')"),
    "beside": ("lang", "not in", ["en", "fr"], "lang not in ('en', 'fr')"),
}


@query("select doc_id as id, " + ", ".join(f"{sql} as {name}" for name, (_, _, _, sql) in _COMPARED.items()) + " from documents")
def comparisons(spark, sf):  # noqa: ANN001, ANN201
    """All fourteen comparisons on every document."""
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), *(L.compared(F.col(c), op, other).alias(name) for name, (c, op, other, _) in _COMPARED.items()))


@query("select o_orderkey, 'all' as logic from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 50000 and o_orderpriority <> '5-LOW' union all select o_orderkey, 'any' from orders where o_orderstatus = 'P' or o_totalprice < 20000 or starts_with(o_orderpriority, '1')")
def metadata_filters(spark, sf):  # noqa: ANN001, ANN201
    o = table(spark, sf, "orders")
    all_ = L.metadata_filter([("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", "≥", 50000), ("o_orderpriority", "≠", "5-LOW")])
    any_ = L.metadata_filter([("o_orderstatus", "=", "P"), ("o_totalprice", "<", 20000), ("o_orderpriority", "start with", "1")], "or")
    return o.where(all_).select("o_orderkey", F.lit("all").alias("logic")).unionByName(o.where(any_).select("o_orderkey", F.lit("any").alias("logic")))


@query(
    """with w as (select event_id as id, value as v, list_transform(range(event_id % 4), lambda i: event_id + i) as xs from events)
select id, round(v + id % 5, 6) as plus, round(v - id % 5, 6) as minus, round(v * (id % 5), 6) as times, case when id % 5 <> 0 then round(v / (id % 5), 6) end as over, id as overwritten, array_to_string(list_append(xs, id), ',') as appended, array_to_string(xs || [id, id], ',') as extended,
 array_to_string(xs[2:], ',') as rest, array_to_string(xs[:greatest(len(xs) - 1, 0)], ',') as most, true as cleared from w"""
)
def assigned_values(spark, sf):  # noqa: ANN001, ANN201
    """Every way to assign a variable, on each event's value and a list of its own."""
    i, v = F.col("event_id"), F.col("value")
    xs = F.filter(F.array(*(F.when(i % 4 > k, i + k) for k in range(3))), lambda x: x.isNotNull())
    n = (i % 5).cast("double")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    a = L.assigned
    numbers = {"plus": F.round(a(v, "+=", n), 6), "minus": F.round(a(v, "-=", n), 6), "times": F.round(a(v, "*=", n), 6), "over": F.round(a(v, "/=", n), 6), "overwritten": a(v, "overwrite", i)}
    arrays = {"appended": text(a(xs, "append", i)), "extended": text(a(xs, "extend", F.array(i, i))), "rest": text(a(xs, "remove_first")), "most": text(a(xs, "remove_last")), "cleared": a(v, "clear").isNull()}
    return table(spark, sf, "events").select(i.alias("id"), *(c.alias(k) for k, c in (numbers | arrays).items()))


_FIELDS = ["service_request", "symptom", "error_code", "product", "attempted_action", "order_identifier", "model", "colour"]


@query(
    f"with m as (select event_id as id, list_filter({_FIELDS}, lambda f, i: (event_id // (1 << (i - 1)::int)) % 2 = 1) as missing from events) select id, coalesce(list_filter({G.PRIORITY}, lambda f: list_contains(missing, f))[1], missing[1], 'symptom') as field from m"
)
def asked_fields(spark, sf):  # noqa: ANN001, ANN201
    """Which missing field to ask for: each event lacks the fields of its number's bits."""
    i = F.col("event_id")
    missing = F.filter(F.array(*(F.when(F.floor(i / (1 << k)) % 2 == 1, F.lit(f)) for k, f in enumerate(_FIELDS))), lambda x: x.isNotNull())
    return table(spark, sf, "events").select(i.alias("id"), G.asked_field(missing).alias("field"))


@query(
    """select event_id as id, (event_id % 100) / 100.0 < 0.58 or event_id % 3 = 0 or event_id % 1500 < 1000 as fall_back,
 case when event_id % 7 < 5 and event_id % 4 = 0 then 'guarded' when event_id % 7 < 5 and event_id % 4 = 1 then 'legacy-only' when event_id % 7 < 5 and ((event_id % 100) / 100.0 < 0.58 or event_id % 3 = 0 or event_id % 1500 < 1000) then 'fallback' end as reason from events"""
)
def guard_reasons(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    fall = G.should_fall_back((i % 100) / 100, i % 3 != 0, i % 1500)
    mode = F.when(i % 4 == 0, "champion_guarded").when(i % 4 == 1, "legacy_only").otherwise("enhanced")
    return table(spark, sf, "events").select(i.alias("id"), fall.alias("fall_back"), G.guard_reason(mode, i % 7 < 5, fall).alias("reason"))


@query(
    "select conv_id, turn, not contains(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 'tion') as ok_form, turn % 4 = 3 as seen from conversations"
)
def guard_forms(spark, sf):  # noqa: ANN001, ANN201
    """Form letters among answers of the guard path, by a term; names and codes are left aside (an empty question)."""
    t = table(spark, sf, "conversations")
    ok = G.answer_acceptable(F.lit(""), F.col("text"), F.lit("technical"), ["tion"], [], F.lit(False))
    return t.select("conv_id", "turn", ok.alias("ok_form"), (F.col("turn") % 4 == 3).alias("seen"))


@query(
    """with a as (select event_id as id, list_transform(range(event_id % 6), lambda i: {'name': event_type || i, 'mime': case when i % 2 = 0 then 'image/png' else 'text/plain' end, 'sha256': sha256(event_type || i), 'size': event_id + i}) as items from events)
select id, k::int as place, x.name as name, x.mime as mime, x.sha256 as sha256, x.size as size from (select id, unnest(items[:3]) as x, generate_subscripts(items[:3], 1) - 1 as k from a)"""
)
def attachment_rows(spark, sf):  # noqa: ANN001, ANN201
    """The first three attachments of each event, without their content."""
    i, kind = F.col("event_id"), F.col("event_type")
    one = lambda k: F.struct(F.concat(kind, F.lit(str(k))).alias("name"), F.lit("text/plain" if k % 2 else "image/png").alias("mime"), F.sha2(F.concat(kind, F.lit(str(k))), 256).alias("sha256"), (i + k).alias("size"), F.lit("secret").alias("content"))
    items = F.filter(F.array(*(F.when(i % 6 > k, one(k)) for k in range(5))), lambda x: x.isNotNull())
    return table(spark, sf, "events").select(i.alias("id"), F.posexplode(C.attachments(items)).alias("place", "x")).select("id", "place", "x.*")


@query("""select doc_id as id, k::int as place, case when k = 0 then 'image/png' else 'text/plain' end as mime, sha256(u) as sha256, length(u) - strpos(u, ',') as size from (select doc_id, k, case when k = 0 then 'data:image/png;base64,' || text else 'data:text/plain,' || source end as u from documents, unnest(range(2)) as t(k))""")
def data_url_facts(spark, sf):  # noqa: ANN001, ANN201
    urls = F.array(F.concat(F.lit("data:image/png;base64,"), "text"), F.concat(F.lit("data:text/plain,"), "source"))
    rows = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.posexplode(C.data_urls(urls)).alias("place", "x"))
    return rows.select("id", "place", "x.mime", "x.sha256", F.col("x.size").cast("long").alias("size"))


@query("select event_id as id, case event_id % 4 when 0 then 'vision' when 1 then 'ocr' when 2 then 'manual' else 'policy' end as kind, event_id % 3 = 0 or event_id % 4 = 0 or (event_id % 4 = 1 and event_id % 5 < 2) as may_cite from events")
def citable_kinds(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "vision").when(i % 4 == 1, "ocr").when(i % 4 == 2, "manual").otherwise("policy")
    return table(spark, sf, "events").select(i.alias("id"), kind.alias("kind"), A.may_cite(kind, i % 3 != 0, i % 5 < 2).alias("may_cite"))


@query("select id, k as place, name from (select event_id as id, unnest(range(least(20, event_id % 25))) as k, event_type || ':' || unnest(range(least(20, event_id % 25))) as name from events)")
def ledger_rows(spark, sf):  # noqa: ANN001, ANN201
    """At most twenty citations of each event, without texts and scores."""
    i = F.col("event_id")
    items = F.transform(F.when(i % 25 > 0, F.sequence(F.lit(0), (i % 25).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.concat(F.col("event_type"), F.lit(":"), k.cast("string")).alias("name"), F.lit("t").alias("text"), F.lit(0.5).alias("score")))
    rows = table(spark, sf, "events").select(i.alias("id"), F.posexplode(I.ledger(items)).alias("place", "x"))
    return rows.select("id", F.col("place").cast("long").alias("place"), "x.*")


@query(
    """with d as (select doc_id as id, list_filter(string_split(text, ' '), lambda w: w <> '') as w from documents)
select id, ((s - 1) // 461)::int as place, len(w[s:s + 511])::bigint as n, sha256(array_to_string(w[s:s + 511], ' ')) as digest from d, unnest(range(1, greatest(1, len(w) - 51) + 1, 461)) as u(s)"""
)
def token_windows(spark, sf):  # noqa: ANN001, ANN201
    """Windows of 512 words of whole texts; each shares a tenth with the next."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    rows = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.posexplode(I.token_pieces(words)).alias("place", "x"))
    return rows.select("id", "place", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", " "), 256).alias("digest"))


_LETTERS = "case doc_id % 5 when 0 then '12 שלום ' when 1 then '(مرحبا) ' when 2 then 'é ' else '' end"


@query(f"select id, case when first = '' then null when regexp_matches(first, '[\\x{{0590}}-\\x{{07FF}}\\x{{FB1D}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFC}}]') then 'rtl' else 'ltr' end as direction from (select doc_id as id, regexp_extract({_LETTERS} || text, '\\p{{L}}') as first from documents)")
def text_directions(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    begin = F.when(i % 5 == 0, "12 שלום ").when(i % 5 == 1, "(مرحبا) ").when(i % 5 == 2, "é ").otherwise("")
    return spread(table(spark, sf, "documents")).select(i.alias("id"), I.direction(F.concat(begin, "text")).alias("direction"))


@query("select case when event_id % 7 = 0 then null else event_id end as id, case when event_id % 7 = 0 then null else event_type end as kind from events where event_id % 5 > 1")
def stream_lines_decoded(spark, sf):  # noqa: ANN001, ANN201
    """Server-sent lines of events: comments and ends go, every seventh line is broken JSON and becomes a null row."""
    i = F.col("event_id")
    body = F.when(i % 7 == 0, '{"id": ').otherwise(F.to_json(F.struct(i.alias("id"), F.col("event_type").alias("kind"))))
    line = F.when(i % 5 == 0, "data: [DONE]").when(i % 5 == 1, ": ping").otherwise(F.concat(F.lit("data: "), body))
    return S.decoded_events(table(spark, sf, "events").select(line.alias("value")), "id long, kind string").select("event.*")


@query("select doc_id as id, sha256(source) as question_sha256, sha256(trim(regexp_replace(source || ' answer', '\\s+', ' ', 'g'))) as answer_sha256 from documents")
def snapshot_rows(spark, sf):  # noqa: ANN001, ANN201
    """A snapshot of questions and answers by digests."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.concat(F.col("source"), F.lit(" answer")).alias("answer"))
    return E.snapshot(d)
