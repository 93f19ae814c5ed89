"""Queries over blocks, sections, pieces and data-flow lists; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import lists as L
from brindle.functions import text as T
from brindle.operators import chunking as C
from brindle.plans.registry import register
from brindle.sources import office as O
from brindle.sources.tables import spread, table

QUERIES: dict = {}
query = register(QUERIES)

#: Documents as manuals: each document's first lines under headings, a list, and two headings in a row.
_MANUAL = """(select doc_id as id, source as title, trim(regexp_replace(text, '[\\r\\n]+[-*# ]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || '-*#') as t from documents where trim(regexp_replace(text, '[\\r\\n]+[-*# ]*', chr(10), 'g'), ' ' || chr(10) || chr(9) || '-*#') <> '')"""


def _manuals(spark, sf):  # noqa: ANN001, ANN202
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.btrim(F.regexp_replace("text", r"[\r\n]+[-*# ]*", "\n"), F.lit(" \n\t-*#")).alias("t")).where("t <> ''")
    n = F.col("id").cast("string")
    return d.select("id", "title", F.concat(F.lit("intro "), n, F.lit("\n# First\n## Second "), n, F.lit("\n\n"), "t", F.lit("\n- item\n* other\nlast line\n \nend\n# Trailing")).alias("text"))


_LINES = "array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9))), chr(10))"


@query(
    f"""with m as {_MANUAL}, p as (select id, trim({_LINES}, chr(10) || ' ' || chr(9)) as t from m) select id, k::int as place, kind, sha256(body) as digest from (
 select id, 0 as k, 'paragraph' as kind, 'intro ' || id as body from p union all select id, 1, 'heading', 'First' from p union all select id, 2, 'heading', 'Second ' || id from p
 union all select id, 2 + i, 'paragraph', trim(string_split(regexp_replace(t, '\\n\\n+', '⟪', 'g'), '⟪')[i], chr(10)) from p, unnest(range(1, len(string_split(regexp_replace(t, '\\n\\n+', '⟪', 'g'), '⟪')) + 1)) as u(i)
 union all select id, 3 + len(string_split(regexp_replace(t, '\\n\\n+', '⟪', 'g'), '⟪')) + j, (['list', 'list', 'paragraph', 'paragraph', 'heading'])[j + 1], (['item', 'other', 'last line', 'end', 'Trailing'])[j + 1] from p, (select unnest(range(5)) as j))"""
)
def parse_blocks(spark, sf):  # noqa: ANN001, ANN201
    rows = _manuals(spark, sf).select("id", F.posexplode(C.blocks(F.col("text"))).alias("place", "b"))
    return rows.select("id", "place", F.col("b.kind").alias("kind"), F.sha2("b.text", 256).alias("digest"))


@query(f"with m as {_MANUAL} select id, 0 as section, title, ('intro ' || id) as first from m union all select id, 1, 'Second ' || id, trim(string_split(trim({_LINES}, chr(10) || ' ' || chr(9)), chr(10))[1]) from m")
def sections_markdownish(spark, sf):  # noqa: ANN001, ANN201
    return C.sections(_manuals(spark, sf), C.blocks(F.col("text"))).select("id", "section", "title", F.btrim(F.split("text", "\n")[0]).alias("first"))


@query(
    """with recursive d as (select doc_id as id, text as t from documents where length(text) > 520),
w as (select id, t, 0 as place, 1 as s, substr(t, 1, 520) as raw from d union all
 select id, t, place + 1, greatest(s + 1, e - 70), substr(t, greatest(s + 1, e - 70), 520) from (select *, s + case when b > 261 then b else length(raw) end as e from (select *, greatest(length(raw) + 1 - coalesce(nullif(instr(reverse(raw), chr(10)), 0), length(raw) + 1), length(raw) + 1 - coalesce(nullif(instr(reverse(raw), '。'), 0), length(raw) + 1)) as b from w)) where e <= length(t)),
c as (select id, place, substr(raw, 1, case when b > 261 then b else length(raw) end) as p from (select *, greatest(length(raw) + 1 - coalesce(nullif(instr(reverse(raw), chr(10)), 0), length(raw) + 1), length(raw) + 1 - coalesce(nullif(instr(reverse(raw), '。'), 0), length(raw) + 1)) as b from w))
select id, count(*) as n, sha256(string_agg(sha256(trim(p, ' ' || chr(10) || chr(9) || chr(13))), ',' order by place)) as digest from c where trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> '' group by 1"""
)
def chunk_soft_boundary(spark, sf):  # noqa: ANN001, ANN201
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text").where("length(text) > 520")
    lists = C.soft_pieces(d).groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.sha2("piece", 256).alias("d")))).alias("x"))
    return lists.select("id", "n", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ","), 256).alias("digest"))


#: Windows of texts over 520 characters, as in chunk_soft_boundary: id and number.
_WINDOWS = """with recursive d as (select doc_id as id, text as t from documents where length(text) > 520),
w as (select id, t, 0 as place, 1 as s, substr(t, 1, 520) as raw from d union all
 select id, t, place + 1, greatest(s + 1, e - 70), substr(t, greatest(s + 1, e - 70), 520) from (select *, s + case when b > 261 then b else length(raw) end as e from (select *, greatest(length(raw) + 1 - coalesce(nullif(instr(reverse(raw), chr(10)), 0), length(raw) + 1), length(raw) + 1 - coalesce(nullif(instr(reverse(raw), '。'), 0), length(raw) + 1)) as b from w)) where e <= length(t)),
c as (select id, count(*) as n from (select id, substr(raw, 1, case when b > 261 then b else length(raw) end) as p from (select *, greatest(length(raw) + 1 - coalesce(nullif(instr(reverse(raw), chr(10)), 0), length(raw) + 1), length(raw) + 1 - coalesce(nullif(instr(reverse(raw), '。'), 0), length(raw) + 1)) as b from w)) where trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> '' group by 1)"""


@query(
    _WINDOWS
    + """, l as (select doc_id, source, text, len(list_filter(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> '')) as lines from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')
select doc_id as id, 0 as section, case when lines > 2 then lines - 1 else coalesce(c.n, 1) end::bigint as n, case when regexp_matches(lower(source || ' ' || text), 'tion') then 'noun' when regexp_matches(lower(source || ' ' || text), 'ouch') then 'other' end as product from l left join c on c.id = doc_id"""
)
def chunk_profiles(spark, sf):  # noqa: ANN001, ANN201
    """Whole documents by the table profile (those of one row by windows): the number of pieces, and the product class of their text."""
    d = spread(table(spark, sf, "documents")).where(F.btrim("text", F.lit(" \t\n\r")) != "").select(F.col("doc_id").alias("id"), F.lit(0).alias("section"), F.col("source").alias("title"), "text")
    made = C.chunks(d, "table", {"noun": ["tion"], "other": ["ouch"]})
    return made.groupBy("id", "section", "product").agg(F.count("*").alias("n"))


@query("select event_id as id, event_type || '-' || user_id as merged, (list_sort([user_id, event_id % 7, 3]))[1] as least, case when event_id % 7 = 3 then 2 when user_id = 3 then 2 when user_id = event_id % 7 then 2 else 3 end::int - case when event_id % 7 = 3 and user_id = 3 then 1 else 0 end as n, 3::bigint as last, user_id > 5 and not contains(event_type, 'e') as held, case when event_id % 3 = 0 then null else value / (event_id % 3) end as share from events where value is not null")
def list_operations(spark, sf):  # noqa: ANN001, ANN201
    values = F.array("user_id", F.col("event_id") % 7, F.lit(3).cast("long"))
    held = L.metadata_filter([("user_id", ">", 5), ("event_type", "not contains", "e")])
    return table(spark, sf, "events").where("value is not null").select(F.col("event_id").alias("id"), L.merged([F.col("event_type"), F.col("user_id")], "hyphen").alias("merged"), L.nth(L.ordered(values), 0).alias("least"), F.size(L.distinct(values)).alias("n"), L.nth(L.tail(L.head(values, 3), 1), -1).alias("last"), held.alias("held"), L.assigned(F.col("value"), "/=", F.col("event_id") % 3).alias("share"))


@query("select event_id as id, (props ->> 'k')::bigint as k, event_type as kind, 2::int as n_selected, case when event_id % 2 = 0 then 'even' else 'odd' end as parity from events")
def object_operations(spark, sf):  # noqa: ANN001, ANN201
    obj = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("none"), F.lit("")))
    full = L.updated(L.value_filtered(obj, "not empty", None), "parity", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    named = L.renamed(full, {"type": "kind"})
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.element_at(L.literals(L.selected(named, ["k"])), "k").cast("long").alias("k"), F.element_at(L.removed(named, ["k"]), "kind").alias("kind"), F.size(L.selected(named, ["kind", "parity", "none"])).alias("n_selected"), F.element_at(named, "parity").alias("parity"))


# ---- word-processor and PDF files, made from the documents and read again
_ROWS = """(select doc_id as id, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), ' ' || chr(9))), lambda x: x <> '') as l from documents)"""


def _line_blocks(spark, sf):  # noqa: ANN001, ANN202
    """Documents as blocks: a list item for each fifth line, a heading for each seventh, else a paragraph; their texts are the lines."""
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    kind = lambda i: F.when(i % 5 == 4, "list").when(i % 7 == 6, "heading").otherwise("paragraph")
    blocks = F.transform(T.lines(clean), lambda x, i: F.struct(kind(i).alias("kind"), x.alias("text"), F.when(kind(i) == "heading", 1 + i % 6).cast("int").alias("level")))
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), blocks.alias("blocks"))


@query(f"select id, k::int as place, case when k % 5 = 4 then 'list' when k % 7 = 6 then 'heading' else 'paragraph' end as kind, case when k % 5 <> 4 and k % 7 = 6 then (1 + k % 6)::int end as level, sha256(l[k + 1]) as digest from {_ROWS}, unnest(range(len(l))) as u(k)")
def docx_blocks(spark, sf):  # noqa: ANN001, ANN201
    rows = O.parsed_files(O.as_files(_line_blocks(spark, sf), "docx"))
    return rows.select(F.col("title").cast("long").alias("id"), "place", "kind", "level", F.sha2("text", 256).alias("digest"))


@query(f"select id, (k + 1)::int as page, case when length(l[k + 1]) <= 80 and right(l[k + 1], 1) not in ('。', '.', '!', '?', '；', ';') then 'heading' else 'paragraph' end as kind, sha256(l[k + 1]) as digest from {_ROWS}, unnest(range(len(l))) as u(k)")
def pdf_pages(spark, sf):  # noqa: ANN001, ANN201
    rows = O.parsed_files(O.as_files(_line_blocks(spark, sf), "pdf"))
    return rows.select(F.col("title").cast("long").alias("id"), "page", "kind", F.sha2("text", 256).alias("digest"))
