"""Queries over text functions: codes, pieces, clean-up, redaction; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import codes as K
from brindle.functions import text as T
from brindle.operators import search as S
from brindle.operators import segment as G
from brindle.plans.registry import register
from brindle.sources.tables import materialised, spread, table

QUERIES: dict = {}
query = register(QUERIES)

# ---- codes. RE2 has no look-around: runs of letters and digits are put in brackets first, so that a code's ends show.
_RUNS = "regexp_replace({}, '([A-Za-z0-9]+)', '⟦\\1⟧', 'g')"
_SHOWN = "ERR(?:⟧[ \\t\\n\\r_-]*⟦)?(?:[0-9]{{1,3}}|CF)|NO(?:⟧[ \\t\\n\\r_-]*⟦)?CF|FULL(?:⟧[ \\t\\n\\r_-]*⟦)?CF".replace("{{", "{").replace("}}", "}")
_ANY = f"(?i)⟦(?:{_SHOWN}|[A-Z]{{1,3}}(?:⟧[_-]⟦)?[0-9]{{2,3}})⟧"
_NORM = """case when regexp_full_match({0}, 'ERR[ \\t\\n\\r_-]*[0-9]{{1,3}}') then 'ERR ' || lpad(regexp_extract({0}, '[0-9]+'), greatest(2, length(regexp_extract({0}, '[0-9]+')))::int, '0')
 when regexp_full_match({0}, 'ERR[ \\t\\n\\r_-]*CF') then 'ERR CF' when regexp_full_match({0}, 'NO[ \\t\\n\\r_-]*CF') then 'NO CF' when regexp_full_match({0}, 'FULL[ \\t\\n\\r_-]*CF') then 'FULL CF'
 when regexp_full_match({0}, '[A-Z]{{1,3}}[_-]?[0-9]{{2,3}}') then regexp_replace({0}, '[_-]', '', 'g') end"""


def codes_sql(text: str, pattern: str = _ANY) -> str:
    """Distinct codes of a text in their one form, in order."""
    raw = f"list_transform(regexp_extract_all({_RUNS.format(text)}, '{pattern}'), lambda y: upper(regexp_replace(y, '[⟦⟧]', '', 'g')))"
    n = _NORM.format("x")
    listed = f"list_transform({raw}, lambda x: {n})"
    return f"list_filter(list_transform({listed}, lambda v, i: case when list_position({listed}, v) = i then v end), lambda v: v is not null)"


_SOME = "(text || ' Err_' || (doc_id % 13) || ' no-cf (E0' || (doc_id % 10) || ') ab' || doc_id || 'x9')"


def _docs(spark, sf):  # noqa: ANN001, ANN202
    """Documents, and their texts with a few codes put behind (the prose holds hardly any)."""
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text", "lang", "source")
    n = F.col("id").cast("string")
    return d.withColumn("coded", F.concat("text", F.lit(" Err_"), (F.col("id") % 13).cast("string"), F.lit(" no-cf (E0"), (F.col("id") % 10).cast("string"), F.lit(") ab"), n, F.lit("x9")))


@query(f"select doc_id as id, array_to_string({codes_sql(_SOME)}, ',') as codes from documents")
def code_extract(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.array_join(K.codes(F.col("coded")), ",").alias("codes"))


@query(f"select doc_id as id, array_to_string({codes_sql(_SOME, f'(?i)⟦(?:{_SHOWN})⟧')}, ',') as codes, len(regexp_extract_all({_RUNS.format('text')}, '(?i)⟦(?:{_SHOWN})⟧')) > 0 as has_code from documents")
def code_display(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.array_join(K.display_codes(F.col("coded")), ",").alias("codes"), K.has_display_code(F.col("text")).alias("has_code"))


@query(f"with c as (select distinct regexp_extract(t, '[A-Za-z]+[ _-]?[0-9]+') as raw from (select unnest(regexp_extract_all({_SOME}, '[A-Za-z]{{1,4}}[_-]?[0-9]{{1,4}}')) as t from documents)) select raw, {_NORM.format('upper(raw)')} as code from c")
def code_normalize(spark, sf):  # noqa: ANN001, ANN201
    raw = _docs(spark, sf).select(F.explode(T.all_of(F.col("coded"), "[A-Za-z]{1,4}[_-]?[0-9]{1,4}")).alias("raw")).distinct()
    return raw.select("raw", K.normalized_code(F.col("raw")).alias("code"))


@query(f"select doc_id as id, array_to_string(flatten(list_transform(list_filter({codes_sql(_SOME)}, lambda c: contains(c, ' ')), lambda c: [c, replace(c, ' ', ''), replace(c, ' ', '_')])), ',') as forms from documents")
def code_search_forms(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.array_join(K.search_forms(F.col("coded")), ",").alias("forms"))


_OTHER = "list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(lower({}), '([\\p{{L}}\\p{{N}}_]+)', '⟦\\1⟧', 'g'), '⟦[a-z]+[0-9]+[a-z0-9]*⟧(?:-+⟦[a-z0-9]+⟧|-+)*'), lambda y: regexp_replace(y, '[⟦⟧]', '', 'g')), lambda x: " + _NORM.format("upper(x)").replace("{", "{{").replace("}", "}}") + " is null))"


@query(f"select doc_id as id, array_to_string(list_sort(list_transform({_OTHER.format(_SOME)}, lambda x: rtrim(x, '-'))), ',') as names from documents")
def code_unrecognized(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.array_join(F.array_sort(K.other_codes(F.col("coded"))), ",").alias("names"))


# ---- tokens and keywords
TOKENS_SQL = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+[0-9]+[a-z0-9-]*|[a-z]{{2,}}|[0-9]+(?:\\.[0-9]+)?') || flatten(list_transform(regexp_extract_all({0}, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))) || list_filter(regexp_extract_all({0}, '[一-鿿]+'), lambda r: length(r) <= 4))"


@query("select doc_id as id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+[0-9]+[a-z0-9-]*|[0-9]+(?:\\.[0-9]+)?(?:v|w|a|hz|mm|cm)?') || regexp_extract_all(lower(text), '[a-z0-9_]+')))::bigint as n from documents")
def tok_search_terms(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.size(T.search_tokens(F.col("text"))).cast("long").alias("n"))


@query("""with w as (select doc_id as id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[.-]+[\\p{L}\\p{N}_]+)*')) as w, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[.-]+[\\p{L}\\p{N}_]+)*'), 1) as i from documents)
select id, count(*) as n from (select distinct id, w from w where regexp_full_match(w, '[A-Za-z]+[0-9]+[A-Za-z0-9]*') or regexp_full_match(w, '[0-9]+(?:V|W|A|Hz|mm|cm)?')) group by 1""")
def keyword_names(spark, sf):  # noqa: ANN001, ANN201
    """Keywords that are one word, counted by document."""
    whole = F.filter(F.array_distinct(T.all_of(F.col("text"), r"[\p{L}\p{N}_]+(?:[.-]+[\p{L}\p{N}_]+)*")), lambda w: w.rlike("^(?:[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+(?:V|W|A|Hz|mm|cm)?)$") & (F.size(T.keywords(w)) == 1))
    return _docs(spark, sf).select("id", F.size(whole).cast("long").alias("n")).where("n > 0")


# ---- segmentation
def _word_lists(spark, sf):  # noqa: ANN001, ANN202
    """id and w, the distinct words of each document in order with blanks between, as written: texts are read once."""
    return materialised(_docs(spark, sf).select("id", F.array_join(F.array_sort(T.words(F.col("text"))), " ").alias("w")))


def _counted(lists):  # noqa: ANN001, ANN202
    """The dictionary of written word lists."""
    return lists.where("w <> ''").select(F.explode(F.split("w", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def _two(sep):  # noqa: ANN001, ANN202
    """The words of w by twos."""
    return F.transform(T.all_of(F.col("w"), "[a-z]++ [a-z]++"), lambda x: F.replace(x, F.lit(" "), F.lit(sep)))


_PATHS = """
with recursive d as (select doc_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) as w from documents),
f as (select w, count(*) as n from (select unnest(w) as w from d) group by 1),
g as (select w, round(ln(n / (select sum(n) from f)) * 1000000)::bigint as k, round(ln(1 / (select sum(n) from f)) * 1000000)::bigint as once from f),
r as (select id, k, w[2 * k + 1] || w[2 * k + 2] as run, w[2 * k + 1] || ' ' || w[2 * k + 2] as whole from d, unnest(range(len(w) // 2)) as u(k)),
u as materialized (select distinct run from r),
e as materialized (select run, i, list({'n': n, 'k': k}) as x from (select run, i, n, substr(run, i, n) as w from u, unnest(range(1, length(run) + 1)) as a(i), unnest(range(1, length(run) - i + 2)) as b(n)) join g using (w) group by 1, 2),
p as (select run, length(run) + 1 as i, [0::bigint] as best, [''] as paths from u union all
 select run, i, [c.s] || best, [substr(run, i, c.n) || ' ' || paths[c.n]] || paths from (
  select p.run, p.i - 1 as i, best, paths, list_max(list_transform(coalesce(e.x, []) || case when len(list_filter(coalesce(e.x, []), lambda y: y.n = 1)) = 0 then [{'n': 1::bigint, 'k': (select min(once) from g)}] else [] end, lambda y: {'s': y.k + best[y.n], 'n': y.n})) as c from p left join e on e.run = p.run and e.i = p.i - 1 where p.i > 1)),
s as (select run, trim(paths[1]) as words from p where i = 1)"""


@query(_PATHS + " select id, sum(1 + length(words) - length(replace(words, ' ', '')))::bigint as n, count(*) filter (words = whole) as n_found, sha256(string_agg(words, ',' order by k)) as digest from r join s using (run) group by id")
def segmented_words(spark, sf):  # noqa: ANN001, ANN201
    """Each document's words, by twos without the blank between, divided again by a dictionary of the whole table."""
    d = _word_lists(spark, sf)
    found = G.segmented_lists(d.where("contains(w, ' ')"), _counted(d), _two("")).withColumn("x", F.transform("words", lambda x: F.array_join(x, " ")))
    n_found = F.size(F.filter(F.arrays_zip("x", _two(" ").alias("whole")), lambda x: x["x"] == x["whole"])).cast("long")
    return found.select("id", F.size(F.flatten("words")).cast("long").alias("n"), n_found.alias("n_found"), F.sha2(F.array_join("x", ","), 256).alias("digest"))


_ASKED = "regexp_extract_all(lower(text), '[a-z]{2,}')"


@query(
    _PATHS.replace("u as materialized (select distinct run from r)", f"b as (select item_id as query_id, unnest({_ASKED}) as run from benchmark),\nu as materialized (select run from r union select run from b)")
    + """, t as (select id, list_distinct(flatten(list(string_split(words, ' ')))) as t from r join s using (run) group by id),
q as (select distinct query_id, unnest(string_split(words, ' ')) as token from b join s using (run)),
st as (select count(*) as n, sum(len(t)) / count(*)::double as avgdl from t), o as (select id, len(t) as dl, unnest(t) as token from t), df as (select token, count(*) as df from o group by 1),
h as (select query_id, id, count(*) as m, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * 2.5::double / (1 + 1.5::double * (0.25::double + 0.75::double * dl / greatest(1.0::double, avgdl)))), 6) as score from o join q using (token) join df using (token), st group by 1, 2)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from h where m >= 2 qualify rank <= 20"""
)
def search_bm25_segmented(spark, sf):  # noqa: ANN001, ANN201
    """Search over texts whose words stand by twos without the blank between, divided by the dictionary of the whole table."""
    d = _word_lists(spark, sf)
    dictionary = G.Lexicon(_counted(d))  # for documents and for queries
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_join(T.words(F.col("text")), " ").alias("text"))
    divided = lambda texts: G.segmented_texts(texts, dictionary, "[a-z]{2,}").select("id", F.array_join("words", " ").alias("text"))
    return S.bm25(divided(d.where("contains(w, ' ')").select("id", F.array_join(_two(""), " ").alias("text"))), divided(asked).withColumnRenamed("id", "query_id"), tokens=lambda t: F.array_distinct(F.split(t, " ")))


# ---- pieces
@query("""with l as (select doc_id as id, list_filter(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') as r, text from documents)
select id, k::int as place, sha256(case when len(r) > 1 then r[1] || chr(10) || r[k + 2] else text end) as digest from l, unnest(range(greatest(1, len(r) - 1))) as u(k)""")
def chunk_table_profile(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.posexplode(T.table_pieces(F.col("text"))).alias("place", "piece")).select("id", "place", F.sha2("piece", 256).alias("digest"))


@query("""with q as (select conv_id, string_agg(case when role = 'user' then 'Q: ' else 'A: ' end || text, chr(10) order by turn) as t from conversations group by 1),
p as (select conv_id, list_filter(list_transform(string_split(regexp_replace(t, '(^|[^\\p{L}\\p{N}_])((?i:Q|问)[:：])', '\\1⟪\\2', 'g'), '⟪'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') as parts from q)
select conv_id, len(parts)::bigint as n, sha256(array_to_string(parts, '|')) as digest from p""")
def chunk_qa_profile(spark, sf):  # noqa: ANN001, ANN201
    said = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), "text").alias("t")).alias("x"))
    text = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("t"))
    parts = T.question_pieces(F.col("t"))
    return text.select("conv_id", F.size(parts).cast("long").alias("n"), F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


@query("""with t as (select doc_id as id, '1. ' || replace(trim(text, ' ' || chr(10) || chr(13) || chr(9)), '. ', chr(10) || '2. ') as t from documents)
select id, len(regexp_extract_all(t, '(?:^|[\\n。；;])[ \\t\\n]*(?:步骤[ \\t\\n]*)?[0-9]+[.、:：][ \\t\\n]*'))::bigint as n_markers,
 array_to_string(case when len(regexp_extract_all(t, '(?:^|[\\n。；;])[ \\t\\n]*(?:步骤[ \\t\\n]*)?[0-9]+[.、:：][ \\t\\n]*')) >= 2 then list_filter(list_transform(string_split(regexp_replace(t, '(?:^|[\\n。；;])[ \\t\\n]*(?:步骤[ \\t\\n]*)?[0-9]+[.、:：][ \\t\\n]*', '⟪', 'g'), '⟪')[2:], lambda x: trim(x, ' ' || chr(10) || '。；;，,')), lambda x: x <> '') else [] end, '|') as steps from t""")
def steps_numbered(spark, sf):  # noqa: ANN001, ANN201
    t = _docs(spark, sf).select("id", F.concat(F.lit("1. "), F.replace(F.btrim("text", F.lit(" \n\r\t")), F.lit(". "), F.lit("\n2. "))).alias("t"))
    marker = r"(?:^|[\n。；;])[ \t\n]*(?:步骤[ \t\n]*)?[0-9]+[.、:：][ \t\n]*"
    return t.select("id", F.size(T.all_of(F.col("t"), marker)).cast("long").alias("n_markers"), F.array_join(T.numbered_steps(F.col("t")), "|").alias("steps"))


# ---- clean-up
@query("select doc_id as id, sha256(trim(regexp_replace(trim(regexp_replace(text || '  ' || chr(13) || chr(10) || ' end ', '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '(?m)[ \\t\\x0b\\x0c]+$', '', 'g'))) as digest from documents")
def answer_normalize(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.sha2(F.btrim(T.normal_answer(F.concat("text", F.lit("  \r\n end ")))), 256).alias("digest"))


@query("""select doc_id as id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(translate(t, chr(160) || '“”‘’–—…·•℃℉', ' ""''''--，--CF'), '≤', '<='), '≥', '>='), '[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{feff}]', '', 'g'),
 '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) as digest from (select doc_id, text || '“q” – 5 ≤ 6 … 20℃' || chr(8203) || chr(10) || chr(10) || chr(10) || 'x' as t from documents)""")
def submission_sanitize(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.sha2(T.submission(F.concat("text", F.lit("“q” – 5 ≤ 6 … 20℃​\n\n\nx"))), 256).alias("digest"))


@query("""with t as (select doc_id as id, '"' || replace(replace(text, chr(10), ' '), '"', '') || '","caf' || chr(233) || ' ' || doc_id || ',"' as t from documents),
l as (select id, string_split(regexp_replace(t, '"[ \\t\\n\\r]*,[ \\t\\n\\r]*\\??[ \\t\\n\\r]*"', chr(10), 'g'), chr(10)) as l from t)
select id, sha256(array_to_string(list_filter(list_transform(l, lambda x: trim(trim(regexp_replace(trim(trim(x, ' ' || chr(9)), '"“”'), '[，,][ \\t]*\\?$', ''), ' ，,'), '"“”')), lambda x: x <> ''), chr(10))) as digest from l""")
def question_repair(spark, sf):  # noqa: ANN001, ANN201
    t = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")), F.lit('","caf\\u00e9 '), F.col("id").cast("string"), F.lit(',"'))
    return _docs(spark, sf).select("id", F.sha2(T.repaired_question(t), 256).alias("digest"))


@query("select page_id, sha256(trim(regexp_replace(html, '(?i)https?://[^ \\t\\n\\r\"''，。！？；]+', '', 'g'))) as digest from pages")
def url_remove(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("page_id", F.sha2(T.without_urls(F.col("html")), 256).alias("digest"))


@query("select page_id, regexp_replace(lower(regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]+$', '\\1')), '[^a-z0-9]+', '', 'g') as stem from pages")
def stem_normalize(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))


@query("select conv_id, turn, substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 36) as title from conversations")
def title_preview(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "conversations").select("conv_id", "turn", T.preview(F.col("text")).alias("title"))


@query("select conv_id, turn, rtrim(substr(text, 1, case when length(text) <= 160 then length(text) else 160 end), ' ' || chr(9) || chr(10) || chr(13)) as head from conversations where not regexp_matches(text, '[一-鿿]')")
def truncate_to_budget(spark, sf):  # noqa: ANN001, ANN201
    """Forty tokens of four characters; texts with ideographs are tested in Python."""
    return table(spark, sf, "conversations").where(~F.col("text").rlike("[一-鿿]")).select("conv_id", "turn", T.within_budget(F.col("text"), 40).alias("head"))


@query("select page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), 1, 107) || '-' || substr(sha256(url), 1, 12) as name from pages")
def safe_components(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "pages").select("page_id", T.safe_component(F.col("url")).alias("name"))


@query("select event_id, nullif(regexp_extract('Answer: ' || props || ' done', '(?s)\\{.*\\}'), '') as body, cast(props ->> 'k' as bigint) as k from events")
def json_from_text(spark, sf):  # noqa: ANN001, ANN201
    body = T.json_object(F.concat(F.lit("Answer: "), "props", F.lit(" done")))
    return table(spark, sf, "events").select("event_id", body.alias("body"), F.get_json_object(body, "$.k").cast("long").alias("k"))


@query("select doc_id as id, substr(case when trim(lang) = trim(source) then trim(lang) else trim(lang) || chr(10) || trim(source) end || case when trim(text) = '' or trim(text) in (trim(lang), trim(source)) then '' else chr(10) || trim(text) end, 1, 1200) as text from documents")
def visual_search_text(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", T.joined_parts([F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.lit("  "), F.col("text"), F.col("lang")]).alias("text"))


@query("select doc_id as id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')).len()::bigint as n from documents")
def string_lists(spark, sf):  # noqa: ANN001, ANN201
    return _docs(spark, sf).select("id", F.size(T.string_list(F.split("text", "\n"))).cast("long").alias("n"))


@query("select conv_id, turn, trim(string_split(text || chr(10) || 'memory: old' || chr(10) || 'more', chr(10) || 'memory:')[1], ' ' || chr(9) || chr(10) || chr(13)) as question from conversations where not contains(text, 'memory:')")
def retrieval_question(spark, sf):  # noqa: ANN001, ANN201
    turns = table(spark, sf, "conversations").where("not contains(text, 'memory:')")
    return turns.select("conv_id", "turn", T.lines_before(F.concat("text", F.lit("\nmemory: old\nmore")), "memory:").alias("question"))


@query("select doc_id as id, array_to_string(list_transform(range(doc_id % 6), lambda k: (doc_id * 7 + k * 131) % 1000), ',') as cited from documents")
def citation_parse(spark, sf):  # noqa: ANN001, ANN201
    """Up to five citations among each document's words, every second one in other digits, with and without a blank."""
    number = lambda k: ((F.col("id") * 7 + k * 131) % 1000).cast("string")
    shown = lambda k: F.when(k % 2 == 1, F.translate(number(k), "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(number(k))
    plain = F.replace(F.col("text"), F.lit("[ID:"), F.lit("[id:"))
    ks = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: k < F.col("id") % 6)
    said = F.array_join(F.transform(ks, lambda k: F.concat(F.lit(" [ID:"), F.when(k % 3 == 0, " ").otherwise(""), shown(k), F.lit("] "), F.substring(plain, k * 40 + 1, F.lit(40)), F.lit(" [ID:] [ID:x1]"))), "")
    return _docs(spark, sf).select("id", F.array_join(T.citations(F.concat("text", said)).cast("array<string>"), ",").alias("cited"))


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'R' then '导入章节 ' || l_partkey when l_quantity::bigint % 4 = 0 then '第 ' || l_partkey || ' 页' else '第 ' || l_partkey || '-' || (l_partkey + l_quantity::bigint % 4) || ' 页' end as label from lineitem")
def locator_label(spark, sf):  # noqa: ANN001, ANN201
    """Where each line item's part stands: imported sections for returned ones, else one page or several."""
    first = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.locator(first, first + F.col("l_quantity").cast("long") % 4, F.col("l_returnflag") == "R").alias("label"))


_MARK = "'[已脱敏:' || substr(sha256({}), 1, 10) || ']'"
#: A checksum's ten digits may hold a long number themselves, which then becomes a token too.
_TOKEN = f"case when regexp_matches({_MARK}, '[0-9]{{{{8}}}}') then replace({_MARK}, regexp_extract({_MARK}, '[0-9]{{{{8,}}}}'), '[已脱敏:' || substr(sha256(regexp_extract({_MARK}, '[0-9]{{{{8,}}}}')), 1, 10) || ']') else {_MARK} end"


@query(f"""with t as (select doc_id as id, (10000000 + doc_id)::varchar as a, 'AB-' || (100 + doc_id) as b from documents)
select id, 'serial number: ' || {_TOKEN.replace('{}', 'b').replace('{{', '{').replace('}}', '}')} || ' call ' || {_MARK.format('a')} || ' or 123, again ' || {_TOKEN.replace('{}', 'b').replace('{{', '{').replace('}}', '}')} as text from t""")
def redact_records(spark, sf):  # noqa: ANN001, ANN201
    """Identifiers with a label, the same ones without it in another field, long numbers; short numbers stay."""
    t = _docs(spark, sf).select("id", (F.lit(10000000) + F.col("id")).cast("string").alias("a"), F.concat(F.lit("AB-"), (F.lit(100) + F.col("id")).cast("string")).alias("b"))
    rows = t.select("id", F.concat(F.lit("serial number: "), "b", F.lit(" call "), "a", F.lit(" or 123")).alias("first"), F.concat(F.lit(", again "), "b").alias("second"))
    known = T.identifiers(F.col("first"))
    return rows.select("id", F.concat(T.redacted_record(F.col("first"), known), T.redacted_record(F.col("second"), known)).alias("text"))
