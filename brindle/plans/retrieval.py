"""Queries over the corpus: tokens, search, fusion, codes, versions, vectors; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import vector as V
from brindle.operators import lifecycle as L
from brindle.operators import search as S
from brindle.operators import views as U
from brindle.plans.registry import register
from brindle.plans.texts import _OTHER, TOKENS_SQL, codes_sql
from brindle.sources.tables import materialised, spread, table

QUERIES: dict = {}
query = register(QUERIES)

#: The corpus: documents with a code of their own put behind the text, by fours under one parent. The queries: benchmark texts,
#: every third with a code.
_D = "(select doc_id as id, doc_id // 4 as parent_id, source as title, lang, text || ' (E' || (10 + doc_id % 90) || ')' as text from documents)"
_Q = "(select item_id as query_id, case when item_id % 3 = 0 then text || ' e' || (10 + item_id % 90) else text end as text from benchmark)"
_TOK = TOKENS_SQL.format("text")


def _exact(text: str) -> str:
    return f"({codes_sql(text)} || {_OTHER.format(text)})"


def corpus(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    """dealt: over many tasks, for work on all texts; to look up texts of few ids they are read where they are."""
    d = table(spark, sf, "documents")
    d = spread(d) if dealt else d
    code = F.concat(F.lit(" (E"), (10 + F.col("doc_id") % 90).cast("string"), F.lit(")"))
    return d.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).cast("long").alias("parent_id"), F.col("source").alias("title"), "lang", "source", F.concat("text", code).alias("text"))


def plain_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "lang", "source", "text")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    coded = F.concat("text", F.lit(" e"), (10 + F.col("item_id") % 90).cast("string"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, coded).otherwise(F.col("text")).alias("text"))


@query(f"select t as token, count(*) as df from (select unnest({_TOK}) as t from {_D}) group by 1")
def tok_document_frequency(spark, sf):  # noqa: ANN001, ANN201
    return S.postings(corpus(spark, sf)).groupBy("token").agg(F.count("*").alias("df"))


@query(f"select id, len({_TOK})::bigint as dl from {_D}")
def tok_doc_length(spark, sf):  # noqa: ANN001, ANN201
    return corpus(spark, sf).select("id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"select t as token, count(*) as df from (select unnest({_TOK}) as t from {_D}) group by 1 order by 2 desc, 1 limit 20")
def tok_top_terms(spark, sf):  # noqa: ANN001, ANN201
    return tok_document_frequency(spark, sf).orderBy(F.desc("df"), "token").limit(20)


_TITLED = TOKENS_SQL.format("concat_ws(' ', title, text)")
_OVERLAPS = f"""
with p as (select id, unnest({_TITLED}) as token, {TOKENS_SQL.format('title')} as titles from {_D}),
q as (select query_id, len({_TOK}) as n_query, unnest({_TOK}) as token, regexp_extract_all(lower(text), '\\b[a-z]+[0-9]+[a-z0-9-]*\\b') as codes from {_Q}),
h as (select query_id, id, count(*) as n, count(*) filter (where list_contains(codes, token)) as n_codes, count(*) filter (where list_contains(titles, token)) as n_title, any_value(n_query) as n_query from p join q using (token) group by 1, 2),
r as (select query_id, id, 4.0::double * n / n_query + 2.5::double * n_codes + 0.3::double * n_title + ln(1 + n::double) as score from h where n >= 2 or n_codes > 0)"""
_OVERLAP = _OVERLAPS + " select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, id)::int as rank from r qualify rank <= 10"


@query(_OVERLAP)
def search_overlap(spark, sf):  # noqa: ANN001, ANN201
    return S.overlap(corpus(spark, sf), asked(spark, sf))


@query(
    _OVERLAPS
    + """, g as (select query_id, id // 4 as parent_id, max(score) as best, count(*) as n_children from r group by 1, 2), s as (select *, best + least(1.2::double, 0.4::double * (n_children - 1)) as s from g)
select query_id, parent_id, round(s, 4) as score, round(least(0.95::double, 0.5::double + s / 20), 4) as confidence, n_children, row_number() over (partition by query_id order by round(s, 4) desc, parent_id)::int as rank from s qualify rank <= 5"""
)
def search_overlap_parents(spark, sf):  # noqa: ANN001, ANN201
    return S.overlap_parents(corpus(spark, sf), asked(spark, sf))


def _bm25_sql(where: str, top: int = 20) -> str:
    return f"""
with d as (select id, {_TOK} as t, {_exact('text')} as c from {_D} {where}),
p as (select id, len(t) as dl, unnest(t) as token from d), pc as (select id, unnest(c) as code from d),
q as (select query_id, unnest({_TOK}) as token from {_Q}), qc as (select query_id, unnest({_exact('text')}) as code from {_Q}),
st as (select count(*) as n, sum(len(t)) / count(*)::double as avgdl from d),
f as (select token, count(*) as df from p group by 1),
h as (select query_id, id, 1 as m, 0 as k, ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * 2.5::double / (1 + 1.5::double * (0.25::double + 0.75::double * dl / greatest(1.0::double, avgdl))) as s from p join q using (token) join f using (token), st
 union all select query_id, id, 0, 1, 3.0::double from pc join qc using (code)),
g as (select query_id, id, round(sum(s), 6) as score from h group by 1, 2 having sum(m) >= 2 or sum(k) > 0)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from g qualify rank <= {top}"""


@query(_bm25_sql(""))
def search_bm25_topk(spark, sf):  # noqa: ANN001, ANN201
    return S.bm25(corpus(spark, sf), asked(spark, sf))


@query(_bm25_sql("where lang = 'en'"))
def search_bm25_filtered(spark, sf):  # noqa: ANN001, ANN201
    return S.bm25(corpus(spark, sf).where("lang = 'en'"), asked(spark, sf))


_DENSE = """
with v as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select q.id as query_id, v.id, round(greatest(0, coalesce(list_cosine_similarity(v.v, q.v), 0)), 6) as score from v, v q where q.id % 50 = 0 and v.id <> q.id)
select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from s where score > 0 qualify rank <= 20"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


@query(_DENSE)
def search_dense_topk(spark, sf):  # noqa: ANN001, ANN201
    return S.dense(*_vectors(spark, sf))


#: Query n of the hybrid search is benchmark text n with the vector of number n among the vectors divisible by 50; its hits are
#: documents and, by number, vectors of documents.
_FUSED = f"""
with lx as ({_bm25_sql('')}), dn as ({_DENSE}),
f as (select coalesce(lx.query_id, dn.query_id) as query_id, coalesce(lx.id, dn.id) as id, lx.rank as lex_rank, dn.rank as dense_rank, lx.score as lex_score, dn.score as dense_score,
 round(coalesce(1.0::double / (60 + lx.rank), 0) + coalesce(1.0::double / (60 + dn.rank), 0), 8) as rrf from lx full outer join (select query_id // 50 as query_id, id, rank, score from dn where id in (select doc_id from documents) and query_id // 50 in (select item_id from benchmark)) dn on lx.query_id = dn.query_id and lx.id = dn.id),
t as (select *, row_number() over (partition by query_id order by rrf desc, coalesce(lex_rank, 1000000), dense_rank)::int as place from f qualify place <= 20)"""


def _fused(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lexical and dense lists of the hybrid search."""
    vectors, queries = _vectors(spark, sf)
    # vectors that stand for no query are not searched for; the ranks are those among all vectors
    named = asked(spark, sf).select((F.col("query_id") * 50).alias("query_id"))
    near = S.dense(vectors, queries.join(named, "query_id", "left_semi")).withColumn("query_id", F.floor(F.col("query_id") / 50))
    near = near.join(corpus(spark, sf, dealt=False).select("id"), "id", "left_semi")
    return S.bm25(corpus(spark, sf), asked(spark, sf)), near


@query(_FUSED + " select query_id, id, lex_rank, lex_score, dense_rank, dense_score, rrf, place from t")
def rrf_fusion(spark, sf):  # noqa: ANN001, ANN201
    return S.fused_top(S.fused(*_fused(spark, sf)))


_PARENTS = (
    _FUSED
    + f""", dc as (select id, parent_id, {_exact('text')} as held from {_D}), qc as (select query_id, {_exact('text')} as asked from {_Q}),
g as (select query_id, parent_id, max(rrf) as rrf, count(*) as n_hits, min(place) as place, coalesce(max(lex_score), 0) as lexical, coalesce(max(dense_score), 0) as dense, list(id order by place) as matched, flatten(list(held)) as held, any_value(asked) as asked from t join dc using (id) join qc using (query_id) group by 1, 2),
s as (select *, round(rrf + least(0.006::double, 0.002::double * (n_hits - 1)) + case when list_has_any(asked, held) then 0.012::double else 0 end, 6) as score from g),
r as (select *, row_number() over (partition by query_id order by score desc, place)::int as rank from s where score >= 0.012 and list_has_all(held, asked) qualify rank <= 5)"""
)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    c, q = corpus(spark, sf, dealt=False), asked(spark, sf)
    return S.parents(S.scored_parents(rrf_fusion(spark, sf), c, q))


@query(_PARENTS + " select query_id, parent_id, score, n_hits, round(lexical, 6) as lexical, round(dense, 6) as dense, array_to_string(matched, ',') as matched, rank from r")
def hybrid_parent_rank(spark, sf):  # noqa: ANN001, ANN201
    return _found(spark, sf).select("query_id", "parent_id", "score", "n_hits", F.round("lexical", 6).alias("lexical"), F.round("dense", 6).alias("dense"), F.array_join("matched", ",").alias("matched"), "rank")


#: A filtered corpus: documents of two languages from sources whose name does not end in 3; vectors of these documents alone.
_SOME = f"(select * from {_D} where lang in ('en', 'fr') and not ends_with(title, '3'))"
_NEAR = f"""
with v as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select q.id // 50 as query_id, v.id, round(greatest(0, coalesce(list_cosine_similarity(v.v, q.v), 0)), 6) as score from v, v q where q.id % 50 = 0 and v.id <> q.id // 50 and v.id in (select id from {_SOME}) and q.id // 50 in (select item_id from benchmark))
select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from s where score > 0 qualify rank <= 20"""
_EXPLAINED = (
    f"""
with lx as ({_bm25_sql('').replace(_D, _SOME)}), dn as ({_NEAR}),
f as (select coalesce(lx.query_id, dn.query_id) as query_id, coalesce(lx.id, dn.id) as id, lx.rank as lex_rank, dn.rank as dense_rank, lx.score as lex_score, dn.score as dense_score,
 round(coalesce(1.0::double / (60 + lx.rank), 0) + coalesce(1.0::double / (60 + dn.rank), 0), 8) as rrf from lx full outer join dn on lx.query_id = dn.query_id and lx.id = dn.id),
t as (select *, row_number() over (partition by query_id order by rrf desc, coalesce(lex_rank, 1000000), dense_rank)::int as place from f qualify place <= 20)"""
    + _PARENTS.removeprefix(_FUSED)
)


@query(
    _EXPLAINED
    + """ select query_id, 'parent' as stage, parent_id, score, rank, '' as mode, '' as reason from r union all select b.item_id, 'rejected', null, null, null, case when b.item_id in (select query_id from dn) then 'hybrid' else 'lexical-only' end,
 case when exists (select 1 from s where s.query_id = b.item_id and s.score >= 0.012) then 'codes-missing' else 'below-threshold' end from benchmark b where b.item_id not in (select query_id from r)"""
)
def search_explained(spark, sf):  # noqa: ANN001, ANN201
    """The whole search over some products and datasets: the parents that it finds, and why other queries find none."""
    c = corpus(spark, sf).withColumn("product", F.col("title")).withColumn("dataset_id", F.col("lang"))
    products = [r["title"] for r in c.select("title").distinct().where(~F.endswith("title", F.lit("3"))).collect()]  # the caller's choice
    vectors, queries = _vectors(spark, sf)[0], asked(spark, sf)
    near = vectors.where("id % 50 = 0").select(F.floor(F.col("id") / 50).cast("long").alias("query_id"), "v").join(queries.select("query_id"), "query_id", "left_semi")
    stages = S.explained(c, queries, vectors, near, products=products, datasets=["en", "fr"])
    none = lambda kind: F.lit(None).cast(kind)
    found = stages["parent"].select("query_id", F.lit("parent").alias("stage"), "parent_id", "score", "rank", F.lit("").alias("mode"), F.lit("").alias("reason"))
    return found.unionByName(stages["rejected"].select("query_id", F.lit("rejected").alias("stage"), none("long").alias("parent_id"), none("double").alias("score"), none("int").alias("rank"), "mode", "reason"))


@query(_PARENTS + " select query_id, rank, 'evidence:' || r.parent_id as evidence_id, title, sha256(text) as digest, score, round(least(0.99::double, 0.5::double + least(0.4::double, 8 * score)), 4) as confidence from r join " + _D + " d on d.id = matched[1]")
def evidence_projection(spark, sf):  # noqa: ANN001, ANN201
    return S.evidence(_found(spark, sf), corpus(spark, sf, dealt=False)).select("query_id", "rank", "evidence_id", "title", F.sha2("text", 256).alias("digest"), "score", "confidence")


@query(
    _PARENTS
    + """, n as (select query_id, count(*) as n from r group by 1), c as (select query_id, rank as pr, score, unnest(matched) as id, generate_subscripts(matched, 1) as pos from r),
e as (select c.*, n, row_number() over (partition by query_id order by pr, pos) as k from c join n using (query_id))
select query_id, rank as place, 'parent' as kind, parent_id as id, score from r union all select query_id, (n + k)::int, 'child', id, round(score - 0.000001::double * k, 8) from e where n + k <= 5"""
)
def evidence_supplement(spark, sf):  # noqa: ANN001, ANN201
    return S.supplemented(_found(spark, sf))


@query(
    _PARENTS.replace("list_has_all(held, asked) qualify", "list_has_all(held, asked || case when query_id % 5 = 0 then ['ZZ99'] else [] end) qualify").replace("list_has_any(asked, held)", "list_has_any(asked, held)")
    + " select b.item_id as query_id, case when exists (select 1 from s where s.query_id = b.item_id and s.score >= 0.012) then 'codes-missing' else 'below-threshold' end as reason from benchmark b where b.item_id not in (select query_id from r)"
)
def hybrid_exact_gate(spark, sf):  # noqa: ANN001, ANN201
    """Queries that find nothing, and why: every fifth asks for one more code, that no document has."""
    c, q = corpus(spark, sf, dealt=False), asked(spark, sf)
    more = q.withColumn("text", F.when(F.col("query_id") % 5 == 0, F.concat("text", F.lit(" zz99"))).otherwise(F.col("text")))
    scored = S.scored_parents(rrf_fusion(spark, sf), c, more)
    state = q.select("query_id").join(scored.groupBy("query_id").agg(F.count_if("over").alias("n_over"), F.count_if(F.col("over") & F.col("complete")).alias("n")), "query_id", "left")
    return state.where("coalesce(n, 0) = 0").select("query_id", F.when(F.col("n_over") > 0, "codes-missing").otherwise("below-threshold").alias("reason"))


@query(
    _FUSED
    + f""", k as (select t.*, length(d.text)::double as rerank from t join {_D} d using (id) where place <= 12) select query_id, id, rerank, row_number() over (partition by query_id order by rerank desc, place)::int as place from k"""
)
def rerank_stage(spark, sf):  # noqa: ANN001, ANN201
    """The reranker's hook with the length of a text as its score."""
    out = S.reranked(rrf_fusion(spark, sf), corpus(spark, sf, dealt=False), asked(spark, sf), lambda q, t: F.length(t))
    return out.select("query_id", "id", "rerank", "place")


@query(_FUSED + " select query_id, 'lexical' as stage, rank, id, score from lx union all select query_id // 50, 'dense', rank, id, score from dn where id in (select doc_id from documents) and query_id // 50 in (select item_id from benchmark) union all select query_id, 'fused', place, id, rrf from t")
def stage_trace_long(spark, sf):  # noqa: ANN001, ANN201
    lex, den = _fused(spark, sf)
    both = S.fused_top(S.fused(lex, den)).select("query_id", F.lit("fused").alias("stage"), F.col("place").alias("rank"), "id", F.col("rrf").alias("score"))
    part = lambda df, name: df.select("query_id", F.lit(name).alias("stage"), "rank", "id", "score")
    return part(lex, "lexical").unionByName(part(den, "dense")).unionByName(both)


@query(f"with h as ({_OVERLAP}), q as (select query_id, {_exact('text')} as asked from {_Q}), d as (select id, {_exact('text')} as held from {_D}) select query_id, id, score, rank from h join q using (query_id) join d using (id) where list_has_all(held, asked)")
def code_gate(spark, sf):  # noqa: ANN001, ANN201
    return S.code_gate(search_overlap(spark, sf), corpus(spark, sf, dealt=False), asked(spark, sf)).select("query_id", "id", "score", "rank")


@query(f"with e as ({_bm25_sql(chr(119) + 'here lang = ' + chr(39) + 'es' + chr(39), 5)}), a as ({_bm25_sql('', 5)}) select query_id, id, score, 'es' as lane from e union all select query_id, id, score, 'all' from a where query_id not in (select query_id from e) union all select query_id, id, score, case when query_id % 2 = 0 then 'answer' else 'shadow' end from a")
def search_fallback_lanes(spark, sf):  # noqa: ANN001, ANN201
    """Search in one language with the whole corpus as fallback, and a second list that answers only where it is asked for."""
    c, q = corpus(spark, sf), asked(spark, sf)
    few, all_ = materialised(S.bm25(c.where("lang = 'es'"), q, 5)), materialised(S.bm25(c, q, 5))  # each is read twice or more
    one = S.with_fallback(few.withColumn("lane", F.lit("es")), all_.withColumn("lane", F.lit("all"))).drop("rank")
    wants = q.withColumn("text", F.when(F.col("query_id") % 2 == 0, "show the picture").otherwise("tell"))
    return one.unionByName(S.merged_lanes(all_.limit(0), all_, wants, "on", "picture").drop("rank"))


_FIELD_TOK = "regexp_extract_all(lower({}), '[a-z]{{2,}}')"


@query(
    f"""with f as (select id, field, {_FIELD_TOK.format('body')} as t from (select id, 'title' as field, title || ' ' || lang as body from {_D} union all select id, 'text', text from {_D})), m as (select field, avg(len(t)) as mean from f group by 1), n as (select count(*) as n from documents),
h as (select id, field, dl, token, count(*) as tf from (select id, field, len(t) as dl, unnest(t) as token from f) group by all), df as (select field, token, count(*) as df from h group by 1, 2), q as (select query_id, token, count(*) as asked from (select query_id, unnest({_FIELD_TOK.format('text')}) as token from {_Q}) group by 1, 2)
select query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(dl, 1) / case when mean > 0 then mean else 1 end)) * least(asked, 2)), 6) as score from h join df using (field, token) join m using (field) join q using (token), n group by 1, 2"""
)
def search_fields(spark, sf):  # noqa: ANN001, ANN201
    """Term frequencies of two fields."""
    c = corpus(spark, sf).select("id", F.concat_ws(" ", "title", "lang").alias("title"), "text")
    return S.fields_bm25(c, asked(spark, sf), ["title", "text"], lambda t: T.all_of(F.lower(t), "[a-z]{2,}"))


@query(
    f"""with p as (select id, unnest({_FIELD_TOK.format('text')}) as token, generate_subscripts({_FIELD_TOK.format('text')}, 1) - 1 as pos from {_D}), q as (select distinct query_id, token from (select query_id, unnest({_FIELD_TOK.format('text')}) as token from {_Q}) where length(token) >= 6),
h as (select query_id, id, pos, token from p join q using (token)), v as (select a.query_id, a.id, a.pos, count(distinct b.token) as n, min(b.pos) as first from h a join h b on a.query_id = b.query_id and a.id = b.id and b.pos between a.pos - 22 and a.pos group by a.query_id, a.id, a.pos), w as (select *, pos - first as span from v),
x as (select query_id, id, n, span from w qualify row_number() over (partition by query_id, id order by n desc, span) = 1) select query_id, id, round(2.6::double * (n + 1.5::double * greatest(0, 23 - span) / 23.0::double), 6) as bonus from x where n >= 2"""
)
def proximity_bonus(spark, sf):  # noqa: ANN001, ANN201
    t = T.all_of(F.lower(F.col("text")), "[a-z]{2,}")
    places = corpus(spark, sf).select("id", F.posexplode(t).alias("pos", "term"))
    wanted = asked(spark, sf).select("query_id", F.explode(F.array_distinct(t)).alias("term")).where("length(term) >= 6")
    return S.proximity(places.join(wanted, "term"), 22, 2.6)


@query("select doc_id as id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) as digest from documents")
def normalize_text(spark, sf):  # noqa: ANN001, ANN201
    return plain_corpus(spark, sf).select("id", F.sha2(T.normalized(F.col("text")), 256).alias("digest"))


@query("select doc_id as id, (length(regexp_replace(text, '[^一-鿿]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0))::bigint as n from documents")
def token_estimate(spark, sf):  # noqa: ANN001, ANN201
    return plain_corpus(spark, sf).select("id", T.estimated_tokens(F.col("text")).alias("n"))


@query("select page_id, len(list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[^\\s\"''<>]+')))::bigint as n_urls, regexp_extract(url, 'https?://[^\\s\"''<>]+') as own from pages")
def url_extract(spark, sf):  # noqa: ANN001, ANN201
    found = F.array_distinct(T.all_of(F.concat_ws(" ", "url", "html"), T.URL))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n_urls"), F.regexp_extract("url", T.URL, 0).alias("own"))


@query(
    """with r as (select doc_id as id, string_split_regex(text, '[0-9]{8,}') as p, regexp_extract_all(text, '[0-9]{8,}') as n from documents)
select id, array_to_string(list_transform(p, lambda x, i: x || coalesce('[已脱敏:' || substr(sha256(n[i]), 1, 10) || ']', '')), '') as text from r"""
)
def redact_identifiers(spark, sf):  # noqa: ANN001, ANN201
    return plain_corpus(spark, sf).select("id", T.redacted(F.col("text")).alias("text"))


@query("select source, lang, count(*) as n_documents, sum(n_chars)::bigint as n_chars, count(distinct sha256(text)) as n_texts from documents group by all")
def dataset_metrics(spark, sf):  # noqa: ANN001, ANN201
    digest = F.sha2("text", 256)
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.countDistinct(digest).alias("n_texts"))


@query("select sha256(text) as digest, min(doc_id) as id, count(*) as n from documents group by 1")
def dedup_by_hash(spark, sf):  # noqa: ANN001, ANN201
    return plain_corpus(spark, sf).groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(
    """with p as (select doc_id as id, sha256(text) as old from documents where lang <> 'de'), c as (select doc_id as id, sha256(case when lang = 'en' then text else lower(text) end) as new from documents where lang <> 'es')
select coalesce(p.id, c.id) as id, case when old is null then 'add' when new is null then 'delete' when old = new then 'reuse' else 'update' end as action from p full outer join c on p.id = c.id"""
)
def manifest_diff(spark, sf):  # noqa: ANN001, ANN201
    docs = plain_corpus(spark, sf)
    before = docs.where("lang <> 'de'").select("id", F.sha2("text", 256).alias("digest"))
    after = docs.where("lang <> 'es'").select("id", F.sha2(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lower("text")), 256).alias("digest"))
    return L.manifest_diff(before, after)


@query("select doc_id as id, source as document_id, lang as version from documents where (source, lang) in (select source, max(lang) from documents group by source having count(*) > 1)")
def publish_visible(spark, sf):  # noqa: ANN001, ANN201
    docs = plain_corpus(spark, sf)
    state = docs.groupBy(F.col("source").alias("document_id")).agg(F.max("lang").alias("published"), (F.count("*") > 1).alias("enabled"))
    return L.visible(docs.select("id", F.col("source").alias("document_id"), F.col("lang").alias("version")), state).select("id", "document_id", "version")


@query(
    """select doc_id as id, k::int as chunk, (k * 450)::int as start, length(substr(text, k * 450 + 1, 520))::bigint as n, sha256(substr(text, k * 450 + 1, 520)) as digest
from documents, unnest(range(greatest(0, length(text) - 71) // 450 + 1)) as u(k) where length(text) > 0"""
)
def chunk_fixed_stride(spark, sf):  # noqa: ANN001, ANN201
    return L.stride_chunks(plain_corpus(spark, sf)).select("id", "chunk", "start", F.length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("digest"))


@query(
    """with r as (select query_id, min(rank) filter (where target) as hit from (
 select b.query_id, b.rank, b.id = o.id as target from (""" + _bm25_sql("", 5) + ") b join (" + _OVERLAP + """) o on b.query_id = o.query_id and o.rank = 1) group by 1)
select count(*) as n, round(avg(case when hit <= 5 then 1.0::double else 0 end), 6) as recall_5, round(sum(coalesce(1.0::double / hit, 0)) / greatest(1, count(*)), 6) as mrr from r"""
)
def eval_recall_mrr(spark, sf):  # noqa: ANN001, ANN201
    truth = search_overlap(spark, sf).where("rank = 1").select("query_id", F.col("id").alias("target"))
    found = S.bm25(corpus(spark, sf), asked(spark, sf), 5).join(truth, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("id") == F.col("target"), F.col("rank"))).alias("hit"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("hit") <= 5, 1.0).otherwise(0.0)), 6).alias("recall_5"), F.round(F.sum(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))) / F.greatest(F.lit(1), F.count("*")), 6).alias("mrr"))


@query(
    """with p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from p)
select id, round(case when hx = lx then 0.5 else (x - lx) / (hx - lx) end, 6) as x, round(case when hy = ly then 0.5 else (y - ly) / (hy - ly) end, 6) as y from p, b"""
)
def map_bounds_normalize(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    b = F.broadcast(p.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")))  # one row
    on = lambda v, lo, hi: F.round(V.on_axis(F.col(v), F.col(lo), F.col(hi)), 6).alias(v)
    return p.crossJoin(b).select("id", on("x", "lx", "hx"), on("y", "ly", "hy"))


@query(f"with m as ({QUERIES['map_bounds_normalize'][1]}) select floor(x * 16)::bigint as cx, floor(y * 16)::bigint as cy, count(*) as n, min(id) as first_id from m group by 1, 2")
def grid_cells(spark, sf):  # noqa: ANN001, ANN201
    return map_bounds_normalize(spark, sf).groupBy(F.floor(F.col("x") * 16).alias("cx"), F.floor(F.col("y") * 16).alias("cy")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    f"""with m as ({QUERIES['map_bounds_normalize'][1]}), c as (select *, floor(x * 16) as cx, floor(y * 16) as cy from m)
select a.id, b.id as near_id, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 8) as d from c a join c b on a.id <> b.id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1
where d <= 0.0039 qualify row_number() over (partition by a.id order by d, b.id) = 1"""
)
def grid_nearest(spark, sf):  # noqa: ANN001, ANN201
    m = map_bounds_normalize(spark, sf).withColumn("priority", F.lit(0))
    return U.nearest_within(m, m, 1 / 16, distance=lambda x, y: x * x + y * y, most=0.0039, apart=True)


@query("select label, i::int as place, round(avg(x::double), 6) as mean, count(*) as n from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by all")
def dense_label_centroid(spark, sf):  # noqa: ANN001, ANN201
    return table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("place", "x")).groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n"))
