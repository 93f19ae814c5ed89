"""Queries over jobs, times, assembly and visible search; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import dates as D
from brindle.operators import ingest as I
from brindle.operators import lifecycle as L
from brindle.operators import neighbours as N
from brindle.operators import vector_map as M
from brindle.plans import retrieval as R
from brindle.plans.registry import register
from brindle.sources.tables import table

QUERIES: dict = {}
query = register(QUERIES)


@query("select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as iso, strftime(ts + interval 8 hour, '%Y-%m-%d') || ' ' || (['星期一', '星期二', '星期三', '星期四', '星期五', '星期六', '星期日'])[isodow(ts + interval 8 hour)] || ' ' || strftime(ts + interval 8 hour, '%H:%M') as local, (event_id % 100000)::bigint as elapsed, greatest(0, 500 - event_id % 100000)::bigint as left_over, event_id % 2 = 0 as expired from events")
def times(spark, sf):  # noqa: ANN001, ANN201
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    later = F.timestamp_millis(F.unix_millis(ts) + i % 100000)
    start = F.timestamp_millis(F.unix_millis(ts))
    due = F.when(i % 2 == 0, ts).otherwise(ts + F.expr("interval 1 second"))
    return table(spark, sf, "events").select(i.alias("id"), D.iso(ts).alias("iso"), D.local_text(ts).alias("local"), D.elapsed_ms(start, later).alias("elapsed"), D.left_ms(start, later, F.lit(500)).alias("left_over"), D.expired(due, ts).alias("expired"))


@query("select doc_id as document_id, sha256('[\"' || lang || '\",\"v2\"]') as config_hash, 'queued' as state from documents where doc_id % 4 <> 1")
def parse_jobs(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), I.config_hash(F.col("lang"), F.lit("v2")).alias("config_hash"))
    state = F.when(F.col("document_id") % 4 == 1, "running").when(F.col("document_id") % 4 == 2, "failed").otherwise("succeeded")
    jobs = d.withColumn("state", state).withColumn("config_hash", F.when(F.col("document_id") % 4 > 2, F.lit("other")).otherwise(F.col("config_hash")))
    return I.new_jobs(d.unionByName(d), jobs.where("document_id % 4 > 0"))


@query("select doc_id as id, case when doc_id % 3 = 0 then 1.0 else length(text) end::double as first, 2::int as n from documents")
def embed_missing(spark, sf):  # noqa: ANN001, ANN201
    """The hook gives each text its length."""
    v = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0)))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", v.alias("v"))
    return I.embedded(rows, lambda texts: [[float(len(t)), 0.0] for t in texts]).select("id", F.col("v")[0].alias("first"), F.size("v").alias("n"))


@query(f"with m as ({R.QUERIES['manifest_diff'][1]}) select count(*) filter (where action = 'add') as \"add\", count(*) filter (where action = 'update') as \"update\", count(*) filter (where action = 'delete') as \"delete\", count(*) filter (where action = 'reuse') as reuse from m")
def plan_statistics(spark, sf):  # noqa: ANN001, ANN201
    return I.plan_counts(R.manifest_diff(spark, sf))


@query("select count(*) filter (where p_partkey % 4 = 0) as matched_sha256, count(*) filter (where p_partkey % 4 = 1) as matched_stem, count(*) filter (where p_partkey % 4 = 2) as ambiguous, count(*) filter (where p_partkey % 4 = 3) as unmatched, count(*) filter (where p_size > 40) as fallback, count(*) filter (where p_size < 5) as malformed, count(*) + count(*) filter (where p_size < 5) as total, count(*) filter (where p_partkey % 4 < 2) + count(*) filter (where p_size > 40) as imported from part")
def import_counts(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part")
    kind = F.get(F.array(*map(F.lit, ["sha256", "stem", "ambiguous", "unmatched"])), (F.col("p_partkey") % 4).cast("int"))
    return I.import_report(p.select(kind.alias("strategy")), p.where("p_size > 40"), p.where("p_size < 5"))


@query("select doc_id as id, 'why ' || doc_id || chr(10) || source || case when doc_id % 2 = 0 then chr(10) || 'more' else '' end as text, case when regexp_matches(text, '\\p{L}') then 'ltr' end as direction, (case when doc_id % 30 < 20 then doc_id % 30 else 20 end)::int as n, greatest(1, ceil((length(text) - 2) / 8.0))::int as n_pieces from documents where length(text) between 1 and 5000")
def assembly(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    text = I.assembled(F.concat(F.lit("why "), i.cast("string"), F.lit("\nmemory: x")), F.array("source", "source"), F.when(i % 2 == 0, "more").otherwise(" "))
    cites = F.transform(F.slice(F.sequence(F.lit(1), F.lit(30)), F.lit(1), (i % 30).cast("int")), lambda k: F.struct(k.alias("id"), F.lit("t").alias("text"), F.lit(0.5).alias("score")))
    pieces = I.token_pieces(F.split("text", ""), 10, 0.2)
    d = table(spark, sf, "documents").where("length(text) between 1 and 5000")
    return d.select(i.alias("id"), text.alias("text"), I.direction(F.col("text")).alias("direction"), F.size(I.ledger(cites)).alias("n"), F.size(pieces).alias("n_pieces"))


@query(R._bm25_sql("where title in (select source from documents group by source having count(*) > 1) and lang = (select max(lang) from documents e where e.source = title)", 20))
def search_visible(spark, sf):  # noqa: ANN001, ANN201
    """The lexical stage of a search over published versions: the last language of each source."""
    c = R.corpus(spark, sf).withColumn("document_id", F.col("source")).withColumn("version", F.col("lang"))
    state = c.groupBy(F.col("source").alias("document_id")).agg(F.max("lang").alias("published"), (F.count("*") > 1).alias("enabled"))
    return I.visible_search(c, state, R.asked(spark, sf))["lexical"].select("query_id", "id", "score", "rank")


_IMAGES = R._bm25_sql("").replace(f"{R._exact('text')} as c", "[]::varchar[] as c")


@query(f"with l as ({_IMAGES}) select query_id, id, round(round(1.0::double / (60 + rank), 8), 6) as score, rank as place from l where rank <= 5")
def image_search(spark, sf):  # noqa: ANN001, ANN201
    return I.image_search(R.corpus(spark, sf).select("id", "text"), R.asked(spark, sf))


@query(None)
def neighbour_graph(spark, sf):  # noqa: ANN001, ANN201
    """The nearest neighbours of every vector, by neighbour descent (recall measured in the tests)."""
    return N.graph(R._vectors(spark, sf)[0])


@query(None)
def vector_map(spark, sf):  # noqa: ANN001, ANN201
    """Every vector's place on a plane."""
    return M.built(R._vectors(spark, sf)[0])[1]


@query("select q.vec_id as query_id, arg_max(s.vec_id, (round(list_cosine_similarity(q.embedding::double[], s.embedding::double[]), 6), -s.vec_id)) as id from embeddings q, embeddings s where q.vec_id % 50 = 0 and s.vec_id <> q.vec_id and list_cosine_similarity(q.embedding::double[], s.embedding::double[]) >= 0.0000005 group by 1")
def nearest_saved(spark, sf):  # noqa: ANN001, ANN201
    vectors, asked = R._vectors(spark, sf)
    return M.nearest_saved(asked, vectors)


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def feedback_known(spark, sf):  # noqa: ANN001, ANN201
    """Rows whose request exists."""
    known = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(known, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("select doc_id as id, lang as version, source from documents where doc_id % 3 > 0 union all select doc_id, 'new', source from documents where doc_id % 3 = 0")
def candidate_versions(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("version"), "source")
    return L.replaced(d, d.where("id % 3 = 0").withColumn("version", F.lit("new")), "id")
