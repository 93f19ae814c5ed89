"""Queries over keyed tables and bundles; each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators import bundle as B
from brindle.operators import keyed as K
from brindle.plans.registry import register
from brindle.sources import matrix as M
from brindle.sources.tables import shared_folder, table

QUERIES: dict = {}
query = register(QUERIES)


@query("select w.k as c_custkey, c_name, c_custkey is not null as found from (select distinct o_custkey * 2 as k from orders) w left join customer on c_custkey = w.k")
def key_lookup(spark, sf):  # noqa: ANN001, ANN201
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")).distinct()
    return K.looked_up(table(spark, sf, "customer").select("c_custkey", "c_name"), wanted, "c_custkey")


@query("with old as (select sha256(text) as digest, min(doc_id) as id from documents where lang <> 'en' group by 1), new as (select sha256(text) as digest, min(doc_id) as id from documents where lang = 'en' or doc_id % 2 = 0 group by 1) select digest, id from old union all select digest, id from new where digest not in (select digest from old)")
def insert_if_absent(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("id"), "lang")
    old = d.where("lang <> 'en'").groupBy("digest").agg(F.min("id").alias("id"))
    return K.inserted(old, d.where("lang = 'en' or id % 2 = 0").select("digest", "id"), ["digest"], ["id"])


@query("select c_custkey, case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 3 = 0 then 0 else c_acctbal end as c_acctbal, case when c_custkey % 3 = 0 then 'now' else c_mktsegment end as c_mktsegment from customer")
def update_columns(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return K.updated(c, changes, "c_custkey", "c_mktsegment", F.lit("now"))


@query("with t as (select c_nationkey as g, max(c_custkey) as k from customer where c_nationkey % 2 = 0 group by 1) select c_custkey, c_nationkey, case when k is not null then c_custkey = k else c_custkey % 5 = 0 end as active from customer left join t on g = c_nationkey")
def exclusive_flag(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5 == 0).alias("active"))
    return K.with_exclusive(c, c.where("c_nationkey % 2 = 0").groupBy("c_nationkey").agg(F.max("c_custkey").alias("c_custkey")), "c_nationkey", "c_custkey", "active")


_LEFT = "with l as (select c_custkey, c_nationkey, c_custkey % 11 = 0 as flag, c_acctbal > 0 as enabled from customer where c_custkey % 2 > 0 or c_custkey % 11 = 0)"


@query(_LEFT + " select c_custkey, c_nationkey, flag or (not bool_or(flag) over (partition by c_nationkey) and enabled and row_number() over (partition by c_nationkey order by enabled desc, c_custkey) = 1) as flag from l")
def delete_and_rehome(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 11 == 0).alias("flag"), (F.col("c_acctbal") > 0).alias("enabled"))
    left = K.without_guarded(c, c.where("c_custkey % 2 = 0"), "c_custkey", "flag")
    return K.rehomed(left, "c_nationkey", "flag", ["c_custkey"], "enabled").select("c_custkey", "c_nationkey", "flag")


@query("select p_partkey from part where p_size > 10 and exists (select 1 from part q where q.p_partkey % 10 = 0 and q.p_type = part.p_type and lower(trim(q.p_name)) = lower(trim(part.p_name)))")
def name_lookup(spark, sf):  # noqa: ANN001, ANN201
    p = table(spark, sf, "part").withColumn("enabled", F.col("p_size") > 10)
    wanted = p.where("p_partkey % 10 = 0").select("p_type", F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")).alias("p_name"))
    return K.named(p, wanted, "p_type", "p_name").select("p_partkey")


@query("select doc_id as id, 'mine' as kind from documents where source = 'src1' union all select doc_id, 'both' from documents where lang in ('en', 'fr') and source = 'src2' union all (select doc_id, 'page' from documents where contains(lower(lang || ' ' || source || ' ' || text), 'tion') or contains(lower(lang || ' ' || source || ' ' || text), 'src1') order by doc_id limit 20 offset 5)")
def filters_and_pages(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    mine = K.visible_to(d.withColumn("owner_id", F.col("source")), F.lit("src1")).select("id", F.lit("mine").alias("kind"))
    both = K.conjunction(d, lang=["en", "fr"], source="src2", id=None).select("id", F.lit("both").alias("kind"))
    page = K.keyword_page(d, ["lang", "source", "text"], "Tion SRC1", ["id"], 20, 5).select("id", F.lit("page").alias("kind"))
    return mine.unionByName(both).unionByName(page)


@query("select conv_id as id, case when conv_id % 3 = 0 then 'created' when conv_id % 3 = 1 then 'kept' else 'refused' end as outcome, n::int as n_children, last from (select conv_id, count(*) as n, arg_max(role, turn) as last from conversations group by 1)")
def owners_and_details(spark, sf):  # noqa: ANN001, ANN201
    t = table(spark, sf, "conversations")
    ids = t.select(F.col("conv_id").alias("id")).distinct()
    old = ids.where("id % 3 > 0").withColumn("owner_id", F.when(F.col("id") % 3 == 1, "me").otherwise("you"))
    full = K.details(K.owned(old, ids.withColumn("owner_id", F.lit("me"))), t.withColumnRenamed("conv_id", "id"), "id", "turn", ["role"])
    return full.select("id", "outcome", F.size("children").alias("n_children"), F.element_at("children", -1)["role"].alias("last"))


@query("select doc_id as id, source, lang as version, 'old' as state from documents where not (source in ('src1', 'src3') and lang = 'en') union all select doc_id, source, lang, 'new' from documents where source in ('src1', 'src3') and lang = 'en' and doc_id % 2 = 0")
def replace_slices(spark, sf):  # noqa: ANN001, ANN201
    """Only slices that have new rows are replaced."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("version"), F.lit("old").alias("state"))
    new = d.where("source in ('src1', 'src3') and version = 'en' and id % 2 = 0").withColumn("state", F.lit("new"))
    keys = d.where("source in ('src1', 'src3') and version = 'en'").select("source", "version").distinct().join(new.select("source", "version").distinct(), ["source", "version"], "left_anti")
    return K.replaced_slice(d.join(keys, ["source", "version"], "left_anti"), new, ["source", "version"])


@query("select doc_id as id, case when lang = 'en' then 'en' else 'old' end as published, case when source = 'src1' then doc_id % 20 < 0 when source = 'src2' then doc_id = (select max(doc_id) from documents where source = 'src2') else doc_id % 7 = 0 end as active from documents where source <> 'src1'")
def publish_and_activate(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents").where("source <> 'src1'").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_id"), F.col("doc_id").alias("version"), F.col("lang").alias("doc_active"), F.lit("old").alias("published"), (F.col("doc_id") % 7 == 0).alias("active"), (F.col("doc_id") % 2 == 0).alias("was_active"))
    newest = d.where("dataset_id = 'src2'").groupBy("dataset_id").agg(F.max("version").alias("version"))
    made = K.activated(d, newest.unionByName(d.where("dataset_id = 'src3' and version < 0").select("dataset_id", "version")))
    done = K.published(made.withColumnRenamed("active", "is_active").withColumnRenamed("doc_active", "active"), F.lit("en"))
    return done.select("id", "published", F.col("is_active").alias("active"))


@query(
    """with r as (select source as document_id, lang as version, doc_id as child_id, 'before ' || text || ' after ' || text as parent_text, text from documents), e as (select text as old from documents where doc_id = (select min(doc_id) from documents where source = 'src1' and lang = 'en'))
select child_id, version, sha256(parent_text) as parent, sha256(text) as child, true as has_vector from r union all
select child_id, 'draft', sha256(case when old <> '' and contains(parent_text, old) then substr(parent_text, 1, instr(parent_text, old) - 1) || 'edited' || substr(parent_text, instr(parent_text, old) + length(old)) else parent_text end), sha256(case when child_id = m then 'edited' else text end), child_id <> m
 from r, e, (select min(doc_id) as m from documents where source = 'src1' and lang = 'en') where document_id = 'src1' and version = 'en'"""
)
def edit_draft(spark, sf):  # noqa: ANN001, ANN201
    d = table(spark, sf, "documents")
    rows = d.select(F.col("source").alias("document_id"), F.col("lang").alias("version"), F.col("doc_id").alias("child_id"), F.concat(F.lit("before "), "text", F.lit(" after "), "text").alias("parent_text"), "text", F.array(F.lit(1.0)).alias("embedding"))
    first = d.where("source = 'src1' and lang = 'en'").agg(F.min("doc_id")).first()[0]
    out = K.draft_copy(rows, F.lit("src1"), F.lit("en"), F.lit("draft"), F.lit(first), F.lit("edited"))
    return out.select("child_id", "version", F.sha2("parent_text", 256).alias("parent"), F.sha2("text", 256).alias("child"), F.col("embedding").isNotNull().alias("has_vector"))


@query("select '{\"a_key\":' || c_custkey || ',\"b_name\":\"' || c_name || '\",\"c_none\":null}' as value from customer")
def json_line_rows(spark, sf):  # noqa: ANN001, ANN201
    c = table(spark, sf, "customer")
    return B.json_lines(c.select(F.col("c_name").alias("b_name"), F.lit(None).cast("string").alias("c_none"), F.col("c_custkey").alias("a_key")))


@query("select event_id as id, event_id % 4 in (1, 2) as malformed, case when event_id % 3 = 0 then 'dimension' when event_id % 3 = 1 then 'not-finite' end as issue, case when event_id % 2 = 0 then 2 end::int as n, case when event_id % 2 = 0 then 1 else 0 end::int as m from events")
def row_decoding(spark, sf):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    e = table(spark, sf, "events").withColumn("value", F.when(i % 4 == 0, F.col("props")).when(i % 4 == 1, "[1]").when(i % 4 == 2, "{broken").otherwise(" "))
    vector = F.when(i % 3 == 0, F.array(F.lit(1.0))).when(i % 3 == 1, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    return e.select(i.alias("id"), B.malformed_lines(e).alias("malformed"), B.vector_issue(vector, 2).alias("issue"), F.size(B.decoded_vector(F.when(i % 2 == 0, "[1, 2.5]").otherwise("[1, null]"))).alias("n0"), F.size(B.decoded_strings(F.when(i % 2 == 0, '["a"]').otherwise("no list"))).alias("m")).select("id", "malformed", "issue", F.when(F.col("n0") > 0, F.col("n0")).alias("n"), "m")


@query("select l_orderkey, l_linenumber, o_orderstatus as parent_title, c_name as document_name, case when o_orderkey is null then 'parent' when c_custkey is null then 'document' end as orphan from lineitem left join (select * from orders where o_orderkey % 5 > 0) on l_orderkey = o_orderkey left join (select * from customer where c_custkey % 3 > 0) on c_custkey = l_suppkey")
def bundle_rows(spark, sf):  # noqa: ANN001, ANN201
    children = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("parent_id"), F.col("l_suppkey").alias("document_id"))
    parents = table(spark, sf, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderstatus").alias("title"))
    docs = table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("product"))
    return B.denormalised(children, parents, docs).select("l_orderkey", "l_linenumber", "parent_title", "document_name", "orphan")


@query("select l_partkey as asset_id, array_to_string(list_sort(list(distinct l_suppkey)), ',') as parents, count(distinct l_orderkey) as n_children from lineitem group by 1")
def assets_inverted(spark, sf):  # noqa: ANN001, ANN201
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("child_id"), F.col("l_suppkey").alias("parent_id"), F.array("l_partkey").alias("asset_ids"))
    return B.inverted(rows).select("asset_id", F.array_join("parents", ",").alias("parents"), F.size("children").cast("long").alias("n_children"))


@query("select o_orderkey as image_id, coalesce((select p_brand from part where p_partkey = 1 + o_orderkey % 40 and p_size > 20), (select p_brand from part where p_partkey = 1 + o_orderkey % 60 and p_size > 20), (select c_mktsegment from customer where c_custkey = o_custkey and c_acctbal > 0)) as product from orders")
def image_product(spark, sf):  # noqa: ANN001, ANN201
    o = F.col("o_orderkey")
    images = table(spark, sf, "orders").select(o.alias("image_id"), F.array(1 + o % 40, 1 + o % 60).alias("parent_ids"), F.array("o_custkey").alias("child_ids"))
    parents = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 20, F.col("p_brand")).alias("product"))
    children = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("product"))
    return B.first_product(images, parents, children)


@query("select source, sha256(string_agg(sha256(text), chr(10) order by doc_id)) as digest from documents group by 1")
def content_fingerprint(spark, sf):  # noqa: ANN001, ANN201
    return B.ordered_digest(table(spark, sf, "documents"), "source", "doc_id", F.col("text"))


@query("select vec_id::varchar as id, len(embedding)::bigint as size, embedding[1]::double as first, embedding[len(embedding)]::double as last, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total from embeddings")
def matrix_rows(spark, sf):  # noqa: ANN001, ANN201
    """All vectors, written as a matrix and read again."""
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    M.write_matrix(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return M.read_matrix(spark, path).select("id", F.size("v").cast("long").alias("size"), F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"), F.round(total, 6).alias("total"))


_FIELD = "coalesce('v' || sha256({0}::varchar), 'n')"
_TREE = "with r as (select lang, doc_id, sha256(concat_ws(',', {fields})) as d from documents), l as (select *, count(*) as copies from r group by all), t0 as (select row_number() over (order by lang nulls first, doc_id nulls first, d) - 1 as i, d || ':' || copies as d from l), {levels} select (select count(*) from r) as n, d as root from t{last}".format(
    fields=", ".join(_FIELD.format(c) for c in sorted(["doc_id", "lang", "n_chars", "source", "text"])),
    levels=", ".join(f"t{k} as (select i // {B.CHILDREN} as i, sha256(string_agg(d, ',' order by i)) as d from t{k - 1} group by 1)" for k in range(1, B.LEVELS + 1)),
    last=B.LEVELS,
)


@query(_TREE)
def content_digests(spark, sf):  # noqa: ANN001, ANN201
    """The digest of all documents in the order of language and id."""
    return B.tree_digest(table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source", "text"), ["lang", "doc_id"])


@query(
    """select * from (select case when lang = 'de' then 'missing-file' when lang = 'en' then 'checksum' when lang = 'es' then 'row-count' end as code, lang as subject from (select distinct lang from documents)) where code is not null
 union all select 'duplicate-id', vec_id::varchar from embeddings where vec_id % 50 = 1 union all select 'dimension', vec_id::varchar from embeddings, (values (1), (2)) where vec_id % 50 = 1"""
)
def bundle_validation(spark, sf):  # noqa: ANN001, ANN201
    made = table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n_rows"), F.lit("x").alias("sha256"))
    want = made.withColumn("sha256", F.when(F.col("name") == "en", "y").otherwise(F.col("sha256"))).withColumn("n_rows", F.when(F.col("name") == "es", F.lit(-1)).otherwise(F.col("n_rows")))
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    odd = v.where("vec_id % 50 = 1").withColumn("embedding", F.slice("embedding", 1, 3))
    return B.validation(made.where("name <> 'de'"), want, v.where("vec_id % 50 <> 1").unionByName(odd).unionByName(odd), "vec_id", 64)


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 2")
def retain_newest(spark, sf):  # noqa: ANN001, ANN201
    return B.newest(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 2)
