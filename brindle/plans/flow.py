"""Queries over control flow, grown tables and rule tables; each with the SQL that checks it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators import gates as G
from brindle.operators import rounds as R
from brindle.operators import verify as V
from brindle.plans import verify as VQ
from brindle.plans.registry import register
from brindle.sources import grown
from brindle.sources.tables import shared_folder, spread, table

QUERIES: dict = {}
query = register(QUERIES)


@query(
    """with recursive r as (select doc_id as id, n_chars as n, 0 as round, n_chars <= 1 as finished from documents union all
 select id, m, round + 1, m <= 1 from (select id, round, case when n % 2 = 0 then n // 2 else 3 * n + 1 end as m from r where not finished and round < 10))
select id, n, round::int as round, finished from r qualify row_number() over (partition by id order by round desc) = 1"""
)
def loop_rounds(spark, sf):  # noqa: ANN001, ANN201
    """Halved where even, else tripled and one more, until one is left or ten rounds have passed."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    step = lambda d: d.withColumn("n", F.when(F.col("n") % 2 == 0, F.floor(F.col("n") / 2)).otherwise(3 * F.col("n") + 1).cast("long"))
    return R.looped(rows, step, F.col("n") <= 1).select("id", "n", "round", "finished")


@query("select doc_id as id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> '' and length(w) % 2 = 1), lambda w: w || '+'), ' ') as words from documents")
def iterated_words(spark, sf):  # noqa: ANN001, ANN201
    """Each word of a text as a row of its own: those of even length go, the others get a mark, in their order."""
    rows = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    step = lambda d: d.where(F.length("item") % 2 == 1).withColumn("item", F.concat("item", F.lit("+")))
    return R.iterated(rows, "id", "words", step).withColumn("words", F.array_join("words", " "))


@query("select doc_id as id, case when n_chars > 2000 then 'long' when lang = 'en' and regexp_matches(text, '[0-9]') then 'counted' else 'plain' end as branch, case when n_chars > 2000 then n_chars when lang = 'en' and regexp_matches(text, '[0-9]') then len(regexp_extract_all(text, '[0-9]'))::bigint else 0 end as n from documents")
def switched_documents(spark, sf):  # noqa: ANN001, ANN201
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "lang", "n_chars", "text")
    out = lambda name, n: lambda rows: rows.select("id", F.lit(name).alias("branch"), n.cast("long").alias("n"))
    digits = F.size(F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0)))
    return R.switched(d, [(F.col("n_chars") > 2000, out("long", F.col("n_chars"))), ((F.col("lang") == "en") & F.col("text").rlike("[0-9]"), out("counted", digits))], out("plain", F.lit(0)))


@query(VQ._PAIRS + " select conv_id || ':' || turn as answer_id, turn % 13 <= 10 as passed, least(10, turn % 13)::int as rounds, sha256(case when turn % 13 <= 10 then text || repeat('!', (turn % 13)::int) else coalesce(before, '') end) as digest from a where text <> ''")
def verify_revised(spark, sf):  # noqa: ANN001, ANN201
    """Answers that name lost evidence are revised round by round (here: one sign less of its name, and a mark); those that never pass give way to their evidence."""
    results, claims, evidence = VQ._answers(spark, sf)
    t = VQ._turns(spark, sf).select("answer_id", (F.col("turn") % 13).cast("int").alias("k"), F.col("text").alias("answer")).where("answer <> ''")
    claims = claims.drop("evidence_ids").join(t, "answer_id").withColumn("evidence_ids", F.array(F.concat(F.repeat(F.lit("x"), F.col("k")), F.lit("e"))))

    def revise(rows):  # noqa: ANN001, ANN202
        return rows.withColumn("evidence_ids", F.transform("evidence_ids", lambda e: F.substring(e, 2, 100))).withColumn("answer", F.concat("answer", F.lit("!")))

    out = V.revised(results.join(t.select("answer_id"), "answer_id", "left_semi"), claims.drop("k"), evidence, ["knowledge"], revise, VQ.WORDS)
    return out.select("answer_id", "passed", "rounds", F.sha2("answer", 256).alias("digest"))


@query(
    """select doc_id, source, case when doc_id % 3 = 0 then 'anonymous' when doc_id % 3 = 1 then lang else 'me' end as owner_id, case when doc_id % 3 = 0 and lang in ('en', 'fr') then n_chars when doc_id % 3 = 0 then null when doc_id % 3 = 1 then null when doc_id % 2 = 0 then 1 else n_chars end as published from documents"""
)
def grown_table(spark, sf):  # noqa: ANN001, ANN201
    """Files of three schemas read as one table: rows of old files get defaults, or are filled from what is published; written values stay, nulls too."""
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    grown.add_generation(d.where("doc_id % 3 = 0"), path)
    grown.add_generation(d.where("doc_id % 3 = 1").withColumn("owner_id", F.col("lang")).withColumn("published", F.lit(None).cast("long")), path)
    grown.add_generation(d.where("doc_id % 3 = 2").withColumn("owner_id", F.lit("me")).withColumn("published", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(F.col("n_chars")).cast("long")), path)
    fill = F.when(F.col("lang").isin("en", "fr"), F.col("n_chars"))
    return grown.read_generations(spark, path, {"owner_id": F.lit("anonymous"), "published": fill}).select("doc_id", "source", "owner_id", "published")


_RULES = [(("payment", "tion"), ["order", "state"]), (("address", "ouch"), ["order", "state", "address"]), (("ier",), ["order", "place", "state"])]


@query("select doc_id as id, case when regexp_matches(lower(text), 'payment|tion') then 'order,state' when regexp_matches(lower(text), 'address|ouch') then 'order,state,address' when contains(lower(text), 'ier') then 'order,place,state' else 'order,time' end as missing from documents")
def missing_information(spark, sf):  # noqa: ANN001, ANN201
    d = spread(table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.array_join(G.missing_information(F.col("text"), _RULES, ["order", "time"]), ",").alias("missing"))
