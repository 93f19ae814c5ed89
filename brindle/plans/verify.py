"""Queries over the checks of answers: turns of conversations as claims, the turns before them as evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import verify as V
from brindle.plans.registry import register
from brindle.sources.tables import table

QUERIES: dict = {}
query = register(QUERIES)

#: Terms for the invented prose of the test tables.
WORDS = V.Vocabulary(prohibition=("never",), continuation="may continue", negation=("not",), commitment=("free repair",), deadline="[0-9]+ days", certainty=("confirmed",), qualifier=("perhaps",), boundary=("official",))
_PAIRS = "with p as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations), a as (select * from p where role = 'assistant')"


def _turns(spark, sf):  # noqa: ANN001, ANN202
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w))
    return t.where("role = 'assistant'").withColumn("answer_id", F.concat_ws(":", "conv_id", "turn"))


@query(
    _PAIRS
    + """, c as (select conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(lower(text), '([\\p{L}\\p{N}_]+)', '⟦\\1⟧', 'g'), '⟦[a-z0-9]+⟧(?:-+⟦[a-z0-9]+⟧)*'), lambda y: regexp_replace(y, '[⟦⟧]', '', 'g')), lambda x: regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9]'))) as names,
 regexp_replace(lower(coalesce(before, '')), '\\s+', '', 'g') as support from a)
select conv_id, turn, len(names)::bigint as n_names, array_to_string(list_sort(list_filter(names, lambda x: not contains(support, x))), ',') as unsupported from c"""
)
def verify_names(spark, sf):  # noqa: ANN001, ANN201
    t, s = _turns(spark, sf), V.packed(F.col("before"))
    names = V.named_terms(F.col("text"))
    return t.select("conv_id", "turn", F.size(names).cast("long").alias("n_names"), F.array_join(F.array_sort(F.filter(names, lambda x: ~F.contains(s, x))), ",").alias("unsupported"))


@query("select l_orderkey, l_linenumber, (l_linenumber * 5 between least(l_quantity::int, l_suppkey) and greatest(l_quantity::int, l_suppkey)) as in_range, (l_linenumber in (month(l_shipdate))) as in_date, true as same from lineitem")
def verify_measures(spark, sf):  # noqa: ANN001, ANN201
    """Values against ranges and parts of dates."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    ranged = V.packed(F.concat(F.lit("wait "), q, F.lit(" - "), F.col("l_suppkey").cast("string"), F.lit(" Minutes, then 7 cm")))
    dated = V.packed(F.date_format("l_shipdate", "yyyy-MM-dd"))
    minutes = F.concat((n * 5).cast("string"), F.lit("分钟"))
    month = F.concat(n.cast("string"), F.lit("月"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.measure_supported(minutes, ranged).alias("in_range"), V.measure_supported(month, dated).alias("in_date"), V.measure_supported(F.lit("7cm"), ranged).alias("same"))


@query(
    _PAIRS
    + """, s as (select conv_id, turn, text, regexp_extract_all(lower(coalesce(before, '')), '[a-z]{4,}')[1:4] as steps from a), w as (select *, list_filter(list_transform(steps, lambda x: instr(text, x)), lambda p: p > 0) as places from s)
select conv_id, turn, len(steps)::bigint as n_steps, len(steps) >= 2 and len(places) >= 2 and places <> list_sort(places) as wrong from w"""
)
def verify_steps(spark, sf):  # noqa: ANN001, ANN201
    """The first four long words of the turn before, as numbered steps, against their order in each answer."""
    words = F.slice(F.regexp_extract_all(F.lower(F.coalesce("before", F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), 1, 4)
    support = F.array_join(F.transform(words, lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), "\n")
    return _turns(spark, sf).select("conv_id", "turn", F.size(words).cast("long").alias("n_steps"), V.steps_out_of_order(F.col("text"), support).alias("wrong"))


#: Parts of words of the invented prose in the place of terms.
PARTS = V.Vocabulary(prohibition=("tion", "ouch"), continuation="ment|ing", negation=("la", "re"), commitment=("eaux", "tion", "and", "der"), deadline="[a-z]+oi|[a-z]+th", certainty=("aux", "the"), qualifier=("eur", "ver"))


@query(
    _PAIRS
    + """, c as (select conv_id, turn, text, coalesce(before, '') as before, regexp_extract(text, '(?s)^(.*?)(?:ment|ing)', 1) as upto from a)
select conv_id, turn, regexp_matches(lower(before), 'tion|ouch') and regexp_matches(text, 'ment|ing') and not regexp_matches(lower(right(upto, 3)), 'la|re') as contradicts,
 array_to_string(list_sort(list_filter(list_distinct(list_filter(['eaux', 'tion', 'and', 'der'], lambda t: contains(text, t)) || regexp_extract_all(text, '[a-z]+oi|[a-z]+th')), lambda t: not contains(regexp_replace(before, '\\s+', '', 'g'), t))), ',') as promises,
 turn % 4 = 1 and not regexp_matches(lower(text), 'eur|ver') and regexp_matches(lower(text), 'aux|the') as promoted from c"""
)
def verify_commitments(spark, sf):  # noqa: ANN001, ANN201
    """Prohibitions, promises, and observations told as facts: each answer against the turn before."""
    claim, support = F.col("text"), F.coalesce("before", F.lit(""))
    kinds = F.when(F.col("turn") % 4 == 1, F.array(F.lit("vision"), F.lit("ocr"))).when(F.col("turn") % 4 == 3, F.array(F.lit("vision"), F.lit("manual"))).otherwise(F.array().cast("array<string>"))
    promises = F.array_join(F.array_sort(V.unsupported_commitments(claim, support, PARTS)), ",")
    return _turns(spark, sf).select("conv_id", "turn", V.contradicts_prohibition(claim, support, PARTS).alias("contradicts"), promises.alias("promises"), V.promotes_observation(claim, kinds, PARTS).alias("promoted"))


def _answers(spark, sf):  # noqa: ANN001, ANN202
    """results, claims and evidence: an assistant's turn claims, the turn before is its evidence; every fifth names another."""
    t = _turns(spark, sf)
    fifth = F.col("turn") % 5 == 2
    results = t.select("answer_id", F.lit("knowledge").alias("agent"), F.when(F.length("text") > 0, "completed").otherwise("failed").alias("status"), F.lit(0.9).alias("confidence"))
    claims = t.select("answer_id", F.lit("c").alias("claim_id"), F.regexp_replace("text", "[0-9]", "").alias("text"), F.array(F.when(fifth, "other").otherwise("e")).alias("evidence_ids"))
    evidence = t.select("answer_id", F.lit("e").alias("evidence_id"), F.lit("manual").alias("source_type"), F.lit("title").alias("title"), F.coalesce("before", F.lit("")).alias("text"), F.lit(None).cast("double").alias("confidence"), (F.length(F.coalesce("before", F.lit(""))) / 1000).alias("score"))
    return results, claims, evidence


_REPORT = (
    _PAIRS
    + """, r as (select conv_id || ':' || turn as answer_id, turn % 5 = 2 as lost, least(0.85::double, greatest(0.35::double, length(coalesce(before, '')) / 1000.0::double)) as support, text, before from a)
select answer_id, case when lost then 'unsupported-claim' else '' end as issues, not lost as passed, case when lost then 'revise' else 'accept' end as action,
 case when lost then 0 else round(least(0.98::double, 0.46::double * 0.9::double + 0.3::double * support + 0.16::double * 0.2::double + 0.08::double), 4) end as confidence from r"""
)


@query(_REPORT)
def verify_report(spark, sf):  # noqa: ANN001, ANN201
    return V.reports(*_answers(spark, sf), ["knowledge"], WORDS).withColumn("issues", F.array_join("issues", ","))


@query(_PAIRS + " select conv_id || ':' || turn as answer_id, 'c' as claim_id, case when turn % 5 = 2 then 1 else 0 end::bigint as n_missing, case when turn % 5 = 2 then 0 else 1 end::bigint as n_bound from a")
def verify_binding(spark, sf):  # noqa: ANN001, ANN201
    _, claims, evidence = _answers(spark, sf)
    return V.bound_claims(claims, evidence).select("answer_id", "claim_id", F.size("missing").cast("long").alias("n_missing"), F.size("bound").cast("long").alias("n_bound"))


@query(_PAIRS + " select conv_id || ':' || turn as answer_id, turn % 5 <> 2 as passed, case when turn % 5 = 2 then 'revise' else 'accept' end as action, turn % 5 <> 2 as shadow_passed, case when turn % 5 = 2 then 'revise' else 'accept' end as shadow_action from a")
def verify_modes(spark, sf):  # noqa: ANN001, ANN201
    return V.both_modes(*_answers(spark, sf), ["knowledge"], WORDS)


@query(_PAIRS + " select conv_id || ':' || turn as answer_id, sha256(case when turn % 5 = 2 then coalesce(before, '') else text end) as digest, turn % 5 = 2 as replaced from a")
def verify_fallback(spark, sf):  # noqa: ANN001, ANN201
    results, claims, evidence = _answers(spark, sf)
    answers = _turns(spark, sf).select("answer_id", F.col("text").alias("answer"))
    return V.with_fallback(V.reports(results, claims, evidence, ["knowledge"], WORDS), answers, evidence).select("answer_id", F.sha2("answer", 256).alias("digest"), "replaced")


@query(_PAIRS + " select conv_id || ':' || turn as answer_id, case when regexp_matches(lower(coalesce(before, '')), 'error') then 'general-request-out-of-domain' when turn % 4 = 3 then 'general-model-unavailable' when regexp_matches(lower(text), 'official') then 'general-route-safety-boundary' end as issue from a")
def verify_general(spark, sf):  # noqa: ANN001, ANN201
    t = _turns(spark, sf).select("answer_id", F.col("text").alias("answer"), F.when(F.col("turn") % 4 == 3, "failed").otherwise("completed").alias("status"), F.lit(0.5).alias("confidence"), "before")
    return V.general_report(t, F.lower(F.coalesce("before", F.lit(""))).rlike("error"), WORDS).select("answer_id", "issue")
