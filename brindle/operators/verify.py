"""Checks of answers against their evidence.

claims: answer_id, claim_id, text, evidence_ids; evidence: answer_id, evidence_id, source_type, title, text, confidence (may be
null), score; results: answer_id, agent, status, confidence. Each claim is held against the evidence that it names.

Odd input: null texts count as empty; a claim without evidence has empty support; an answer without claims gets an issue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources.tables import materialised

_BLANKS = " \t\n\r\x0b\x0c"
#: Units of measured values, and how evidence may spell them.
UNITS = {"分钟": "(?:分钟|minutes?|mins?)", "小时": "(?:小时|hours?|hrs?)", "天": "(?:天|days?)", "次": "(?:次|times?|cycles?)", "年": "(?:年|years?)", "月": "(?:月|months?)", "日": "(?:日|days?)", "℃": "(?:℃|°c|degrees?c)", "%": "%", "v": "v", "w": "w", "a": "a", "hz": "hz", "mm": "mm", "cm": "cm"}
_MEASURE = r"[0-9]+(?:\.[0-9]+)?\s*(?:%|v|w|a|hz|mm|cm|分钟|小时|天|次|年|月|日|℃)"


@dataclass(frozen=True)
class Vocabulary:
    """The terms that the checks look for; another language brings its own."""

    prohibition: tuple[str, ...] = ("严禁", "禁止", "不得", "切勿", "不要", "不可", "不能")
    continuation: str = "(?:仍然?|依然?)?(?:可以|可|能够|能)继续|(?:可以|可)正常使用"
    negation: tuple[str, ...] = ("不", "不能", "不可", "禁止", "严禁")
    commitment: tuple[str, ...] = ("免费维修", "免费更换", "全额退款", "无条件退货", "无理由退货", "赔付", "赔偿", "上门维修")
    deadline: str = r"[0-9]+(?:\.[0-9]+)?(?:分钟|小时|天|工作日)内"
    certainty: tuple[str, ...] = ("确认", "确定", "就是", "证明", "已经", "表明")
    qualifier: tuple[str, ...] = ("图片中", "图片显示", "画面中", "可见", "疑似", "可能", "看起来", "识别到")
    boundary: tuple[str, ...] = ("拆机", "拆开维修", "自行维修", "自己维修", "全额退款", "无条件退货", "保证退款", "保证赔偿", "免费维修", "官方说明书指出", "根据官方手册")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return T.any_term(text, [t.lower() for t in terms])


def packed(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


def named_terms(claim: Column) -> Column:
    """Distinct names with letters and digits in a claim, lower case."""
    found = T.all_of(F.lower(claim), r"(?<![\p{L}\p{N}_])[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?![\p{L}\p{N}_])")
    return F.array_distinct(F.filter(found, lambda x: x.rlike("[a-z]") & x.rlike("[0-9]")))


def measures(claim: Column) -> Column:
    """Distinct measured values in a claim, without white space."""
    return F.array_distinct(F.transform(T.all_of(F.lower(claim), r"(?<![\p{L}\p{N}_])" + _MEASURE), packed))


def measure_supported(term: Column, support: Column) -> Column:
    """Whether packed evidence holds the value: as it stands, inside a range of the same unit, or as a part of a date."""
    body = F.replace(support, F.lit("\\~"), F.lit("~"))
    value = F.regexp_extract(term, r"^[0-9]+(?:\.[0-9]+)?", 0).cast("double")
    unit = F.regexp_replace(term, r"^[0-9]+(?:\.[0-9]+)?", "")
    spelled = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), unit), F.lit("(?!)"))
    pattern = F.concat(F.lit(r"(?i)([0-9]+(?:\.[0-9]+)?)(?:[-–~至～]([0-9]+(?:\.[0-9]+)?))?"), spelled)
    low, high = (F.regexp_extract_all(body, pattern, F.lit(k)) for k in (1, 2))
    ranges = F.zip_with(low, high, lambda a, b: F.struct(a.cast("double").alias("a"), F.when(b == "", a).otherwise(b).cast("double").alias("b")))
    inside = F.exists(ranges, lambda r: (value >= F.least(r["a"], r["b"])) & (value <= F.greatest(r["a"], r["b"])))
    date = r"(?<![0-9])(?:([0-9]{4})[-/年])?([0-9]{1,2})[-/月]([0-9]{1,2})(?:日)?"
    part = F.when(unit == "年", F.lit(1)).when(unit == "月", F.lit(2)).when(unit == "日", F.lit(3))
    dated = F.when(part == 1, F.regexp_extract_all(body, F.lit(date), F.lit(1))).when(part == 2, F.regexp_extract_all(body, F.lit(date), F.lit(2))).when(part == 3, F.regexp_extract_all(body, F.lit(date), F.lit(3)))
    in_date = F.coalesce(F.exists(dated, lambda x: (x != "") & (F.when(x != "", x).cast("double") == value)), F.lit(False))
    return F.contains(body, term) | inside | in_date


def unsupported_terms(claim: Column, support: Column) -> Column:
    """Names, then measured values, of a claim that its packed evidence does not hold; each kind sorted."""
    names = F.filter(named_terms(claim), lambda x: ~F.contains(support, x))
    values = F.filter(measures(claim), lambda x: ~measure_supported(x, support))
    return F.array_distinct(F.concat(F.array_sort(names), F.array_sort(values)))


def steps_out_of_order(claim: Column, support: Column) -> Column:
    """Whether two or more numbered steps of the evidence stand in the claim in another order."""
    at = F.filter(F.transform(T.numbered_steps(support), lambda s: F.instr(F.coalesce(claim, F.lit("")), s)), lambda p: p > 0)
    return (F.size(T.numbered_steps(support)) >= 2) & (F.size(at) >= 2) & (at != F.array_sort(at))


def contradicts_prohibition(claim: Column, support: Column, words: Vocabulary) -> Column:
    """Evidence forbids, and the claim says to go on, with no negation in the three characters before."""
    before = F.regexp_extract(claim, f"(?s)^(.*?)(?:{words.continuation})", 1)
    positive = claim.rlike(words.continuation)
    return _any(support, words.prohibition) & positive & ~_any(F.substring(before, -3, 3), words.negation)


def unsupported_commitments(claim: Column, support: Column, words: Vocabulary) -> Column:
    """Promises and deadlines of a claim that are not in its evidence, in order."""
    said = F.filter(F.array(*map(F.lit, words.commitment)), lambda t: F.contains(claim, t))
    all_said = F.array_distinct(F.concat(said, T.all_of(claim, words.deadline)))
    plain = F.regexp_replace(F.coalesce(support, F.lit("")), r"\s+", "")
    return F.filter(all_said, lambda t: ~F.contains(plain, F.regexp_replace(t, r"\s+", "")))


def promotes_observation(claim: Column, types: Column, words: Vocabulary) -> Column:
    """All evidence is seen, not read, and the claim is certain without a qualifier."""
    seen = (F.size(types) > 0) & F.forall(types, lambda t: t.isin("vision", "ocr"))
    return seen & ~_any(claim, words.qualifier) & _any(claim, words.certainty)


def bound_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with their evidence: bound (structs in the claim's order) and missing (ids that do not exist)."""
    named = claims.select("answer_id", "claim_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    support = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    held = evidence.select("answer_id", "evidence_id", F.col("source_type").alias("kind"), support.alias("support"))
    found = named.join(held, ["answer_id", "evidence_id"], "left")
    row = F.struct("at", "evidence_id", "kind", "support")
    lists = found.groupBy("answer_id", "claim_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    out = claims.select("answer_id", "claim_id", "text").join(lists, ["answer_id", "claim_id"], "left")
    known = F.coalesce(F.filter("all", lambda x: x["support"].isNotNull()), F.array())
    lost = F.coalesce(F.transform(F.filter("all", lambda x: x["support"].isNull()), lambda x: x["evidence_id"]), F.array().cast("array<string>"))
    return out.select("answer_id", "claim_id", F.coalesce("text", F.lit("")).alias("text"), known.alias("bound"), lost.alias("missing"))


def claim_issues(claims: DataFrame, evidence: DataFrame, words: Vocabulary = Vocabulary(), enhanced: bool = True) -> DataFrame:
    """answer_id, claim_id and issues (codes of the failed checks, in the order of the checks)."""
    b = bound_claims(claims, evidence)
    text = F.col("text")
    joined = F.array_join(F.transform("bound", lambda x: x["support"]), "\n")
    checks = [(F.size("missing") > 0, "unsupported-claim")]
    if enhanced:
        checks += [
            (F.size(unsupported_terms(text, packed(joined))) > 0, "unsupported-number-or-model"),
            (F.exists("bound", lambda x: steps_out_of_order(text, x["support"])), "safety-step-order-mismatch"),
            (F.exists("bound", lambda x: contradicts_prohibition(text, x["support"], words)), "contradicts-prohibition"),
            (F.size(unsupported_commitments(text, joined, words)) > 0, "unsupported-service-commitment"),
            (promotes_observation(text, F.transform("bound", lambda x: x["kind"]), words), "visual-observation-promoted"),
        ]
    codes = F.filter(F.array(*(F.when(c, name) for c, name in checks)), lambda x: x.isNotNull())
    return b.select("answer_id", "claim_id", codes.alias("issues"))


def reports(results: DataFrame, claims: DataFrame, evidence: DataFrame, expected: list[str], words: Vocabulary = Vocabulary(), enhanced: bool = True) -> DataFrame:
    """One row per answer: issues, passed, action (accept, revise, fallback) and confidence.

    Confidence: 0.46 of the least expected agent's, 0.30 of the mean evidence's, 0.16 of five distinct pieces of evidence,
    and 0.08; at most 0.98; 0 where a check failed.
    """
    found = claim_issues(claims, evidence, words, enhanced).groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.array_distinct(F.flatten(F.collect_list("issues"))).alias("claim_issues"))
    done = (F.col("status") == "completed") & F.col("agent").isin(expected)
    agents = results.groupBy("answer_id").agg(F.min(F.when(done, F.col("confidence"))).alias("least"), F.collect_set(F.when(F.col("status") == "completed", F.col("agent"))).alias("completed"))
    sure = F.coalesce("confidence", F.least(F.lit(0.85), F.greatest(F.lit(0.35), F.coalesce("score", F.lit(0.0)))))
    held = evidence.groupBy("answer_id").agg(F.avg(sure).alias("support"), F.countDistinct("evidence_id").alias("n_evidence"))
    all_ = agents.join(found, "answer_id", "left").join(held, "answer_id", "left")
    lost = F.when(F.size(F.array_except(F.array(*map(F.lit, expected)), "completed")) > 0, "missing-domain-result")
    none = F.when(F.coalesce("n_claims", F.lit(0)) == 0, "no-claims")
    issues = F.array_sort(F.filter(F.concat(F.array(lost, none), F.coalesce("claim_issues", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    passed = F.size("issues") == 0
    value = 0.46 * F.col("least") + 0.3 * F.coalesce("support", F.lit(0.0)) + 0.16 * F.least(F.lit(1.0), F.coalesce("n_evidence", F.lit(0)) / 5) + 0.08
    action = F.when(passed, "accept").when((F.coalesce("n_claims", F.lit(0)) > 0) & (F.coalesce("n_evidence", F.lit(0)) > 0), "revise").otherwise("fallback")
    confidence = F.when(passed & F.col("least").isNotNull(), F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.0), value)), 4)).otherwise(0.0)
    return all_.withColumn("issues", issues).select("answer_id", "issues", passed.alias("passed"), action.alias("action"), confidence.alias("confidence"))


def general_report(rows: DataFrame, needs_domain: Column, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Checks of answers without evidence (answer_id, answer, status, confidence): issue, passed, action, confidence."""
    answer = F.btrim(F.coalesce("answer", F.lit("")), F.lit(_BLANKS))
    issue = F.when(needs_domain, "general-request-out-of-domain").when((F.col("status") != "completed") | (answer == ""), "general-model-unavailable").when(_any(answer, words.boundary), "general-route-safety-boundary")
    ok = issue.isNull()
    return rows.select("answer_id", issue.alias("issue"), ok.alias("passed"), F.when(ok, "accept").otherwise("handoff").alias("action"), F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence"))


def both_modes(results: DataFrame, claims: DataFrame, evidence: DataFrame, expected: list[str], words: Vocabulary = Vocabulary()) -> DataFrame:
    """The basic verdict, which decides, beside the enhanced one, which is only recorded."""
    basic = reports(results, claims, evidence, expected, words, enhanced=False).select("answer_id", "passed", "action")
    shadow = reports(results, claims, evidence, expected, words).select("answer_id", F.col("passed").alias("shadow_passed"), F.col("action").alias("shadow_action"))
    return basic.join(shadow, "answer_id")


def with_fallback(reports_: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers that failed are replaced by the text of their best evidence (score, then id); the rest stay.

    Returns answer_id, answer, replaced.
    """
    best = evidence.groupBy("answer_id").agg(F.max_by("text", F.struct("score", "evidence_id")).alias("instead"))
    rows = answers.join(reports_.select("answer_id", "passed"), "answer_id").join(best, "answer_id", "left")
    swap = ~F.col("passed") & F.col("instead").isNotNull()
    return rows.select("answer_id", F.when(swap, F.col("instead")).otherwise(F.col("answer")).alias("answer"), swap.alias("replaced"))


def revised(results: DataFrame, claims: DataFrame, evidence: DataFrame, expected: list[str], revise: Callable[[DataFrame], DataFrame], words: Vocabulary = Vocabulary(), most: int = 10) -> DataFrame:
    """answer_id, answer, passed, rounds: answers checked and revised until they pass, at most so often; then their best evidence stands in.

    claims also have answer, the text as it stands. revise gets the claims of answers that may be revised, with issues, and gives them
    anew; it sees only those that are still open, and each round is written before the next.
    """
    parts, now, wanted = [], claims, results
    for turn in range(most + 1):
        now = materialised(now)
        report = materialised(reports(wanted, now, evidence, expected, words).select("answer_id", "issues", "passed", "action").withColumn("rounds", F.lit(turn)))
        again = report.where("action = 'revise'")
        last = turn == most or again.isEmpty()
        answers = now.groupBy("answer_id").agg(F.min_by("answer", "claim_id").alias("answer"))
        parts.append((report if last else report.where("action <> 'revise'")).join(answers, "answer_id", "left").select("answer_id", "answer", "passed", "rounds"))
        if last:
            break
        wanted = wanted.join(again.select("answer_id"), "answer_id", "left_semi")
        now = revise(now.join(again.select("answer_id", "issues"), "answer_id")).select(*claims.columns)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    kept = with_fallback(out, out.select("answer_id", "answer"), evidence)
    return out.drop("answer").join(kept, "answer_id").select("answer_id", "answer", "passed", "rounds")
