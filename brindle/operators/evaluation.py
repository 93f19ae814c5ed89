"""Evaluation of retrieval runs, answer snapshots and import reports.

Odd input: a case without targets hits where there is any result; without facts its coverage is whole; counts of nothing are 1
where they divide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T


def case_results(cases: DataFrame, results: DataFrame, top: int = 5) -> DataFrame:
    """What a run gave for each case: case_id, hit, rank, required_hits, required_total, forbidden_hits, passed, locked.

    cases: case_id, targets, required, forbidden (arrays), locked; results: case_id, rank, id, text.
    """
    rows = results.where(F.col("rank") <= top)
    found = rows.join(cases.select("case_id", "targets"), "case_id").groupBy("case_id").agg(F.min(F.when(F.array_contains("targets", F.col("id")), F.col("rank"))).alias("rank"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
    full = cases.join(found, "case_id", "left")
    context = F.coalesce("context", F.lit(""))
    hit = F.when(F.size("targets") > 0, F.col("rank").isNotNull()).otherwise(F.coalesce("n", F.lit(0)) > 0)
    required, forbidden = (F.size(F.filter(c, lambda f: F.contains(context, f))) for c in ("required", "forbidden"))
    out = full.select("case_id", hit.alias("hit"), "rank", required.alias("required_hits"), F.size("required").alias("required_total"), forbidden.alias("forbidden_hits"), "locked")
    return out.withColumn("passed", F.col("hit") & (F.col("required_hits") == F.col("required_total")) & (F.col("forbidden_hits") == 0))


def run_metrics(rows: DataFrame) -> DataFrame:
    """One row: recall, mrr, fact_coverage, forbidden_rate and whether the run passed (no locked case failed, all hit)."""
    n = F.greatest(F.lit(1), F.count("*"))
    agg = rows.agg(
        (F.count_if("hit") / n).alias("recall"),
        (F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)) / n).alias("mrr"),
        F.when(F.sum("required_total") > 0, F.sum("required_hits") / F.sum("required_total")).otherwise(1.0).alias("fact_coverage"),
        (F.coalesce(F.sum("forbidden_hits"), F.lit(0)) / n).alias("forbidden_rate"),
        F.count_if(F.col("locked") & ~F.col("passed")).alias("locked_failures"),
    )
    return agg.withColumn("passed", (F.col("locked_failures") == 0) & (F.col("recall") == 1) & (F.col("forbidden_rate") == 0))


def snapshot(answers: DataFrame) -> DataFrame:
    """id, question digest and answer digest; answers are normalised first."""
    return answers.select("id", F.sha2("question", 256).alias("question_sha256"), F.sha2(T.normal_answer(F.col("answer")), 256).alias("answer_sha256"))


def snapshot_differences(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Rows that differ between two snapshots: id and issue (missing, extra, question, answer)."""
    a = saved.select("id", F.col("question_sha256").alias("q"), F.col("answer_sha256").alias("a"))
    b = current.select("id", F.col("question_sha256").alias("p"), F.col("answer_sha256").alias("b"))
    issue = F.when(F.col("p").isNull(), "missing").when(F.col("q").isNull(), "extra").when(F.col("q") != F.col("p"), "question").when(F.col("a") != F.col("b"), "answer")
    return a.join(b, "id", "full_outer").select("id", issue.alias("issue")).where("issue is not null")


def report_counts(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row with the number of rows of each name, and the total."""
    return rows.agg(*(F.count_if(F.col(key) == n).alias(n) for n in names), F.count("*").alias("total"))


def questions(rows: DataFrame, url: str = T.URL) -> DataFrame:
    """Questions of an exported table (id, question): the repaired text without its links, the distinct links, and issue for
    an empty or repeated id."""
    n = rows.groupBy("id").agg(F.count("*").alias("_n"))
    links = F.array_distinct(T.all_of(F.col("question"), url))
    issue = F.when(F.coalesce(F.btrim("id"), F.lit("")) == "", "empty-id").when(F.col("_n") > 1, "duplicate-id")
    return rows.join(n, "id", "left").select("id", T.repaired_question(F.regexp_replace("question", url, "")).alias("question"), links.alias("links"), issue.alias("issue"))


def with_placeholders(answer: Column, assets: Column, most: int = 3, mark: str = "<PIC>") -> Column:
    """A struct of text and assets: distinct assets up to the limit, one mark in the text for each; marks too many go, missing
    ones are put behind the text."""
    kept = F.slice(T.string_list(assets), 1, most)
    parts = F.split(answer, mark)
    n = F.size(kept)
    first = F.array_join(F.slice(parts, F.lit(1), n + 1), mark)
    rest = F.array_join(F.slice(parts, n + 2, F.greatest(F.size(parts) - n - 1, F.lit(0))), "")
    missing = n - (F.size(parts) - 1)
    padded = F.concat(F.rtrim(answer, F.lit(" \t\n\r")), F.repeat(F.lit("\n" + mark), F.greatest(missing, F.lit(0))))
    text = F.when(n == 0, F.btrim(F.replace(answer, F.lit(mark), F.lit("")), F.lit(" \t\n\r"))).when(missing > 0, padded).otherwise(F.concat(first, rest))
    return F.struct(text.alias("text"), kept.alias("assets"))
