"""Scores and confidences as column expressions. The weights are fixed values.

Odd input: null confidences are derived from the score where there is one; results are rounded to four places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def valid_confidence(value: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & v.between(0, 1), v)


def hit_confidence(score: Column, rerank: Column) -> Column:
    """Confidence of a search hit from its score and its rerank score."""
    return F.round(F.least(F.lit(0.99), 0.5 + F.least(F.lit(0.4), 8 * score) + 0.05 * rerank), 4)


def overlap_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.95), 0.5 + score / 20), 4)


def quality(confidence: Column, score: Column) -> Column:
    """Quality of one piece of evidence, 0 to 1."""
    derived = F.least(F.lit(0.88), 0.42 + F.least(F.lit(0.42), 8 * F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))))
    return between(F.coalesce(confidence, derived), 0.0, 1.0)


def harmonic_mean(values: Column) -> Column:
    """Mean of a ranked list with the weights 1, 1/2, 1/3, ...; null for an empty list."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("rank"))
    step = lambda acc, x: F.struct((acc["sum"] + x / acc["rank"]).alias("sum"), (acc["weight"] + 1 / acc["rank"]).alias("weight"), (acc["rank"] + 1).alias("rank"))
    return F.when(F.size(values) > 0, F.aggregate(values, start, step, lambda acc: acc["sum"] / acc["weight"]))


def evidence_confidence(qualities: Column, n_assets: Column) -> Column:
    """Confidence of an answer from its ranked evidence and related assets; 0 without evidence."""
    n = F.size(qualities)
    value = 0.35 * F.get(qualities, F.lit(0)) + 0.35 * harmonic_mean(qualities) + 0.2 * F.least(F.lit(1.0), n / 5) + 0.04 * F.least(F.lit(1.0), n_assets / 3) + 0.06
    return F.when(n > 0, F.round(between(value, 0.2, 0.97), 4)).otherwise(0.0)


def _detail(answer: Column, most: float) -> Column:
    """What the length of an answer adds."""
    length = F.length(F.btrim(F.coalesce(answer, F.lit(""))))
    return F.least(F.lit(most), F.greatest(F.lit(0), length - 20) / 900 * most)


def guard_confidence(previous: Column, support: Column, answer: Column) -> Column:
    """Confidence of an answer by the guard path; support is the mean confidence of its citations."""
    return F.round(between(0.4 * F.greatest(F.lit(0.0), previous) + 0.33 * F.coalesce(support, F.lit(0.0)) + _detail(answer, 0.12) + 0.07, 0.15, 0.93), 4)


def general_confidence(answer: Column, reported: Column, visual: Column) -> Column:
    """Confidence of an answer without evidence, from its own report where it has one."""
    base = 0.52 + _detail(answer, 0.14) + F.when(visual, 0.08).otherwise(0.04)
    return F.round(F.when(reported.isNull(), F.least(F.lit(0.8), base)).otherwise(between(0.68 * between(reported, 0.0, 1.0) + 0.32 * base, 0.32, 0.92)), 4)


def least_confidence(parts: Column) -> Column:
    """The least positive confidence of those parts (status, confidence) that are ok; 0 where there is none."""
    good = F.filter(parts, lambda p: (p["status"] == "ok") & (p["confidence"] > 0))
    return F.coalesce(F.array_min(F.transform(good, lambda p: p["confidence"])), F.lit(0.0))


def field_term(df: Column, n: Column, tf: Column, length: Column, mean_length: Column, asked: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 term of one field with term frequency; a term asked for several times counts twice at most."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    saturated = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(length, F.lit(1)) / F.when(mean_length > 0, mean_length).otherwise(1.0)))
    return idf * saturated * F.least(asked, F.lit(2))
