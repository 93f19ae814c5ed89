"""Control flow over tables: rounds until rows are finished, items of a list one by one, branches, and named categories.

A round's rows are written before the next one begins, finished rows leave, and only the others go on; so a loop costs what its
unfinished rows cost, and a lost executor repeats one round. Rounds are bounded by a parameter, for a step may never finish a row.

Odd input: a condition that is null does not hold; empty tables take no round; a null or empty list has no items and gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import materialised

#: Most rounds of a loop.
ROUNDS = 10

Step = Callable[[DataFrame], DataFrame]


def looped(rows: DataFrame, step: Step, finished: Column, most: int = ROUNDS) -> DataFrame:
    """The rows after as many steps as each needs, at most so many; with round (steps taken) and finished.

    finished is a condition on a row's columns; step gives the unfinished rows' columns anew (it may drop or add rows).
    """
    parts, now = [], rows
    for turn in range(most + 1):
        tested = materialised(now.withColumn("finished", F.coalesce(finished, F.lit(False))).withColumn("round", F.lit(turn)))
        rest = tested.where(~F.col("finished"))
        if turn == most or rest.isEmpty():
            parts.append(tested)
            break
        parts.append(tested.where("finished"))
        now = step(rest.drop("finished", "round"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def iterated(rows: DataFrame, key: str, items: str, step: Step) -> DataFrame:
    """key and items: each list after step has seen its items as rows (key, place, item) and given item anew, in order; rows that go, go from the list."""
    each = rows.select(key, F.posexplode(items).alias("place", "item"))
    lists = step(each).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("x"))
    back = rows.select(key, F.slice(items, 1, 0).alias("none")).join(lists.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return back.select(key, F.coalesce(F.transform("x", lambda x: x["item"]), "none", F.array()).alias(items))


def switched(rows: DataFrame, cases: list[tuple[Column, Step]], otherwise: Step) -> DataFrame:
    """Each row goes through the step of the first condition that holds, else through the last step; steps give equal columns."""
    branch = F.lit(len(cases))
    for k in range(len(cases) - 1, -1, -1):
        branch = F.when(cases[k][0], k).otherwise(branch)
    dealt = rows.withColumn("_branch", branch)
    out = None
    for k, step in enumerate([*(s for _, s in cases), otherwise]):
        part = step(dealt.where(F.col("_branch") == k).drop("_branch"))
        out = part if out is None else out.unionByName(part)
    return out


def first_filled(*columns: Column) -> Column:
    """The first of several results that is neither null nor blank."""
    return F.coalesce(*(F.when(F.btrim(c, F.lit(" \t\r\n")) != "", c) for c in columns))


def categorised(answer: Column, categories: list[str], fallback: str) -> Column:
    """What a classifier answered, if it is one of the categories (any case, blanks around it), else the fallback."""
    plain = F.lower(F.btrim(F.coalesce(answer, F.lit("")), F.lit(" \t\r\n.\"'")))
    out = F.lit(fallback)
    for name in reversed(categories):
        out = F.when(plain == name.lower(), name).otherwise(out)
    return out
