"""The digest tree against a plain fold over sorted rows."""

import hashlib
from collections import Counter

import pytest

from brindle.operators import bundle as B


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, columns, order):
    field = lambda v: "n" if v is None else "v" + sha(str(v))
    key = lambda r: tuple((r[columns.index(c)] is not None, r[columns.index(c)] or 0) for c in order)
    leaves = Counter((key(r), sha(",".join(field(r[columns.index(c)]) for c in sorted(columns)))) for r in rows)
    level = [f"{d}:{n}" for (_, d), n in sorted(leaves.items())]
    for _ in range(B.LEVELS):
        level = [sha(",".join(level[k : k + B.CHILDREN])) for k in range(0, len(level), B.CHILDREN)]
    return len(rows), level[0] if level else sha("")


@pytest.mark.parametrize("n", [0, 1, 5, 2500])
def test_root(spark, n):
    rows = [(k % 700, f"text {k % 900}", None if k % 3 else k % 50) for k in range(n)] + ([(None, None, None)] * 3 + [(7, "x", 1)] * 2 if n > 1 else [])
    frame = spark.createDataFrame(rows, "id long, text string, n long")
    for other in (frame, frame.repartition(7), frame.orderBy("text").coalesce(2)):
        assert tuple(B.tree_digest(other, ["id"]).first()) == plain(rows, ["id", "text", "n"], ["id"])


def test_order_and_content_count(spark):
    root = lambda rows, order: B.tree_digest(spark.createDataFrame(rows, "a long, b string"), order).first()["root"]
    rows = [(1, "z"), (2, "y"), (3, "x")]
    roots = [root(rows, ["a"]), root(rows, ["b"]), root([(1, "z"), (2, "y"), (3, "X")], ["a"]), root(rows[:2], ["a"]), root([*rows, (3, "x")], ["a"]), root([(1, "z,"), (2, "y"), (3, "x")], ["a"])]
    assert len(set(roots)) == len(roots)
