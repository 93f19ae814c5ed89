"""Block-max search against plain scoring of every document."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import ranked
from brindle.llm.common import table, written

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def plain(docs, items):
    rows = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs) if w]
    n, length, df = len(rows), sum(r[2] for r in rows), Counter(t for r in rows for t in r[1])
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(x for x in terms(t) if x in df)
    out = []
    for i, q in wanted.items():
        found = []
        for d, c, size in rows:
            m = 100 - 50 + ((50 * size * n) // length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in q if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[: ranked.TOP])]
    return sorted(out, key=str)


def made(seed, n):
    """Documents of few words, so that ties are many, some very long, some without terms."""
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma42", "Émile", "é", "ß", "日本", "x", "42", "A_b", "İ", " ", "\x7f", "z" * 300]
    text = lambda k: r.choice([" ", ",", "\n", "\x00"]).join(r.choices(words, range(len(words), 0, -1), k=k))
    docs = [(i, text(r.choice([0, 1, 2, 3, 5, 40]))) for i in range(n)]
    docs += [(None, text(3)), (None, None), (5, text(4)), (5, text(4)), (7, ""), (8, "alpha " * 5000 + "rare"), (9, "alpha " * 5000 + "rare")]
    items = [(k, text(4)) for k in range(12)] + [(3, "rare"), (None, "beta"), (None, "x"), (90, None), (91, "--"), (92, "unknown"), (93, "rare ALPHA")]
    return docs, items


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 30), (3, 600)])
def test_lists(spark, seed, n):
    docs, items = made(seed, n)
    index = written(ranked.forward_index(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, rank int").repartition(4), 1 + seed % 3))
    got = ranked.search(index, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int"))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain(docs, items)


def test_packs_give_the_same_lists(spark, monkeypatch):
    docs, items = made(4, 200)
    index = written(ranked.forward_index(spark.createDataFrame(docs, "doc_id long, text string")))
    frame = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked, "TERMS_A_PACK", 10)
    assert sorted((tuple(r) for r in ranked.search(index, frame).select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.ranked_digest(docs, items).count() == 0
    assert ranked.ranked_digest(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_bounds_hold_and_prune(spark):
    """No score is above its block's bound, and most blocks stay below the items' thresholds."""
    index = written(ranked.forward_index(table(spark, "/root/testdata/sf0.1", "documents")))
    (pack,) = ranked.packs(index, table(spark, "/root/testdata/sf0.1", "benchmark"))
    scored, pairs = 0, 0
    for part in pa.Table.from_batches(index.limit(300).toArrow().to_batches()).combine_chunks().to_batches():
        chunk = ranked._Chunk(part, pack, pa.array(pack.terms))
        where, scores, _, _, block = chunk.tables(np.ones(part.num_rows, bool))
        for q, of in enumerate(pack.of_item):
            at = where[of]
            found = scores[at[at >= 0]].sum(0)
            assert (found <= chunk.bound[block, q]).all()
        scored, pairs = scored + int((chunk.bound >= pack.least).sum()), pairs + chunk.bound.size
    print("share of blocks scored", scored / pairs)
    assert scored < 0.3 * pairs
