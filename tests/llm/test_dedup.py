"""Line dedup and near-duplicate classes against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import line_dedup, near_dedup
from brindle.llm.common import table

SPACES = " \t\n\x0b\x0c\r"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def brute_lines(docs):
    """Kept text by row, for rows (doc_id, text)."""
    order = sorted({(d if d is not None else -(1 << 63), line_dedup_hash[t], t) for d, t in docs if t is not None})
    seen, kept = [], {}
    for d, h, t in order:
        lines = []
        for raw in t.split("\n"):
            line = raw.strip(SPACES)
            if line == "":
                lines.append(raw)
                continue
            alike = any(s == line or (min(len(s), len(line)) >= line_dedup.LEAST_CHARS and one_edit(s, line)) for s in seen)
            seen.append(line)
            if not alike:
                lines.append(raw)
        kept[d, t] = "\n".join(lines)
    return [(d, None if t is None else kept[d if d is not None else -(1 << 63), t]) for d, t in docs]


line_dedup_hash = {}


@pytest.fixture(scope="module")
def small(spark, sf):
    base = "the quick brown fox jumps over the lazy dog again"
    odd = [(1, f"{base}\n\nshort\n{base}"), (2, f"  {base} \n{base[:-1]}\nunique line of the second document"), (3, base[:10] + "X" + base[11:]), (4, base + "s"), (4, base + "s"), (5, None), (6, ""), (7, "\n \n"), (None, base), (8, "short\nshorx"), (9, base[1:]), (10, "z" * 5000 + "\n" + "z" * 4999), (11, "a" * 16), (12, "a" * 15)]
    docs = [(r[0] + 100, r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    return spark.createDataFrame([(d, t, "s") for d, t in odd + docs], "doc_id long, text string, source string")


def test_lines(spark, small):
    from pyspark.sql import functions as F

    rows = small.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), line_dedup.TEXT_SHIFT).alias("h")).collect()
    line_dedup_hash.update({r["text"]: r["h"] for r in rows})
    want = Counter(brute_lines([(r["doc_id"], r["text"]) for r in rows]))
    got = line_dedup.dedup_lines(small)
    assert got.columns == small.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert line_dedup.line_dedup_digest(small).count() == small.count()
    assert line_dedup.dedup_lines(small.limit(0)).count() == 0


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    k = 5
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    if not a or not b:
        return float(a == b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(docs):
    reps = {}
    for d, t in docs:
        known = [x for x in (d, reps.get(t)) if x is not None]
        reps[t] = min(known, default=None)
    texts = list(reps)
    bags = [bag(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and 0.75 * max(sum(bags[i].values()), sum(bags[j].values())) <= min(sum(bags[i].values()), sum(bags[j].values())) and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, t in enumerate(texts):
        least[find(i)] = min((x for x in (reps[t], least.get(find(i))) if x is not None), default=None)
    return {t: least[find(i)] for i, t in enumerate(texts)}


def test_near_classes(spark, sf):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    family = []
    for k in range(40):
        w = list(base)
        for at in rng.choice(120, 1 + k % 4, replace=False):
            w[at] = f"new{k}"
        family.append((1000 + k, " ".join(w)))
    chain = []
    w = list(rng.choice(words, 200))
    for k in range(12):  # each step is near the one before; the ends are far apart
        w = list(w)
        for at in range(k * 14, k * 14 + 3):
            w[at] = f"step{k}"
        chain.append((2000 + k, " ".join(w)))
    odd = [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "one two"), (3005, "one  two"), (None, "one two"), (3006, "a " * 3000), (3007, "a " * 2900), (3003, "one two")]
    docs = [(r[0], r[1]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()] + family + chain + odd
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_classes([(d, t or "") for d, t in docs])
    got = near_dedup.near_duplicate_classes(df).collect()
    assert len(got) == len(docs)
    by = {}
    for d, t in docs:
        by.setdefault(d, set()).add(want[t or ""])
    for r in got:
        assert r["class_id"] in by[r["doc_id"]], r
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_one_id_with_two_texts(spark):
    a, b = "one text that stands here alone and nowhere else", "another text without a single common word in it"
    rows = [(5, a, "x"), (5, b, "y"), (6, a, "z"), (None, a, "w"), (None, "only here", "v"), (7, b, "y"), (7, b, "y"), (8, None, "n"), (9, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stay string")
    got = near_dedup.near_duplicate_classes(df).collect()
    assert len(got) == len(rows) and len({r["class_key"] for r in got}) == 4
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_one(df).collect())
    assert kept == [(0, "only here"), (5, b), (5, a), (8, None)]


def test_families_with_and_without_an_original(spark):
    """Recall of the stars against brute force: edited copies of one text, and copies so far apart that few are linked."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for family, edits in enumerate((4, 7, 9, 12)):
        base = list(rng.choice(words, 150))
        for k in range(120):
            w = list(base)
            for at in rng.choice(150, int(rng.integers(1, edits)), replace=False):
                w[at] = f"n{family}x{k}x{at}"
            docs.append((1000 * family + k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    mine = {r["doc_id"]: r["class_key"] for r in near_dedup.near_duplicate_classes(df).collect()}
    bags = [(d, bag(t)) for d, t in docs]
    linked = [(a, b) for i, (a, x) in enumerate(bags) for b, y in bags[:i] if a // 1000 == b // 1000 and jaccard(x, y) >= 0.8]
    together = sum(mine[a] == mine[b] for a, b in linked) / len(linked)
    print("links", len(linked), "recall", together)
    assert together >= 0.95
    want = brute_classes(docs)
    finest = {}
    for d, t in docs:  # no class holds texts that brute force keeps apart
        assert finest.setdefault(mine[d], want[t]) == want[t]


def test_signatures_estimate_the_weighted_overlap():
    a = " ".join(f"w{i % 97} x{i}" for i in range(600))
    b = a.replace("x1", "y1")
    sig = near_dedup.signatures([a, b])
    estimate = float((sig[0] == sig[1]).mean())
    assert abs(estimate - jaccard(bag(a), bag(b))) < 0.2


def test_near_classes_of_nothing(spark):
    assert near_dedup.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_bucket_of_many_families_is_closed(spark):
    """Texts of one bucket that link to none of its centres still meet each other: classes, links and blocks of any size."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for family in range(30):
        base = list(rng.choice(words, 100))
        for k in range(2 + family % 3):
            docs.append((10 * family + k, " ".join([*base, f"end{k}"]) if family else " ".join(base[: 100 - k])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    reps = near_dedup.written(near_dedup.sign(df).select(F.col("doc_id").alias("rep"), "h1", "h2", F.array(F.lit(1).cast("long")).alias("bands"), "sig"))
    for block in (near_dedup.BLOCK_BYTES, 6000):
        before, near_dedup.BLOCK_BYTES = near_dedup.BLOCK_BYTES, block
        try:
            links, label = near_dedup.near_links(reps, df)
        finally:
            near_dedup.BLOCK_BYTES = before
        assert {r["rep"]: r["class"] for r in label.collect()} == {d: d // 10 * 10 for d, _ in docs}
        text = dict(docs)
        assert all(abs(r["similarity"] - jaccard(bag(text[r["a"]]), bag(text[r["b"]]))) < 1e-9 for r in links.collect())


def test_links_of_different_labels_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    for sides in ([2] * 40, [0] * 15 + [1] * 25):
        bags = [np.sort(rng.integers(0, 12, int(rng.integers(3, 14)))).astype(np.uint32) for _ in sides]
        label = rng.integers(0, 20, len(sides))
        got = near_dedup.apart_links(label, np.array(sides), np.array([len(b) for b in bags]), np.concatenate(bags), 0.6)
        up = {int(k): int(k) for k in label}
        want = dict(up)

        def join(known, i, j):
            old, new = known[int(label[i])], known[int(label[j])]
            known.update({k: new for k, v in known.items() if v == old})

        for i, j, alike in got:
            assert abs(alike - near_dedup.overlap(bags[i], bags[j])) < 1e-9 and alike >= 0.6
            join(up, i, j)
        for i in range(len(sides)):
            for j in range(i):
                if (sides[i] == 2 or sides[i] != sides[j]) and near_dedup.overlap(bags[i], bags[j]) >= 0.6:
                    join(want, i, j)
        groups = lambda known: {frozenset(k for k in known if known[k] == v) for v in known.values()}
        assert groups(up) == groups(want) and got
