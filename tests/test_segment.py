"""Segmentation against all paths, and search over segmented text."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import search as S
from brindle.operators import segment as G

WORDS = [("清洁", 50), ("滤网", 40), ("清洁滤网", 3), ("洗衣机", 30), ("洗衣", 20), ("机", 25), ("衣", 5), ("排水", 30), ("排水管", 12), ("管", 9), ("水管", 14), ("ab", 7), ("b", 2), (None, 5), ("x", 0), ("清洁", 1)]


def counts():
    out = {}
    for w, n in WORDS:
        if w and n > 0:
            out[w] = out.get(w, 0) + n
    return out


def all_paths(run):
    """The best of all ways to cut a run."""
    words, total = counts(), sum(counts().values())
    weight = lambda n: round(math.log(n / total) * 1_000_000)
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        parts, start = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(run[start:k])
                start = k
        parts.append(run[start:])
        if any(len(p) > 1 and p not in words for p in parts):
            continue
        key = (sum(weight(words.get(p, 1)) for p in parts), [len(p) for p in parts])
        if best is None or key > best[0]:
            best = (key, parts)
    return best[1]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(WORDS, "word string, freq long")


def test_paths(spark, dictionary):
    r = random.Random(3)
    runs = {"".join(r.choices("清洁滤网洗衣机排水管abx新", k=r.randint(1, 11))) for _ in range(300)} | {"清洁滤网", "洗衣机排水管", "b", "新"}
    frame = spark.createDataFrame([(x, 1) for x in [*runs, "", None, "清洁"]], "run string, words int")
    want = {x: all_paths(x) for x in runs | {"清洁"}}
    table = G.prefixes(dictionary)
    for found in (G.segmented_runs(frame, dictionary, table), G.segmented_runs(frame, dictionary)):
        assert {x["run"]: list(x["words"]) for x in found.collect()} == want


def test_large_dictionaries_have_no_table(dictionary, monkeypatch):
    monkeypatch.setattr(G, "MOST_WORDS", 3)
    assert G.prefixes(dictionary) is None


def test_empty_dictionary(spark, dictionary):
    none = dictionary.limit(0)
    frame = spark.createDataFrame([("清洁",)], "run string")
    for table in (G.prefixes(none), None):
        assert G.segmented_runs(frame, none, table).first()["words"] == ["清", "洁"]


def test_very_long_runs(spark, dictionary):
    run = "清洁滤网洗衣机" * 20_000
    words = G.segmented(G.prefixes(dictionary))(F.col("t"))
    row = spark.createDataFrame([(run,), (None,), ("",)], "t string").select(F.size(words).alias("n")).collect()
    assert [r["n"] for r in row] == [60_000, 0, 0]


def test_texts_by_table_and_by_joins(spark, dictionary, monkeypatch):
    texts = spark.createDataFrame([(1, "E03: 洗衣机 7.5v 清洁滤网 新a", 0), (2, None, 0), (3, "", 0), (4, "清洁滤网 清洁滤网", 0), (None, "door 95.5%", 0)], "id long, text string, words int")
    want = {1: ["e03", "洗衣机", "7.5", "v", "清洁", "滤网", "新", "a"], 2: [], 3: [], 4: ["清洁", "滤网"] * 2, None: ["door", "95.5%"]}
    rows = lambda: {r["id"]: list(r["words"]) for r in G.segmented_texts(texts, dictionary).collect()}
    assert rows() == want
    monkeypatch.setattr(G, "MOST_WORDS", 3)
    assert rows() == want


def test_search_tokens(spark, dictionary):
    tokens = G.search_tokens(G.prefixes(dictionary))
    row = spark.createDataFrame([("E03: 洗衣机 7.5v 清洁滤网了, the door 95.5%",)], "t string").select(tokens(F.col("t"))).first()[0]
    # codes and numbers with units come first, then words by the dictionary, then pairs
    assert list(row) == ["e03", "7.5v", "95.5", "洗衣机", "7.5", "v", "清洁", "滤网", "了", "the", "door", "95.5%", "洗衣", "衣机", "洁滤", "网了"]


def test_segmented_words_find_what_pairs_alone_do_not(spark, dictionary):
    docs = spark.createDataFrame([(1, "洗衣机的排水管"), (2, "排水管和水管"), (3, "清洁滤网")], "id long, text string")
    asked = spark.createDataFrame([(9, "洗衣机排水管")], "query_id long, text string")
    tokens = G.search_tokens(G.prefixes(dictionary))
    found = {r["id"]: r["score"] for r in S.bm25(docs, asked, tokens=tokens).collect()}
    words = {1: ["洗衣机", "的", "排水管", "洗衣", "衣机", "机的", "的排", "排水", "水管"], 2: ["排水管", "和", "水管", "排水", "管和", "和水"], 3: ["清洁", "滤网", "洁滤"]}
    query = ["洗衣机", "排水管", "洗衣", "衣机", "机排", "排水", "水管"]
    mean = sum(map(len, words.values())) / 3
    score = lambda d: sum(math.log(1 + (3 - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) for t in query if t in words[d] for df in [sum(t in w for w in words.values())])
    assert found == {1: pytest.approx(score(1), abs=1e-5), 2: pytest.approx(score(2), abs=1e-5)}


def test_lists_of_runs(spark, dictionary, monkeypatch):
    lists = spark.createDataFrame([(1, ["清洁滤网", "b", "清洁滤网"]), (2, []), (3, None), (4, ["", None, "洗衣机排水管"])], "id long, runs array<string>")
    want = {1: [all_paths("清洁滤网"), ["b"], all_paths("清洁滤网")], 2: [], 3: [], 4: [[], [], all_paths("洗衣机排水管")]}
    by_table = G.segmented_lists(lists, dictionary)
    # by the table no run is shuffled to its words and back
    assert "Exchange" not in by_table._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["words"] for r in by_table.collect()} == want
    monkeypatch.setattr(G, "MOST_WORDS", 3)
    assert {r["id"]: r["words"] for r in G.segmented_lists(lists, dictionary).collect()} == want


def test_few_parts_of_a_large_dictionary_move(spark, monkeypatch):
    words = [f"{a}{b}{c}" for a in ("ka", "to", "mi", "ren", "sul") for b in ("da", "vel", "o", "pri") for c in ("n", "sta", "lum")]
    dictionary = spark.createDataFrame([(w, 1 + 7 * (k % 9 == 0)) for k, w in enumerate(words)], "word string, freq long")
    r = random.Random(5)
    lists = spark.createDataFrame([(k, ["".join(r.choices(words, k=2)) for _ in range(20)] + ["".join(r.choices(words, k=40))]) for k in range(40)] + [(None, ["kadanx"])], "id long, runs array<string>")
    rows = lambda df: {x["id"]: x["words"] for x in df.collect()}
    want = rows(G.segmented_lists(lists, dictionary))
    assert all("".join(w) == run for x in lists.collect() for run, w in zip(x["runs"], want[x["id"]], strict=True)) and want[None] == [["kadan", "x"]]
    monkeypatch.setattr(G, "MOST_WORDS", 30)
    found = G.segmented_lists(lists, dictionary)
    assert rows(found) == want
    # what is joined are parts that are words: no row for each part of a run, and none for each run
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "posexplode" not in plan
    lexicon = G.Lexicon(dictionary)
    parts = lists.select("id", F.explode(G._parts(lexicon.filter, G._pieces_of_lists)(F.col("runs"))).alias("word")).collect()
    assert {x["word"] for x in parts} <= set(words) and 0 < len(parts) < 40 * 80 and lexicon.further.count() == 30


def test_parts_with_a_words_hash_are_no_words(spark, dictionary, monkeypatch):
    monkeypatch.setattr(G, "SEEDS", [1])  # sums of letters: words of the same letters have one hash
    table = G.prefixes(dictionary)
    runs = ["网滤清洁", "滤网衣洗", "管水排洗衣机", "清洁滤网"]
    frame = spark.createDataFrame([(x,) for x in runs], "run string")
    found = {x["run"]: list(x["words"]) for x in G.segmented_runs(frame, dictionary, table).collect()}
    assert found == {x: all_paths(x) for x in runs}
    twice = spark.createDataFrame([("ab", 1), ("ba", 2)], "word string, freq long")
    monkeypatch.setattr(G, "SEEDS", [1, 0x9E3779B97F4A7C15])  # another multiplier parts them
    for most in (9, 1):
        monkeypatch.setattr(G, "MOST_WORDS", most)
        assert G.segmented_runs(spark.createDataFrame([("abba",)], "run string"), twice).first()["words"] == ["ab", "ba"]


def test_texts_of_a_large_dictionary_stay_whole(spark, dictionary, monkeypatch):
    texts = spark.createDataFrame([(k, f"清洁滤网{k} 洗衣机排水管 door") for k in range(30)], "id long, text string")
    rows = lambda df: {r["id"]: r["words"] for r in df.collect()}
    want = rows(G.segmented_texts(texts, dictionary))
    monkeypatch.setattr(G, "MOST_WORDS", 4)
    lexicon = G.Lexicon(dictionary)  # made once, for texts and for queries
    found = G.segmented_texts(texts, lexicon)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == want == rows(G.segmented_texts(texts, dictionary)) and "posexplode" not in plan and "sequence" not in plan
