"""Quality classifier, sharding, HTML extraction and the pipeline."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import html_text, mil_quality, shards
from brindle.llm.common import table
from brindle.llm.queries import op3_quality, op4_shards, op9_html

ODD_DOCS = [(-1, None, None, None), (-2, "", "en", "s"), (-3, "z" * 60_000, None, "s"), (None, "no id", "en", None), (-4, "twice", "en", "s"), (-4, "twice", "en", "s")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string")
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source").unionByName(odd)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op3_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    held = [d for d in labels if d in got and labels[d] is not None and got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    right = sum(got[d]["predicted"] == labels[d] for d in held) / len(held)
    print("held-out accuracy", round(right, 3), len(held))
    assert right > 0.8


def test_quality_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["quality_score"] for r in mil_quality.score_documents(docs, mil_quality.train(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(d, d % 2) for d in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = mil_quality.keep_good(docs, some)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_shards(spark, sf, docs):
    rows = shards.shard_documents(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    sizes = Counter()
    for r in op4_shards(spark, "/root/testdata/sf0.01").collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    print("largest shard over mean", max(sizes.values()) / mean)
    assert len(sizes) == 16 and max(sizes.values()) < 1.25 * mean
    assert shards.shard_documents(docs.limit(0)).count() == 0


def test_shards_are_cut_along_the_widest_dimension(spark):
    # deviations at the root: lang 0.5, source 0.37, log_size 0.2; below the cuts of lang and source: 0, 0.17, 0.2
    places = [(lang, source, k, i) for lang in "pq" for source in "abcd" for k in range(6, 14) for i in range(20)]
    rows = [(n, f"{n:05d}".ljust(2**k - 1, "x"), lang, source) for n, (lang, source, k, _) in enumerate(places)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = shards.grow_tree(shards.written(shards.points(df)))
    assert [{s.dimension for s in cuts.values()} for cuts in levels] == [{"lang"}, {"source"}, {"log_size"}, {"source", "log_size"}]
    held = defaultdict(set)
    for r in shards.shard_documents(df).join(df, "doc_id").collect():
        held[r["shard"]].add((r["lang"], r["source"] in "ab"))
    assert len(held) == 16 and all(len(kinds) == 1 for kinds in held.values())


def replayed(rows, shards=16):
    """The shard of every point (dims, fine, row, size), by plain recursion over lists."""
    dims = shards_dims = ("lang", "source", "log_size")
    places = {d: sorted({r[d] for r in rows}) for d in dims}
    scale = {d: {p: (k if d != "log_size" else p - places[d][0]) / max(1, (len(places[d]) - 1 if d != "log_size" else places[d][-1] - places[d][0])) for k, p in enumerate(places[d])} for d in shards_dims}
    out = {}

    def deviation(mine, d):
        total = sum(r["size"] for r in mine)
        mean = sum(scale[d][r[d]] * r["size"] for r in mine) / total
        return (sum((scale[d][r[d]] - mean) ** 2 * r["size"] for r in mine) / total) ** 0.5

    def go(mine, node, left):
        if left == 1:
            out.update({r["doc_id"]: node for r in mine})
            return
        if not mine:
            return
        wide = {d: deviation(mine, d) for d in dims}
        best = max(dims, key=lambda d: (round(wide[d], 9), d))
        key = lambda r: (r[best], r["fine"], r["row"])
        half, done, cells = sum(r["size"] for r in mine) / 2, 0, Counter()
        for r in mine:
            cells[key(r)] += r["size"]
        for cell in sorted(cells):
            if done + cells[cell] > half:
                cut = (*cell[:2], cell[2] + (half - done > cells[cell] / 2))
                break
            done += cells[cell]
        go([r for r in mine if key(r) < cut], 2 * node, left // 2)
        go([r for r in mine if key(r) >= cut], 2 * node + 1, left // 2)

    go(rows, 0, shards)
    return out


def test_shards_by_plain_recursion(spark):
    pts = shards.written(shards.points(table(spark, "/root/testdata/sf0.01", "documents")))
    want = replayed([r.asDict() for r in pts.collect()])
    got = {r["doc_id"]: r["s"] for r in pts.select("doc_id", shards.shard_of(shards.grow_tree(pts)).alias("s")).collect()}
    assert got == want


def test_equal_texts_share_a_shard(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang", "source")
    hot = spark.range(400).select((F.lit(10**6) + F.col("id")).alias("doc_id"), F.lit("a hot text " * 300).alias("text"), F.lit("en").alias("lang"), F.format_string("s%d", F.col("id") % 9).alias("source"))
    rows = shards.shard_documents(docs.unionByName(hot)).collect()
    sizes, groups = Counter(), defaultdict(lambda: [set(), 0])
    for r in rows:
        sizes[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]][0].add(r["shard"])
        groups[r["text_crc32"], r["size"]][1] += r["size"]
    mean = sum(sizes.values()) / 16
    print("shards over mean", max(sizes.values()) / mean, min(sizes.values()) / mean)
    assert len(sizes) == 16 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    assert all(len(held) == 1 for held, total in groups.values() if total <= shards.GROUP_SHARE * mean)
    assert sum(len(held) > 1 for held, _ in groups.values()) <= 1


def test_shards_of_many_sources_keep_their_order(spark):
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.format_string("text %05d", "id").alias("text"), F.lit("en").alias("lang"), F.format_string("s%05d", "id").alias("source"))
    found = {r["doc_id"]: r["source"] for r in shards.points(df).collect()}
    assert all(found[i] <= found[i + 1] for i in range(9999)) and 3000 < len(set(found.values())) <= shards.SLICES
    firsts = sorted((min(ids), max(ids)) for ids in shards.shard_documents(df).groupBy("shard").agg(F.collect_list("doc_id").alias("ids")).toPandas()["ids"])
    widest = max(Counter(found.values()).values())  # neighbours that share a slice may be cut anywhere
    assert len(firsts) == 16 and widest < 100 and all(high < low + widest for (_, high), (low, _) in zip(firsts, firsts[1:], strict=False))


def test_html_blocks():
    blocks = html_text.blocks_of
    assert blocks('<p>a<p class="ad">x<p>b</p><div id="cookieNotice">z</div><nav>m</nav>c &lt; d<br>e') == [(0, "a"), (0, "b"), (0, "c < d e")]
    page = '<body><header>site</header><article><header><h1>T</h1><span>by x</span></header><p>one <b>two</b></p><aside>no</aside><section class="comments"><p>hm</p></section><p>th&eacute;</p><form><label>l</label></form></article><p>out</p>'
    assert html_text.root_blocks(blocks(page)) == (3, ["T", "one two", "thé"])
    long = "the whole story is told here and not there " * 3
    assert html_text.root_blocks(blocks(f"<main><p>{long}</p><article><p>teaser</p></article></main><p>out</p>")) == (2, [long.strip(), "teaser"])
    assert html_text.root_blocks(blocks(f"<main><p>short</p><article><p>{long}</p></article></main>")) == (3, [long.strip()])
    names = {"side-effects": False, "form-of-poetry": False, "reply-all": False, "social-history": False, "comment-list": True, "site-nav": True, "leftSidebar": True, "ad": True, "ad-300x250": True, "no-sidebar": False, "article-header": False}
    assert {n: html_text.names_boilerplate(html_text._words(n)) for n in names} == names
    assert blocks('<p>x<!-- c --> y<script>if(a<b){"</p>"}</script> z') == [(0, "x y z")]
    assert blocks("") == [] and blocks("a < b and c > d") == [(0, "a < b and c > d")] and blocks('<div class="no-sidebar">k') == [(0, "k")]


def test_covered_tokens_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    shared = list(rng.integers(1, 50, 20))
    streams = [[int(x) for x in [*rng.integers(1, 6, 30), *(shared if k % 2 else []), *rng.integers(1, 50, 10)]] for k in range(9)] + [[1, 2], []]
    holders = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - html_text.RUN + 1):
            holders[tuple(s[i : i + html_text.RUN])].add(tuple(s))
    for k, (s, cover) in enumerate(zip(streams, html_text.covered_tokens(streams), strict=True)):
        want = [any(len(holders[tuple(s[i : i + html_text.RUN])]) >= html_text.PAGES_ALIKE for i in range(max(0, j - html_text.RUN + 1), min(j, len(s) - html_text.RUN) + 1)) for j in range(len(s))]
        assert list(cover) == want


def test_unmarked_boilerplate_goes(spark):
    notice = "we and our partners use small files to make this site work for you"
    pages = [(i, f"http://h.example/{i}", f"<div>{notice}</div><p>story {i} tells of number {i * 7919} and nothing else at all</p>", "x") for i in range(6)] + [(7, None, None, "x"), (8, "http://h.example/8", "", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract_text(df).collect()}
    assert all(got[i] == f"story {i} tells of number {i * 7919} and nothing else at all" for i in range(6)) and got[7] == got[8] == ""
    assert html_text.extract_text(df.limit(0)).count() == 0


def repeated_tokens(rows):
    """For each (host, blocks): how many tokens lie in runs that enough distinct pages of the host hold. Plain Python."""
    streams = [(host, ["\n", *(w for b in blocks for w in (*b.split(" "), "\n"))]) for host, blocks in rows]
    holders = defaultdict(set)
    for host, s in streams:
        for i in range(len(s) - html_text.RUN + 1):
            holders[(host, *s[i : i + html_text.RUN])].add(tuple(s))
    out = []
    for host, s in streams:
        inside = set()
        for i in range(len(s) - html_text.RUN + 1):
            if len(holders[(host, *s[i : i + html_text.RUN])]) >= html_text.PAGES_ALIKE:
                inside.update(range(i, i + html_text.RUN))
        out.append(len(inside))
    return out


@pytest.mark.parametrize("sent", [html_text.SENT_BYTES, 0])
def test_runs_are_counted_over_all_chunks(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "SENT_BYTES", sent)
    monkeypatch.setattr(html_text, "CHUNK_CHARS", 3000)
    notice, other = "we and our partners use small files to make this site work for you", "all of these words stand here on two pages only and so they stay"
    story = lambda i: f"story {i} tells of number {i * 7919} and nothing else at all"
    # a hot host of 513 pages, hosts of 3 pages far apart, and a host where only equal pages share the text
    pages = [(i, f"http://hot.example/{i}", f"<div>{notice}</div><p>{story(i)}</p>") for i in range(513)]
    pages += [(1000 + i, f"http://few{i % 200}.example/{i}", f"<p>{notice}</p><p>{story(i)}</p><i>{'long ' * 40}</i>") for i in range(600)]
    pages += [(700 + i, f"http://equal.example/{i}", f"<p>{other}</p><p>{story(i % 2)}</p>") for i in range(40)]
    pages += [(800, "http://big.example/", f"<p>{notice}</p>" + "<p>one more</p>" * 800)]
    pages = [p for k in range(7) for p in pages[k::7]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(pages, 5), "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert len(got) == len(pages) and all(got[i]["main_text"] == story(i) for i in range(513))
    assert all(notice not in got[1000 + i]["main_text"] for i in range(600)) and all(other in got[700 + i]["main_text"] for i in range(40)) and notice in got[800]["main_text"]
    want = repeated_tokens([(u, html_text.root_blocks(html_text.blocks_of(h))[1]) for u, h in ((u.split("/")[2], h) for _, u, h in pages)])
    assert [got[p[0]]["repeated_tokens"] for p in pages] == want


def test_repeated_tokens_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    pages = table(spark, sf, "pages").select("page_id", "html", html_text.host_of().alias("host")).collect()
    want = Counter(zip((r["page_id"] for r in pages), repeated_tokens([(r["host"], html_text.root_blocks(html_text.blocks_of(r["html"] or ""))[1]) for r in pages]), strict=True))
    assert Counter((r["page_id"], r["repeated_tokens"]) for r in op9_html(spark, sf).collect()) == want


def test_html_query(spark, sf):
    rows = op9_html(spark, sf).collect()
    assert len(rows) == table(spark, sf, "pages").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert not any("©" in r["text"] or "<" in r["text"][:1] for r in rows)


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near", "private", "packing"]
    packed = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    all_ids = {r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect()}
    assert ids and ids <= all_ids and len(ids) < len(all_ids)
    assert packed.where(F.col("length") > 2048).isEmpty()


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force, over what the stage before it kept."""
    from brindle.llm import near_dedup, packing, pii
    from brindle.llm.common import written
    from tests.llm.test_dedup import brute_classes, brute_lines, line_dedup_hash

    docs = table(spark, sf, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    good = written(stage["quality"](spark, docs, sf))
    scores = {r["doc_id"]: r["score"] for r in op3_quality(spark, sf).collect()}
    assert sorted(d for d, _ in pairs(good)) == sorted(d for d, x in scores.items() if x >= 0.5) and good.columns == columns
    line_dedup_hash.update({r["text"]: r["h"] for r in good.select("text", F.shiftrightunsigned(F.xxhash64("text"), 24).alias("h")).collect()})
    short = written(stage["lines"](spark, good, sf))
    assert Counter(pairs(short)) == Counter(brute_lines(pairs(good))) and short.columns == columns
    single = written(stage["near"](spark, short, sf))
    assert sorted(d for d, _ in pairs(single)) == sorted(set(brute_classes([(d, t or "") for d, t in pairs(short)]).values())) and single.columns == columns
    private = written(stage["private"](spark, single, sf))
    assert private.count() == single.count() and pii.pii_digest(private).where("n_email + n_ip + n_phone > 0").isEmpty() and private.columns == columns
    packed = stage["packing"](spark, private, sf).collect()
    encoder = packing.WordEncoder(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    assert sum(r["length"] for r in packed) == sum(len(encoder.ids(t or "")) + 1 for _, t in pairs(private))
    assert near_dedup.SIMILARITY == 0.8


@pytest.mark.parametrize("name", ["quality", "lines", "near", "private", "packing"])
def test_pipeline_stages_on_odd_rows(spark, sf, docs, name):
    odd = docs.where("doc_id is null or doc_id < 0").withColumn("n_chars", F.length("text").cast("long"))
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, sf)
    rows = out.collect()
    assert rows if name != "quality" else len(rows) <= 6
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), sf).count() == 0
