"""Batch retrieval: many queries at once against a corpus.

A corpus has id, text and, where known, title, parent_id and code_text (what codes are read from; the text where it is absent);
queries have query_id, text. A lexical hit shares two tokens with the query, or a code that must match exactly; each shared
code adds to its score. Statistics are those of the given corpus, so filter it first. Only rows that hold a token of a query
are shuffled. The queries are a stated set; Spark broadcasts their tokens only below its own size limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions import codes as K
from brindle.functions import scores as S
from brindle.functions import text as T
from brindle.sources.tables import materialised

#: Saturation and length weight of the score, ranks kept of each list, rank offset of the fusion, children given to a reranker.
K1, B, TOP, RANK_OFFSET, RERANKED = 1.5, 0.75, 20, 60, 12
#: Added for each code that query and document share, by BM25 and by overlap.
CODE_BM25, CODE_OVERLAP = 3.0, 2.5
#: Added to a parent for each further hit, at most; for a shared code; a rerank score's weight; the least score of a result.
COVERAGE, MOST_COVERAGE, EXACT_BONUS, RERANK_WEIGHT, LEAST_SCORE = 0.002, 0.006, 0.012, 0.004, 0.012
#: Vectors of a block of the dense search, and blocks of queries whose best hits a task holds at once.
BLOCK, HELD_BLOCKS = 1024, 64
#: Terms of all queries that a task holds at most; more of them are joined.
MOST_ASKED = 200_000

Tokens = Callable[[Column], Column]


def postings(corpus: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    """token, id and dl (distinct tokens of the text)."""
    tok = corpus.select("id", tokens(F.col("text")).alias("t"))
    return tok.select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("token"))


def query_tokens(queries: DataFrame, tokens: Tokens = T.tokens) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The best ids of each query with their rank; equal scores go by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _code_text(df: DataFrame) -> Column:
    return F.col("code_text" if "code_text" in df.columns else "text")


def _marked(codes: Column) -> Column:
    """Codes as terms beside tokens, which never begin with this sign."""
    return F.transform(codes, lambda c: F.concat(F.lit("="), c))


def bm25(corpus: DataFrame, queries: DataFrame, top: int = TOP, tokens: Tokens = T.tokens) -> DataFrame:
    """query_id, id, score, rank."""
    found = corpus.select("id", tokens(F.col("text")).alias("t"), _marked(K.exact_terms(_code_text(corpus))).alias("c"))
    # texts are tokenized once: the statistics read dl alone, the hits read the terms
    docs = materialised(found.select("id", F.size("t").alias("dl"), F.concat("t", "c").alias("terms")))
    stats = docs.agg(F.count("*").alias("n"), F.sum("dl").alias("total"))
    wanted = materialised(queries.select("query_id", F.explode(F.concat(tokens(F.col("text")), _marked(K.exact_terms(F.col("text"))))).alias("term")))
    is_code = F.startswith("term", F.lit("="))
    hits = docs.select("id", "dl", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.where(~is_code).groupBy("term").agg(F.count("*").alias("df"))
    weights = materialised(df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("total") / F.col("n")).alias("avgdl")))  # one row
    asked = wanted.join(weights, "term", "left").select("query_id", "term", "idf", "avgdl").limit(MOST_ASKED + 1).collect()
    once = docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()
    if len(asked) <= MOST_ASKED and once:
        return ranked(_best_of_tasks(docs, wanted, asked, top), top)
    # more terms than a task holds, or texts that share an id: every pair of a text and a query is a row
    norm = 1 + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl")))
    score = F.when(is_code, F.lit(CODE_BM25)).otherwise(F.col("idf") * (K1 + 1) / norm)
    found = hits.join(wanted, "term").join(weights, "term", "left").groupBy("query_id", "id").agg(F.round(F.sum(score), 6).alias("score"), F.count_if(~is_code).alias("n_matched"), F.count_if(is_code).alias("n_codes"))
    return ranked(found.where("n_matched >= 2 or n_codes > 0").select("query_id", "id", "score"), top)


def _best_of_tasks(docs: DataFrame, wanted: DataFrame, asked: list, top: int) -> DataFrame:
    """query_id, id and score of the best texts that each task meets. asked: all rows query_id, term, idf and avgdl."""
    names = list(dict.fromkeys(r["query_id"] for r in asked))
    place = {q: k for k, q in enumerate(names)}
    rows: dict[str, list[int]] = {}
    for r in asked:
        rows.setdefault(r["term"], []).append(place[r["query_id"]])
    terms = list(rows)
    idf = {r["term"]: r["idf"] for r in asked}
    code = np.array([t.startswith("=") for t in terms], bool)
    weight = np.array([0.0 if t.startswith("=") or idf[t] is None else idf[t] for t in terms])
    number = np.array([len(rows[t]) for t in terms], np.int64)
    of_term = np.concatenate([np.array(rows[t], np.int64) for t in terms]) if terms else np.zeros(0, np.int64)
    start, width = np.cumsum(number) - number, len(names)
    avgdl = next((r["avgdl"] for r in asked if r["avgdl"] is not None), 1.0)
    id_type, query_type = (df.schema[c].dataType for df, c in ((docs, "id"), (wanted, "query_id")))
    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = pa.array(terms, pa.string()), np.full(width, -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = after = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            first = np.searchsorted(q, np.arange(width))
            stay = np.arange(len(q)) - first[q] < top
            q, ids, scores = q[stay], ids[stay], scores[stay]
            full = np.bincount(q, minlength=width) >= top
            last = np.searchsorted(q, np.arange(width), "right") - 1
            least[full] = scores[last[full]]
            return q, ids, scores

        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK // 4 if width <= 4096 else 16):
                part = whole.slice(lo, BLOCK // 4 if width <= 4096 else 16)
                lists = part.column("terms")
                length = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found = pa.compute.fill_null(pa.compute.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), length)[found >= 0]
                found = found[found >= 0]
                # each hit becomes its text's places in the row of queries that ask for the term
                n = number[found]
                at = np.repeat(start[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(row * width, n) + of_term[at]
                coded, shape = np.repeat(code[found], n), (part.num_rows, width)
                count = lambda some: np.bincount(cell[some], minlength=shape[0] * width).reshape(shape)  # noqa: B023, E731
                words, codes = count(~coded), count(coded)
                sums = np.bincount(cell, np.repeat(weight[found], n), shape[0] * width).reshape(shape)
                norm = 1 + K1 * (1 - B + B * part.column("dl").to_numpy(zero_copy_only=False).astype(np.float64) / max(1.0, avgdl))
                scores = np.round(sums * (K1 + 1) / norm[:, None] + CODE_BM25 * codes, 6)
                row, q = np.nonzero(((words >= 2) | (codes > 0)) & (scores >= least))
                if len(row):
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    kept.append((q, ids[row], scores[row, q]))
                    held += len(row)
                if held > max(200_000, 2 * after):
                    kept[:] = [best()]
                    held = after = len(kept[0][0])
        if kept:
            q, ids, scores = best()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in q], out[0]), pa.array(ids, out[1]), pa.array(scores)], names=["query_id", "id", "score"])

    out = [to_arrow_type(query_type), to_arrow_type(id_type)]
    return docs.select("id", "dl", "terms").mapInArrow(run, schema)


def overlap(corpus: DataFrame, queries: DataFrame, top: int | None = 10, tokens: Tokens = T.tokens) -> DataFrame:
    """query_id, id, score, rank by shared tokens: coverage of the query, shared codes, shared tokens of the title, and the
    logarithm of their number. Without top: all hits with their scores not rounded, no rank."""
    has_title = "title" in corpus.columns
    body = F.concat_ws(" ", "title", "text") if has_title else F.col("text")
    codes = F.array_distinct(T.all_of(F.lower(F.col("text")), T.EXACT))
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"), F.size(tokens(F.col("text"))).alias("n_query"), codes.alias("codes"))
    title = tokens(F.col("title")) if has_title else F.array().cast("array<string>")
    marked = F.transform(tokens(body), lambda t: F.struct(t.alias("token"), F.array_contains(title, t).cast("int").alias("in_title")))
    terms = corpus.select("id", F.explode(marked).alias("x")).select("id", "x.*")
    hits = terms.join(wanted, "token")
    is_code = F.array_contains("codes", F.col("token"))
    shared = hits.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.count_if(is_code).alias("n_codes"), F.sum("in_title").alias("n_title"), F.first("n_query").alias("n_query")).where("n >= 2 or n_codes > 0")
    score = 4.0 * F.col("n") / F.col("n_query") + CODE_OVERLAP * F.col("n_codes") + 0.3 * F.col("n_title") + F.log1p(F.col("n"))
    scored = shared.select("query_id", "id", score.alias("score"))
    return ranked(scored.withColumn("score", F.round("score", 6)), top) if top else scored


def overlap_parents(corpus: DataFrame, queries: DataFrame, top: int = 5, tokens: Tokens = T.tokens) -> DataFrame:
    """Parents by overlap: query_id, parent_id, score, confidence, n_children, rank. Each further child adds 0.4, 1.2 at most."""
    hits = overlap(corpus, queries, None, tokens).join(corpus.select("id", "parent_id"), "id")
    rows = hits.groupBy("query_id", "parent_id").agg(F.max("score").alias("best"), F.count("*").alias("n_children"))
    score = F.col("best") + F.least(F.lit(1.2), 0.4 * (F.col("n_children") - 1))
    out = rows.select("query_id", "parent_id", F.round(score, 4).alias("score"), S.overlap_confidence(score).alias("confidence"), "n_children")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """ids and unit vectors (v) of BLOCK rows in one row each; vectors without length go. All vectors have one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                part = whole.slice(lo, BLOCK)
                part = part.filter(pa.compute.is_valid(part.column("v")))
                if not part.num_rows:
                    continue
                v = np.asarray(part.column("v").flatten(), np.float64).reshape(part.num_rows, -1)
                length = np.sqrt((v * v).sum(axis=1))
                some = length > 0
                ids = part.column(key).to_numpy(zero_copy_only=False)[some].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([(v[some] / length[some, None]).tobytes()], pa.binary())], names=["ids", "v"])

    return rows.select(key, "v").mapInArrow(run, "ids binary, v binary")


def dense(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, id, score, rank by cosine. vectors: id, v; queries: query_id, v (a stated set, against all rows, in blocks).

    Both sides are packed into blocks; a task multiplies blocks and keeps the best hits of each query that it meets.
    """
    q = _blocks(queries, "query_id").select(F.monotonically_increasing_id().alias("b"), F.col("ids").alias("q_ids"), F.col("v").alias("q"))
    pairs = _blocks(vectors, "id").crossJoin(q).select("b", "ids", "v", "q_ids", "q")  # blocks of a stated query set

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best columns of each row, by score and then id (rows keep an order of their own)."""
        if scores.shape[1] <= top:
            return ids, scores
        order = np.lexsort((ids, -scores), axis=1)[:, :top]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def flush(b: int) -> pa.RecordBatch:
            q_ids, ids, scores = held.pop(b)
            some = scores > 0
            row = np.repeat(q_ids, some.sum(1))
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[some]), pa.array(scores[some])], names=["query_id", "id", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.column("b")[k].as_py()
                get = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)  # noqa: B023, E731
                ids, q_ids = get("ids", np.int64), get("q_ids", np.int64)
                if not len(ids) or not len(q_ids):
                    continue
                scores = np.round(np.maximum(get("q", np.float64).reshape(len(q_ids), -1) @ get("v", np.float64).reshape(len(ids), -1).T, 0.0), 6)
                scores[q_ids[:, None] == ids[None, :]] = 0.0
                all_ids = np.broadcast_to(ids, scores.shape)
                if scores.shape[1] > 4 * top:  # narrow each row to what may be among its best
                    least = np.maximum(np.partition(scores, -top, axis=1)[:, -top], 1e-6)
                    row, col = np.nonzero(scores >= least[:, None])
                    n = np.bincount(row, minlength=len(scores))
                    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    few, few_ids = np.zeros((len(scores), max(1, n.max()))), np.full((len(scores), max(1, n.max())), -1, np.int64)
                    few[row, at], few_ids[row, at] = scores[row, col], ids[col]
                    all_ids, scores = few_ids, few
                if b in held:
                    _, old_ids, old = held[b]
                    all_ids, scores = np.concatenate([old_ids, all_ids], 1), np.concatenate([old, scores], 1)
                held[b] = (q_ids, *best(all_ids, scores))
                if len(held) > HELD_BLOCKS:
                    yield flush(next(iter(held)))
        for b in list(held):
            yield flush(b)

    return ranked(pairs.mapInArrow(run, "query_id long, id long, score double"), top)


def fused(lexical: DataFrame, vector: DataFrame, offset: int = RANK_OFFSET) -> DataFrame:
    """query_id, id, both ranks and scores, and the reciprocal-rank score of two ranked lists."""
    a = lexical.select("query_id", "id", F.col("rank").alias("lex_rank"), F.col("score").alias("lex_score"))
    b = vector.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    part = lambda c: F.coalesce(1.0 / (offset + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("rrf", F.round(part("lex_rank") + part("dense_rank"), 8))


def fused_top(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The best fused hits with their place: by score, then by lexical rank, then by dense rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.coalesce("lex_rank", F.lit(1 << 30)), "dense_rank")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def reranked(hits: DataFrame, corpus: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column], top: int = RERANKED) -> DataFrame:
    """Only the first hits, placed anew by a score of query and text (a hook: any column function)."""
    first = materialised(hits.where(F.col("place") <= top)).join(corpus.select("id", F.col("text").alias("_t")), "id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = first.withColumn("rerank", score(F.col("_q"), F.col("_t")).cast("double")).drop("_q", "_t")
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "place")
    return scored.withColumn("place", F.row_number().over(w))


def scored_parents(hits: DataFrame, corpus: DataFrame, queries: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """All parents of placed hits: score and its parts, matched children, page range, assets, over (the threshold) and
    complete (holds every code of the query over its matched children).

    corpus: id, parent_id, text; optionally code_text, page_start, page_end, asset_ids. The score is rounded before it is
    held against the threshold.
    """
    asked = queries.select("query_id", K.exact_terms(F.col("text")).alias("asked"))
    extra = [c for c in ("page_start", "page_end", "asset_ids") if c in corpus.columns]
    # the hits are few: written, they go to the texts, and codes are read of the texts that were hit alone
    held = corpus.select("id", "parent_id", _code_text(corpus).alias("_c"), *extra)
    rows = materialised(hits).join(held, "id").withColumn("held", K.exact_terms(F.col("_c"))).drop("_c").join(asked, "query_id")
    if "rerank" not in hits.columns:
        rows = rows.withColumn("rerank", F.lit(0.0))
    child = F.struct("place", "id", *(["asset_ids"] if "asset_ids" in extra else []))
    more = [F.min(c).alias(c) if c == "page_start" else F.max(c).alias(c) for c in extra if c != "asset_ids"]
    agg = rows.groupBy("query_id", "parent_id").agg(
        F.max("rrf").alias("rrf"),
        F.max("rerank").alias("rerank"),
        F.coalesce(F.max("lex_score"), F.lit(0.0)).alias("lexical"),
        F.coalesce(F.max("dense_score"), F.lit(0.0)).alias("dense"),
        F.count("*").alias("n_hits"),
        F.min("place").alias("place"),
        F.array_sort(F.collect_list(child)).alias("matched"),  # at most the hits of one query
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
        F.first("asked").alias("asked"),
        *more,
    )
    bonus = F.least(F.lit(MOST_COVERAGE), COVERAGE * (F.col("n_hits") - 1)) + F.when(F.arrays_overlap("asked", "held"), EXACT_BONUS).otherwise(0.0)
    out = agg.withColumn("score", F.round(F.col("rrf") + bonus + RERANK_WEIGHT * F.col("rerank"), 6))
    out = out.withColumn("over", F.col("score") >= least).withColumn("complete", F.size(F.array_except("asked", "held")) == 0)
    if "asset_ids" in extra:
        out = out.withColumn("asset_ids", F.array_distinct(F.flatten(F.transform("matched", lambda x: x["asset_ids"]))))
    return out.withColumn("matched", F.transform("matched", lambda x: x["id"])).drop("held", "asked")


def parents(scored: DataFrame, top: int = 5) -> DataFrame:
    """The best complete parents over the threshold with their rank; equal scores go by the place of the best child."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    return scored.where("over and complete").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("over", "complete", "place")


def explained(corpus: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, rerank: Callable[[Column, Column], Column] | None = None, top: int = 5, least: float = LEAST_SCORE, products: list[str] | None = None, datasets: list[str] | None = None) -> dict[str, DataFrame]:
    """The whole search: stages lexical, dense, rrf, rerank (where there is a reranker) and parent, and rejected queries.

    products and datasets filter the corpus before its statistics are taken (an empty list filters nothing). rejected has
    query_id, mode and the reason: no evidence over the threshold, or none with the codes of the query.
    """
    if products:
        corpus = corpus.where(F.col("product").isin(products))
    if datasets:
        corpus = corpus.where(F.col("dataset_id").isin(datasets))
    lexical = materialised(bm25(corpus, queries))
    if vectors is not None and query_vectors is not None:
        near = materialised(dense(vectors.join(corpus.select("id"), "id", "left_semi"), query_vectors))
    else:
        near = lexical.limit(0)
    hits = materialised(fused_top(fused(lexical, near)))
    final = reranked(hits, corpus, queries, rerank) if rerank else hits
    scored = materialised(scored_parents(final, corpus, queries, least))
    found = parents(scored, top)
    over = scored.where("over").groupBy("query_id").agg(F.count("*").alias("n_over"))
    reason = F.when(F.col("n_over") > 0, "codes-missing").otherwise("below-threshold")
    mode = F.lit("hybrid-rerank") if rerank else F.when(F.col("n_dense") > 0, "hybrid").otherwise("lexical-only")
    n_dense = near.groupBy("query_id").agg(F.count("*").alias("n_dense"))
    empty = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti").join(over, "query_id", "left").join(n_dense, "query_id", "left")
    stages = {"lexical": lexical, "dense": near, "rrf": hits, "parent": found, "rejected": empty.select("query_id", mode.alias("mode"), reason.alias("reason"))}
    return stages | ({"rerank": final} if rerank else {})


def evidence(found: DataFrame, corpus: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Parents as evidence rows: text of the parent's best child, page label, score, confidence."""
    first = found.withColumn("id", F.get("matched", F.lit(0)))
    rows = first.join(corpus.select("id", "title", "text"), "id")
    return rows.select("query_id", "rank", F.concat(F.lit("evidence:"), F.col("parent_id").cast("string")).alias("evidence_id"), "title", "text", "score", S.hit_confidence(F.col("score"), F.col("rerank")).alias("confidence"), F.lit(mode).alias("stage"))


def supplemented(found: DataFrame, limit: int = 5) -> DataFrame:
    """Parents and, up to the limit, their further children: query_id, place, kind, id, score.

    Children come in the order of the parents and of their match, each once; each costs a little of the score.
    """
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    children = found.select("query_id", F.col("rank").alias("parent_rank"), "score", F.posexplode("matched").alias("at", "id"))
    first = children.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("parent_rank", "at"))).where("r = 1").join(n, "query_id")
    w = Window.partitionBy("query_id").orderBy("parent_rank", "at")
    extra = first.withColumn("k", F.row_number().over(w)).where(F.col("k") + F.col("n") <= limit)
    parts = extra.select("query_id", (F.col("n") + F.col("k")).cast("int").alias("place"), F.lit("child").alias("kind"), "id", F.round(F.col("score") - 1e-6 * F.col("k"), 8).alias("score"))
    own = found.select("query_id", F.col("rank").alias("place"), F.lit("parent").alias("kind"), F.col("parent_id").alias("id"), "score").where(F.col("place") <= limit)
    return own.unionByName(parts)


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """The filtered results; for queries without any, the unfiltered ones."""
    return filtered.unionByName(unfiltered.join(filtered.select("query_id").distinct(), "query_id", "left_anti"))


def merged_lanes(texts: DataFrame, images: DataFrame, queries: DataFrame, mode: str, intent: str) -> DataFrame:
    """Text and image evidence with a lane (answer or shadow): images answer only if mode is on and the query asks to see."""
    if mode == "off":
        return texts.withColumn("lane", F.lit("answer"))
    wants = queries.select("query_id", F.coalesce(F.col("text").rlike(intent), F.lit(False)).alias("_wants"))
    lane = F.when(F.lit(mode == "on") & F.col("_wants"), "answer").otherwise("shadow")
    return texts.withColumn("lane", F.lit("answer")).unionByName(images.join(wants, "query_id").withColumn("lane", lane).drop("_wants"))


def fields_bm25(corpus: DataFrame, queries: DataFrame, fields: list[str], tokens: Tokens) -> DataFrame:
    """query_id, id and score: BM25 of each field with term frequencies, summed. tokens keeps repeated tokens.

    corpus: id and the fields; of a query's repeated token two count.
    """
    n = corpus.agg(F.count("*").alias("n"))
    rows = corpus.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields))).alias("x")).select("id", "x.field", "x.t", F.size("x.t").alias("length"))
    means = rows.groupBy("field").agg(F.avg("length").alias("mean"))
    wanted = materialised(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("asked")))
    # hits are found again rather than written: a corpus dealt by id keeps its parts up to the sums, which then move no row
    hits = rows.select("id", "field", "length", F.explode("t").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi").groupBy("id", "field", "length", "token").agg(F.count("*").alias("tf"))
    df = materialised(hits.groupBy("field", "token").agg(F.count("*").alias("df")))
    all_ = hits.join(df, ["field", "token"]).join(F.broadcast(means), "field").crossJoin(F.broadcast(n)).join(wanted, "token")  # a row a field; one row
    term = S.field_term(F.col("df"), F.col("n"), F.col("tf"), F.col("length"), F.col("mean"), F.col("asked"))
    return all_.groupBy("query_id", "id").agg(F.round(F.sum(term), 6).alias("score"))


def proximity(positions: DataFrame, window: int, weight: float) -> DataFrame:
    """query_id, id and bonus: most distinct terms in a window of positions, then the least span; two terms at least.

    positions: query_id, id, pos, term (each place of a meaningful query term). A window ends at a term's place; the latest
    place of each term within it gives the span.
    """
    w = Window.partitionBy("query_id", "id").orderBy("pos").rangeBetween(-window, 0)
    seen = positions.withColumn("n", F.size(F.collect_set("term").over(w))).withColumn("first", F.min("pos").over(w))
    best = seen.groupBy("query_id", "id").agg(F.max(F.struct("n", (F.col("first") - F.col("pos")).alias("minus_span"))).alias("x")).where("x.n >= 2")
    closeness = F.greatest(F.lit(0.0), (window + 1 + F.col("x.minus_span")) / (window + 1))
    return best.select("query_id", "id", F.round(weight * (F.col("x.n") + 1.5 * closeness), 6).alias("bonus"))


def code_gate(hits: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (query_id, id) whose text has every code of the query; queries without codes pass."""
    asked = queries.select("query_id", K.exact_terms(F.col("text")).alias("asked"))
    # the hits are few: written, they go to the texts, and codes are read of the texts that were hit alone
    held = corpus.select("id", _code_text(corpus).alias("_c"))
    rows = materialised(hits).join(held, "id").withColumn("held", K.exact_terms(F.col("_c"))).drop("_c")
    return rows.join(asked, "query_id").where(F.size(F.array_except("asked", "held")) == 0).drop("asked", "held")
