"""From files to a searchable corpus: jobs, embedding of what has no vector yet, assembly of queries, search over what is visible."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import lifecycle as L
from brindle.operators import search as S

#: Texts that an embedding hook gets at once.
BATCH = 10


def config_hash(*parts: Column) -> Column:
    """What tells one way of parsing from another."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def new_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Wanted parse jobs (document_id, config_hash) that no queued, running or finished job does already."""
    live = jobs.where(F.col("state").isin("queued", "running", "succeeded")).select("document_id", "config_hash").distinct()
    return wanted.select("document_id", "config_hash").distinct().join(live, ["document_id", "config_hash"], "left_anti").withColumn("state", F.lit("queued"))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """id and v of rows (id, text, v): vectors there are stay, the others come from the hook, batch by batch.

    A batch whose answer has another number of vectors fails the job, so no row gets another row's vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                found = embed([t or "" for t in part.column("text").to_pylist()])
                if len(found) != part.num_rows:
                    raise ValueError(f"embedding count mismatch: {len(found)} of {part.num_rows}")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(pa.float64()))], names=["id", "v"])

    missing = rows.where("v is null").select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, v array<double>")
    return rows.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).unionByName(missing)


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: how many sources of an incremental plan (id, action) are added, updated, deleted and used again."""
    return plan.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("add", "update", "delete", "reuse")))


def import_report(matches: DataFrame, fallbacks: DataFrame, malformed: DataFrame) -> DataFrame:
    """One row of counts of a description import: by strategy, malformed lines, fallbacks, and rows made."""
    by = lambda s: F.count_if(F.col("strategy") == s)
    a = matches.agg((F.count("*")).alias("parsed"), by("sha256").alias("matched_sha256"), by("stem").alias("matched_stem"), by("ambiguous").alias("ambiguous"), by("unmatched").alias("unmatched"))
    b, c = fallbacks.agg(F.count("*").alias("fallback")), malformed.agg(F.count("*").alias("malformed"))
    return a.crossJoin(b).crossJoin(c).withColumn("total", F.col("parsed") + F.col("malformed")).withColumn("imported", F.col("matched_sha256") + F.col("matched_stem") + F.col("fallback")).drop("parsed")  # one row each


def assembled(question: Column, products: Column, expansion: Column) -> Column:
    """The text to search for: the question without remembered lines, its products and its expansion, each once, one a line."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(T.lines_before(question, "memory:")), products, F.array(expansion)), lambda x: x.isNotNull() & (F.btrim(x) != ""))), "\n")


def visible_search(children: DataFrame, documents: DataFrame, queries: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """Search over the children of published versions only."""
    return S.explained(L.visible(children, documents), queries, top=top)


def image_search(images: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, top: int = 5) -> DataFrame:
    """query_id, id, score, place of pictures (id, text): two shared tokens at least, codes give no exception, no parents.

    The score is that of the fused ranks.
    """
    lexical = S.bm25(images.withColumn("code_text", F.lit("")), queries)
    near = S.dense(vectors, query_vectors) if vectors is not None and query_vectors is not None else lexical.limit(0)
    hits = S.fused_top(S.fused(lexical, near))
    return hits.where(F.col("place") <= top).select("query_id", "id", F.round("rrf", 6).alias("score"), "place")


def token_pieces(tokens: Column, size: int = 512, overlap: float = 0.1) -> Column:
    """Windows of so many tokens; each shares a part with the next."""
    step = max(1, size - int(size * overlap))
    last = F.greatest(F.lit(0), F.size(tokens) - 1 - (size - step))
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.slice(tokens, i + 1, F.lit(size)))


def ledger(citations: Column, most: int = 20) -> Column:
    """Citations for a ledger: the first ones, without text and scores."""
    return F.transform(F.slice(citations, 1, most), lambda x: x.dropFields("text", "score"))


def direction(text: Column) -> Column:
    """rtl where the first letter of a text is Hebrew or Arabic, ltr where it is another letter, null without letters."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"\p{L}", 0)
    return F.when(first.rlike(r"[\u0590-\u07ff\ufb1d-\ufdff\ufe70-\ufefc]"), "rtl").when(first != "", "ltr")
