"""Versions of a corpus: differences of manifests, visibility, checksums, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """id and action (add, update, reuse, delete) between two manifests (id, digest)."""
    both = previous.select("id", F.col("digest").alias("old")).join(current.select("id", F.col("digest").alias("new")), "id", "full_outer")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "reuse").otherwise("update")
    return both.select("id", action.alias("action"))


def visible(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children whose document is enabled and has published their version. documents: document_id, enabled, published."""
    return children.join(documents.where("enabled").select("document_id", F.col("published").alias("version")), ["document_id", "version"], "left_semi")


def replaced(published: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Candidate rows, and the published rows of keys that the candidate does not have."""
    return published.join(candidate.select(key).distinct(), key, "left_anti").unionByName(candidate)


def stride_chunks(docs: DataFrame, size: int = 520, overlap: int = 70) -> DataFrame:
    """id, chunk, start and text of windows of fixed size and overlap over whole texts."""
    last = F.greatest(F.lit(0), F.length("text") - overlap - 1)
    starts = F.posexplode(F.sequence(F.lit(0), last.cast("int"), F.lit(size - overlap)))
    return docs.where("length(text) > 0").select("id", "text", starts.alias("chunk", "start")).select("id", "chunk", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("piece"))
