"""The numbered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.centroids import centroid_digest
from brindle.llm.common import table
from brindle.llm.fingerprint import fingerprint_digest
from brindle.llm.html_text import html_digest
from brindle.llm.line_dedup import line_dedup_digest
from brindle.llm.mil_quality import quality_digest
from brindle.llm.near_dedup import near_duplicate_classes
from brindle.llm.packing import pack_documents
from brindle.llm.pieces import piece_digest
from brindle.llm.pii import pii_digest
from brindle.llm.quality_rules import rules_digest
from brindle.llm.ranked import ranked_digest
from brindle.llm.shards import shard_documents
from brindle.llm.warc import warc_digest


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text. Null text: none; repeated rows: a row each; spans of one kind do not overlap; empty table: no rows."""
    return pii_digest(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text and what they decode to. Null text: empty; repeated rows: a row each; other columns are not read."""
    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every text. Null or blank text: scored as learned; null doc_id: not held out; repeated rows: equal scores; no labels: 0.5."""
    return quality_digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and slot for every document. Null text: size 1; null lang or source: a value of its own; repeated rows: slots of their own."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text. Null text: no lines; blank lines stay; repeated rows: each comes back; ties go to the least document and line."""
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. Null text: empty; null doc_id: first; equal doc_ids: by text; one document: its own next."""
    return fingerprint_digest(table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text. Null text: no words, fails; repeated rows: a row each."""
    return rules_digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every piece. Null text: the closing id alone; repeated rows: packed each; equal pieces: in the order of their columns."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null html: empty; null url: a host of its own; equal pages count once; repeated rows: a row each."""
    return html_digest(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every document. Null text: empty; no words: alike only to equal texts; null doc_id: takes part; repeated rows: copies of each other."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back. Null html: an empty payload; null page_id: before all others; repeated rows: the first is the response."""
    return warc_digest(table(spark, sf_dir, "pages"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every item. Null text: no terms; repeated rows: a document each; rows of one item_id: one item; ties: least doc_id, null last."""
    return ranked_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster for every usable vector. Null, short, long or non-finite vectors: no row; repeated rows: a vector each; empty table: no rows."""
    return centroid_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_pieces, op3_quality, op4_shards, op5_line_dedup, op6_fingerprints, op7_rules, op8_packing, op9_html, op10_near_dedup, op11_warc, op12_ranked, op13_centroids)}
