"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, PII, best-fit packing.

Each stage takes what the stage before it kept and returns the columns of documents; the last returns packed pieces. Stages keep
rows with null columns, empty and very long texts and repeated rows, but for what each says below; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import table, written
from brindle.llm.line_dedup import dedup_lines
from brindle.llm.mil_quality import keep_good
from brindle.llm.near_dedup import keep_one
from brindle.llm.packing import pack_documents
from brindle.llm.pii import redact
from brindle.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score below 0.5); without labels all stay. Repeated rows go or stay together."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines only the earliest stays; a document whose lines all go has an empty text, a null text stays null."""
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id (null last), then by hashes of text and row."""
    return keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; of overlapping spans the first; a null text stays null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece with its place."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("private", private), ("packing", packing)]
#: No stage but PII is a SQL expression; the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
