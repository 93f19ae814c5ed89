"""Files as tables: kinds by content, checked uploads, a store by digest, tables of questions, event lines.

PDF and DOCX content becomes blocks in sources.office; picture content is kept as bytes.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Kinds of files by extension, and the most bytes of an upload.
KINDS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain", "md": "text/markdown"}
MOST_BYTES = 50 * 1024 * 1024


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./]+)$", 1))


def sniffed(name: Column, content: Column) -> Column:
    """The kind of a file by its first bytes, and for texts by their encoding; null where it is none of the known ones."""
    first = lambda n: F.hex(F.substring(content, 1, n))
    ext = extension(name)
    text = F.is_valid_utf8(content.cast("string")) & (F.locate("\x00", content.cast("string")) == 0)
    return (
        F.when(first(5) == "255044462D", KINDS["pdf"])
        .when((first(4) == "504B0304") & (ext == "docx"), KINDS["docx"])
        .when(first(8) == "89504E470D0A1A0A", KINDS["png"])
        .when(first(3) == "FFD8FF", KINDS["jpg"])
        .when((ext == "md") & text, KINDS["md"])
        .when((ext == "txt") & text, KINDS["txt"])
    )


def refusal(name: Column, declared: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """Why an upload is refused (empty, too-large, extension, content, mismatch); null where it is taken."""
    kind, ext = sniffed(name, content), extension(name)
    by_ext = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), ext)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(F.octet_length(content) > most, "too-large")
        .when(by_ext.isNull(), "extension")
        .when(kind.isNull() | (kind != by_ext), "content")
        .when(declared.isNotNull() & (declared != "") & (declared != kind), "mismatch")
    )


def stored(files: DataFrame) -> DataFrame:
    """Files (name, content) once per content: digest, place (first two digits, digest, extension), name, kind, n_bytes.

    Of files with the same content the least name stays.
    """
    rows = files.select("name", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("n_bytes"), sniffed(F.col("name"), F.col("content")).alias("kind"))
    one = rows.groupBy("digest").agg(F.min(F.struct("name", "kind", "n_bytes")).alias("x"))
    place = F.concat(F.substring("digest", 1, 2), F.lit("/"), F.col("digest"), F.lit("."), extension(F.col("x.name")))
    return one.select("digest", place.alias("place"), "x.name", "x.kind", "x.n_bytes")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name and content of all files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, title (stem) and text of text files, by their content; files of other kinds go."""
    files = read_files(spark, path).withColumn("kind", sniffed(F.col("name"), F.col("content")))
    rows = files.where(F.col("kind").isin(KINDS["txt"], KINDS["md"]))
    return rows.select("name", F.regexp_replace("name", r"(.)\.[^.]+$", "$1").alias("title"), (F.col("kind") == KINDS["md"]).alias("markdown"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id and question of question tables: UTF-8, or GB18030 where a file is not valid UTF-8. Each file is parsed by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                try:
                    text = content.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = content.decode("gb18030")
                rows = list(csv.DictReader(io.StringIO(text, newline="")))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string()) for c in ("id", "question")], names=["id", "question"])

    return read_files(spark, path).select("content").mapInArrow(run, "id string, question string")


def write_submission(rows: DataFrame, path: str) -> None:
    """id and ret in the order of pos, in one file: the result of one question set."""
    rows.orderBy("pos").select("id", "ret").coalesce(1).write.option("header", True).option("escape", '"').csv(path)


def imported(sections: DataFrame, chunks: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, children and assets of an exported corpus; ids are digests of what they stand for, so a second import is the same.

    sections: product, section, title, text; chunks: product, section, place, text; captions: product, section, file, caption.
    """
    key = lambda *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 24)
    parents = sections.select(key("product", "section").alias("parent_id"), "product", "title", "text")
    children = chunks.select(key("product", "section", "place").alias("child_id"), key("product", "section").alias("parent_id"), "text").join(parents.select("parent_id"), "parent_id", "left_semi")
    assets = captions.select(key("product", "file").alias("asset_id"), key("product", "section").alias("parent_id"), "file", T.preview(F.col("caption"), 200).alias("caption")).dropDuplicates(["asset_id"])
    return parents, children, assets


def event_lines(events: DataFrame) -> DataFrame:
    """Events (request_id, at, event_id, type, payload) as numbered JSON lines; the last of a request is marked terminal."""
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("at", "event_id")
    last = F.lead("event_id").over(w).isNull()
    rows = events.select("request_id", F.row_number().over(w).alias("sequence"), "type", "payload", last.alias("terminal"))
    return rows.select("request_id", "sequence", F.to_json(F.struct("sequence", "type", "payload", "terminal")).alias("value"))


def decoded_events(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of server-sent lines (value): those that begin with 'data:', without the end mark; malformed ones are null rows."""
    body = F.btrim(F.regexp_replace("value", "^data:", ""))
    return lines.where("value like 'data:%'").where(body != "[DONE]").select(F.from_json(body, schema).alias("event"))
