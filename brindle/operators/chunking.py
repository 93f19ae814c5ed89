"""Documents as blocks, sections and pieces.

Odd input: a null or blank text has no blocks, and one section with the document's title and no text; line ends of all kinds
count; very long texts are cut in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Characters of a piece and of what it shares with the next, and signs after which a piece may end early.
SIZE, OVERLAP, ENDS = 520, 70, "。\n"
_EDGE = "\x01"


def blocks(text: Column, markdown: bool = True) -> Column:
    """Blocks of a text (structs kind, text, level): headings (markdown), list items, paragraphs between blank lines.

    One pass of patterns: lines are trimmed, headings and list items are fenced, blank lines become fences.
    """
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    trimmed = F.regexp_replace(unix, r"(?m)^[ \t]+|[ \t]+$", "")
    own = r"(?m)^(#{1,6}[ \t]+.+|[-*] .*)$" if markdown else r"(?m)^([-*] .*)$"
    parts = F.split(F.regexp_replace(F.regexp_replace(trimmed, own, f"{_EDGE}$1{_EDGE}"), r"\n{2,}", _EDGE), f"\n*{_EDGE}[\n{_EDGE}]*")

    def block(x: Column) -> Column:
        heading = x.rlike(r"^#{1,6}[ \t]+[^\n]+$") if markdown else F.lit(False)
        listed = x.rlike(r"^[-*] ")
        kind = F.when(heading, "heading").when(listed, "list").otherwise("paragraph")
        body = F.when(heading, F.regexp_replace(x, r"^#{1,6}[ \t]+", "")).when(listed, F.substr(x, F.lit(3))).otherwise(x)
        level = F.when(heading, F.length(F.regexp_extract(x, "^#{1,6}", 0)))
        return F.struct(kind.alias("kind"), F.btrim(body, F.lit(" \t\n")).alias("text"), level.alias("level"))

    return F.transform(F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit("\n"))), lambda x: x != ""), block)


def sections(docs: DataFrame, found: Column) -> DataFrame:
    """id, section (from 0), title, text of documents (id, title, and found: an array of blocks).

    A heading after other blocks starts a section, a further heading right after it renames it. A section without blocks goes,
    unless it is the only one.
    """
    rows = docs.select("id", F.col("title").alias("_title"), F.posexplode_outer(found).alias("pos", "b"))
    by_doc = Window.partitionBy("id").orderBy("pos")
    heading = F.col("b.kind") == "heading"
    starts = heading & (F.lag(heading).over(by_doc) == False)  # noqa: E712
    numbered = rows.withColumn("s", F.sum(F.when(starts, 1).otherwise(0)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_sort(F.collect_list(F.when(~heading & (F.col("b.text") != ""), F.struct("pos", "b.text"))))
    made = numbered.groupBy("id", "s").agg(F.max_by("b.text", F.when(heading, F.col("pos"))).alias("t"), F.count_if(F.col("b").isNotNull() & ~heading).alias("n"), body.alias("body"), F.first("_title").alias("_title"))
    only = F.count("*").over(Window.partitionBy("id")) == 1
    kept = made.withColumn("only", only).where((F.col("n") > 0) | F.col("only"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("s")) - 1
    title = F.coalesce("t", "_title")
    text = F.btrim(F.array_join(F.transform("body", lambda x: x["text"]), "\n"))
    return kept.select("id", place.alias("section"), title.alias("title"), F.when(text == "", title).otherwise(text).alias("text"))


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of a text: a window ends after its last full stop or line end where that lies beyond its middle."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        end = min(len(text), start + size)
        last = max(text.rfind(c, start, end) for c in ENDS)
        if last > start + size // 2:
            end = last + 1
        out.append(text[start:end].strip())
        if end >= len(text):
            return [p for p in out if p]
        start = max(start + 1, end - overlap)


def soft_pieces(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """id, place and piece of whole texts (id, text), cut at soft boundaries; in Arrow batches, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = cut(text or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[k].as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["id", "place", "piece"])

    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, place int, piece string")


#: Terms that name a product class, in their order.
PRODUCTS = {"washing-machine": ["洗衣机", "e03", "排水"], "air-purifier": ["空气净化器", "滤网", "净化器"], "fitness-tracker": ["手环", "健身追踪器", "表带"]}


def product_class(text: Column, terms: dict[str, list[str]] = PRODUCTS) -> Column:
    """The first class one of whose terms stands in the text; null for none."""
    out = None
    for name, words in terms.items():
        out = F.when(T.any_term(text, words), name) if out is None else out.when(T.any_term(text, words), name)
    return out


def chunks(parts: DataFrame, profile: str, products: dict[str, list[str]] = PRODUCTS) -> DataFrame:
    """Children of sections (id, section, title, text) by profile: table, qa, or windows for general, manual and picture.

    Returns id, section, place, title, piece, normalized, keywords, product.
    """
    if profile not in {"general", "manual", "qa", "table", "picture"}:
        raise ValueError(f"unknown profile: {profile}")
    # the class is that of the whole section: found once, not for each of its pieces
    parts = parts.select("id", "section", "title", "text", product_class(F.concat_ws(" ", "title", "text"), products).alias("product"))
    if profile in ("table", "qa"):
        found = T.table_pieces(F.col("text")) if profile == "table" else T.question_pieces(F.col("text"))
        short = parts.withColumn("_p", found)
        done = short.where(F.size("_p") > (1 if profile == "table" else 0))
        rows = done.select("id", "section", "title", "product", F.posexplode("_p").alias("place", "piece"))
        # a table of one line is cut into windows
        rest = short.where(F.size("_p") <= 1).drop("_p") if profile == "table" else None
        rows = rows.unionByName(_windows(rest)) if rest is not None else rows
    else:
        rows = _windows(parts)
    whole = F.concat_ws(" ", "title", "piece")
    return rows.select("id", "section", "place", "title", "piece", F.btrim(F.regexp_replace(F.lower("piece"), r"\s+", " ")).alias("normalized"), T.keywords(whole, profile == "manual").alias("keywords"), "product")


def _windows(parts: DataFrame) -> DataFrame:
    """Sections cut into windows, with their columns but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut(t or "") for t in batch.column("text").to_pylist()]
            at = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            place, piece = pa.array([p for f in found for p in range(len(f))], pa.int32()), pa.array([p for f in found for p in f], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), place, piece], names=[*kept, "place", "piece"])

    kept = ["id", "section", "title", "product"]
    rows = parts.select(*kept, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.mapInArrow(run, f"{kinds}, place int, piece string")
