"""Line dedup by a deletion-neighbourhood join: near-equal lines of the whole corpus are found, the earliest is kept.

Two lines are near-equal if they are equal without outer blanks, or if both have LEAST_CHARS code points or more and one
edit (replace, insert, delete) turns one into the other. Lines are ordered by document and line number. A line goes if a
near-equal line stands before it; the others stay.

1. Keys of all lines are written once; equal lines meet by one aggregation on the key, which keeps the earliest place.
2. One edit leaves the first or the second half of a line as it is. Lines that share no half with another are done; for
   texts that leaves about one line in fifty.
3. The rest emit all variants with one deletion, as hashed keys with the place of the deletion. Lines that agree in
   variant and place differ by one replacement; a line whose own key is a variant of another differs by one insertion.
   In each group only the earliest is linked to the others, never all pairs, and each link's edit distance is verified.

Rules for odd input: a null text has no lines and stays null; blank lines always stay; repeated rows (equal doc_id and
text) are one document for the comparison, and each comes back; a document whose lines all go has an empty text; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, spare, written

#: Lines from this many code points on may differ by one edit.
LEAST_CHARS = 16
#: Most candidates that are sent to every task (8 MB), and variants of an Arrow batch.
BROADCAST_KEYS, BATCH_ROWS = 1_000_000, 1 << 16
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


#: Only documents of one doc_id (or none) are told apart by a hash of the text; 40 bits of it do, and shuffle less.
TEXT_SHIFT = 24
#: Stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 63)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """key (two hashes), at and line (trimmed) of every line. docs: _doc, _text, text.

    A blank line's key is its place, so it equals no other line.
    """
    parts = docs.select("_doc", "_text", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    line = F.btrim(F.col("raw"), F.lit(SPACE_CHARS))
    same = F.when(line == "", F.concat_ws(":", F.lit("\n"), "_doc", "_text", "no")).otherwise(line)
    key = F.struct(F.xxhash64(same).alias("a"), F.xxhash64(F.lit(1), same).alias("b"))
    return parts.select(key.alias("key"), F.struct(F.col("_doc").alias("doc"), F.col("_text").alias("text"), "no").alias("at"), line.alias("line"))


def halves(line: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Keys of the halves that one edit may leave, for lines of n code points and partners of n - 1, n and n + 1."""
    n = F.length(line)
    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    front = lambda k: F.xxhash64(F.lit("front"), k, F.substring(line, F.lit(1), k))
    back = lambda k: F.xxhash64(F.lit("back"), k, F.substr(line, n - k + 1, k))
    keys = F.array_distinct(F.array(front(h), front(g), back(n - h), back(n - 1 - g)))
    return F.when(n >= least_chars, keys).otherwise(F.array().cast("array<bigint>"))


def candidates(keys: DataFrame) -> DataFrame:
    """Keys (their first hash) of the lines that share a half with another line. keys: key, halves."""
    h = keys.select(F.col("key.a").alias("a"), F.explode("halves").alias("half"))
    shared = h.groupBy("half").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("half")
    return h.join(shared, "half", "left_semi").select("a").distinct()


def candidate_lines(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Earliest place and form of each distinct line that shares a half with another, written.

    The candidates are broadcast up to BROADCAST_KEYS, beyond that the lines are shuffled to them.
    """
    some = written(candidates(keys))
    if some.count() <= BROADCAST_KEYS:
        some = F.broadcast(some)
    lines = keyed_lines(docs).join(some, F.col("key.a") == F.col("a"), "left_semi")
    return written(lines.groupBy("key").agg(F.min(F.struct("at", "line")).alias("x")).select("x.at", "x.line"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def variant_keys(line: str, powers: np.ndarray) -> tuple[int, np.ndarray]:
    """The line's own key and those of its variants with the code point at each place deleted, in linear time."""
    codes = _mix(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(codes)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:n], dtype=np.uint64)])
    shifted = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[1:] * powers[: n - 1], dtype=np.uint64)])
    whole = _mix(before[n : n + 1] + np.array([n], np.uint64) * _MULTIPLIER)[0]
    return int(whole.view(np.int64)), _mix(before[:n] + shifted[n - 1] - shifted + np.array([n - 1], np.uint64) * _MULTIPLIER).view(np.int64)


def variants(lines: DataFrame) -> DataFrame:
    """All keys of each line; place -1 is the whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << 12, _MULTIPLIER)]), dtype=np.uint64)
        held: list[tuple[np.ndarray, np.ndarray, tuple]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = [len(k) for k, _, _ in held]
            place = [pa.array(np.repeat(np.array([at[c] for _, _, at in held], np.int64), n), t) for c, t in (("doc", pa.int64()), ("text", pa.int64()), ("no", pa.int32()))]
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in held])), pa.array(np.concatenate([p for _, p, _ in held])), *place], names=["variant", "place", "doc", "text", "no"])
            held.clear()
            return out

        for batch in batches:
            for at, line in zip(batch.column("at").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if len(line) >= len(powers):
                    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(line), _MULTIPLIER)]), dtype=np.uint64)
                own, keys = variant_keys(line, powers)
                held.append((np.append(keys, own), np.append(np.arange(len(keys)), -1).astype(np.int32), at))
                size += len(keys) + 1
                if size >= BATCH_ROWS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = lines.select("at", "line").mapInArrow(run, "variant long, place int, doc long, text long, no int")
    return rows.select("variant", "place", F.struct("doc", "text", "no").alias("at"))


def earlier_links(v: DataFrame) -> DataFrame:
    """at and other: for each line the earliest lines that it meets, if they stand before it.

    A group of one variant and place holds lines that differ in one code point, so at most one line for each; the whole
    and the shortened lines of one variant differ by an insertion. Both windows share one shuffle by variant.
    """
    same = Window.partitionBy("variant")
    met = (
        v.withColumn("whole", F.min(F.when(F.col("place") < 0, F.col("at"))).over(same))
        .withColumn("short", F.min(F.when(F.col("place") >= 0, F.col("at"))).over(same))
        .withColumn("first", F.min("at").over(Window.partitionBy("variant", "place")))
    )
    other = F.array(F.when(F.col("place") >= 0, F.col("first")), F.when(F.col("place") < 0, F.col("short")).otherwise(F.col("whole")))
    return met.select("at", F.explode(other).alias("other")).where("other is not null and other < at").distinct()


def dropped_lines(some: DataFrame) -> DataFrame:
    """Places of the distinct lines that have a near-equal, not equal, line before them. some: at, line of the candidates."""
    pairs = earlier_links(variants(some)).join(some, "at").join(some.select(F.col("at").alias("other"), F.col("line").alias("other_line")), "other")
    return pairs.where(F.levenshtein("line", "other_line", 1).between(0, 1)).select("at").distinct()


def kept_places(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """_doc, _text and the numbers of the kept lines of each distinct document that keeps any. docs: _doc, _text, text.

    Keys, halves and places of all lines are written once; of the lines' texts only the candidates' are shuffled.
    """
    keys = written(keyed_lines(docs).select("key", "at", halves(F.col("line"), least_chars).alias("halves")))
    first = keys.groupBy("key").agg(F.min("at").alias("at")).select("at.*", F.lit(False).alias("gone"))
    rows = first.unionByName(dropped_lines(candidate_lines(docs, keys)).select("at.*", F.lit(True).alias("gone")))
    stays = rows.groupBy("doc", "text", "no").agg(F.max("gone").alias("gone")).where("not gone")
    return stays.groupBy(F.col("doc").alias("_doc"), F.col("text").alias("_text")).agg(F.sort_array(F.collect_list("no")).alias("_kept"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The same columns, with the kept lines of each text; also n_chars, where there is such a column.

    least_chars: shorter lines go only where they are equal. One edit of a short word makes another word, so the bound is part
    of what counts as near-equal; a larger edit distance is not sought.
    """
    body, doc, same, kept = F.col(f"`{text}`"), spare(df, "line_doc"), spare(df, "line_text"), spare(df, "line_kept")
    keyed = df.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias(doc), F.shiftrightunsigned(F.xxhash64(body), TEXT_SHIFT).alias(same))
    docs = keyed.where(body.isNotNull()).select(F.col(doc).alias("_doc"), F.col(same).alias("_text"), body.alias("text"))
    out = keyed.join(kept_places(docs, least_chars).toDF(doc, same, kept), [doc, same], "left")
    # the lines are bound once, as a lambda's variable, and then picked by number
    picked = F.transform(F.array(F.split(body, "\n", -1)), lambda lines: F.transform(F.col(kept), lambda i: F.get(lines, i)))[0]
    new = F.when(F.col(kept).isNotNull(), F.array_join(picked, "\n")).when(body.isNotNull(), F.lit(""))
    return out.select(*(new.alias(c) if c == text else F.length(new).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in df.columns))


def line_dedup_digest(df: DataFrame) -> DataFrame:
    """doc_id, lines and code points kept, and the digest of the kept text."""
    kept = dedup_lines(df.select("doc_id", "text"))
    return kept.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines_kept"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
