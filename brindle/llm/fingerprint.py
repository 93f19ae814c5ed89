"""Context-triggered piecewise hashing: a rolling hash cuts chunks, each chunk gives one character of a signature.

A fingerprint is "block:signature:signature at twice the block". Two of them are compared, where their block sizes are
equal or one is twice the other, by the edit distance of the signatures of the same block size.

Rules for odd input: a null or empty text has the fingerprint "3::"; two such are alike by 1, one such and another text by
0; documents of equal doc_id follow each other by text, those without doc_id come first; repeated rows each get a result;
with a single document, the next one is itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import whole_text

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes in the rolling window, least block size, chunks wanted (at twice that the block size is doubled).
WINDOW, LEAST_BLOCK, CHUNKS = 7, 3, 64
#: Signatures must share this many letters in a row, else they are not alike; short ones must share all they have.
SHARED = 4
#: Rows that a range of doc_ids holds, about.
ROWS_A_RANGE = 4000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            m = 1 << (n + 1).bit_length()
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, b)]), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))
        return cls.up, cls.down


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: plain sum, weighted sum and shifted exclusive or of the last seven bytes."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = wide[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += part * np.uint32(1 + WINDOW - back)
        mixed ^= part << np.uint32(5 * back)
    return total + mixed


def _signature(ends: np.ndarray, sums: np.ndarray, n: int) -> str:
    """One letter for each chunk; ends are the places after each chunk. Over three equal letters in a row count as three."""
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    _, down = _Powers.upto(n)
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    letters = (h >> np.uint64(58)).astype(np.uint8)
    if len(letters) > 3:
        same = np.ones(len(letters), bool)
        same[:3] = False
        for k in (1, 2, 3):
            same[3:] &= letters[3:] == letters[3 - k : len(letters) - k]
        letters = letters[~same]
    return "".join(LETTERS[i] for i in letters)


def fingerprint(text: str | bytes) -> str:
    """The fingerprint of a whole text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    n = len(raw)
    if not n:
        return f"{LEAST_BLOCK}::"
    data = np.frombuffer(raw, np.uint8)
    roll = _rolling(data)
    up, _ = _Powers.upto(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    block = LEAST_BLOCK
    while block * CHUNKS < n:
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
        if len(ends) <= 2 * CHUNKS:
            break
        block *= 2
    wider = ends[roll[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(ends, sums, n)}:{_signature(wider, sums, n)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rest = every = (1 << len(a)) - 1
    for c in b:
        hit = rest & places.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & every
    return len(a) - rest.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    n = min(SHARED, len(a), len(b))
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    if not any(b[i : i + n] in grams for i in range(len(b) - n + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * _common(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: how alike two fingerprints are; 0 if their block sizes are not compatible."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    if x == y:
        return max(_alike(x1, y1), _alike(x2, y2)) if x1 and y1 else 0.0
    if int(x) == 2 * int(y):
        return _alike(x1, y2)
    return _alike(x2, y1) if int(y) == 2 * int(x) else 0.0


_FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _by_range(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows dealt out by ranges of doc_id, each range with the next range's first rows as guards at its end.

    The bounds are doc_ids that occur, so a row that equals a bound is the first of its range and the guard of the range
    before (of the last range, for the very first row). Only the bounds, one per range, come to the driver.
    """
    n = docs.count()
    ranges = max(1, min(100_000, -(-n // ROWS_A_RANGE)))
    marks = [k / ranges for k in range(ranges)]
    low, found = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", marks, min(1_000_000, 100 * ranges))).first()
    bounds = sorted({low, *found}) if low is not None else []
    k = max(1, len(bounds))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range's number, and one more at its first doc_id; -1 without doc_id."""
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy(np.int64)
        r = np.maximum(np.searchsorted(edges, values, side="right") - 1, 0)
        return pd.Series(np.where(known, 2 * r + (edges[r] == values), -1))

    placed = docs.withColumn("_p", place("doc_id"))
    here = F.greatest(F.shiftright("_p", 1), F.lit(0)).cast("int")
    guard = F.when(F.col("_p").isin(-1, 1), F.lit(k - 1)).when(F.col("_p") % 2 == 1, here - 1)
    row = F.struct(here.alias("r"), F.lit(0).alias("g"))
    both = F.when(guard.isNotNull(), F.array(row, F.struct(guard.alias("r"), F.lit(1).alias("g")))).otherwise(F.array(row))
    return placed.select("doc_id", "text", F.explode(both).alias("_x")).select("doc_id", "text", F.col("_x.r").cast("int").alias("_r"), F.col("_x.g").alias("_g")), k


def fingerprint_digest(df: DataFrame) -> DataFrame:
    """The fingerprint of each text, of its edited form, and how near the text is to that and to the next document.

    One shuffle of the texts, by range of doc_id; each task then reads its sorted rows as a stream, two at a time.
    """
    docs = df.select("doc_id", whole_text().alias("text"))
    dealt, ranges = _by_range(docs)
    rows = dealt.repartitionById(ranges, F.col("_r")).sortWithinPartitions(F.col("_r"), F.col("_g"), F.col("doc_id").asc_nulls_first(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, done = None, False  # the row that waits for its next one
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                out: list[tuple] = []
                for doc, text, is_guard in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("_g").to_pylist(), strict=True):
                    if done:
                        break
                    if before is not None and before[1] == text:
                        mark = before[2]
                    else:
                        mark = fingerprint(text)
                    if before is not None:
                        out.append(_row(before, text, mark))
                    before, done = (doc, text, mark), bool(is_guard)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(row: tuple, next_text: str, next_mark: str) -> tuple:
    doc, text, mark = row
    n = len(text)
    edited = (text[: n - n // 2] + next_text[: n // 2]).encode("utf-8", "surrogatepass")
    other = fingerprint(edited)
    return doc, n, hashlib.sha256(edited).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)
