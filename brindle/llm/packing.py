"""Packing of tokenized documents into sequences: bounded-space online best-fit.

Each task keeps a fixed number of open bins, listed by free space, and a bitset of the free spaces that occur. A piece
goes into the open bin with the least space that holds it; if none does, a new bin opens, and where too many are open the
fullest closes first. Only documents longer than a sequence are cut.

Rules for odd input: a null text counts as empty, which is the one closing id; repeated rows are packed each on their
own; the order of equal pieces within a task is by their columns, so a task that runs again gives the same bins; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_CHARS, slices_of_bytes, written

#: Tokens in a sequence, open bins of a task, and pieces that a task packs (fewer bins stay half empty with more pieces).
SEQUENCE, OPEN_BINS, PIECES_A_TASK = 2048, 2048, 20_000
#: Bytes of text encoded at once in a task (a longer text stands alone), and of a window of a text with odd characters.
CHUNK_BYTES, WINDOW_BYTES = 1 << 21, 1 << 16
#: Longer words, in bytes, go to the tokenizer itself.
LONGEST_MERGED = 64
#: The id that closes each document.
CLOSING = (0).to_bytes(4, "little")

#: Characters whose class no Unicode version or normal form changes: ASCII, Latin letters that one lower-case letter stands
#: for, and punctuation that is neither white space nor a number.
_ODD = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u00a1\u00bf\u00ab\u00bb\u2010-\u2027]|<\\|")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[0xC3:0xC6] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_NONE = np.int32(1 << 30)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def word_starts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in lower-case bytes, and which bytes belong to words.

    Words are runs of letters, single digits, runs of other signs, and 's 't 'm 'd 're 've 'll where an apostrophe begins a
    run: the vocabulary's own rule.
    """
    kind = _CLASS[buf]
    inner = np.flatnonzero((buf & 0xC0) == 0x80)  # later bytes of a character are as its first one
    kind[inner] = kind[inner - 1]
    kind[inner] = kind[inner - 1]
    cut = np.empty(len(buf), bool)
    cut[:1] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero((buf == ord("'")) & cut)
    after = np.concatenate([buf, np.zeros(3, np.uint8)])
    one, two = after[quote + 1], after[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    cut[quote[short | long] + 1] = False
    ends = np.concatenate([quote[short] + 2, quote[long] + 3])
    cut[ends[ends < len(buf)]] = True
    inside = kind != _SPACE
    return np.flatnonzero(cut & inside), inside


def windows(text: str, size: int) -> Iterator[str]:
    """The text in parts of size characters or more, each cut at a space, which no token crosses."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop < len(text) and text[stop] not in SPACE_CHARS:
            stop += 1
        yield text[at:stop]
        at = stop


class WordEncoder:
    """Ids of texts as little-endian bytes; each distinct word of a call is merged once, all words together.

    Texts that hold other characters than the rule for words covers, or that may hold a special token, and very long words
    go to the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, ends = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others are shifted
        others = iter(range(256, 512))
        chars = [chr(b if b in set(plain) else next(others)) for b in range(256)]
        self.byte_ids = np.array([vocab[c] for c in chars] + [vocab[c + ends] for c in chars], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.path, self._tokenizer = path, None

    def ids(self, text: str) -> np.ndarray:
        """Ids of one string by the tokenizer itself."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return np.frombuffer(array("I", self._tokenizer.encode(text, add_special_tokens=False).ids), np.uint32).astype(np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, _NONE where nothing merges them."""
        key = (a.astype(np.int64) << 16) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NONE)

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merges the pair of least rank, leftmost first, in every row until none is left. The last column is all -1."""
        out, rows, cols = np.empty_like(symbols), np.arange(len(symbols)), np.arange(symbols.shape[1])
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < _NONE
            if not live.all():
                out[rows[~live]] = symbols[~live]
                rows, symbols, ranks, at, best = rows[live], symbols[live], ranks[live], at[live], best[live]
            here, move = np.arange(len(rows)), cols + (cols > at[:, None])
            symbols = np.take_along_axis(symbols, np.minimum(move, len(cols) - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(move[:, :-1], len(cols) - 2), 1)
            symbols[here, at] = self.merged[best]
            ranks[here, at] = self._ranks(symbols[here, at], symbols[here, at + 1])
            some, left = here[at > 0], at[at > 0]
            ranks[some, left - 1] = self._ranks(symbols[some, left - 1], symbols[some, left])
        return out

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        buf, lengths = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
        count, parts = np.zeros(len(words), np.int64), []
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, LONGEST_MERGED):  # rows of like width together
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if not len(at):
                continue
            cols = np.arange(high + 1)
            held = cols < lengths[at, None]
            symbols = self.byte_ids[buf[np.minimum(offsets[at, None] + cols, len(buf) - 1)] + 256 * (cols == lengths[at, None] - 1)]
            symbols = self._merge(np.where(held, symbols, -1))
            held = symbols >= 0
            count[at] = held.sum(1)
            parts.append((at, symbols[held]))
        for k in np.flatnonzero(lengths > LONGEST_MERGED):
            ids = self.ids(words[int(k)].as_py().decode())
            count[k] = len(ids)
            parts.append((np.array([k]), ids))
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for at, ids in parts:
            n = count[at]
            flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, count

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without odd characters."""
        raw = [t.lower().encode() + b"\n" for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        starts, inside = word_starts(buf)
        place = np.cumsum(inside, dtype=np.int32)
        data = buf[inside]
        offsets = np.append(place[starts] - 1, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        flat, count = self._word_ids(coded.dictionary)
        n = count[codes]
        stop = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(count) - count)[codes] - (stop - n), n) + np.arange(int(n.sum()))]
        cut = np.append(0, stop)[np.searchsorted(starts, np.cumsum([len(r) for r in raw]))].tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *cut], cut, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Odd and very long ones go window by window."""
        odd = [bool(_ODD.search(t)) for t in texts]
        plain = iter(self._plain([t for t, o in zip(texts, odd, strict=True) if not o and len(t) <= CHUNK_BYTES]))
        out = []
        for text, strange in zip(texts, odd, strict=True):
            if strange:
                out.append(b"".join(self.ids(w).astype("<u4").tobytes() for w in windows(text, WINDOW_BYTES)))
            elif len(text) > CHUNK_BYTES:
                out.append(b"".join(self._plain([w])[0] for w in windows(text, CHUNK_BYTES)))
            else:
                out.append(next(plain))
        return out


def token_pieces(df: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids. Streams batches, no shuffle.

    The vocabulary lives as long as the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = WordEncoder(tokenizer_path), 4 * sequence
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for whole in batches:
            for batch in slices_of_bytes(whole, "text", CHUNK_BYTES):
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    ids += CLOSING
                    view = memoryview(ids)
                    for k, i in enumerate(range(0, len(ids), step)):
                        part = view[i : i + step]
                        rows.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, _PIECES)


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, sequence: int, most: int):
        self.sequence, self.most, self.next_id, self.open, self.bits = sequence, most, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(sequence + 1)]

    def _put(self, bin_id: int, space: int) -> None:
        self.by_space[space].append(bin_id)
        self.bits |= 1 << space
        self.open += 1

    def _take(self, space: int) -> int:
        bin_id = self.by_space[space].pop()
        if not self.by_space[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            bin_id, space = self.next_id, self.sequence
            self.next_id += 1
        left = space - length
        if left:
            if self.open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if fullest <= left:
                    self._take(fullest)
                else:
                    return bin_id, self.sequence - space  # this one is the fullest: it closes
            self._put(bin_id, left)
        return bin_id, self.sequence - space


def pack(pieces: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Adds sequence_id and offset to pieces (written before, as they are counted and then dealt out at random).

    Only numbers are shuffled. A task's share is a random draw of all pieces, so a hot source is spread over all tasks.
    """
    tasks = max(1, -(-pieces.count() // pieces_a_task))
    order = F.xxhash64("doc_id", "piece", "start", F.lit(7))
    dealt = pieces.withColumn("_o", order).repartition(tasks, "_o").sortWithinPartitions("_o", *pieces.columns).drop("_o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = OpenBins(sequence, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            at = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(df, tokenizer_path, sequence)), sequence)
