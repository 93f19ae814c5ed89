"""Dictionary segmentation: a run of letters without blanks becomes the words of its best path.

A dictionary is a table (word, freq). A word weighs the logarithm of its share of all counts; a letter that begins no word of the
dictionary counts as a word seen once. The best path through a run has the largest sum of weights; of equal paths the one whose
first word is longest, then the second, and so on. Weights are whole millionths, so sums are exact and equal everywhere.

Every task holds the MOST_WORDS words that runs are likeliest to meet. Of a larger dictionary it has, of the further words, a
filter that tells which parts of a text may be one of them; these few parts alone are joined with the further words, which come
back to their row. So no run leaves its row, whatever the dictionary's size. Words are found by hashes and compared letter by letter.

Odd input: a null or empty run has no words; very long runs take time in proportion to their length times the longest word;
words with a null or non-positive count do not count, equal words add their counts; an empty dictionary gives single letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.sources.tables import materialised

#: Words that a task's table holds at most.
MOST_WORDS = 1_000_000
#: Runs that are segmented: ideographs. Other words are runs of letters and digits, with a fraction or a percent sign.
RUN, PLAIN = T.IDEOGRAPHS, r"[a-z0-9_]+(?:\.[0-9]+)?%?"
#: Minus the logarithm of the chance that a run goes on with a given letter: short words are met by chance.
LETTER = 1.8
#: Bits of a slice of the filter (a power of two), bits for a word, bits set by each; slices at most.
SLICE, BITS, PROBES, MOST_SLICES = 20, 32, 6, 1024
#: Runs that are divided at once, letters of the longest of these, letters that a task holds as arrays.
TOGETHER, LONG, LETTERS = 16_384, 64, 1 << 20
#: Multiplier of the hash for each try; another one is taken if two words of a dictionary have one hash.
SEEDS = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xC2B2AE3D27D4EB4F]
_SPREAD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5, 0x9FB21C651E98DF25)]


def weighed(dictionary: DataFrame) -> DataFrame:
    """word and weight (a long; the word seen once, null, has its weight too)."""
    # counted once: a dictionary is read out of whole texts
    words = materialised(dictionary.where("word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").alias("freq")))
    total = words.agg(F.coalesce(F.sum("freq"), F.lit(1)).alias("total"))
    rows = words.unionByName(dictionary.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), F.lit(1).alias("freq")))
    return rows.crossJoin(F.broadcast(total)).select("word", F.round(F.log(F.col("freq") / F.col("total")) * 1_000_000).cast("long").alias("weight"))  # one row


def path(run: str, matches: Callable[[int], Iterator[tuple[int, int]]], once: int) -> list[str]:
    """The words of the best path. matches gives the ends and weights of the words that begin at a place, shortest first."""
    best, end = [0] * (len(run) + 1), [0] * len(run)
    for i in range(len(run) - 1, -1, -1):
        top, to = once + best[i + 1], i + 1
        for e, w in matches(i):
            score = w + best[e]
            # a letter that is a word has its own weight
            if score >= top or e == i + 1:
                top, to = score, e
        best[i], end[i] = top, to
    out, i = [], 0
    while i < len(run):
        out.append(run[i : end[i]])
        i = end[i]
    return out


class Letters:
    """All letters of some texts (strings without nulls) in one array, and where each text begins."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.string())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = texts.buffers()[2] if len(texts) else None
        self.data = data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")
        self.text = self.data.to_pybytes().decode()
        self.codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        #: The first byte of each letter, and where the letters end.
        self.byte = np.arange(len(self.codes) + 1) if len(self.codes) == self.data.size else np.concatenate([[0], np.cumsum(1 + (self.codes >= 0x80) + (self.codes >= 0x800) + (self.codes >= 0x10000))])
        self.start = np.searchsorted(self.byte, at - at[0])
        self.length = np.diff(self.start)

    def parts(self, first: np.ndarray) -> pa.Array:
        """The texts cut before each of these letters (sorted)."""
        at = np.append(self.byte[first], self.byte[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(at), self.data)


def _marks(codes: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each letter."""
    x = codes.astype(np.uint64) * _SPREAD[0]
    x ^= x >> np.uint64(31)
    return x * _SPREAD[1] | np.uint64(1)


def _layers(letters: Letters, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts sorted by length, the longest first: the marks of the letters at each distance from the end, and how many texts have one."""
    length = letters.length[which]
    longest = int(length[0])
    some = len(length) - np.searchsorted(length[::-1], np.arange(longest + 1))
    end = letters.start[which] + length
    marks = np.zeros((longest + 1, len(which)), np.uint64)
    for d in range(1, longest + 1):
        marks[d, : some[d]] = _marks(letters.codes[end[: some[d]] - d])
    return marks, some


def _together(letters: Letters, which: np.ndarray) -> Iterator[np.ndarray]:
    """Some of the texts, the longest first."""
    order = which[np.argsort(-letters.length[which], kind="stable")]
    for lo in range(0, len(order), TOGETHER):
        yield order[lo : lo + TOGETHER]


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """The hash of each word: a polynomial of its letters' marks, modulo two to the 64."""
    letters, base = Letters(words), np.uint64(seed)
    out = np.zeros(len(words), np.uint64)
    for which in _together(letters, np.flatnonzero(letters.length)):
        marks, _ = _layers(letters, which)
        length, h = letters.length[which], np.zeros(len(which), np.uint64)
        for n in range(1, int(length[0]) + 1):
            k = int(np.searchsorted(-length, -n, "right"))
            h[:k] = h[:k] * base + marks[length[:k] - n + 1, np.arange(k)]
        out[which] = h
    return out


class Words:
    """A dictionary's words by their hashes. Of a larger dictionary: likely words."""

    def __init__(self, words: pa.Array, weights: np.ndarray, once: int, longest: int, seed: int) -> None:
        h = hashes(words, seed)
        order = np.argsort(h)
        self.words, self.weights, self.once, self.longest, self.seed = words.take(pa.array(order)), weights[order].astype(np.int64), once, longest, seed
        self.keys = np.append(h[order], np.uint64(2**64 - 1))
        #: Where the keys with certain first bits begin; and a bit for each key, of many.
        self.wide = max(4, len(words).bit_length() + 1)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << self.wide, dtype=np.uint64) << np.uint64(64 - self.wide)).astype(np.int32)
        self.bits = np.zeros(1 << self.wide, np.uint8)
        self.mark(self.bits, self.keys[:-1])
        self.exact: dict[str, int] | None = None

    def mark(self, bits: np.ndarray, keys: np.ndarray) -> None:
        at = keys * _SPREAD[2] >> np.uint64(61 - self.wide)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = h * _SPREAD[2] >> np.uint64(61 - self.wide)
        return np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of these hashes among the keys, -1 for none."""
        out, live, at = np.full(len(h), -1, np.int64), np.arange(len(h)), self.first[h >> np.uint64(64 - self.wide)]
        while len(live):
            key = self.keys[at]
            same, on = key == h, key < h
            out[live[same]] = at[same]
            live, at, h = live[on], at[on] + 1, h[on]
        out[out == len(self.words)] = -1
        return out

    def divided(self, pieces: pa.Array, runs: np.ndarray, more: tuple[pa.Array, np.ndarray] | None = None) -> tuple[pa.Array, np.ndarray]:
        """The words of all pieces (strings without nulls) in order, and their number in each piece. runs: the numbers of those that are
        divided. more: further words of the dictionary and their weights."""
        letters = Letters(pieces)
        first, chosen = np.zeros(len(letters.codes), bool), np.full(len(letters.codes), -1, np.int32)
        first[letters.start[:-1][letters.length > 0]] = True
        extra = Words(*more, self.once, self.longest, self.seed) if more is not None and len(more[0]) else None
        bits = self.bits
        if extra is not None:
            self.mark(bits := bits.copy(), extra.keys[:-1])

        def weights(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Which of the hashes are words, their places (in extra: after all of self) and weights."""
            hit = self.may_hold(bits, h)
            at = self.find(h[hit])
            if extra is None:
                good = at >= 0
                return hit[good], at[good], self.weights[at[good]]
            w = np.where(at >= 0, self.weights[at] if len(self.weights) else 0, 0)
            lost = np.flatnonzero(at < 0)
            other = extra.find(h[hit[lost]])
            lost, other = lost[other >= 0], other[other >= 0]
            at[lost], w[lost] = other + len(self.words), extra.weights[other]
            good = at >= 0
            return hit[good], at[good], w[good]

        for which in _together(letters, runs[(letters.length[runs] > 0) & (letters.length[runs] <= LONG)]):
            self._divide(letters, which, weights, first, chosen)
        for k in runs[letters.length[runs] > LONG]:
            self._divide_long(letters, int(k), weights, first, chosen)
        # hashes tell words but for chance; what stands on a path is compared
        start = np.flatnonzero(first)
        words, wrong = letters.parts(start), []
        for base, table in ((0, self), (len(self.words), extra)):
            if table is not None:
                some = np.flatnonzero((chosen[start] >= base) & (chosen[start] < base + len(table.words)))
                other = pc.invert(pc.equal(words.take(pa.array(some)), table.words.take(pa.array(chosen[start[some]] - base)))).to_numpy(zero_copy_only=False)
                wrong += start[some[other]].tolist()
        for k in {int(np.searchsorted(letters.start, s, "right")) - 1 for s in wrong}:
            lo, hi = letters.start[k], letters.start[k + 1]
            found = self._by_letters(letters.text[lo:hi], extra)
            first[lo:hi] = False
            first[lo + np.cumsum([0, *map(len, found[:-1])])] = True
        if wrong:
            words = letters.parts(np.flatnonzero(first))
        number = np.diff(np.concatenate([[0], np.cumsum(first)])[letters.start])
        return words, number

    def _divide(self, letters: Letters, which: np.ndarray, weights: Callable, first: np.ndarray, chosen: np.ndarray) -> None:
        """Best paths of many runs at once, from their ends: of each distance from the end, the best first word."""
        (marks, some), base = _layers(letters, which), np.uint64(self.seed)
        length, size = letters.length[which], len(marks)
        best, step, word = np.zeros(marks.shape, np.int64), np.ones(marks.shape, np.int16), np.full(marks.shape, -1, np.int32)
        for d in range(1, size):
            k = int(some[d])
            top, h = best[d, :k], np.zeros(k, np.uint64)
            top[:] = best[d - 1, :k] + self.once
            for n in range(1, min(d, self.longest) + 1):
                h *= base
                h += marks[d - n + 1, :k]
                hit, at, w = weights(h)
                score = w + best[d - n, hit]
                # a letter that is a word has its own weight; of equal paths that with the longer word
                better = (score >= top[hit]) | (n == 1)
                hit = hit[better]
                top[hit], step[d, hit], word[d, hit] = score[better], n, at[better]
        end, live, d = letters.start[which] + length, np.arange(len(which)), length
        while len(live):
            first[end[live] - d] = True
            chosen[end[live] - d] = word[d, live]
            d = d - step[d, live]
            live, d = live[d > 0], d[d > 0]

    def _divide_long(self, letters: Letters, k: int, weights: Callable, first: np.ndarray, chosen: np.ndarray) -> None:
        lo, size = int(letters.start[k]), int(letters.length[k])
        marks, base = _marks(letters.codes[lo : lo + size]), np.uint64(self.seed)
        h, found = np.zeros(size, np.uint64), []
        for n in range(1, min(size, self.longest) + 1):
            h = h[: size - n + 1] * base + marks[n - 1 :]
            at, word, w = weights(h)
            found.append((at, np.full(len(at), n), word, w))
        at, n, word, w = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((n, at))
        at, n, word, w = at[order], n[order], word[order], w[order]
        begin = np.searchsorted(at, np.arange(size + 1)).tolist()
        ends, costs = (at + n).tolist(), w.tolist()
        i = 0
        for x in path(letters.text[lo : lo + size], lambda i: zip(ends[begin[i] : begin[i + 1]], costs[begin[i] : begin[i + 1]], strict=True), self.once):
            first[lo + i] = True
            same = np.flatnonzero(n[begin[i] : begin[i + 1]] == len(x))
            chosen[lo + i] = word[begin[i] + same[0]] if len(same) else -1
            i += len(x)

    def _by_letters(self, run: str, extra: Words | None) -> list[str]:
        """By the words themselves: for runs in which a part has a word's hash and is none."""
        tables = [self] if extra is None else [self, extra]
        for t in tables:
            if t.exact is None:
                t.exact = dict(zip(t.words.to_pylist(), t.weights.tolist(), strict=True))
        found = lambda i: ((e, t.exact[run[i:e]]) for e in range(i + 1, min(len(run), i + self.longest) + 1) for t in tables if run[i:e] in t.exact)
        return path(run, found, self.once)


class Further:
    """A filter of the words of a dictionary that a task's table does not hold: bits in slices."""

    def __init__(self, bits: np.ndarray, shortest: int, longest: int, seed: int) -> None:
        self.bits, self.shortest, self.longest, self.seed = bits, shortest, longest, seed

    @staticmethod
    def slices(h: np.ndarray, wide: int) -> np.ndarray:
        return h * _SPREAD[0] >> np.uint64(64 - wide) if wide else np.zeros(len(h), np.uint64)

    @staticmethod
    def probe(h: np.ndarray, k: int) -> np.ndarray:
        return h * _SPREAD[k + 1] >> np.uint64(64 - SLICE)

    def held(self, h: np.ndarray) -> np.ndarray:
        at, wide = np.arange(len(h)), (len(self.bits) >> SLICE - 3).bit_length() - 1
        for k in range(PROBES):
            bit = (self.slices(h[at], wide) << np.uint64(SLICE)) + self.probe(h[at], k)
            at = at[(self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at

    def parts(self, pieces: pa.Array, runs: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Parts of runs that may be further words: the number of the piece and the part."""
        letters, base = Letters(pieces), np.uint64(self.seed)
        piece, out = [], []

        def add(numbers: np.ndarray, start: np.ndarray, n: int) -> None:
            piece.extend(numbers.tolist())
            out.extend(letters.text[i : i + n] for i in start.tolist())

        for which in _together(letters, runs[(letters.length[runs] > 0) & (letters.length[runs] <= LONG)]):
            marks, some = _layers(letters, which)
            end = letters.start[which] + letters.length[which]
            for d in range(self.shortest, len(marks)):
                h = np.zeros(int(some[d]), np.uint64)
                for n in range(1, min(d, self.longest) + 1):
                    h *= base
                    h += marks[d - n + 1, : len(h)]
                    if n >= self.shortest and len(at := self.held(h)):
                        add(which[at], end[at] - d, n)
        for k in runs[letters.length[runs] > LONG]:
            lo, size = int(letters.start[k]), int(letters.length[k])
            marks, h = _marks(letters.codes[lo : lo + size]), np.zeros(size, np.uint64)
            for n in range(1, min(size, self.longest) + 1):
                h = h[: size - n + 1] * base + marks[n - 1 :]
                if n >= self.shortest and len(at := self.held(h)):
                    add(np.full(len(at), k), lo + at, n)
        return np.array(piece, np.int64), out


class Lexicon:
    """A dictionary made ready once for several texts: the words of a task's table, and further words (word, weight) with their filter."""

    def __init__(self, dictionary: DataFrame) -> None:
        spark = dictionary.sparkSession
        weights = weighed(dictionary)
        once = weights.where("word is null").first()["weight"]
        words = weights.where("word is not null")
        n, longest = words.agg(F.count("*"), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
        self.further = self.filter = None
        if n <= MOST_WORDS:
            found = words.toArrow()
            seed = next(s for s in SEEDS if len(np.unique(hashes(found["word"].combine_chunks(), s))) == n)
            self.table = spark.sparkContext.broadcast(_words(found, once, longest, seed))
            return
        for seed in SEEDS:
            hashed = materialised(words.mapInArrow(_hashed(seed), "word string, weight long, h long"))
            if hashed.agg(F.count_distinct("h")).first()[0] == n:
                break
        else:
            raise ValueError("words of the dictionary have the same hash under every multiplier")
        # the logarithm of both chances: that a word is this one, and that letters in a row are; the hash parts equal ones
        rank = F.log(F.exp(F.col("weight") / 1_000_000) + F.exp(-LETTER * F.length("word"))) + F.pmod("h", F.lit(1 << 20)) / (1 << 40)
        ranked = hashed.withColumn("rank", rank)
        least = ranked.agg(F.percentile_approx("rank", 1 - MOST_WORDS / n, 100_000)).first()[0]
        self.table = spark.sparkContext.broadcast(_words(ranked.where(F.col("rank") > least).select("word", "weight").toArrow(), once, longest, seed))
        self.further = ranked.where(F.col("rank") <= least).select("word", "weight", "h")
        number = self.further.count()
        wide = min(MOST_SLICES, max(1, -(-number * BITS >> SLICE))).bit_length() - 1
        bits = np.zeros(1 << wide + SLICE - 3, np.uint8)
        for r in self.further.select("h", F.lit(0).alias("s")).mapInArrow(_sliced(wide), "s long, h long").groupBy("s").applyInArrow(_slice, "s long, bits binary").toLocalIterator():
            bits[r["s"] << SLICE - 3 : r["s"] + 1 << SLICE - 3] = np.frombuffer(r["bits"], np.uint8)
        shortest, longest = self.further.agg(F.min(F.length("word")), F.max(F.length("word"))).first()
        self.filter = spark.sparkContext.broadcast(Further(bits, shortest, longest, seed))


def _words(found: pa.Table, once: int, longest: int, seed: int) -> Words:
    return Words(found["word"].combine_chunks().cast(pa.string()), found["weight"].to_numpy().astype(np.int64), once, longest, seed)


def _hashed(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("weight"), pa.array(hashes(b.column("word"), seed).view(np.int64))], names=["word", "weight", "h"])

    return run


def _sliced(wide: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(Further.slices(h.view(np.uint64), wide).astype(np.int64)), pa.array(h)], names=["s", "h"])

    return run


def _slice(found: pa.Table) -> pa.Table:
    """The bits of one slice."""
    h, bits = found["h"].to_numpy().astype(np.int64).view(np.uint64), np.zeros(1 << SLICE - 3, np.uint8)
    for k in range(PROBES):
        at = Further.probe(h, k)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return pa.table({"s": found["s"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def prefixes(dictionary: DataFrame) -> Words | None:
    """The table of a dictionary (word, freq); None where it has more than MOST_WORDS words."""
    found = Lexicon(dictionary)
    return found.table.value if found.further is None else None


Pieces = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]


def _pieces_of_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces of all rows, where each row's begin, and which of them are runs."""
    pieces = pc.fill_null(lists.flatten(), "")
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pieces, at, np.arange(len(pieces))


def _pieces_of_texts(pattern: str) -> Pieces:
    shape = f"({pattern})|{PLAIN}"

    def of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        find, pieces, run, at = re.compile(shape), [], [], [0]
        for text in texts.to_pylist():
            for m in find.finditer(text or ""):
                if m.lastindex:
                    run.append(len(pieces))
                pieces.append(m[0])
            at.append(len(pieces))
        return pa.array(pieces, pa.string()), np.array(at), np.array(run, np.int64)

    return of


def _few(column: pa.Array) -> Iterator[slice]:
    """Rows of about LETTERS bytes."""
    size = max(1, column.nbytes // max(1, len(column)))
    for lo in range(0, len(column), step := max(1, LETTERS // size)):
        yield slice(lo, lo + step)


def _divided(table: Callable[[], Words], of: Pieces, nested: bool) -> Callable[..., Column]:
    """A function of a column, and of each row's further words: the words of its pieces (nested: a list for each)."""

    def run(column: pa.Array, more: pa.Array | None = None) -> pa.Array:
        out = []
        for s in _few(column):
            pieces, at, runs = of(column[s])
            extra = None
            if more is not None and len(found := more[s].flatten()):
                word, where = np.unique(found.field("word").to_numpy(zero_copy_only=False).astype(object), return_index=True)
                extra = pa.array(word, pa.string()), found.field("weight").to_numpy(zero_copy_only=False).astype(np.int64)[where]
            words, number = table().divided(pieces, runs, extra)
            to = np.concatenate([[0], np.cumsum(number)])
            if nested:
                words = pa.ListArray.from_arrays(pa.array(to, pa.int32()), words)
            out.append(pa.ListArray.from_arrays(pa.array(at if nested else to[at], pa.int32()), words))
        kind = pa.list_(pa.list_(pa.string())) if nested else pa.list_(pa.string())
        return pa.concat_arrays(out) if out else pa.array([], kind)

    kind = "array<array<string>>" if nested else "array<string>"

    @F.arrow_udf(kind)
    def by_table(column: pa.Array) -> pa.Array:
        return run(column)

    @F.arrow_udf(kind)
    def by_both(column: pa.Array, more: pa.Array) -> pa.Array:
        return run(column, more)

    return lambda *columns: (by_table if len(columns) == 1 else by_both)(*columns)


def _parts(filtered, of: Pieces) -> Callable[[Column], Column]:  # noqa: ANN001
    """A function of a column: the different parts of its runs that may be further words."""

    @F.arrow_udf("array<string>")
    def parts(column: pa.Array) -> pa.Array:
        out = []
        for s in _few(column):
            pieces, at, runs = of(column[s])
            found: list[set[str]] = [set() for _ in range(len(at) - 1)]
            number, words = filtered.value.parts(pieces, runs)
            for k, word in zip((np.searchsorted(at, number, "right") - 1).tolist(), words, strict=True):
                found[k].add(word)
            out += map(list, found)
        return pa.array(out, pa.list_(pa.string()))

    return parts


def _segmented(rows: DataFrame, dictionary: DataFrame | Lexicon, column: Column, of: Pieces, nested: bool) -> DataFrame:
    """The rows with their words."""
    lexicon = dictionary if isinstance(dictionary, Lexicon) else Lexicon(dictionary)
    table = lexicon.table
    divided = _divided(lambda: table.value, of, nested)
    if lexicon.further is None:
        return rows.select("*", divided(column).alias("words"))
    # only parts that may be further words move, to these words and back to their row
    parts = rows.select("id", F.explode(_parts(lexicon.filter, of)(column)).alias("word"))
    more = parts.join(lexicon.further.select("word", "weight"), "word").groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("word", "weight")).alias("_more"))
    both = rows.join(more, F.col("id").eqNullSafe(F.col("_id")), "left")
    return both.select(*rows.columns, divided(column, F.col("_more")).alias("words"))


def segmented(table: Words, pattern: str = RUN) -> Callable[[Column], Column]:
    """A function of a text (lower case): its words in order, runs of the pattern by the dictionary."""
    return _divided(lambda: table, _pieces_of_texts(pattern), False)


def segmented_texts(texts: DataFrame, dictionary: DataFrame | Lexicon, pattern: str = RUN) -> DataFrame:
    """id and words of texts (id, text; one row an id), in lower case and in order. Of a dictionary of over MOST_WORDS words the texts are read twice."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return _segmented(texts.select("id", "text"), dictionary, low, _pieces_of_texts(pattern), False).select("id", "words")


def segmented_lists(rows: DataFrame, dictionary: DataFrame | Lexicon, runs: Column | None = None) -> DataFrame:
    """The rows (id, runs; one row an id) with words, a list for each run. runs: where the runs are no column of that name. Of a
    dictionary of over MOST_WORDS words the rows are read twice."""
    return _segmented(rows, dictionary, F.col("runs") if runs is None else runs, _pieces_of_lists, True)


def search_tokens(table: Words, pattern: str = RUN) -> Callable[[Column], Column]:
    """A function of a text: its codes and numbers with units, words by the dictionary, and pairs of neighbouring ideographs; distinct, in this order."""
    words = segmented(table, pattern)

    def tokens(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array_distinct(F.concat(T.exact_and_units(low), words(low), T.pairs(low)))

    return tokens


def segmented_runs(runs: DataFrame, dictionary: DataFrame, table: Words | None = None) -> DataFrame:
    """run and words of the different runs (run). Without a table it is made of the dictionary, whatever its size."""
    each = runs.where("run <> ''").select("run").distinct()
    if table is not None:
        return each.select("run", F.element_at(_divided(lambda: table, _pieces_of_lists, True)(F.array("run")), 1).alias("words"))
    return segmented_lists(each.withColumn("id", F.col("run")), dictionary, F.array("run")).select("run", F.element_at("words", 1).alias("words"))
