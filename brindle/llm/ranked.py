"""Ranked lexical search with block-max pruning over a forward index of document ranges.

Build: each task cuts its documents into ranges of neighbours. A block holds the forward lists of its documents (places in the
block's own vocabulary and counts) and, for each term, how many documents hold it, its largest count and the least length of a
document that holds it. Nothing is shuffled, and the index does not depend on queries or on statistics of the corpus.

Search: a term's largest part of a score in a block follows from its largest count and least length, and their weighted sum over
an item's terms bounds every score in the block. The blocks of highest bound of each item are scored first, wherever they lie;
the lowest of the best scores found there is the item's threshold. Then every task sorts its blocks by an item's bound and scores
them until the bound drops below the threshold, which rises with the task's own finds. What is left out cannot reach the list,
so results are exact, ties included.

Items come in packs of about TERMS_A_PACK terms in all, and the index is scanned once for each pack: terms and thresholds of one
pack go to every task, whatever the number of items. The driver holds one pack.

Rules for odd input: a text without a term (null, empty) counts nowhere; each repeated row is a document of its own; a null
doc_id sorts last among equal scores; rows of one item_id are one item with the terms of all, so are those without item_id; an
item without a term that some document holds gives no row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import slices_of_bytes, written

#: Rows of an item's list, and blocks scored first for its threshold.
TOP, SEEDS = 50, 64
#: Documents of a block (few, so that its bounds are close), and terms of its documents, about (a longer document stands alone).
BLOCK_DOCUMENTS, BLOCK_TERMS = 4, 50_000
#: Terms of the items of a pack, about (an item is never cut).
TERMS_A_PACK = 200_000
#: Bytes of text analysed at once, blocks written at once, blocks read at once, cells (terms by documents) of a score table, blocks scored at once for an item.
SLICE_BYTES, WRITTEN_BLOCKS, READ_BLOCKS, CELLS, STEP = 8 << 20, 64, 64, 16 << 20, 16

#: A block: its number, documents and their terms; its summary (the vocabulary, joined by blanks, and for each term the documents that hold it, the largest
#: count and the least length) and its forward lists (for each document its id, whether that is null, its length and the number of its different terms; then
#: these terms' places in the vocabulary and their counts). Both are compressed, so that a task's batches stay small.
_SCHEMA = "block long, docs long, length long, summary binary, forward binary"
_SUMMARY = {"vocabulary": np.uint8, "df": np.int32, "most": np.int32, "least": np.int32}
_FORWARD = {"ids": np.int64, "none": np.bool_, "n": np.int32, "held": np.int32, "terms": np.int32, "tf": np.int32}

#: Bytes of ASCII that are no letter or digit become blanks, A to Z become lower case, all other bytes stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode().translate(_FOLD).split()


class _Block:
    """Documents of a range, as they are added."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.held: list[int] = []
        self.terms: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.n.append(len(words))
        self.held.append(len(counts))
        put = self.places.setdefault
        self.terms += [put(t, len(self.places)) for t in counts]
        self.tf += counts.values()

    def full(self, documents: int) -> bool:
        return len(self.ids) >= documents or len(self.terms) >= BLOCK_TERMS

    def summary(self) -> bytes:
        size, terms = len(self.places), np.array(self.terms, np.int32)
        most, least = np.zeros(size, np.int32), np.full(size, np.iinfo(np.int32).max)
        np.maximum.at(most, terms, np.array(self.tf, np.int32))
        np.minimum.at(least, terms, np.repeat(np.array(self.n, np.int32), self.held))
        return _packed(_SUMMARY, np.frombuffer(b" ".join(self.places), np.uint8), np.bincount(terms, minlength=size), most, least)

    def forward(self) -> bytes:
        return _packed(_FORWARD, [i or 0 for i in self.ids], [i is None for i in self.ids], self.n, self.held, self.terms, self.tf)


def _packed(kinds: dict[str, type], *parts) -> bytes:  # noqa: ANN002
    """Arrays of the given kinds, after their sizes in bytes, compressed."""
    data = [np.asarray(p, k).tobytes() for p, k in zip(parts, kinds.values(), strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(d) for d in data], np.int64).tobytes(), *data]))


def _unpacked(column: pa.Array, kinds: dict[str, type]) -> list[dict[str, np.ndarray]]:
    """The arrays of each row."""
    out, reader = [], zstandard.ZstdDecompressor()
    for packed in column:
        data = reader.decompress(packed.as_buffer())
        ends = 8 * len(kinds) + np.cumsum([0, *np.frombuffer(data, np.int64, len(kinds))])
        out.append({name: np.frombuffer(data, kind, (ends[i + 1] - ends[i]) // np.dtype(kind).itemsize, ends[i]) for i, (name, kind) in enumerate(kinds.items())})
    return out


def _rows(blocks: list[_Block], number: int) -> pa.RecordBatch:
    """Blocks as rows, numbered from number on."""
    numbers = [range(number, number + len(blocks)), [len(b.ids) for b in blocks], [sum(b.n) for b in blocks]]
    columns = [*(pa.array(x, pa.int64()) for x in numbers), pa.array([b.summary() for b in blocks], pa.binary()), pa.array([b.forward() for b in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _blocks(documents: int):  # noqa: ANN202
    """Blocks of the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, done = TaskContext.get().partitionId() << 32, [_Block()]
        for whole in batches:
            for part in slices_of_bytes(whole, "text", SLICE_BYTES):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if words := terms_of(text or ""):
                        done[-1].add(doc_id, words)
                    if done[-1].full(documents):
                        if len(done) >= WRITTEN_BLOCKS or sum(len(b.terms) for b in done) >= WRITTEN_BLOCKS * BLOCK_TERMS // 8:
                            yield _rows(done, number)
                            number, done = number + len(done), []
                        done.append(_Block())
        if not done[-1].ids:
            done.pop()
        if done:
            yield _rows(done, number)

    return run


def forward_index(docs: DataFrame, documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """The index of documents (doc_id, text), one row a block; write it before it is searched."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(documents), _SCHEMA)


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices_of_bytes(whole, "text", SLICE_BYTES):
                found = [(i, t) for i, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True) for t in set(terms_of(text or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term string").distinct()


@dataclass
class Pack:
    """Items that are searched in one scan: their terms and weights, and each item's least score worth a look."""

    items: list[int | None]
    terms: list[str]
    of_item: list[np.ndarray]
    documents: int
    length: int
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, rows: list, documents: int, length: int) -> Pack:
        """rows: item_id, term."""
        places: dict[str, int] = {}
        of_item: dict[int | None, list[int]] = {}
        for r in rows:
            of_item.setdefault(r["item_id"], []).append(places.setdefault(r["term"], len(places)))
        return cls(list(of_item), list(places), [np.array(x, np.int64) for x in of_item.values()], documents, length, least=np.ones(len(of_item), np.int64))

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What one occurrence list adds to a score, before its weight."""
        m = 50 + (50 * n * self.documents) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _joined(rows: list[dict[str, np.ndarray]], name: str) -> np.ndarray:
    """One list of all rows."""
    found = np.concatenate([r[name] for r in rows])
    return found.astype(np.int64) if found.dtype == np.int32 else found


def _places(rows: list[dict[str, np.ndarray]], terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each block's vocabulary begins and ends, and the place of each of its terms among the given ones (-1: none)."""
    words = pc.split_pattern(pa.array([r["vocabulary"].tobytes() for r in rows], pa.binary()).cast(pa.string()), " ")
    return words.offsets.to_numpy().astype(np.int64), pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy().astype(np.int64)


class _Chunk:
    """A batch of blocks: the pack's terms that each holds, and the bound of each block for each item."""

    def __init__(self, part: pa.RecordBatch, pack: Pack, terms: pa.Array) -> None:
        self.part, self.pack = part, pack
        blocks = _unpacked(part.column("summary"), _SUMMARY)
        self.at, self.place = _places(blocks, terms)
        hit = np.flatnonzero(self.place >= 0)
        most, least = _joined(blocks, "most")[hit], _joined(blocks, "least")[hit]
        row = np.searchsorted(self.at, hit, "right") - 1
        self.hits = np.bincount(row, minlength=part.num_rows)
        largest = np.zeros((part.num_rows, len(pack.terms)), np.int64)
        largest[row, self.place[hit]] = pack.weights[self.place[hit]] * pack.parts(most, least)
        ends = np.cumsum([len(t) for t in pack.of_item])
        self.bound = np.add.reduceat(largest[:, np.concatenate(pack.of_item)], np.concatenate([[0], ends[:-1]]), axis=1)

    def tables(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the wanted blocks: each of the pack's terms' row in the table (-1: none), the table (terms by documents), ids, which ids are null, and the documents' blocks."""
        used = np.unique(self.place[self.place >= 0])
        where = np.full(len(self.pack.terms), -1, np.int64)
        where[used] = np.arange(len(used))
        rows = np.flatnonzero(wanted)
        blocks = _unpacked(self.part.column("forward").take(pa.array(rows)), _FORWARD)
        n, tf, ids = _joined(blocks, "n"), _joined(blocks, "tf"), _joined(blocks, "ids")
        doc = np.repeat(np.arange(len(n)), _joined(blocks, "held"))
        place = self.place[np.repeat(self.at[rows], [len(b["terms"]) for b in blocks]) + _joined(blocks, "terms")]
        some = place >= 0
        doc, place = doc[some], place[some]
        out = np.zeros((len(used), len(n)), np.int64)
        out[where[place], doc] = self.pack.weights[place] * self.pack.parts(tf[some], n[doc])
        return where, out, ids, _joined(blocks, "none"), np.repeat(rows, [len(b["n"]) for b in blocks])


def _small(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most READ_BLOCKS blocks, and about so many cells of blocks by terms."""
    step = max(1, min(READ_BLOCKS, CELLS // max(1, cells)))
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            yield whole.slice(lo, step)


def _seeds(pack: Pack):  # noqa: ANN202
    """The task's blocks of highest bound for each item: item, block, bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(pack.terms, pa.string())
        held, ids = np.zeros((0, len(pack.items)), np.int64), np.zeros((0, len(pack.items)), np.int64)
        for part in _small(batches, len(pack.terms)):
            new = part.column("block").to_numpy()
            held = np.concatenate([held, _Chunk(part, pack, terms).bound])
            ids = np.concatenate([ids, np.repeat(new[:, None], len(pack.items), 1)])
            if len(held) > SEEDS:
                best = np.argpartition(-held, SEEDS - 1, axis=0)[:SEEDS]
                held, ids = np.take_along_axis(held, best, 0), np.take_along_axis(ids, best, 0)
        row, item = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids[row, item]), pa.array(held[row, item])], names=["item", "block", "bound"])

    return run


class _Best:
    """An item's best documents so far: by score, then doc_id, null last."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        self.score, self.id, self.none = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, ids), (self.none, none)))
        if len(self.score) >= TOP:
            keep = np.lexsort((self.id, self.none, -self.score))[:TOP]
            self.score, self.id, self.none = self.score[keep], self.id[keep], self.none[keep]
            self.least = max(self.least, int(self.score[-1]))


def _parted(part: pa.RecordBatch, pack: Pack, terms: pa.Array) -> Iterator[_Chunk]:
    """The blocks in chunks whose score tables are small."""
    chunk = _Chunk(part, pack, terms)
    cells = min(int(chunk.hits.sum()), len(pack.terms)) * sum(part.column("docs").to_pylist())
    if cells <= CELLS or part.num_rows == 1:
        yield chunk
        return
    half = part.num_rows // 2
    yield from _parted(part.slice(0, half), pack, terms)
    yield from _parted(part.slice(half), pack, terms)


def _scored(pack: Pack):  # noqa: ANN202
    """The task's best documents of each item: item, doc_id, score. Where there is a column only, a block counts for these items alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(pack.terms, pa.string())
        best = [_Best(int(x)) for x in pack.least]
        for part in _small(batches, len(pack.terms)):
            for chunk in _parted(part, pack, terms):
                bound = chunk.bound
                if "only" in chunk.part.schema.names:
                    named = np.zeros_like(bound, bool)
                    for b, only in enumerate(chunk.part.column("only").to_pylist()):
                        named[b, only] = True
                    bound = np.where(named, bound, 0)
                open_ = bound >= np.array([x.least for x in best])
                if not open_.any():
                    continue
                where, table, ids, none, block = chunk.tables(open_.any(1))
                for q in np.flatnonzero(open_.any(0)):
                    blocks, found = np.flatnonzero(open_[:, q]), best[q]
                    order = blocks[np.argsort(-bound[blocks, q], kind="stable")]
                    rows = where[pack.of_item[q]]
                    rows = rows[rows >= 0]
                    for lo in range(0, len(order), STEP):
                        if bound[order[lo], q] < found.least:
                            break
                        docs = np.flatnonzero(np.isin(block, order[lo : lo + STEP]))
                        found.add(table[np.ix_(rows, docs)].sum(0), ids[docs], none[docs])
        for q, x in enumerate(best):
            if n := len(x.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q, np.int32)), pa.array(x.id, mask=x.none), pa.array(x.score)], names=["item", "doc_id", "score"])

    return run


def _best_of_items(found: DataFrame, top: int, *order) -> DataFrame:  # noqa: ANN002
    w = Window.partitionBy("item").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def thresholds(index: DataFrame, pack: Pack) -> np.ndarray:
    """For each item the TOP-th best score among its blocks of highest bound, 1 where they hold fewer documents."""
    bounds = index.select("block", "summary").mapInArrow(_seeds(pack), "item int, block long, bound long")
    picked = _best_of_items(bounds, SEEDS, F.desc("bound"), "block").groupBy("block").agg(F.collect_list("item").alias("only"))
    # at most SEEDS blocks an item of one pack
    found = index.join(F.broadcast(picked), "block").mapInArrow(_scored(pack), "item int, doc_id long, score long")
    rows = _best_of_items(found, TOP, F.desc("score")).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()
    out = np.ones(len(pack.items), np.int64)
    for r in rows:
        if r["n"] == TOP:
            out[r["item"]] = max(1, r["s"])
    return out


def _counts(terms: list[str]):  # noqa: ANN202
    """The task's number of documents that hold each term: place, df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(terms, pa.string()), np.zeros(len(terms) + 1, np.int64)
        for part in _small(batches, 1):
            blocks = _unpacked(part.column("summary"), _SUMMARY)
            _, place = _places(blocks, wanted)
            np.add.at(total, place, _joined(blocks, "df"))
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["place", "df"])

    return run


def weights(index: DataFrame, pack: Pack) -> np.ndarray:
    """The weight of each of the pack's terms, 0 where no document holds it."""
    n = F.lit(pack.documents)
    df = index.select("summary").mapInArrow(_counts(pack.terms), "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    out = np.zeros(len(pack.terms), np.int64)
    for r in df.select("place", weight.alias("weight")).collect():  # one pack
        out[r["place"]] = r["weight"]
    return out


def packs(index: DataFrame, items: DataFrame) -> Iterator[Pack]:
    """The items (item_id, text) with their terms' weights and their thresholds, pack by pack."""
    n, length = index.agg(F.sum("docs"), F.sum("length")).first()
    terms = written(_item_terms(items))
    parts = -(-terms.count() // TERMS_A_PACK) if n else 0
    for p in range(parts):
        pack = Pack.of(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect(), n, length)
        if pack.items:
            pack.weights = weights(index, pack)
            pack.least = thresholds(index, pack)
            yield pack


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item (item_id, text). index must have been written."""
    spark = index.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for pack in packs(index, items):
        found = index.mapInArrow(_scored(pack), "item int, doc_id long, score long")
        names = F.broadcast(spark.createDataFrame(list(enumerate(pack.items)), "item int, item_id long"))  # one pack
        ranked = _best_of_items(found, TOP, F.desc("score"), F.asc_nulls_last("doc_id")).join(names, "item")
        out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out


def ranked_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The lists of all items over all documents."""
    return search(written(forward_index(docs)), items)
