"""MinHash near-dedup with BagMinHash: weighted-Jaccard signatures of word shingles, bands, and verified overlap.

A document is the multiset of its runs of five words (of all its words, if they are fewer). A shingle of weight w is cut
into dyadic weight levels [0,1), [1,2), [2,4), ... below w. Each level is a Poisson process whose rate is its width; every
point has a time, a weight inside its level (points at or above w are thinned out) and a slot of the signature. A slot
keeps its earliest point, so two slots agree with the chance of the weighted Jaccard similarity. A process goes on only
while its time is before the latest slot.

1. Equal texts are one class at once: only hashes meet, one row stands for them (its number is rep).
2. Each signature opens BANDS buckets; the key of a band is ROWS slots, drawn from all slots by a fixed seed. A bucket is a
   star: its centre is the member that shares most buckets with others, so the original of a family of edited copies, and
   members are paired with the centre only. That costs one row per member and bucket, however large a bucket is.
3. Pairs go through a filter on their signatures, and the rest are verified by their multiset overlap. First each text is
   paired with its best centre alone; links make components; then with the centres of other components; then each bucket
   whose members are still in several components gets further centres, outside the components of the earlier ones, CENTRES in
   all. So the work of this step grows with the members, whatever they have in common.
4. In buckets that are still open, all members of different components are held against each other, exactly: members are dealt
   into blocks of BLOCK_BYTES, and a task takes two blocks (closing_links). This is the square of such a bucket by nature, in
   blocks; components that are already joined meet no more.
5. A class is a component; its id is its least doc_id.

Loss, for a pair at exactly 0.8 (less above): no common band 0.2 %, the filter 0.003 % (step 4 has no filter). Every link of
two members of a bucket that passes the filter joins their classes.

Rules for odd input: a null text counts as empty; a text without words is alike only to equal texts; texts, not doc_ids, are
compared, so two texts under one doc_id may be in two classes (class_key tells these apart), and rows without doc_id take
part (class_id is null only if no member has one); repeated rows are copies of each other; an empty table gives an empty
result; no other columns are read, and keep_one() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices_of_bytes, spare, whole_text, written

#: Words of a shingle, least similarity, slots of a signature, bands and the slots of each, centres of a bucket.
SHINGLE, SIMILARITY, SLOTS, BANDS, ROWS, CENTRES = 5, 0.8, 192, 56, 10, 3
#: Pairs whose signatures agree in a smaller part are not verified (four standard deviations below SIMILARITY).
LEAST_ESTIMATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / SLOTS) ** 0.5
CHUNK_BYTES = 1 << 20
#: Bytes of a block of members that are all held against each other, and what each counts beside its shingles.
BLOCK_BYTES, MEMBER_BYTES = 4 << 20, 1 << 10

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(17)
_BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE_STEP = np.uint64(0xA0761D6478BD642F)
_SHINGLE_STEP = np.uint64(0xE7037ED1A0B428DB)
_BAND_SLOTS = np.array([np.random.default_rng((17, band)).permutation(SLOTS)[:ROWS] for band in range(BANDS)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and the number of the text of each."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    blank = np.concatenate([[True], _BLANK[buf], [True]])
    change = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    inside = np.flatnonzero(~blank[1:-1])
    place = (inside - np.repeat(starts, lengths)).astype(np.uint64)
    coded = _mix(_BYTE_CODE[buf[inside]] + place * _PLACE_STEP)
    words = _mix(np.add.reduceat(coded, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64))
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    count = np.bincount(doc, minlength=len(texts))
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, n)):
        out[: n - k] = (out[: n - k] + words[k:]) * _SHINGLE_STEP
        out[: n - k] ^= out[: n - k] >> np.uint64(32)
    left = np.cumsum(count)[doc] - np.arange(n)  # words from here to the text's end
    full = left >= SHINGLE
    for d in np.flatnonzero((count > 0) & (count < SHINGLE)):  # short texts: one shingle of all their words
        at = np.flatnonzero(doc == d)
        h = np.zeros(1, np.uint64)
        for w in words[at]:
            h = (h + w) * _SHINGLE_STEP
            h ^= h >> np.uint64(32)
        out[at[0]], full[at[0]] = (h ^ np.uint64(len(at)))[0], True
    return _mix(out[full]), doc[full]


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, weight; sorted by both."""
    h, doc = shingles(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(texts: list[str]) -> np.ndarray:
    """BagMinHash signatures, one row of SLOTS whole numbers for each text (texts without words: all zero)."""
    doc, h, weight = bags(texts)
    out = np.full((len(texts), SLOTS), np.inf)
    flat = out.reshape(-1)
    # dyadic levels below each weight: level 0 is [0,1), level j is [2^(j-1), 2^j)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    who = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed, doc, top = _mix(h[who] + level.astype(np.uint64) * _PLACE_STEP), doc[who], weight[who].astype(np.float64)
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        first = _mix(seed + np.array([2 * step], np.uint64) * _SHINGLE_STEP)
        time = time - np.log(_uniform(first)) / (width * SLOTS)
        latest = out.max(axis=1)
        alive = time < latest[doc]
        seed, doc, top, low, width, time = (x[alive] for x in (seed, doc, top, low, width, time))
        second = _mix(first[alive] ^ _PLACE_STEP)
        held = low + width * _uniform(_mix(second + np.uint64(1))) < top
        slot = (second % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(flat, (doc * SLOTS + slot)[held], time[held])
    bits = _mix(out.view(np.uint64)) >> np.uint64(32)
    bits[np.isinf(out).all(axis=1)] = 0
    return bits.astype(np.int64)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = sig.astype(np.uint64)[:, _BAND_SLOTS]
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE_STEP, (len(sig), BANDS)).copy()
    for r in range(ROWS):
        h = (h + parts[:, :, r]) * _SHINGLE_STEP
        h ^= h >> np.uint64(32)
    return _mix(h).view(np.int64)


def overlap(a: np.ndarray | bytes, b: np.ndarray | bytes) -> float:
    """Weighted Jaccard similarity of two multisets of 32-bit hashes, each a sorted array."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    return both / (len(x) + len(y) - both)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text (null: empty)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return text.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2"))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, its band keys and its signature, a byte for each slot. One stream, no shuffle.

    Texts without words have no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices_of_bytes(whole, "text", CHUNK_BYTES):
                once: dict[str, int] = {}
                at = np.array([once.setdefault(t, len(once)) for t in part.column("text").to_pylist()])
                sig = signatures(list(once))
                some, keys, short = sig.any(axis=1), band_keys(sig), sig.astype(np.uint8)
                offsets = np.concatenate([[0], np.cumsum(BANDS * some[at])]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[at[some[at]]].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), bands, pa.array([short[k].tobytes() for k in at], pa.binary())], names=["doc_id", "h1", "h2", "bands", "sig"])

    return keyed(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>, sig binary")


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, as they lie in the batch."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in LEAST_ESTIMATE of their slots or more, written."""

    def signs(column: pa.Array) -> np.ndarray:
        offsets, data = _buffers(column)
        return data[offsets[0] : offsets[-1]].reshape(-1, SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (signs(batch.column("sig_a")) == signs(batch.column("sig_b"))).mean(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(agree >= LEAST_ESTIMATE))

    sig = reps.select("rep", "sig")
    both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return written(both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long"))


def bags_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep and bag (the sorted 32-bit hashes of all its shingles) of the texts with these hashes (rep, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices_of_bytes(whole, "text", CHUNK_BYTES):
                n = part.num_rows
                h, doc = shingles(part.column("text").to_pylist())
                h = (h >> np.uint64(32)).astype(np.uint32)
                h = h[np.lexsort((h, doc))]
                cut = np.searchsorted(doc, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in range(n)], pa.binary())], names=["rep", "bag"])

    texts = keyed(docs).join(ids, ["h1", "h2"]).select("rep", "text")
    return texts.mapInArrow(run, "rep long, bag binary").dropDuplicates(["rep"])


def verified(pairs: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, x), (bt, y) = (_buffers(batch.column(c)) for c in ("bag_a", "bag_b"))
            alike = np.array([overlap(x[at[k] : at[k + 1]], y[bt[k] : bt[k + 1]]) for k in range(batch.num_rows)])
            kept = batch.select(["a", "b"]).append_column("similarity", pa.array(alike, pa.float64()))
            yield kept.filter(pa.array(alike >= similarity))

    both = pairs.join(bags.select(F.col("rep").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("rep").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """rep and class: the least id that links (a, b) reach. Labels spread to neighbours and jump; a written table a round."""
    ends = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(ends.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("a"), F.min("b")).alias("class")))
    while True:
        near = ends.join(labels.select(F.col("rep").alias("b"), "class"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("class").alias("near"))
        spread = labels.join(near, "rep").select("rep", "class", F.least("class", "near").alias("to"))
        jump = spread.join(labels.select(F.col("rep").alias("to"), F.col("class").alias("beyond")), "to", "left")
        new = written(jump.select("rep", F.col("class").alias("old"), F.least("to", F.coalesce("beyond", "to")).alias("class")))
        if new.where("old <> class").isEmpty():
            return new.select("rep", "class")
        labels = new.select("rep", "class")


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links; only the classes that these touch go through components() again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    full = written(label.join(ends, "rep", "full_outer").select("rep", F.coalesce("class", "rep").alias("class")))
    of = lambda end: full.select(F.col("rep").alias(end), F.col("class").alias(f"c_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct()
    new = components(between).select(F.col("rep").alias("class"), F.col("class").alias("new"))
    return written(full.join(new, "class", "left").select("rep", F.coalesce("new", "class").alias("class")))


def stars(rest: DataFrame) -> DataFrame:
    """rep, centre and rank of the centre, for each bucket's members but the centre. rest: bucket, rep, rank."""
    centres = rest.groupBy("bucket").agg(F.max_by("rep", "rank").alias("centre"), F.max("rank").alias("rank"))
    return rest.drop("rank").join(centres, "bucket").where("rep <> centre").select("bucket", "rep", "centre", "rank")


def _pair(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _with_class(df: DataFrame, label: DataFrame, rep: str, name: str) -> DataFrame:
    """Adds the class of a column of reps (the rep itself where it has no links)."""
    found = label.select(F.col("rep").alias(rep), F.col("class").alias("_c"))
    return df.join(found, rep, "left").withColumn(name, F.coalesce("_c", rep)).drop("_c")


def apart_links(label: np.ndarray, side: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
    """Links (places and similarity) that join texts of different labels: side 0 against side 1, and side 2 within itself.

    hashes: the sorted bags of all texts, one after another. Pairs that links of this call have joined are left out.
    """
    label = np.unique(label, return_inverse=True)[1]
    order = np.lexsort((label, np.bincount(label)[label], side))  # the largest class last: it meets nothing behind it
    label, side, owner = label[order], side[order], np.repeat(np.arange(len(lengths)), lengths)
    # the second copy of a hash within a text is a word of its own, so shared words are counted with their copies
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]))
    copy = np.arange(len(hashes)) - np.repeat(new, np.diff(np.append(new, len(hashes))))
    words = np.unique(hashes.astype(np.uint64) << np.uint64(32) | copy.astype(np.uint64), return_inverse=True)[1]
    place = np.cumsum(lengths) - lengths
    words = np.concatenate([words[place[k] : place[k] + lengths[k]] for k in order])
    lengths = lengths[order]
    start = np.concatenate([[0], np.cumsum(lengths)])
    mine, found = np.zeros(words.max() + 1, bool), []
    second = int(np.searchsorted(side, 1))
    for i in range(second if second and second < len(side) else len(side) - 1):
        first = second if second and second < len(side) else i + 1
        least, most = np.minimum(lengths[first:], lengths[i]), np.maximum(lengths[first:], lengths[i])
        if not ((label[first:] != label[i]) & (least >= similarity * most)).any():
            continue
        held = words[start[i] : start[i + 1]]
        mine[held] = True
        both = np.add.reduceat(mine[words[start[first] :]], start[first:-1] - start[first], dtype=np.int64)
        mine[held] = False
        alike = both / (lengths[first:] + lengths[i] - both)
        for j in np.flatnonzero((alike >= similarity) & (label[first:] != label[i])):
            if label[first + j] != label[i]:
                label[label == label[first + j]] = label[i]
                found.append((int(order[i]), int(order[first + j]), float(alike[j])))
    return found


def closing_links(rest: DataFrame, label: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links a, b, similarity between members of a bucket that are in different classes: all such pairs are verified.

    Buckets of one centre are taken as one group where that makes fewer pairs. A group's classes are dealt into blocks, small
    classes together and large ones apart; each pair of blocks that holds two classes is a group of rows in a task.
    """
    named = _with_class(rest, label, "rep", "class")
    apart = named.groupBy("bucket").agg(F.max_by("rep", "rank").alias("centre"), F.count("*").cast("double").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    # of three members or fewer all pairs were tried as centres
    apart = written(apart.where("lo <> hi and n > 3").select("bucket", "centre", "n"))
    met = written(named.join(apart, "bucket").select("bucket", "centre", "n", "rep", "class"))
    # the sum of n over members is that of the squares over buckets
    whole = met.groupBy("centre").agg(F.sum("n").alias("pairs"), F.countDistinct("rep").cast("double").alias("all")).where("all * all <= pairs")
    key = F.struct(F.col("all").isNotNull().alias("whole"), F.when(F.col("all").isNotNull(), F.col("centre")).otherwise(F.col("bucket")).alias("id"))
    keys = apart.join(whole, "centre", "left").select("bucket", key.alias("key"))
    rows = met.join(keys, "bucket").select("key", "rep", "class").distinct()
    sized = written(rows.join(bags.select("rep", (F.length("bag") + MEMBER_BYTES).alias("bytes")), "rep"))
    classes = sized.groupBy("key", "class").agg(F.sum("bytes").alias("bytes")).withColumn("large", F.col("bytes") > BLOCK_BYTES // 4)
    small = classes.where("not large").groupBy("key").agg(F.sum("bytes").alias("small"))
    parts = F.ceil(F.when(F.col("large"), F.col("bytes")).otherwise(F.col("small")) / BLOCK_BYTES)
    block = F.struct(F.when(F.col("large"), F.col("class")).otherwise(-1).alias("only"), F.pmod(F.xxhash64(F.when(F.col("large"), F.col("rep")).otherwise(F.col("class"))), parts).alias("part"))
    placed = written(sized.drop("bytes").join(classes, ["key", "class"]).join(small, "key", "left").select("key", block.alias("block"), "rep", "class"))
    blocks = placed.groupBy("key", "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    x, y = (blocks.select("key", F.col("block").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi")) for n in "xy")
    pairs = x.join(y, "key").where("x <= y and (x_lo <> x_hi or y_lo <> y_hi or x_lo <> y_lo)").select("key", "x", "y")
    at = lambda n, side: F.struct(F.col(n).alias("block"), F.lit(side).alias("side"))
    sides = pairs.select("key", "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(at("x", 2))).otherwise(F.array(at("x", 0), at("y", 1)))).alias("s")).select("key", "x", "y", "s.*")

    def run(part: pa.Table) -> pa.Table:
        rep, label, side = (part.column(c).to_numpy() for c in ("rep", "class", "side"))
        offsets, data = _buffers(part.column("bag").combine_chunks())
        found = apart_links(label, side, np.diff(offsets) // 4, data[offsets[0] : offsets[-1]].view(np.uint32), similarity)
        ends = np.array([sorted((rep[i], rep[j])) for i, j, _ in found], np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1], "similarity": np.array([s for _, _, s in found], np.float64)})

    held = placed.join(sides, ["key", "block"]).join(bags, "rep").select("key", "x", "y", "rep", "class", "side", "bag")
    found = held.groupBy("key", "x", "y").applyInArrow(run, "a long, b long, similarity double")
    return written(found.dropDuplicates(["a", "b"]))


def near_links(reps: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts, enough of them to join the classes, and rep and class of their ends.

    reps: rep, h1, h2, bands and sig, written.
    """
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(members.join(shared, "bucket").select("bucket", "rep", "n"))
    # how many buckets' places a text shares; ties go by a hash
    rank = met.groupBy("rep").agg((F.shiftleft(F.sum("n"), 20) + F.pmod(F.xxhash64("rep"), F.lit(1 << 20))).alias("rank"))
    rest = written(met.join(rank, "rep").select("bucket", "rep", "rank"))
    bags = written(bags_of(reps.select("rep", "h1", "h2").join(rank, "rep", "left_semi"), docs))

    def linked(pairs: DataFrame) -> DataFrame:
        return written(verified(estimated(pairs, reps), bags, similarity))

    star = written(stars(rest).groupBy("rep", "centre").agg(F.max("rank").alias("rank")))
    tried = written(star.groupBy("rep").agg(F.max_by("centre", "rank").alias("centre")).select(*_pair("rep", "centre")).distinct())
    links = linked(tried)
    label = components(links)
    open_star = _with_class(_with_class(star, label, "rep", "c"), label, "centre", "d").where("c <> d")
    new = written(open_star.select(*_pair("rep", "centre")).distinct().join(tried, ["a", "b"], "left_anti"))
    waiting = rest.withColumn("waits", F.lit(True))
    centre_of = rest.groupBy("bucket").agg(F.max_by("rep", "rank").alias("centre"))
    for left in range(CENTRES - 1, -1, -1):
        found = linked(new)
        label, links, tried = relabelled(label, found), links.unionByName(found), tried.unionByName(new)
        if left == 0:
            break
        # members of open buckets; those in the class of the last centre wait for no other centre
        named = _with_class(waiting, label, "rep", "class")
        named = _with_class(named.join(centre_of, "bucket"), label, "centre", "d")
        named = written(named.select("bucket", "rep", "rank", "class", (F.col("waits") & (F.col("class") != F.col("d"))).alias("waits")))
        nexts = named.where("waits").groupBy("bucket").agg(F.max_by(F.struct("rep", "class"), "rank").alias("x")).select("bucket", F.col("x.rep").alias("centre"), F.col("x.class").alias("d"))
        nexts = written(nexts)
        pairs = named.join(nexts, "bucket").where(F.col("class") != F.col("d")).select(*_pair("rep", "centre")).distinct()
        new = written(pairs.join(tried, ["a", "b"], "left_anti"))
        waiting, centre_of = named.select("bucket", "rep", "rank", "waits"), nexts.select("bucket", "centre")
    found = closing_links(rest, label, bags, similarity)
    return links.unionByName(found), relabelled(label, found)


def signed_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h1, h2 of each row, with rep, class_key and n_links of its text."""
    signed = written(sign(docs))
    distinct = signed.groupBy("h1", "h2").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(distinct.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "bands", "sig"))
    links, label = near_links(reps, docs, similarity)
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = reps.select("h1", "h2", "rep").join(label, "rep", "left").join(count, "rep", "left")
    named = named.select("h1", "h2", "rep", F.coalesce("class", "rep").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return written(signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, rep (least doc_id of its exact text), class_id (least doc_id of its class), class_key
    (a number of the class in this run), n_links (verified links of its text that joined the class)."""
    rows = signed_classes(docs, similarity)
    least = rows.groupBy("class_key", "rep").agg(F.min("doc_id").alias("r"))
    classes = least.groupBy("class_key").agg(F.min("r").alias("class_id"))
    names = least.join(classes, "class_key").select(F.col("rep").alias("_rep"), F.col("r"), "class_id")
    return rows.join(names, F.col("rep") == F.col("_rep")).select("doc_id", F.col("r").alias("rep"), "class_id", "class_key", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The same columns; of each class one row stays: the least doc_id (null last), then text hash, then hash of the row."""
    rows = signed_classes(docs, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h1", "h2")
    first = rows.groupBy("class_key").agg(F.min(order).alias("x")).select("x.doc_id", "x.h1", "x.h2")
    many = rows.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h1") == F.col(f"{b}.h1")) & (F.col(f"{a}.h2") == F.col(f"{b}.h2"))
    stay = spare(docs, "stay")
    stays = first.alias("f").join(many.alias("m"), same("f", "m"), "left").select(F.struct("f.doc_id", "f.h1", "f.h2", "n").alias(stay))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col(stay)["doc_id"]) & (F.xxhash64(text) == F.col(stay)["h1"]) & (F.xxhash64(F.lit(5), text) == F.col(stay)["h2"])
    kept = written(docs.join(stays, mine).select(*cols, stay))
    # repeated rows: one of each, by a hash of the whole row
    again = kept.where(F.col(stay)["n"].isNotNull()).groupBy(stay).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("row"))
    return kept.where(F.col(stay)["n"].isNull()).drop(stay).unionByName(again.select("row.*"))
