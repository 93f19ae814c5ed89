"""Quality classifier: multiple-instance learning with gated attention over the passages of a document.

Every passage (a window of bytes) becomes a vector of counts: kinds of characters, word shapes, repetition, and hashed
words. A layer encodes it; gated attention weighs the passages; the weighted mean gives the score. All of it is learned
from document labels. The labelled sample is bounded (TRAIN_DOCUMENTS); scoring covers whole texts.

Rules for odd input: a null text is empty, and an empty text is one passage without words, scored as learned; null labels are
not used; a document with several labels counts once per distinct label; without any labels every score is 0.5; repeated rows
get equal scores; an empty table gives an empty result; other columns are kept by score_documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import batches_of_bytes, slices_of_bytes, spare, whole_text

#: Bytes of a passage, most labelled documents to learn from and passages of each (evenly spaced), classes of hashed words.
PASSAGE, TRAIN_DOCUMENTS, TRAIN_PASSAGES, WORD_BINS = 1024, 6000, 64, 64
#: Size of an encoded passage, steps of learning, pull towards zero, seed.
HIDDEN, STEPS, DECAY, SEED = 24, 300, 1e-3, 11
#: Characters handled at once in a task (a longer text stands alone); arrays take some 65 bytes for each byte.
CHUNK_BYTES = 1 << 18

_KIND = np.full(256, 8, np.uint8)  # other ASCII signs
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[ord(c) for c in "#*$%&|<>"]] = 7
_KIND[0xC0:] = 9
_KIND[0x80:0xC0] = 10
_KINDS = 11
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(5)
_BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE_CODE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = _KINDS + 9 + WORD_BINS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and 64-bit hashes of the words in the bytes."""
    blank = np.concatenate([[True], _BLANK[buf], [True]])
    change = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    inside = np.flatnonzero(~blank[1:-1])
    place = inside - starts[word]
    coded = (_BYTE_CODE[buf[inside]] * _PLACE_CODE[place & 63]) ^ (place.astype(np.uint64) << np.uint64(40))
    sums = np.add.reduceat(_mix(coded), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return starts, lengths, _mix(sums + lengths.astype(np.uint64))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of the texts, and the number of the text that each belongs to."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raw])
    per = -(-sizes // PASSAGE)
    owner = np.repeat(np.arange(len(raw)), per)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    doc_of = np.repeat(np.arange(len(raw)), sizes)
    passage_of = first[doc_of] + (np.arange(len(buf)) - at[doc_of]) // PASSAGE
    n = len(owner)
    kinds = np.bincount(passage_of * _KINDS + _KIND[buf], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float32)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :_KINDS] = kinds / kinds.sum(1, keepdims=True)
    starts, lengths, hashes = word_hashes(buf)
    if len(starts):
        p, d = passage_of[starts], doc_of[starts]
        words = np.bincount(p, minlength=n)
        some = np.maximum(words, 1)
        chars = np.bincount(p, lengths, minlength=n)

        def distinct(group: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
            order = np.lexsort((keys, group))
            g, v = group[order], keys[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
            return np.bincount(g[new], minlength=k)

        docs = np.bincount(d, minlength=len(raw))
        pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
        together = p[:-1] == p[1:]
        n_pairs = np.bincount(p[:-1][together], minlength=n)
        head = _KIND[buf[starts]]
        out[:, _KINDS + 0] = chars / some / 10
        out[:, _KINDS + 1] = distinct(p, hashes, n) / some
        out[:, _KINDS + 2] = distinct(p[:-1][together], pairs[together], n) / np.maximum(n_pairs, 1) if together.any() else 0
        out[:, _KINDS + 3] = np.bincount(p, head == 1, minlength=n) / some
        out[:, _KINDS + 4] = np.bincount(p, lengths > 15, minlength=n) / some
        out[:, _KINDS + 5] = np.bincount(p, lengths == 1, minlength=n) / some
        out[:, _KINDS + 6] = (distinct(d, hashes, len(raw)) / np.maximum(docs, 1))[owner]
        out[:, _KINDS + 7] = np.log1p(docs)[owner] / 10
        bins = np.bincount(p * WORD_BINS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_BINS, minlength=n * WORD_BINS).reshape(n, WORD_BINS)
        out[:, _KINDS + 9 :] = np.sqrt(bins / some[:, None])
    out[:, _KINDS + 8] = np.log1p(sizes - 1)[owner] / 10
    return out, owner


@dataclass
class Model:
    """Standardisation, encoder, gated attention and the last layer."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> tuple[np.ndarray, tuple]:
        """Logits of the bags; owner is ascending and each bag has a passage."""
        w = self.w
        h = np.tanh(x @ w["we"] + w["be"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        first = np.searchsorted(owner, np.arange(bags))
        e = np.exp(s - np.maximum.reduceat(s, first)[owner])
        alpha = e / np.add.reduceat(e, first)[owner]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        return z @ w["c"] + w["c0"][0], (h, t, g, alpha, z)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts."""
        out = np.empty(len(texts))
        for lo, hi in batches_of_bytes([len(t) for t in texts], CHUNK_BYTES):
            x, owner = passages(texts[lo:hi])
            logit, _ = self.forward((x - self.mean) / self.scale, owner, hi - lo)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return out


def learn(x: np.ndarray, owner: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Fits the model to bags of passages by full-batch Adam on the log loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng, d = np.random.default_rng(SEED), x.shape[1]
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"we": draw(d, HIDDEN), "be": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, HIDDEN), "u": draw(HIDDEN, HIDDEN), "a": draw(HIDDEN), "c": draw(HIDDEN), "c0": np.zeros(1, np.float32)}
    model, n = Model(mean, scale, w), len(labels)
    m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
    for step in range(1, steps + 1):
        logit, (h, t, g, alpha, z) = model.forward(x, owner, n)
        dl = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / n
        first = np.searchsorted(owner, np.arange(n))
        dz = dl[:, None] * w["c"]
        dh = alpha[:, None] * dz[owner]
        da = (h * dz[owner]).sum(1)
        ds = alpha * (da - np.add.reduceat(alpha * da, first)[owner])
        dt, dg = ds[:, None] * g * w["a"] * (1 - t * t), ds[:, None] * t * w["a"] * g * (1 - g)
        dh = dh + dt @ w["v"].T + dg @ w["u"].T
        de = dh * (1 - h * h)
        grads = {"we": x.T @ de, "be": de.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dl, "c0": dl.sum(keepdims=True)}
        for k, grad in grads.items():
            grad = grad + DECAY * w[k] * (k not in ("be", "c0"))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = (w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """Whether a document's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Model | None:
    """Learns from at most so many labelled documents, drawn by a hash of doc_id. None if none is labelled.

    Only ids and labels (bounded) are broadcast; passages become vectors on the executors before they are gathered.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("_q")).distinct()
    drawn = usable.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "_q").limit(documents).collect()
    if not drawn:
        return None
    spark = docs.sparkSession
    sample = spark.createDataFrame([tuple(r) for r in drawn], "doc_id long, _q int")
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices_of_bytes(whole, "text", CHUNK_BYTES):
                x, owner = passages(part.column("text").to_pylist())
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                bags = [x[np.unique(np.linspace(lo, hi - 1, min(hi - lo, TRAIN_PASSAGES)).astype(int))].tobytes() for lo, hi in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_q"), pa.array(bags, pa.binary())], names=["doc_id", "_q", "x"])

    bags = sorted(rows.mapInArrow(run, "doc_id long, _q int, x binary").collect(), key=lambda r: (r["doc_id"], r["_q"], bytes(r["x"])))
    if not bags:
        return None
    vectors = [np.frombuffer(b["x"], np.float32).reshape(-1, FEATURES) for b in bags]
    owner = np.repeat(np.arange(len(bags)), [len(v) for v in vectors])
    return learn(np.concatenate(vectors), owner, np.array([b["_q"] for b in bags], np.float32))


def score_documents(docs: DataFrame, model: Model | None, score: str = "quality_score", text: str = "text") -> DataFrame:
    """Adds the score of each whole text. No shuffle."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return docs.withColumn(score, run(whole_text(f"`{text}`")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The same columns; documents that score below least go. All stay where nothing is labelled."""
    score = spare(docs, "quality_score")
    return score_documents(docs, train(docs, labels), score).where(F.col(score) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. A null doc_id is not held out; repeated rows each get a row."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
