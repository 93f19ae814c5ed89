"""SentencePiece BPE: encoding by a prefix table, and decoding.

A byte-pair encoding keeps, for every prefix of a text, exactly one possible last token. The table of last tokens is
filled from left to right: of the tokens that end at a place (found by an automaton), the one is stored whose pair with
the last token before it is compatible, that is, would not have been merged otherwise. Ids are then read off backwards.

Rules for odd input: a null text counts as empty and has no ids; repeated rows each get their own result; an empty table
gives an empty result; encode_pieces and decode_pieces keep other columns, the digest reads only doc_id and text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: A word with the spaces before it. No vocabulary entry goes on after a word into the next space, so no merge does.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Most segments that a task remembers, and the longest one it does.
REMEMBERED, LONGEST_REMEMBERED, REMEMBERED_PAIRS = 800_000, 48, 500_000
_NO_RANK = float("inf")


class PieceTable:
    """The vocabulary of one model with what the prefix table needs: ranks, and each token's last merge."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a space: segments are not independent")
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        # the order of merges as small whole numbers; single characters come before all merges
        merges = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (self.rank[p], self.ids[p]))
        self.order = {p: -1 for p in self.ids if len(p) == 1} | {p: k for k, p in enumerate(merges)}
        self.halves: dict[str, tuple[str, str]] = {}
        for p in merges:
            if (halves := self._last_merge(p)) is not None:
                self.halves[p] = halves
        self.automaton = ahocorasick.Automaton()
        for p in self.halves:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, tuple[str, int, str]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """The plain method: again and again merge the best pair, the leftmost of equals. For ties, and to find halves."""
        at, left, right = list(symbols), list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := self.rank.get(both := at[i] + at[j])) is not None:
                heapq.heappush(heap, (rank, i, j, both))

        for i in range(len(at) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not at[i] or not at[j] or right[i] != j or at[i] + at[j] != both:
                continue
            at[i], at[j], right[i] = both, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in at if x]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge makes the piece, or None if no merges ever make it."""
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(((self.rank.get(a + b, _NO_RANK), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))), default=None)
            if best is None or best[0] == _NO_RANK:
                return None
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return (symbols[0], symbols[1]) if len(symbols) == 2 else None

    def compatible(self, a: str, b: str) -> bool:
        """Whether the tokens a and b can stand side by side: no merge across their border comes before their own.

        Both are taken apart from the border inwards, the later merge first; at each state the pair that meets at the
        border must not merge earlier than the merges that have been undone.
        """
        limit, order = _NO_RANK, self.order
        while True:
            if (k := order.get(a + b, _NO_RANK)) < limit:
                return False
            ka, kb = order.get(a, -1), order.get(b, -1)
            if ka < 0 and kb < 0:
                return True
            if ka > kb:
                # undo a's last merge: a merge across the border with its right half must not come before it
                limit, a = ka, self.halves[a][1]
            else:
                # b's last merge lies further right: at equal rank the pair at the border goes first
                limit, b = kb + 0.5, self.halves[b][0]

    def encode_segment(self, segment: str) -> list[str]:
        """Tokens of one segment, through the table of last tokens."""
        if segment.startswith(SPACE * 2):
            return self.merged(list(segment))  # pieces of spaces only share one score
        n = len(segment)
        last: list[str] = [*segment[:1], *segment]  # without a longer token, a character is its own
        pairs = self.pairs
        done = -1
        for end, (piece, length) in self.automaton.iter(segment):  # longest first at each end
            if end == done:
                continue
            start = end + 1 - length
            if start:
                pair = (last[start], piece)
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last[end + 1] = piece
            done = end
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids_of(self, tokens: list[str]) -> list[int]:
        """Ids; a character that is no piece becomes its bytes."""
        out: list[int] = []
        for t in tokens:
            if (i := self.ids.get(t)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in t.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: runs of byte tokens are read as UTF-8, spaces come back, and the one put first goes."""
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(_from_bytes(run))
                run = bytearray()
            if i not in self.special:
                parts.append(self.pieces[i])
        if run:
            parts.append(_from_bytes(run))
        text = "".join(parts)
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def _remember(self, segment: str) -> tuple[str, int, str]:
        tokens = self.encode_segment(segment)
        ids = [self.ids.get(t, -1) for t in tokens]
        back = segment  # tokens that are pieces decode to themselves
        if -1 in ids:
            ids = self.ids_of(tokens)
            back = SPACE + self.decode([self.ids[SPACE], *ids]).replace(" ", SPACE).removeprefix(SPACE)
        out = (",".join(map(str, ids)), len(ids), back)
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[segment] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [int(x) for s in self.digest(text)[:1] if s for x in s.split(",")]

    def digest(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        seen = self.seen
        parts = [seen.get(s) or self._remember(s) for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts])[1:].replace(SPACE, " ")


def _from_bytes(run: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes a replacement character of its own."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_table(model_path: str) -> PieceTable:
    """The table of a model, built once in each process."""
    return PieceTable(model_path)


def piece_digest(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id, number of ids, digests of the ids and of the decoded text. No shuffle: each task streams its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_path)
        for batch in batches:
            rows = [table.digest(t or "") for t in batch.column("text").to_pylist()]
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([r[1] for r in rows], pa.int64()), "ids_sha256": pa.array([sha(r[0]) for r in rows], pa.string()), "decoded_sha256": pa.array([sha(r[2]) for r in rows], pa.string())}
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_pieces(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds piece_ids, the ids of the text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts):  # noqa: ANN001, ANN202
        table = piece_table(model_path)
        return texts.map(lambda t: table.encode(t or ""))

    return df.withColumn("piece_ids", run(F.col(f"`{text}`")))


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids") -> DataFrame:
    """Adds decoded, the text of the ids (null ids: empty)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(lists):  # noqa: ANN001, ANN202
        table = piece_table(model_path)
        return lists.map(lambda x: "" if x is None else table.decode([int(i) for i in x]))

    return df.withColumn("decoded", run(F.col(f"`{ids}`")))
