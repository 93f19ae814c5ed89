"""Main text of web pages: markup names what it can, runs repeated over a host find the boilerplate that it does not name.

1. Each page becomes blocks of text in page order. Markup that says menu, header, footer, sidebar, notice, advert, form,
   script, style or comments takes its blocks out; article markup marks the blocks of the article. The blocks are written
   once, in chunks of bounded size.
2. A run is RUN tokens that stand in PAGES_ALIKE distinct pages of a host or more. Equal pages count as one. Each chunk
   proposes its runs by a suffix array, sorted as deep as a run is long, and the runs' hashes are counted over all chunks,
   so chunks, partitions and hot hosts change nothing. To shuffle little, a first round counts only the least hash of the
   PART-token parts of each run: equal runs have equal ones, so a run whose least part is rare is rare itself.
3. A page whose article is marked keeps the article whole, as texts may well share passages. Of other pages the covered
   runs go and the unique runs stay.

Rules for odd input: a null or empty html gives an empty text; a null url is a host of its own (all such pages together);
repeated rows each get a result; an empty table gives an empty result; other columns are kept, except that columns named
like the operator's own are replaced. A page longer than a chunk's bound is a chunk by itself. Runs and pages are told
apart by hashes of 64 bits.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import shared_dir

#: Tokens of a run (a power of two), distinct pages that must hold it.
RUN, PAGES_ALIKE = 8, 3
#: Tokens of the parts of a run that the first round counts.
PART = 4
#: Characters of a chunk, and characters of all pages for each bucket of hashes.
CHUNK_CHARS, BUCKET_CHARS = 4_000_000, 16_000_000
#: Most bytes of found hashes that go to every task; more are joined to their chunks.
SENT_BYTES = 64_000_000
#: How sure the markup is that a block belongs to the article; from ARTICLE on, the block is kept whole.
UNMARKED, CONTENT, MAIN, ARTICLE = 0, 1, 2, 3

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe textarea select title button object canvas video audio".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav aside footer header form dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
# Words in class or id that name boilerplate, words that take that back, and words that name the article.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar header masthead banner footer sidebar sidebars side aside rail notice notices "
    "cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup ad ads advert adverts advertisement advertising "
    "adsense adslot adbox sponsor sponsored promo promos promotion form search searchbox login comment comments disqus respond reply replies "
    "share sharing social related recommended recommendations trending popular widget widgets pagination pager toolbar skip".split()
)
# Words that may follow a boilerplate word without changing what it names: "comment-list" is one, "side-effects" is not.
STRUCTURE = frozenset(
    "area bar block body box btn button buttons card cell col column container content cta desktop field fixed footer full group head header heading icon icons id "
    "image img inner input item items label large left link links list lists main mobile module nav outer page panel pane post posts primary right row secondary "
    "section site slot small sticky tab tabs text title top bottom unit view wrap wrapper zone".split()
)
NOT_WORDS = frozenset("no has with without non".split())
HEADER_OF = frozenset("article post entry content story main body text title".split())
CONTENT_WORDS = frozenset("article post entry content story".split())

# Each pattern runs through its text once: nothing that it took is given back.
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW}


def _words(value: str) -> list[str]:
    return [w for w in _PARTS.split(_CAMEL.sub("-", value).lower()) if w]


def names_boilerplate(words: list[str]) -> bool:
    """Whether the words of one class or id name boilerplate: by the last word, or by the first with words of structure after it."""
    hit = [w for w in words if w in ASIDE_WORDS]
    if not hit or NOT_WORDS & set(words) or (set(hit) <= {"header"} and HEADER_OF & set(words)):
        return False
    return words[-1] in ASIDE_WORDS or (words[0] in ASIDE_WORDS and all(w in STRUCTURE or w in ASIDE_WORDS or w[0].isdigit() for w in words[1:]))


def zone_of(name: str, attributes: str) -> int | None:
    """What an element says of its blocks: a level of sureness, or None if they are boilerplate."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    if name in ("html", "body"):
        return UNMARKED
    if role in ASIDE_ROLES or found.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        return None
    named = [_words(part) for key in ("class", "id") for part in found.get(key, "").split()]
    if name != "main" and any(map(names_boilerplate, named)):
        return None
    if name in ASIDE:
        return None
    if name == "article" or role == "article" or "articleBody" in found.get("itemprop", ""):
        return ARTICLE
    if name == "main" or role == "main":
        return MAIN
    return CONTENT if any(CONTENT_WORDS & set(words) for words in named) else UNMARKED


class _Tags:
    """The tags of a page, one after another, in time in proportion to its length.

    A tag goes to the first > outside of quotes. Where quotes do not close before the page ends, they count as any other sign from
    there to the place where the reading failed, so no part is read again and again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.plain = page, page.rfind(">"), 0

    def next(self, at: int) -> tuple[int, int, re.Match | None, str] | None:
        """Begin, end, and of an element's tag its name and what stands inside; None where no tag begins at or after a place."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, None, ""
            if page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                return begin, len(page) if end < 0 else end + 1, None, ""
            if begin > self.last:
                return None
            if name := _NAME.match(page, begin):
                end = _INSIDE.match(page, name.end()).end() if name.end() >= self.plain else page.find(">", name.end())
                if page[end : end + 1] != ">":
                    self.plain = end
                    end = page.find(">", name.end())
                if end < 0:
                    return None
                return begin, end + 1, name, page[name.end() : end]
            at = begin + 1
        return None


def blocks_of(page: str) -> list[tuple[int, str]]:
    """The blocks of a page that markup does not take out, each with how sure it is of the article.

    An inline element that is taken out leaves its block whole.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int | None]] = []  # open elements: name, and the zone within (None: taken out)
    held: Counter[str] = Counter()  # their names
    zone: int | None = UNMARKED
    text: list[str] = []
    at, n, tags = 0, len(page), _Tags(page)

    def close_block() -> None:
        # within what is taken out there is no text; text that waits belongs to the block around it
        if text and zone is not None:
            if block := " ".join(entities.unescape("".join(text)).split()):
                out.append((zone, block))
            text.clear()

    def pop_to(place: int) -> None:
        nonlocal zone
        while len(stack) > place:
            name, inner = stack.pop()
            held[name] -= 1
            if inner is not None:
                close_block()
            zone = stack[-1][1] if stack else UNMARKED

    while at < n:
        tag = tags.next(at)
        if tag is None:
            if zone is not None:
                rest = page[at:]
                # an unfinished tag at the very end is markup
                cut = rest.rfind("<")
                text.append(rest[:cut] if cut >= 0 and re.match(r"<[A-Za-z/!]", rest[cut:]) else rest)
            break
        begin, end, found, inside = tag
        if begin > at and zone is not None:
            text.append(page[at:begin])
        at = end
        if found is None:
            continue
        name = found[2].lower()
        if found[1]:
            if name in BLOCKS or name in ("td", "th"):
                if held[name]:
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                elif name in BLOCKS:
                    close_block()
            elif stack and stack[-1][0] == name:  # an inline element with a zone of its own
                pop_to(len(stack) - 1)
            continue
        if name in RAW:
            if not inside.rstrip().endswith("/"):
                at = _RAW_END[name].search(page, at).end()
            if zone is not None:
                text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close_block()
            elif zone is not None:
                text.append(" " if name == "br" else "")
            continue
        if name in ("td", "th") and zone is not None:
            text.append(" ")
        inner = zone_of(name, inside)
        if name in BLOCKS:
            close_block()
            if name not in ("html", "body"):
                # a new block ends an open paragraph, a new item the item before it
                for k in range(len(stack) - 1, -1, -1):
                    other = stack[k][0]
                    if other == "p" or (other == name and name in ("li", "dt", "dd", "tr")):
                        pop_to(k)
                        break
                    if other in BLOCKS or stack[k][1] is None:
                        break
        elif inner is not None or zone is None:
            continue  # inline elements matter only where they are taken out
        if zone is None:
            # the heading of an article stays, though it stands in the article's own header
            keeps = name in HEADINGS and inner is not None and len(stack) > 1 and stack[-1][0] in ("header", "hgroup") and stack[-2][1] is not None and stack[-2][1] >= MAIN
            inner = stack[-2][1] if keeps else None
        elif inner is not None:
            inner = max(zone, inner)
        if name == "hgroup" and zone is None:
            inner = None
        stack.append((name, inner))
        held[name] += 1
        zone = inner
    if zone is None:
        zone = next((z for _, z in reversed(stack) if z is not None), UNMARKED)
    close_block()
    return out


def root_blocks(blocks: list[tuple[int, str]]) -> tuple[int, list[str]]:
    """The level of a page's main text, and the blocks of that level or surer ones.

    That is the surest level that occurs, unless the element for the main content holds more text outside of its articles than
    inside: then these are teasers, and the whole element is the text.
    """
    level = max((z for z, _ in blocks), default=UNMARKED)
    if level == ARTICLE:
        size = {z: sum(len(b) for y, b in blocks if y == z) for z in (MAIN, ARTICLE)}
        level = MAIN if size[MAIN] > size[ARTICLE] else ARTICLE
    return level, [b for z, b in blocks if z >= level]


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix in the suffix array of concatenated streams, sorted run tokens deep by doubling.

    Suffixes of equal rank have a common prefix of run tokens or more. The token at the end of each stream is made one of
    its own, so no common prefix goes across streams.
    """
    total = len(tokens)
    rank = tokens.copy()
    rank[ends] = int(tokens.max(initial=0)) + 1 + np.arange(len(ends))
    depth = 1
    while depth < run:
        top = int(rank.max(initial=0)) + 2
        further = np.full(total, 0, np.int64)
        further[: total - depth] = rank[depth:] + 1
        _, rank = np.unique(rank * top + further, return_inverse=True)
        depth *= 2
    return rank


def _cover(starts: np.ndarray, total: int, run: int) -> np.ndarray:
    """Which of so many tokens lie in a run that begins at one of the starts."""
    edge = np.zeros(total + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:total] > 0


def covered_tokens(streams: list[list[int]], run: int = RUN, pages: int = PAGES_ALIKE) -> list[np.ndarray]:
    """For each token stream, which tokens lie in a run that so many distinct ones of these streams hold."""
    once: dict[bytes, int] = {}
    arrays = [np.array(s, np.int64) for s in streams]
    alias = np.array([once.setdefault(a.tobytes(), len(once)) for a in arrays])
    sizes = np.array([len(a) + 1 for a in arrays])
    total = int(sizes.sum())
    page = np.repeat(np.arange(len(arrays)), sizes)
    tokens = np.zeros(total, np.int64)
    ends = np.cumsum(sizes) - 1
    inside = np.ones(total, bool)
    inside[ends] = False
    tokens[inside] = np.concatenate(arrays) if arrays else []
    rank = suffix_ranks(tokens, ends, run)
    # distinct pages of each rank
    ranks = int(rank.max(initial=-1)) + 1
    held = np.unique(rank * (len(once) + 1) + alias[page]) // (len(once) + 1)
    often = np.bincount(held, minlength=ranks) >= pages
    cover = _cover(np.flatnonzero(often[rank]), total, run)
    return [cover[e - len(a) : e] for e, a in zip(ends, arrays, strict=True)]


def _unique_words(block: list[str], cover: np.ndarray, run: int) -> list[str]:
    """The words of a block outside its covered stretches. A stretch shorter than a run is only the end of one that
    began in the block before, so it stays, unless it is the whole block."""
    if cover.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    keep = np.ones(len(block), bool)
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        keep[lo:hi] = hi - lo < run
    return [w for w, k in zip(block, keep, strict=True) if k]


_ODD = np.array([int.from_bytes(blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(RUN)], np.uint64)


def _hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict[str, int]):
    """Hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        self[word] = h = _hash_of(word)
        return h


class Chunk:
    """The token streams of some pages, one after the other, as hashes of their words and hosts.

    The border of two blocks is a token, so that a row of short blocks can be a run.
    """

    def __init__(self, hosts: list[str], texts: list[str], seen: WordHashes):
        if len(seen) > 200_000:
            seen.clear()
        self.words = [f"\n {t.replace('\n', ' \n ')} \n".split(" ") if t else ["\n"] for t in texts]
        self.sizes = np.array([len(w) + 1 for w in self.words])
        self.ends = np.cumsum(self.sizes) - 1
        self.total = int(self.sizes.sum())
        self.page = np.repeat(np.arange(len(texts)), self.sizes)
        host = np.array([_hash_of(f"host {h}") for h in hosts], np.uint64)
        tokens = np.zeros(self.total, np.uint64)
        for w, end in zip(self.words, self.ends, strict=True):
            tokens[end - len(w) : end] = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
        self.tokens = _mixed(tokens + host[self.page])
        self.stream = np.array([_hash_of(t) for t in texts], np.uint64)
        # where a run can begin: run tokens of one page, without its end
        self.starts = np.flatnonzero(self.page[RUN:] == self.page[: self.total - RUN]) if self.total > RUN else np.zeros(0, np.int64)

    def _grams(self, width: int) -> np.ndarray:
        n = self.total - width + 1
        return _mixed(sum(self.tokens[k : k + n] * _ODD[k] for k in range(width)))

    def least_parts(self) -> np.ndarray:
        """For each start of a run, the least hash of the run's parts."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        part = self._grams(PART)
        n = self.total - RUN + 1
        least = part[:n]
        for k in range(1, RUN - PART + 1):
            least = np.minimum(least, part[k : k + n])
        return least[self.starts]

    def runs(self) -> np.ndarray:
        """For each start of a run, the run's hash."""
        return self._grams(RUN)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)


def _holders(values: np.ndarray, streams: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a value and a page's hash, at most so many of one value, sorted."""
    order = np.lexsort((streams, values))
    v, s = values[order], streams[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    v, s = v[new], s[new]
    first = np.searchsorted(v, v)
    few = np.arange(len(v)) - first < most
    return v[few], s[few]


def _found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def short_keys(values: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes cut to a bucket and 32 bits more; the first round may take some for equal, which costs no run."""
    b = np.uint64(buckets)
    return ((values // b) & np.uint64(0xFFFFFFFF)) * b + values % b


def propose_parts(chunk: Chunk, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, hashes, nothing) of the parts to count; a part stands once for each page of the chunk, up to PAGES_ALIKE."""
    keys, _ = _holders(short_keys(chunk.least_parts(), buckets), chunk.stream[chunk.page[chunk.starts]], PAGES_ALIKE)
    place = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    keys, place = keys[order] // np.uint64(buckets), place[order]
    for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(place)) + 1):
        if len(at):
            yield int(place[at[0]]), keys[at].astype(np.uint32).tobytes(), b""


def propose_runs(chunk: Chunk, often: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, hashes, pages' hashes) of the runs whose least part is frequent, each with up to PAGES_ALIKE pages."""
    likely = _found(short_keys(chunk.least_parts(), buckets), often)
    if not likely.any():
        return
    starts = chunk.starts[likely]
    _, numbers = np.unique(chunk.tokens, return_inverse=True)
    rank = suffix_ranks(numbers.astype(np.int64), chunk.ends, RUN)[starts]
    # neighbours in the suffix array are one run: it is hashed once
    _, first, which = np.unique(rank, return_index=True, return_inverse=True)
    runs, pages = _holders(chunk.runs()[likely][first][which], chunk.stream[chunk.page[starts]], PAGES_ALIKE)
    place = (runs % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    runs, pages, place = runs[order], pages[order], place[order]
    for at in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(place)) + 1):
        yield int(place[at[0]]), runs[at].tobytes(), pages[at].tobytes()


def cut_texts(chunk: Chunk, texts: list[str], levels: list[int], runs: np.ndarray) -> list[tuple[str, int]]:
    """Main text of each page of a chunk, and how many of its tokens stand in repeated runs."""
    cover = _cover(chunk.starts[_found(chunk.runs(), runs)], chunk.total, RUN)
    out = []
    for text, level, words, end in zip(texts, levels, chunk.words, chunk.ends, strict=True):
        covered = cover[end - len(words) : end]
        if level >= ARTICLE or not covered.any():
            out.append((text, int(covered.sum())))
            continue
        kept, at = [], 1
        for block in (b.split(" ") for b in text.split("\n")):
            if rest := _unique_words(block, covered[at : at + len(block)], run=RUN):
                kept.append(" ".join(rest))
            at += len(block) + 1
        out.append(("\n".join(kept), int(covered.sum())))
    return out


def host_of(url: str = "url") -> F.Column:
    """The host of a url, in lower case; the url itself if it has none; empty for null."""
    c = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.lower(F.when(host != "", host).otherwise(c))


OWN = ("main_text", "main_chars", "repeated_tokens")


def _written(df: DataFrame) -> DataFrame:
    """As in common, but packed smaller: these are the texts of all pages."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one batch and one chunk."""
    for batch in batches:
        borders = np.flatnonzero(np.diff(batch.column("_chunk").to_numpy())) + 1
        for begin, end in zip([0, *borders], [*borders, batch.num_rows], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _with_hashes(parsed: DataFrame, found: DataFrame | None, work: Callable[[pa.RecordBatch, np.ndarray, WordHashes], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """Runs work on slices of pages, with the found hashes (_chunk, hashes) of their chunks or with all hashes.

    Few hashes go to every task; of many, each chunk gets its own by a join.
    """
    size = (found.agg(F.sum(F.length("hashes"))).first()[0] or 0) if found is not None else 0
    if size <= SENT_BYTES:
        parts = [bytes(r[0]) for r in found.select("hashes").toLocalIterator()] if size else []
        all_hashes = parsed.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(parts), np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = WordHashes()
            for piece in _slices(batches):
                yield from work(piece, all_hashes.value, seen)

        return parsed.mapInArrow(run, schema)

    def joined(pages: pa.Table, hashes: pa.Table) -> pa.Table:
        own = np.unique(np.frombuffer(b"".join(hashes.column("hashes").to_pylist()), np.uint64))
        seen = WordHashes()
        return pa.Table.from_batches([b for piece in _slices(pages.combine_chunks().to_batches()) for b in work(piece, own, seen)])

    return parsed.groupBy("_chunk").cogroup(found.groupBy("_chunk")).applyInArrow(joined, schema)


PROPOSED = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("pages", T.BinaryType())])


def _counted(proposed: DataFrame, buckets: int, short: bool) -> DataFrame:
    """_chunk and hashes: what stands in PAGES_ALIKE distinct pages over all chunks. One bucket is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(bucket: int, rows: list[dict]) -> pa.RecordBatch:
            parts = [np.frombuffer(r["hashes"], np.uint32 if short else np.uint64).astype(np.uint64) for r in rows]
            values = np.concatenate(parts)
            if not short:
                values, _ = _holders(values, np.concatenate([np.frombuffer(r["pages"], np.uint64) for r in rows]), PAGES_ALIKE)
            values, times = np.unique(values, return_counts=True)
            often = values[times >= PAGES_ALIKE]
            out = []
            for r, part in zip(rows, parts, strict=True):
                hit = np.unique(part[_found(part, often)])
                if len(hit):
                    out.append((r["_chunk"], (hit * np.uint64(buckets) + np.uint64(bucket) if short else hit).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.binary())], names=["_chunk", "hashes"])

        last, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["bucket"] != last:
                    yield decided(last, rows)
                    rows = []
                last = r["bucket"]
                rows.append(r)
        if rows:
            yield decided(last, rows)

    dealt = proposed.repartition(min(buckets, 2000), "bucket").sortWithinPartitions("bucket")
    return _written(dealt.mapInArrow(run, "_chunk long, hashes binary"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns but html, and main_text, main_chars (code points) and repeated_tokens.

    Pages are parsed where they are read; only hashes are shuffled, each chunk's equal ones together.
    """
    keep = [c for c in pages.columns if c != html and c not in OWN]
    kept = [T.StructField(c, pages.schema[c].dataType) for c in keep]
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"), host_of(url).alias("_host"))
    inner = [("_chunk", T.LongType()), ("_host", T.StringType()), ("_level", T.IntegerType()), ("_chars", T.LongType()), ("_text", T.StringType())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, chars = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            found, chunks, begin = [], [], 0

            def flush(end: int, batch: pa.RecordBatch = batch, found: list = found, chunks: list = chunks) -> pa.RecordBatch:
                narrow = batch.slice(begin, end - begin)
                columns = [*(narrow.column(c) for c in keep), pa.array(chunks, pa.int64()), narrow.column("_host"), pa.array([z for z, _ in found], pa.int32()), pa.array([len(t) for _, t in found], pa.int64()), pa.array([t for _, t in found], pa.string())]
                found.clear()
                chunks.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*keep, *(c for c, _ in inner)])

            for k, page in enumerate(batch.column("_html")):
                level, blocks = root_blocks(blocks_of(page.as_py()))
                text = "\n".join(blocks)
                if chars and chars + len(text) > CHUNK_CHARS:
                    if found:
                        yield flush(k)
                    begin = k
                    chunk, chars = chunk + 1, 0
                chars += len(text) + 1
                found.append((level, text))
                chunks.append(chunk)
            if found:
                yield flush(batch.num_rows)

    parsed = _written(rows.mapInArrow(parse, T.StructType([*kept, *(T.StructField(c, t) for c, t in inner)])))
    buckets = max(16, (parsed.agg(F.sum("_chars")).first()[0] or 0) // BUCKET_CHARS)
    narrow = parsed.select("_chunk", "_host", "_text")

    def chunk_of(piece: pa.RecordBatch, seen: WordHashes) -> tuple[Chunk, list[str]]:
        texts = piece.column("_text").to_pylist()
        return Chunk(piece.column("_host").to_pylist(), texts, seen), texts

    def proposals(propose: Callable[[Chunk, np.ndarray], Iterable[tuple[int, bytes, bytes]]]) -> Callable[[pa.RecordBatch, np.ndarray, WordHashes], Iterator[pa.RecordBatch]]:
        def work(piece: pa.RecordBatch, often: np.ndarray, seen: WordHashes) -> Iterator[pa.RecordBatch]:
            found = list(propose(chunk_of(piece, seen)[0], often))
            columns = [pa.array([piece.column("_chunk")[0].as_py()] * len(found), pa.int64()), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, names=PROPOSED.names)

        return work

    def cut(piece: pa.RecordBatch, runs: np.ndarray, seen: WordHashes) -> Iterator[pa.RecordBatch]:
        chunk, texts = chunk_of(piece, seen)
        done = cut_texts(chunk, texts, piece.column("_level").to_pylist(), runs)
        columns = [*(piece.column(c) for c in keep), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([k for _, k in done], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, *OWN])

    parts = _counted(_with_hashes(narrow, None, proposals(lambda chunk, _: propose_parts(chunk, buckets)), PROPOSED), buckets, short=True)
    runs = _counted(_with_hashes(narrow, parts, proposals(lambda chunk, often: propose_runs(chunk, often, buckets)), PROPOSED), buckets, short=False)
    schema = T.StructType([*kept, T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType()), T.StructField("repeated_tokens", T.LongType())])
    return _with_hashes(parsed, runs, cut, schema)


def html_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and the number of tokens in repeated runs."""
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"), "repeated_tokens")
