"""Evaluation passages inside training documents (problem 7): size-partitioned MinHash containment.

Passages are short and documents long, so whole-set similarity says nothing. Passages are put into
size classes; every passage is cut into overlapping blocks of its class, every document into
windows a little larger than a block. Block and window are compared by MinHash over five-word
shingles; pairs that agree in enough hashes are candidates. The shortest passages have too few
shingles for that: of them every shingle is looked up. A candidate counts if exact shingle
matches, chained along one stretch, hold at least half of the passage's words. Passages of fewer
words than a shingle and a block must occur whole, word by word.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table

SHINGLE = 5
HASHES = 32
#: Agreeing hashes between a block and a window that make a candidate.
AGREE = 3
#: A passage of n words is cut into blocks of a quarter of its words; classes of block sizes.
CLASSES = (4, 6, 8, 11, 16, 22, 32, 45, 64, 90, 128, 181, 256)
#: Passages under this many words are searched by all of their shingles, those under LEAST_WORDS as a whole.
EXACT_WORDS = 24
LEAST_WORDS = SHINGLE + CLASSES[0]
#: Share of a passage's words that one stretch must hold.
SHARE = 0.5
#: Words that may be missing from a stretch by replacement and still count as held.
GAP = 14
#: Words of a document within which a stretch must go on.
FAR = 2 * (GAP + SHINGLE)
#: Passages searched in one pass over the documents; more are searched in as many passes as needed,
#: so what is sent to the workers is bounded by this number, not by the size of the evaluation set.
PASS_ITEMS = 20_000

# Letters that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁԛԝвнкмтгґѵһӏαεορυικνχτηωɑɡıℓ", "aeopcyxijsdqwbhkmtrrvhlaeopuiknxtnwagil"
)
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")
_MARKUP = re.compile(r"<[^<>\n]{1,30}>|\[?\(?(?<![\d.])(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\)?\]?|&(?:#?\w{2,7});")
_WORDS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W_฀-๿぀-ヿ㐀-鿿]+")
# Hesitations dropped on both sides.
_FILLERS = frozenset("um uh er hmm erm uhm ah eh äh ähm hm euh heu ờ ơ ừm".split())


def words(text: str) -> list[str]:
    """The words of a text without case, marks, layout, invisible characters, look-alike letters and hesitations."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower().translate(LOOK_ALIKES)
    else:
        text = text.lower()
    return [w for w in _WORDS.findall(_MARKUP.sub(" ", text)) if w not in _FILLERS]


_A = (np.random.RandomState(97).randint(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.RandomState(98).randint(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(w: str) -> int:
    b = w.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) << 32 | zlib.crc32(b, 0xABCD1234)


def size_class(n_words: int) -> int | None:
    """The largest class not above a quarter of the words; None for passages that are searched exactly."""
    fit = [c for c in CLASSES if c <= n_words / 4]
    return fit[-1] if n_words >= EXACT_WORDS else None


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` word hashes; len(h) - n + 1 of them."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : k + size]) * _SEED
            out ^= out >> np.uint64(29)
    return out


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    return run_hashes(h, SHINGLE)


class Filter:
    """A bit table over hashes, sixteen bits or more for each of them; tells which values are surely absent."""

    def __init__(self, values: np.ndarray):
        self.bits = max(16, int(16 * max(1, len(values))).bit_length())
        at = self._place(values)
        self.table = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        np.bitwise_or.at(self.table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def _place(self, values: np.ndarray) -> np.ndarray:
        # Minima are small numbers, so their bits are mixed first.
        with np.errstate(over="ignore"):
            return (values * _SEED) >> np.uint64(64 - self.bits)

    def maybe(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values that may be among the hashes."""
        at = self._place(values)
        return np.flatnonzero((self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


class Lookup:
    """Hashes with their owners, found exactly: sorted, behind a filter."""

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.filter = values[order], owner[order], Filter(values)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``values``, owner) of every hit."""
        maybe = self.filter.maybe(values)
        lo, hi = np.searchsorted(self.values, values[maybe], "left"), np.searchsorted(self.values, values[maybe], "right")
        some = hi > lo
        m, lo, hi = maybe[some], lo[some], hi[some]
        if len(m) == 0:
            return m, m
        return np.repeat(m, hi - lo), np.concatenate([self.owner[x:y] for x, y in zip(lo, hi)])


@dataclass
class Index:
    """Passages of one pass: their words, ids, and per class and hash the sorted minima of their blocks."""

    passages: list[list[str]]
    ids: list[list[int]]
    minima: dict[int, tuple[np.ndarray, np.ndarray]]  # class -> (HASHES x blocks values), block -> passage

    def __post_init__(self):
        self.lookups = {c: [Lookup(values[j], np.arange(len(owner))) for j in range(HASHES)] for c, (values, owner) in self.minima.items()}
        hashes = [np.fromiter(map(_word_hash, p), np.uint64, len(p)) for p in self.passages]
        self.shingles = []
        for h in hashes:
            at: dict[int, list[int]] = defaultdict(list)
            for i, s in enumerate(shingle_hashes(h).tolist()):
                at[s].append(i)
            self.shingles.append(at)
        # Every shingle of the short passages; the shortest ones as one run of words each.
        of = [(p, s) for p, h in enumerate(hashes) if LEAST_WORDS <= len(h) < EXACT_WORDS for s in self.shingles[p]]
        self.exact = Lookup(np.asarray([s for _, s in of], dtype=np.uint64), np.asarray([p for p, _ in of], dtype=np.int64))
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, h in enumerate(hashes):
            if 0 < len(h) < LEAST_WORDS:
                runs[len(h)].append((int(run_hashes(h, len(h))[0]), p))
        self.whole = {n: Lookup(np.asarray([x for x, _ in rs], dtype=np.uint64), np.asarray([p for _, p in rs], dtype=np.int64)) for n, rs in runs.items()}

    def __getstate__(self):
        return self.passages, self.ids, self.minima

    def __setstate__(self, s):
        self.passages, self.ids, self.minima = s
        self.__post_init__()


def build_index(items: list[tuple[int, str]]) -> Index:
    """Passages that are equal in their words are searched once and reported for all of their items."""
    by: dict[tuple, list[int]] = defaultdict(list)
    for i, passage in items:
        by[tuple(words(passage or ""))].append(i)
    passages, ids = [], []
    blocks: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for p, own in sorted(by.items()):
        if not p:
            continue
        c = size_class(len(p))
        if c is not None:
            s = shingle_hashes(np.fromiter(map(_word_hash, p), np.uint64, len(p)))
            size = c - SHINGLE + 1
            for at in range(0, max(1, len(s) - size + 1), max(1, c // 2)):
                blocks[c].append((len(passages), s[at : at + size]))
        passages.append(list(p))
        ids.append(sorted(own))
    minima = {}
    for c, bs in blocks.items():
        values = np.empty((HASHES, len(bs)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, (_, s) in enumerate(bs):
                values[:, k] = (s[None, :] * _A[:, None] + _B[:, None]).min(axis=1)
        minima[c] = (values, np.asarray([o for o, _ in bs]))
    return Index(passages, ids, minima)


def candidates(shingles: np.ndarray, starts: np.ndarray, index: Index) -> dict[tuple[int, int], list[int]]:
    """(document, passage) -> window starts, for documents laid end to end; document d owns shingles starts[d]:starts[d+1]."""
    found: dict[tuple[int, int], list[int]] = defaultdict(list)
    if len(shingles) == 0:
        return found
    at, owner = index.exact.find(shingles)
    doc = np.searchsorted(starts, at, "right") - 1
    for d, p, a in zip(doc.tolist(), owner.tolist(), (at - starts[doc]).tolist()):
        found[(d, p)].append(a)
    docs = np.flatnonzero(np.diff(starts) > 0)
    for c, (_, owner) in index.minima.items():
        # Half-block chunks; a window is five of them, so any stretch of two blocks' length minus a chunk lies in one.
        half = max(1, c // 2)
        lens = np.diff(starts)[docs]
        n_chunks = -(-lens // half)
        total = int(n_chunks.sum())
        first = np.concatenate(([0], np.cumsum(n_chunks)[:-1]))
        doc_of = np.repeat(np.arange(len(docs)), n_chunks)
        chunk_at = starts[docs][doc_of] + (np.arange(total) - first[doc_of]) * half
        last = first[doc_of] + n_chunks[doc_of] - 1
        votes: list[np.ndarray] = []
        span = np.arange(total)
        with np.errstate(over="ignore"):
            for j in range(HASHES):
                low = np.minimum.reduceat(shingles * _A[j] + _B[j], chunk_at)
                win = low.copy()
                for k in range(1, 5):
                    win = np.minimum(win, low[np.minimum(span + k, last)])
                w, b = index.lookups[c][j].find(win)
                if len(w):
                    votes.append(w.astype(np.int64) * len(owner) + b)
        if not votes:
            continue
        pair, n = np.unique(np.concatenate(votes), return_counts=True)
        for p in pair[n >= AGREE].tolist():
            w, b = divmod(p, len(owner))
            found[(int(docs[doc_of[w]]), int(owner[b]))].append(int(chunk_at[w] - starts[docs[doc_of[w]]]))
    return found


def held(doc: list[str], hashes: list[int], near: list[int], passage: list[str], at: dict[int, list[int]]) -> float:
    """The largest share of the passage's words found in one stretch of the document around the candidate windows."""
    n = len(passage)
    best = 0
    reach = 2 * n + 40
    spans: list[list[int]] = []
    for w in sorted(near):
        a, b = max(0, w - reach), min(len(hashes), w + reach)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in spans:
        # Chains: a match follows the newest one that it moves on from by about as much on both sides.
        # Only chains that ended within FAR words can be followed, by the places where they ended.
        chains: list[list] = []  # last match, first match, passage words held
        ended: dict[int, list[int]] = defaultdict(list)
        for j in range(a, b):
            for i in at.get(hashes[j], ()):
                best_k = -1
                for i0 in range(max(0, i - GAP - SHINGLE), i):
                    near_ends = ended.get(i0)
                    if not near_ends:
                        continue
                    near_ends[:] = [k for k in near_ends if chains[k][1] == i0 and j - chains[k][0] <= FAR]
                    for k in near_ends:
                        dj, di = j - chains[k][0], i - i0
                        if dj > 0 and abs(dj - di) <= 2 + max(di, dj) // 4:
                            best_k = max(best_k, k)
                if best_k >= 0:
                    chains[best_k][:2] = j, i
                    chains[best_k][4].update(range(i, i + SHINGLE))
                else:
                    best_k = len(chains)
                    chains.append([j, i, j, i, set(range(i, i + SHINGLE))])
                ended[i].append(best_k)
        for j1, i1, j0, i0, got in chains:
            if (i1 + SHINGLE - i0) + 2 * GAP < SHARE * n:
                continue
            ok = set(got)
            _extend(doc, passage, j1 + SHINGLE, i1 + SHINGLE, 1, ok)
            _extend(doc, passage, j0 - 1, i0 - 1, -1, ok)
            inside = range(min(ok), max(ok) + 1)
            # Words replaced inside the stretch belong to it, as long as most of it is exact.
            if len(ok) >= 0.6 * len(inside):
                best = max(best, len(inside))
    return best / n


def _extend(doc: list[str], passage: list[str], j: int, i: int, step: int, ok: set[int]) -> None:
    """Carry a stretch on word by word past replaced and inserted words, until two in a row are foreign."""
    misses = 0
    while 0 <= i < len(passage) and 0 <= j < len(doc) and misses < 2:
        if passage[i] == doc[j]:
            ok.add(i)
            misses = 0
            i, j = i + step, j + step
        elif 0 <= j + step < len(doc) and passage[i] == doc[j + step]:
            j += step
        else:
            misses += 1
            i, j = i + step, j + step


def search(texts: list[str], index: Index) -> list[tuple[int, int, float]]:
    """(text, passage, share) of every passage of which a text holds at least SHARE in one stretch."""
    docs = [words(t) if t else [] for t in texts]
    memo: dict[str, int] = {}
    flat: list[int] = []
    for d in docs:
        for w in d:
            h = memo.get(w)
            if h is None:
                h = memo[w] = _word_hash(w)
            flat.append(h)
    all_hashes = np.asarray(flat, dtype=np.uint64)
    parts, starts, at = [], [0], 0
    for d in docs:
        s = shingle_hashes(all_hashes[at : at + len(d)])
        parts.append(s)
        starts.append(starts[-1] + len(s))
        at += len(d)
    shingles = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    out = []
    lists: dict[int, list[int]] = {}
    for (d, p), near in candidates(shingles, np.asarray(starts), index).items():
        if d not in lists:
            lists[d] = parts[d].tolist()
        share = held(docs[d], lists[d], near, index.passages[p], index.shingles[p])
        if share >= SHARE:
            out.append((d, p, share))
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    for n, lookup in index.whole.items():
        at, owner = lookup.find(run_hashes(all_hashes, n))
        doc = np.searchsorted(first, at, "right") - 1
        hits = {(d, p) for a, d, p in zip(at.tolist(), doc.tolist(), owner.tolist()) if a + n <= first[d + 1] and docs[d][a - first[d] : a - first[d] + n] == index.passages[p]}
        out += [(d, p, 1.0) for d, p in sorted(hits)]
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", pass_items: int = PASS_ITEMS) -> DataFrame:
    """``key, item, share``: every document that holds an evaluation passage, whole or by half, with each leaked item.

    Null and empty texts and passages are never found; passages under LEAST_WORDS words only where they
    occur whole. Items with
    the same passage are all listed; repeated items once. The documents are scanned without a
    shuffle, once per ``pass_items`` items; a document is searched whole, whatever its length.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = items.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).cast("bigint"), passage).distinct()
    passes = max(1, -(-own.count() // pass_items))
    schema = f"{key} {kinds[key]}, {item} int, share double"
    result = None
    for n in range(passes):
        rows = own.where(F.pmod(F.xxhash64(passage), F.lit(passes)) == n).collect()
        shared = spark.sparkContext.broadcast(build_index(sorted((r[0], r[1]) for r in rows)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                texts = b.column(text).to_pylist()
                at = 0
                while at < len(texts):  # a few million characters at a time bound the memory
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end] or "") <= 3_000_000):
                        size += len(texts[end] or "")
                        end += 1
                    rows = [(at + d, i, s) for d, p, s in search(texts[at:end], index) for i in index.ids[p]]
                    if rows:
                        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], [key, item, "share"])
                    at = end

        part = docs.select(key, text).mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "passage"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: documents per item and the largest share held."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("max_share"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLES: dict[str, str] = {}
