"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased). The CGK walk reads a window with one
pointer: step j emits the word under the pointer and moves on if that word's random bit for step j says so (the bits of a word repeat every eight steps). Windows at a small edit
distance give embeddings at a small Hamming distance, as the walks fall into step again after an edit. Items are dealt into classes of size (powers of two); the sampled steps of a
class spread over a walk through a window of that size. A repetition hashes the sampled steps of one walk; two windows that agree there are candidates. Windows begin at
every word of a document. The items' side enters the table at every word of the item whose sampled steps stay inside it, which makes up for edits near a
window's head. An alignment becomes a candidate when two of the w * repetitions keys agree on it.

The walks miss some passages near the allowed edits, short ones above all. So each item is also cut into one piece more than the edits allowed: at least one
piece is left whole by any of them, and an alignment by a whole piece is a candidate, too. No passage within the allowed edits is missed. Before verification
a candidate's stretch must hold as many words of the item as the edits leave.

Every candidate alignment is verified: the smallest edit distance in words between the item and a stretch of the document around it (bit-parallel,
both ends free in the document) must not exceed max_error of the item's words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import kernels as K

U64 = np.uint64
#: Items and bytes of one broadcast block; more take more passes over the documents. (An item of more bytes is a block of its own or shares one by chance.)
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Steps after which a word's bits repeat.
PERIOD = 8
#: Items of fewer words enter the table by all runs of words of a piece's size, longer ones by their pieces.
SHORT = 14
#: Words of candidate stretches that are tested at once.
TESTED = 1 << 21


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.word_bounds(data, offs, K.ALNUM)
    return K.span_hashes(data, starts, ends, lower=True), first


def distance(item: list[int], text: list[int]) -> int:
    """Smallest edit distance between all of item and any stretch of text."""
    m = len(item)
    if not m:
        return 0
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        peq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        best = min(best, score)
    return best


class Walks:
    """Seeded CGK walks with sampled steps for windows of each class of size."""

    def __init__(self, samples: int = 3, repetitions: int = 4, seed: int = 1):
        self.samples, self.seed = samples, seed
        self.salts = np.random.default_rng(seed).integers(1, 1 << 62, repetitions).astype(np.uint64)

    @staticmethod
    def size_class(words):
        """floor(log2) of an item's words; items of fewer than eight share a class."""
        return np.maximum(np.floor(np.log2(np.maximum(words, 1))).astype(np.int64), 3)

    def steps(self, size: int, repetition: int) -> list[int]:
        """Sampled steps of a class: the first, one in each further part of a walk that moves through about three quarters of the window."""
        edges = np.linspace(1, 3 << (size - 1), self.samples).astype(int)
        rng = np.random.default_rng([self.seed, size, repetition])
        return [0, *(int(rng.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False))]

    def keys(self, words: np.ndarray, classes: list[int]):
        """For each repetition and class: class, the key of the walk from every word, and the last word that its samples read (relative). Long walks go by powers of the
        walk through one period, so a sample costs the logarithm of its step. Behind the last word a walk stands still on an empty word."""
        n = len(words)
        padded = np.append(words, U64(0))
        for r, salt in enumerate(self.salts):
            bits = (K.mix(padded ^ salt) & U64(0xFF)).astype(np.uint8)
            bits[n] = 0
            within = [np.arange(n + 1, dtype=np.int32)]
            for j in range(PERIOD):
                within.append(within[j] + ((bits[within[j]] >> j) & 1))
            powers = [within.pop()]
            for c in classes:
                key = np.full(n, int(salt) ^ c, U64)
                for step in self.steps(c, r):
                    at, times, level = None, step // PERIOD, 0
                    while times >> level:
                        if level == len(powers):
                            powers.append(powers[-1][powers[-1]])
                        if times >> level & 1:
                            at = powers[level][:n] if at is None else powers[level][at]
                        level += 1
                    at = within[step % PERIOD][:n] if at is None else within[step % PERIOD][at]
                    key = key * U64(0xC2B2AE3D27D4EB4F) + padded[at]
                yield c, K.mix(key), at - np.arange(n, dtype=np.int32)


class Items:
    """One block of benchmark items with the table of their keys."""

    def __init__(self, rows: list[tuple[int, str]], max_error: float, walks: Walks):
        self.ids = [r[0] for r in rows]
        self.walks, self.max_error = walks, max_error
        data, offs = K.buffers(pa.array([r[1] for r in rows], pa.large_string()))
        h, first = _words(data, offs)
        self.words = [h[first[i] : first[i + 1]] for i in range(len(rows))]
        self.size = np.diff(first)
        self.slack = (max_error * self.size).astype(np.int64) + 1
        item, at = K.runs(np.diff(first)), np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        left = np.repeat(np.diff(first), np.diff(first)) - at
        found = []
        size = Walks.size_class(self.size)
        self.classes = [int(c) for c in np.unique(size[self.size > 0])]
        for c, key, reach in walks.keys(h, self.classes):
            ok = (reach < left) & (size[item] == c)
            found.append((key[ok], item[ok], at[ok]))
        # runs of words, of which one survives the allowed edits
        self.runs = set()
        for i, w in enumerate(self.words):
            pieces = int(max_error * len(w)) + 1
            if 0 < len(w) < SHORT:
                size = max(1, len(w) // pieces)
                self.runs.add(size)
                key = self.grams(w, size)
                found.append((key, np.full(len(key), i), np.arange(len(key))))
            elif len(w):
                cuts = np.arange(pieces + 1) * len(w) // pieces
                for size in set(np.diff(cuts).tolist()) - {0}:
                    self.runs.add(size)
                    place = cuts[:-1][np.diff(cuts) == size]
                    found.append((self.grams(w, size)[place], np.full(len(place), i), place))
        key, self.item, self.at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], self.item[order], self.at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.key >> U64(42)).astype(np.int64)] = True
        # the words of each item, as bits of a table
        self.salt = K.mix(np.arange(1, len(rows) + 1).astype(U64))
        self.shift = U64(64 - max(16, int(16 * len(h)).bit_length()))
        self.held = np.zeros(1 << (64 - int(self.shift)), bool)
        self.held[(K.mix(h ^ self.salt[item]) >> self.shift).astype(np.int64)] = True

    @staticmethod
    def grams(words: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(words) - size + 1)
        key = np.full(n, size, U64)
        for j in range(size):
            key = key * U64(0x9FB21C651E98DF25) + words[j : j + n]
        return K.mix(key)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, item, the position's place in the item and whether a run of words agrees, for all agreeing keys."""
        at, lo, hi, runs = [], [], [], []
        streams = [(k, False) for _, k, _ in self.walks.keys(words, self.classes)] + [(self.grams(words, s), True) for s in sorted(self.runs)]
        for key, run in streams:
            p = np.flatnonzero(self.bits[(key >> U64(42)).astype(np.int64)])
            a, b = np.searchsorted(self.key, key[p]), np.searchsorted(self.key, key[p], "right")
            ok = b > a
            at.append(p[ok])
            lo.append(a[ok])
            hi.append(b[ok])
            runs.append(np.full(ok.sum(), run))
        if not streams:  # a block without any word
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool)
        at, lo, hi, runs = (np.concatenate(x) for x in (at, lo, hi, runs))
        n = hi - lo
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(at, n), self.item[i], self.at[i], np.repeat(runs, n)

    def possible(self, words: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretch from a to b holds as many words of the item as the allowed edits leave."""
        least, size = self.size[item] - (self.max_error * self.size[item]).astype(np.int64), b - a
        out, ends = np.zeros(len(item), bool), np.cumsum(size)
        lo = 0
        while lo < len(item):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + TESTED, "right")))
            n = size[lo:hi]
            heads = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(heads, n) + np.repeat(a[lo:hi], n)
            held = self.held[(K.mix(words[at] ^ np.repeat(self.salt[item[lo:hi]], n)) >> self.shift).astype(np.int64)]
            sums = np.concatenate([[0], np.cumsum(held)])
            out[lo:hi] = sums[heads + n] - sums[heads] >= least[lo:hi]
            lo = hi
        return out

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, first word of the stretch) for each pair of a text and an item in it."""
        out = []
        data, offs = K.buffers(column)
        for lo, hi in K.groups(offs):
            words, first = _words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            pos, item, at, runs = self.candidates(words)
            doc = np.searchsorted(first, pos, "right") - 1
            start = pos - at
            order = np.lexsort((start, item, doc))
            doc, item, start, runs = doc[order], item[order], start[order], runs[order]
            if not len(doc):
                continue
            slack = self.slack[item]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
            heads = np.flatnonzero(new)
            stops = np.append(heads[1:], len(doc))
            # an alignment needs two agreeing keys of walks, or a piece
            good = (stops - heads > 1) | np.logical_or.reduceat(runs, heads)
            heads, stops = heads[good], stops[good]
            doc, item, head, tail = doc[heads], item[heads], start[heads], start[stops - 1]
            gap = self.slack[item]
            begin, end = np.maximum(head - gap, first[doc]), np.minimum(tail + self.size[item] + gap, first[doc + 1])
            good = self.possible(words, item, begin, end)
            for d, t, a, b in zip(doc[good].tolist(), item[good].tolist(), begin[good].tolist(), end[good].tolist(), strict=True):
                w = self.words[t]
                region = words[a:b]
                most = int(self.max_error * len(w))
                # words that the stretch shares with the item bound the distance from below
                if np.isin(w, region).sum() >= len(w) - most:
                    e = distance(w.tolist(), region.tolist())
                    if e <= most:
                        out.append((lo + d, t, e, a - int(first[d])))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, t, e, a in out:
            best[d, t] = min(best.get((d, t), (e, a)), (e, a))
        return [(d, t, *x) for (d, t), x in sorted(best.items())]


class Decontaminate:
    """Finds benchmark items in documents (hits) and returns the documents without any (clean).

    max_error: allowed edits, as a share of an item's words. Null or empty texts and items match nothing; repeated rows each get their
    hits, repeated items count once; extra columns are kept by clean() and ignored by hits(). Ties between stretches of one document go to the first. An
    empty benchmark leaves all documents. Items are a query set: they are read in blocks of bounded size, each searched in one scan
    of the documents without a shuffle.
    """

    def __init__(self, max_error: float = 0.3, walks: Walks | None = None):
        self.max_error, self.walks = max_error, walks or Walks()

    def _blocks(self, benchmark: DataFrame):
        rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        n = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
        for i in range(n):
            block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
            yield benchmark.sparkSession.sparkContext.broadcast(Items(sorted((r.item_id, r.text) for r in block), self.max_error, self.walks))

    def hits(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """A row per document and item: doc_id, item_id, distance in words, start_word, item_words."""
        schema = "doc_id long, item_id long, distance int, start_word int, item_words int"
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        out = docs.sparkSession.createDataFrame([], schema)
        for items in self._blocks(benchmark):

            def run(batches, items=items):
                x = items.value
                for b in batches:
                    found = x.search(b.column("text"))
                    ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()), pa.array([len(x.words[f[1]]) for f in found], pa.int32())], ["doc_id", "item_id", "distance", "start_word", "item_words"])

            out = out.unionByName(docs.mapInArrow(run, schema))
        return out

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        for items in self._blocks(benchmark):

            def run(batches, items=items):
                for b in batches:
                    keep = np.ones(b.num_rows, bool)
                    keep[[f[0] for f in items.value.search(b.column("text"))]] = False
                    yield b.filter(pa.array(keep))

            docs = docs.mapInArrow(run, docs.schema)
        return docs
