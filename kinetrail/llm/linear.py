"""Hashed n-gram logistic regression trained with follow-the-regularised-leader updates (FTRL-proximal)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetrail.llm import kernels as K
from kinetrail.llm.labelled import texts_of

U64 = np.uint64


@dataclass(frozen=True)
class Features:
    """Families of hashed n-grams. Tokens are runs of letters and digits or runs of symbols; case is kept. A family's values
    are its counts as shares of the family's total in the text, times scale. fold_repeats: a word after itself is one bigram, whatever the word."""

    word_orders: tuple[int, ...] = (1, 2)
    char_orders: tuple[int, ...] = ()
    bits: int = 18
    scale: float = 30.0
    fold_repeats: bool = True

    @property
    def families(self) -> int:
        return len(self.word_orders) + len(self.char_orders)

    def slots(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """For ranges of texts: first and last text, and by family each n-gram's slot and the texts' bounds in it."""
        data, offs = K.buffers(column)
        for lo, hi in K.groups(offs):
            part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            out = []
            if self.word_orders:
                starts, ends, first = K.token_bounds(part, o)
                h = K.span_hashes(part, starts, ends)
            for family, order in enumerate([*self.word_orders, *self.char_orders]):
                if family < len(self.word_orders):
                    key, bounds = self._runs(h, first, order)
                    slot = (key >> U64(64 - self.bits)).astype(np.int64)
                else:
                    slot, bounds = self._chars(part, o, order)
                out.append((slot + (family << self.bits), bounds))
            yield lo, hi, out

    def _runs(self, h: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        if order == 1:
            return h, first
        n = np.maximum(np.diff(first) - order + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)
        key = np.full(len(at), order, U64)
        for j in range(order):
            key = key * U64(0x9FB21C651E98DF25) + h[at + j]
        if order == 2 and self.fold_repeats:
            key[h[at] == h[at + 1]] = U64(2)
        return key * U64(0x9E3779B97F4A7C15), bounds

    def _chars(self, data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of order bytes (at most four) inside each text."""
        if len(data) < order:
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        key = np.zeros(len(data) - order + 1, np.uint32)
        for j in range(order):
            key |= data[j : len(data) - order + 1 + j].astype(np.uint32) << np.uint32(8 * j)
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        n = np.maximum(np.diff(offs) - order + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        keep = np.ones(len(key), bool)
        for j in range(1, order):
            cut = offs[1:-1] - j
            keep[cut[(cut >= 0) & (cut < len(key))]] = False
        # texts shorter than order give no run of their own, and none that crosses their end is kept
        return key[keep].astype(np.int64), bounds


@dataclass
class Model:
    features: Features
    weights: np.ndarray = field(repr=False)
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, column: pa.Array) -> np.ndarray:
        """Sparse dot products with the weights; an empty text has the bias alone."""
        out = np.full(len(column), self.bias)
        for lo, hi, families in self.features.slots(column):
            for slot, bounds in families:
                n = np.diff(bounds)
                out[lo:hi] += self.features.scale * K.sums(self.weights[slot].astype(np.float64), bounds) / np.maximum(n, 1)
        return out

    def probability(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(column) + self.shift, -30, 30)))


def rows(docs: DataFrame, picked: DataFrame, features: Features) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Feature rows of the picked labelled documents, made on the executors; in an order by hashes of the ids. The number of rows is picked's bound. Slots and
    their counts (in as few bytes as the largest needs) come as Arrow batches; the values follow from them."""

    def run(batches):
        for b in batches:
            idx, n = [], []
            for lo, hi, families in features.slots(b.column("text")):
                for i in range(hi - lo):
                    found = [np.unique(s[bounds[i] : bounds[i + 1]], return_counts=True) for s, bounds in families]
                    idx.append(np.concatenate([u for u, _ in found]).astype(np.int32).tobytes())
                    counts = np.concatenate([c for _, c in found])
                    n.append(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(idx, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "y", "idx", "n"])

    out = []
    for b in texts_of(docs, picked).mapInArrow(run, "doc_id long, y int, idx binary, n binary").toArrow().to_batches():
        for doc, y, idx, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "idx", "n")), strict=True):
            slot = np.frombuffer(idx, np.int32)
            counts = np.frombuffer(n, f"u{len(n) // max(1, len(slot)) or 1}")
            family = slot >> features.bits
            total = np.bincount(family, counts, features.families)
            out.append((doc, y, slot, (counts * (features.scale / np.maximum(total, 1))[family]).astype(np.float32)))
    return sorted(out, key=lambda r: (_order(r[0]), r[0]))


def _order(i: int) -> int:
    return int(K.mix(np.array([i]).astype(U64))[0])


def train(data: list, features: Features, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1, epochs: int = 3) -> Model:
    """Plain FTRL-proximal over the rows, in their order, epochs times. Both classes weigh the same; the shift is taken back from the bias."""
    size = features.families << features.bits
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = wb = 0.0
    ys = np.array([r[1] for r in data], float)
    share = float(np.clip(ys.mean(), 1e-3, 1 - 1e-3)) if len(ys) else 0.5
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for _ in range(epochs):
        for _, y, idx, x in data:
            p = 1 / (1 + np.exp(-np.clip(wb + w[idx] @ x, -30, 30)))
            g = weight[y] * (p - y)
            gi = g * x
            zi, ni = z[idx], n[idx]
            step = (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / alpha
            zi += gi - step * w[idx]
            ni += gi * gi
            z[idx], n[idx] = zi, ni
            w[idx] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            step = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - step * wb
            nb += g * g
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
    return Model(features, w.astype(np.float32), float(wb))


def spread(spark: SparkSession, model):
    return spark.sparkContext.broadcast(model)
