"""Mixing sources to target weights by soft membership.

A classifier learned from labelled rows gives every document a posterior over domains. Document rates r >= least minimise the squared
distance between the expected domain tokens sum_d r_d n_d p_dk and the targets; of all such rates they are those nearest to 1. They have the form
max(least, 1 + p . price) with one price for each domain, which Newton steps with a line search find in the dual, a convex function of K variables. Each step is
one distributed sum over the table of distinct posteriors (rounded to three digits) with their tokens; only a few times K * K numbers for each partition
reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import kernels as K, linear
from kinetrail.llm.labelled import texts_of
from kinetrail.llm.store import written

#: Digits of a posterior.
DIGITS = 3
#: Weight of the prices' squares in the dual, which bounds the prices where the targets cannot be met; the tokens' total counts as 1.
RIDGE = 1e-9
#: Lengths of a Newton step that one sum tries.
LENGTHS = 0.25 ** np.arange(12)


@dataclass
class Posterior:
    """One model for each domain over the same features; posteriors are the softmax of their margins."""

    domains: list[str]
    features: linear.Features
    weights: np.ndarray  # domains x slots
    bias: np.ndarray

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text and its posteriors, rounded; a text without words has uniform ones."""
        n, k = len(column), len(self.domains)
        margin, words = np.tile(self.bias, (n, 1)), np.zeros(n, np.int64)
        for lo, hi, families in self.features.slots(column):
            for f, (slot, bounds) in enumerate(families):
                size = np.diff(bounds)
                if not f:
                    words[lo:hi] = size
                for j in range(k):
                    margin[lo:hi, j] += self.features.scale * K.sums(self.weights[j][slot].astype(np.float64), bounds) / np.maximum(size, 1)
        e = np.exp(margin - margin.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        p[words == 0] = 1 / k
        return words, np.round(p, DIGITS)


def rated(p: np.ndarray, price: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(least, 1 + p @ price)


def dual(p: np.ndarray, n: np.ndarray, prices: np.ndarray, least: float) -> np.ndarray:
    """For each row of prices the sums of the dual's value, gradient and second derivatives over the documents: prices x (1 + K + K * K)."""
    k, out = p.shape[1], []
    for price in prices:
        z, low = p @ price, least - 1
        free = z >= low
        value = np.where(free, z + z * z / 2, least * (z - low) + low + low * low / 2)
        held = p * (n * free)[:, None]
        out.append(np.concatenate([[n @ value], (n * rated(p, price, least)) @ p, (held.T @ p).ravel()]))
    return np.array(out).reshape(len(prices), 1 + k + k * k)


def solve(total: Callable[[np.ndarray], np.ndarray], goal: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Prices, expected tokens, steps and whether the prices are optimal. total: dual()'s sums over all documents; goal as a share of all tokens.

    The steps end when each domain is within tolerance of its own goal, or when the dual's gradient shows that no rates come nearer.
    """
    k = len(goal)
    price, sums = np.zeros(k), total(np.zeros((1, k)))[0]
    value = sums[0]
    for step in range(steps + 1):
        tokens, slope = sums[1 : k + 1], sums[1 : k + 1] - goal + RIDGE * price
        met = (np.abs(tokens - goal) <= tolerance * np.where(goal > 0, goal, 1)).all()
        if met or np.abs(slope).max() <= 1e-9 * max(1.0, goal.sum()) or step == steps:
            return price, tokens, step, bool(met or np.abs(slope).max() <= 1e-9 * max(1.0, goal.sum()))
        way = -np.linalg.lstsq(sums[k + 1 :].reshape(k, k) + RIDGE * np.eye(k), slope, rcond=None)[0]
        tried = price + LENGTHS[:, None] * way
        found = total(tried)
        values = found[:, 0] - tried @ goal + RIDGE / 2 * (tried**2).sum(1)
        slopes = np.abs(found[:, 1 : k + 1] - goal + RIDGE * tried).max(1)
        # values that differ by rounding only: the smaller gradient
        i = min(np.flatnonzero(values <= values.min() + 1e-13 * (1 + abs(values.min()))), key=lambda j: slopes[j])
        if values[i] >= value and slopes[i] >= np.abs(slope).max():
            return price, tokens, step, bool(np.abs(slope).max() <= 1e-6 * max(1.0, goal.sum()))
        price, sums, value = tried[i], found[i], values[i]
    raise AssertionError


class Mixer:
    """fit() learns domains and rates; rates() gives doc_id, n_tokens, posterior, rate, copies; mix() repeats or drops documents so.

    labelled: a table (doc_id, domain); at most max_rows of its rows train. targets: domain -> weight. Total tokens stay as they are, or, with grow=True, grow just
    so far that no domain must shrink. copies: the rate's whole part, and one more if a seeded hash of the id falls below the rest. Null texts have no
    tokens and rate 1, as have empty ones (they weigh nothing). Repeated rows each get their row; ties in the posterior stay soft; extra
    columns are kept by mix() and ignored by rates(). An empty table gives an empty result; without labels posteriors are uniform.
    report: tokens and goal by domain; met, whether each domain is within tolerance of its own goal; optimal, whether no rates come nearer. Where the
    targets are not met, fit() warns.
    """

    def __init__(self, targets: dict[str, float], max_rows: int = 2000, steps: int = 60, tolerance: float = 1e-4, grow: bool = False, least: float = 0.0, seed: int = 5):
        total = sum(targets.values())
        self.targets = {k: v / total for k, v in sorted(targets.items())}
        self.max_rows, self.steps, self.tolerance, self.grow, self.least, self.seed = max_rows, steps, tolerance, grow, least, seed
        self.features = linear.Features(word_orders=(1,), bits=16)
        self.posterior: Posterior | None = None
        self.price = np.zeros(len(self.targets))
        self.report: dict = {}

    def fit(self, docs: DataFrame, labelled: DataFrame) -> Mixer:
        domains = list(self.targets)
        known = F.create_map(*(F.lit(x) for i, d in enumerate(domains) for x in (d, i)))
        picked = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
        picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.max_rows).select("doc_id", known[F.col("domain")].cast("int").alias("y"))
        data = linear.rows(docs, picked, self.features)
        models = [linear.train([(i, int(y == k), idx, x) for i, y, idx, x in data], self.features, epochs=2) for k in range(len(domains))]
        self.posterior = Posterior(domains, self.features, np.stack([m.weights for m in models]), np.array([m.bias for m in models]))
        self._solve(docs)
        return self

    def _soft(self, docs: DataFrame) -> DataFrame:
        model = linear.spread(docs.sparkSession, self.posterior)

        def run(batches):
            for b in batches:
                n, p = model.value(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")

    def _solve(self, docs: DataFrame) -> None:
        k, least = len(self.targets), self.least
        table = self._soft(docs).where("n_tokens > 0").groupBy("posterior").agg(F.sum("n_tokens").alias("n"))
        table = written(table, "posteriors")

        def total(of, shape):
            def run(batches):
                acc = np.zeros(shape)
                for b in batches:
                    p, n = b.column("posterior").flatten().to_numpy().reshape(-1, k), b.column("n").to_numpy()
                    if len(p):
                        acc += of(p, n.astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()], pa.list_(pa.float64()))], ["x"])

            rows = [r.x for r in table.mapInArrow(run, "x array<double>").collect()]
            return np.sum(rows, axis=0).reshape(shape) if rows else np.zeros(shape)

        now = total(lambda p, n: n @ p, (k,))
        size, weights = now.sum(), np.array(list(self.targets.values()))
        self.price = np.zeros(k)
        if not size:
            return
        goal = weights * (max(now / np.maximum(weights, 1e-12)) if self.grow else size)
        price, tokens, step, optimal = solve(lambda prices: total(lambda p, n: dual(p, n / size, prices, least), (len(prices), 1 + k + k * k)), goal / size, self.steps, self.tolerance)
        self.price, tokens = price, tokens * size
        met = bool((np.abs(tokens - goal) <= self.tolerance * np.where(goal > 0, goal, size)).all())
        self.report = {"tokens": dict(zip(self.targets, tokens, strict=True)), "goal": dict(zip(self.targets, goal, strict=True)), "steps": step, "met": met, "optimal": optimal}
        if not met:
            warnings.warn(f"targets are not met{', no rates come nearer' if optimal else ', steps ran out'}: {self.report}", stacklevel=3)

    def _copies(self, ids: np.ndarray, rate: np.ndarray) -> np.ndarray:
        u = (K.mix(ids.astype(np.int64).astype(np.uint64) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        return np.floor(rate + u).astype(np.int64)

    def _rate(self, p: np.ndarray, n: np.ndarray, price: np.ndarray) -> np.ndarray:
        rate = np.round(rated(p, price, self.least), 6)
        rate[n == 0] = 1.0
        return rate

    def rates(self, docs: DataFrame) -> DataFrame:
        spread, mixer = docs.sparkSession.sparkContext.broadcast(self.price), self._light()

        def run(batches):
            for b in batches:
                n = b.column("n_tokens").to_numpy()
                p = np.array(b.column("posterior").to_pylist()).reshape(b.num_rows, -1)
                rate = mixer._rate(p, n, spread.value)
                ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("posterior"), pa.array(rate), pa.array(mixer._copies(ids, rate))], ["doc_id", "n_tokens", "posterior", "rate", "copies"])

        return self._soft(docs).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double, copies long")

    def mix(self, docs: DataFrame) -> DataFrame:
        spread, mixer = docs.sparkSession.sparkContext.broadcast((self.posterior, self.price)), self._light()

        def run(batches):
            posterior, price = spread.value
            for b in batches:
                n, p = posterior(b.column("text"))
                ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
                copies = mixer._copies(ids, mixer._rate(p, n, price))
                at = np.repeat(np.arange(b.num_rows), copies)
                for lo in range(0, len(at), max(1, b.num_rows)):
                    yield b.take(pa.array(at[lo : lo + max(1, b.num_rows)]))

        return docs.mapInArrow(run, docs.schema)

    def _light(self) -> Mixer:
        """Settings without the model, for the executors."""
        other = Mixer(self.targets, least=self.least, seed=self.seed)
        return other
