"""Labelled rows for the models of this subpackage: folds, bounded samples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column | str, folds: int = 3) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(-1)).cast("long").cast("string").cast("binary")), F.lit(folds))


def sample(labels: DataFrame, label: str, max_rows: int, held_out: int | None = 1) -> DataFrame:
    """At most max_rows labelled ids (doc_id, y), first by a hash of the id, without the held-out fold. Repeated ids count once (largest label)."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        rows = rows.where(fold("doc_id") != held_out)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, y and the whole text of the picked rows (picked is bounded, so it is broadcast); one text for an id, the smallest that is not null."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # a hot id leaves one row for each task of the scan
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b), fitted by Newton steps with a weak pull to a = 1, b = 0."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w, e = p * (1 - p), p - y
        g = np.array([(e * score).sum() + (a - 1), e.sum() + 0.1 * b])
        h = np.array([[(w * score * score).sum() + 1, (w * score).sum()], [(w * score).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Isotonic:
    """Non-decreasing fit by pooling adjacent violators; between knots it is linear."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(s), float(s)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        # one pseudo count keeps small pools off 0 and 1
        value = [(b[0] + 0.02) / (b[1] + 0.04) for b in blocks]
        self.x = np.array([x for b in blocks for x in b[2:]]) if blocks else np.zeros(1)
        self.y = np.maximum.accumulate(np.repeat(value, 2)) if blocks else np.full(1, 0.5)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
