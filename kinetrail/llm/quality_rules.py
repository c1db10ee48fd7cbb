"""Quality rules: exact counts of a text, and a calibrated word and character n-gram model against fixed thresholds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import kernels as K, linear
from kinetrail.llm.labelled import platt, sample

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(column: pa.Array) -> np.ndarray:
    """The columns of COUNTS for each text, over the whole text. Lines and word windows compare by 64-bit hashes."""
    data, offs = K.buffers(column)
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for lo, hi in K.groups(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = K.word_bounds(part, o)
        out[lo:hi, 0] = np.diff(first)
        out[lo:hi, 1] = K.sums(K.NOT_SPACE[part] & ((part & 0xC0) != 0x80), o)
        out[lo:hi, 2] = K.sums(_SYMBOL[part], o)
        out[lo:hi, 3] = _dup_lines(part, o, starts)
        out[lo:hi, 4] = _repeat_words(K.span_hashes(part, starts, ends), first)
    return out


def _dup_lines(part: np.ndarray, o: np.ndarray, words: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(part == 10)
    ends = np.sort(np.concatenate([breaks, o[1:]]), kind="stable")
    starts = np.sort(np.concatenate([breaks + 1, o[:-1]]), kind="stable")
    filled = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[filled], ends[filled]
    doc = np.searchsorted(o, starts, "right") - 1
    same, _ = K.distinct(doc, K.span_hashes(part, starts, ends))
    n = len(o) - 1
    return np.bincount(doc, minlength=n) - np.bincount(same, minlength=n)


def _repeat_words(h: np.ndarray, first: np.ndarray, window: int = 3) -> np.ndarray:
    n = np.maximum(np.diff(first) - window + 1, 0)
    doc = K.runs(n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    key = np.zeros(len(at), np.uint64)
    for j in range(window):
        key = key * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + j]
    key = K.mix(key)
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        k, d = key[order], doc[order]
        equal = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    covered = np.zeros(len(h) + window, bool)
    for j in range(window):
        covered[at[same] + j] = True
    return K.sums(covered[: len(h)], first)


class QualityRules:
    """judge(): a row per document with the counts, base_failed, probability and kept.

    The model learns from at most max_rows labelled documents outside the held-out fold; every fifth of them (by order of the hash) is
    set aside to calibrate its probabilities. base_failed: fewer than min_words words, or 100 * n_repeat_words > max_repeat * n_words.
    kept: not base_failed and probability >= threshold. A null text counts as empty (no words, so base_failed). Repeated rows each get their
    row; extra columns are ignored; an empty table gives an empty result. Without labels the probability is 0.5.
    """

    def __init__(self, max_rows: int = 6000, held_out: int | None = 1, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50, features: linear.Features | None = None):
        self.max_rows, self.held_out, self.threshold = max_rows, held_out, threshold
        self.min_words, self.max_repeat = min_words, max_repeat
        self.features = features or linear.Features(word_orders=(1, 2), char_orders=(3, 4))
        self.model: linear.Model | None = None

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityRules:
        data = linear.rows(docs, sample(labels, "quality", self.max_rows, self.held_out), self.features)
        model = linear.train([r for i, r in enumerate(data) if i % 5], self.features)
        aside = data[::5]
        if aside:
            margin = np.array([model.bias + model.weights[idx] @ x for _, _, idx, x in aside], float)
            model.slope, model.shift = platt(margin, np.array([r[1] for r in aside], float))
        self.model = model
        return self

    def judge(self, docs: DataFrame) -> DataFrame:
        model = linear.spread(docs.sparkSession, self.model)
        threshold, min_words, max_repeat = self.threshold, self.min_words, self.max_repeat

        def run(batches):
            for b in batches:
                text = b.column("text")
                c, p = counts(text), np.round(model.value.probability(text), 9)
                failed = (c[:, 0] < min_words) | (100 * c[:, 4] > max_repeat * c[:, 0])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, probability double, kept boolean")
