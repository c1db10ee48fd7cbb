"""Chooses features and regularisers of the n-gram models on labels that a score may use: python tests/llm/tuning.py [folder]

The held-out fold (crc32 of the id modulo 3 is 1) is never read. Of the rest, models learn from remainder 0 and are measured on remainder 2 and the other way round.
"""

import os
import sys
import zlib
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from kinetrail.llm import linear  # noqa: E402


def allowed(folder, label="quality"):
    """doc_id -> (fold, label, text) without the held-out fold."""
    labels, docs = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    both = labels[labels[label].isin([0, 1])].merge(docs[["doc_id", "text"]], on="doc_id").sort_values("doc_id")
    return [(i, f, y, t) for i, y, t in zip(both.doc_id, both[label], both.text, strict=True) if (f := zlib.crc32(str(i).encode()) % 3) != 1]


def feature_rows(rows, features):
    out = []
    for i, _, y, t in rows:
        idx, val = [], []
        for _, _, families in features.slots(pa.array([t], pa.large_string())):
            for s, _ in families:
                u, n = np.unique(s, return_counts=True)
                idx.append(u)
                val.append(n * (features.scale / max(1, len(s))))
        out.append((i, y, np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)))
    return out


def measured(rows, features, **options):
    """Accuracy and log loss over both directions."""
    data, fold = feature_rows(rows, features), np.array([r[1] for r in rows])
    right, loss = [], []
    for learn, test in ((0, 2), (2, 0)):
        some = sorted((r for r, f in zip(data, fold, strict=True) if f == learn), key=lambda r: linear._order(r[0]))
        model = linear.train(some, features, **options)
        for _, y, idx, x in (r for r, f in zip(data, fold, strict=True) if f == test):
            p = 1 / (1 + np.exp(-np.clip(model.bias + model.weights[idx] @ x, -30, 30)))
            right.append((p >= 0.5) == y)
            loss.append(-np.log(max(1e-9, p if y else 1 - p)))
    return float(np.mean(right)), float(np.mean(loss))


if __name__ == "__main__":
    rows = allowed(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
    print(len(rows), "rows")
    for chars, repeats, l1 in product(((), (3, 4)), (False, True), (0.02, 0.1, 0.3)):
        features = linear.Features(char_orders=chars, fold_repeats=repeats)
        print(f"chars {chars}, fold_repeats {repeats}, l1 {l1}: accuracy {{:.4f}}, log loss {{:.4f}}".format(*measured(rows, features, l1=l1)), flush=True)
