"""Vectorised text kernels on Arrow buffers, shared by the operators of this subpackage.

A batch of texts is one byte buffer with offsets. Words are found by a 256-entry byte table, and each word
gets a 64-bit hash from one prefix sum: ``sum(value[byte] * P**i)`` is divided by ``P**start`` (P is odd, so it has
an inverse modulo 2**64). Nothing here loops over bytes or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = ALNUM[ord("A") : ord("Z") + 1] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants)."""
    x = np.array(x, dtype=U64, ndmin=1)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_VALUE_LOWER = _VALUE[LOWER]
_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i in [0, n]."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("up", _P), ("down", _PINV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def groups(offs: np.ndarray, size: int = BLOCK, docs: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), lo + docs, n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (len(offs) entries)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = table[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = word[cut]
    end[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans given in order of their ends; spans may overlap by little."""
    value, out, i, n = (_VALUE_LOWER if lower else _VALUE), np.zeros(len(starts), U64), 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + BLOCK, "right")), i + 1)
        base = int(starts[i:j].min())
        top = int(ends[i:j].max())
        up, down = powers(top - base)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(value[data[base:top]] * up[: top - base], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * down[s]
        i = j
    return mix(out ^ ((ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)))


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 2, 2, 2 ... : the index of each group, repeated."""
    return np.repeat(np.arange(len(counts)), counts)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words and each one's document; a document of fewer words has one, an empty one none."""
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = runs(n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    left = np.minimum(counts, size)[doc]
    h = np.full(len(doc), 0x243F6A8885A308D3, U64) + left.astype(U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for j in range(size):
        h = h * U64(0xC2B2AE3D27D4EB4F) + np.where(left > j, padded[at + j], U64(0))
    return mix(h), doc


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order of document, then hash; at most 65,536 documents."""
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over consecutive ranges first[i]:first[i + 1]; empty ranges give 0."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


#: Classes of bytes for mixed tokens: white space, letters and digits, the rest.
CLASS = np.where(SPACE, 0, np.where(ALNUM, 1, 2)).astype(np.int8)


def token_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_bounds for runs of letters and digits and runs of symbols, as tokens of their own."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    c = CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = c[1:] != c[:-1]
    edge[offs[(offs > 0) & (offs < n)]] = True
    starts = np.flatnonzero(edge[:-1] & (c != 0))
    return starts, np.flatnonzero(edge[1:] & (c != 0)) + 1, np.searchsorted(starts, offs)
