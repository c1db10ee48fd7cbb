"""N-gram Jaccard join by partitioning the universe of shingles (pigeonhole on segments), verified exactly.

Two sets of sizes l <= s with Jaccard similarity t or more differ in at most tau = floor((l + s)(1 - t) / (1 + t)) elements.
Every size band has its own scheme: hashing deals the universe into m > tau segments, so on at least one segment the two
sets agree. A set stands in the index of its own band with the subset hash of every segment that it touches; it probes its own
and the next larger band (a partner is at most 1/t times as large, and bands grow by that factor). In bands of small sets the
index also holds the one-deletion neighbours of each subset; a probe then gives each segment -1 (skip), 0 (equal) or 1
(one deletion) and takes the cheapest allocation whose units (0 gives one, 1 gives two) reach tau + 1. The cost of a signature falls
geometrically with the size of its subset, as the length of its list does. A set that touches too few segments to
reach tau + 1 also gives the signatures of its empty segments; if a probe is in that state and nothing else matches, its partner is too
(their difference is at least the partner's units), so no pair is lost.

Lists are not expanded into all pairs. Lists of two are pairs. Every member of a longer list is paired with the list's hub, the member that is in most lists. What passes
exact verification makes components; more rounds may pair the members of lists in several components with another hub; what
is still open gives its pairs across components, pruned by a bound that is never wrong (bits of two parity sketches differ at most as often as the sets do); a long open list is
cut into blocks, and each pair of blocks is a unit of work of its own. Equal sets are one node from the start.

A signature that very many sets share is found by a count over a sample of the sets, which only decides on routing: its list is dealt over several parts of the key space and
stays one list. Verification sends the smaller party of each pair to its centre, the set with more pairs, whose elements travel once for each part of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinetrail.llm import kernels as K
from kinetrail.llm.components import components
from kinetrail.llm.store import written

U64 = np.uint64
INDEX, PROBE = 1, 2
#: Sets of up to this size get one-deletion neighbourhoods.
SMALL = 24
#: Needed documents up to this number are broadcast (8 MB of ids); beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 500_000
#: Members from which on a signature's list is dealt over parts, the share of the sets (one in so many) that is counted for it, and how many such lists are known at most.
HEAVY, COUNTED, KNOWN = 200_000, 64, 100_000
#: Sets and elements in a block of a component whose links are counted: two blocks are what a task holds.
UNIT, UNIT_ELEMENTS = 1_000, 1_000_000
#: Members in a row of a list, in a block of an open list, and pairs of a centre in one part.
ROW, BLOCK, PAIRS = 50_000, 4_000, 4_000
_MASK = (1 << 64) - 1


class Scheme:
    """Bands of set sizes and their segments for a threshold of num/den."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * den // num)))
        self.edges = np.array(self.low[1:], np.int64)

    def tau(self, total):
        """Most differing elements of two sets of so many elements together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, n):
        return np.searchsorted(self.edges, n, "right")

    def top(self, n):
        """Size of the largest partner."""
        return n * self.den // self.num

    def segments(self, band: int) -> int:
        last = self.low[band + 1] - 1
        if last <= SMALL:
            return max(self.tau(2 * last) + 1, 2)
        return max(self.tau(2 * last) + 2, math.ceil(last * 0.36))


def _signatures(e: np.ndarray, n: int, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of one set with mixed elements e."""
    keys, roles = [], []
    own = int(s.band(n))
    for band in (own, own + 1):
        index = band == own
        top = min(s.top(n), s.low[band + 1] - 1)
        if top < s.low[band]:
            continue
        m, need = s.segments(band), int(s.tau(n + top)) + 1
        at = (e % U64(m)).astype(np.int64)
        size = np.bincount(at, minlength=m)
        total = np.zeros(m, U64)
        np.add.at(total, at, e)
        salt = (np.arange(m, dtype=np.int64) + (band << 40)).astype(U64) * U64(0x9E3779B97F4A7C15)
        full = K.mix(total ^ salt)
        used = np.flatnonzero(size)
        near = s.low[band + 1] - 1 <= SMALL
        units = int((size[used] > 1).sum() * near) + len(used)
        bound = int(s.tau(2 * n)) + 1
        role = np.full(m, INDEX * index, np.int8)
        role[size == 0] = 0
        one = np.zeros(m, bool)
        if units < need:
            role[used] |= PROBE
            one[used] = near
        else:
            steps = [(0.05 ** size[i], 0, i) for i in used]
            if near:
                steps += [(size[i] * (0.01 + 0.05 ** (size[i] - 1)), 1, i) for i in used if size[i] > 1]
                steps.sort()
                left = need
                for _, kind, i in steps:
                    if left <= 0:
                        break
                    if kind and not role[i] & PROBE:
                        left -= 1
                    role[i] |= PROBE
                    one[i] |= bool(kind)
                    left -= 1
            else:
                best = used[np.argsort(-size[used], kind="stable")[:need]]
                role[best] |= PROBE
        short_probe, short_index = units < need, index and units < bound
        if short_probe or short_index:
            role[size == 0] = INDEX * short_index | PROBE * short_probe
        keep = role > 0
        keys.append(full[keep])
        roles.append(role[keep])
        if near:
            cut = K.mix((total[at] - e) ^ salt[at])
            cut_role = (INDEX * index | PROBE * one[at]).astype(np.int8)
            ok = (size[at] > 1) & (cut_role > 0)
            keys.append(cut[ok])
            roles.append(cut_role[ok])
    return (np.concatenate(keys), np.concatenate(roles)) if keys else (np.zeros(0, U64), np.zeros(0, np.int8))


def _signatures_large(e: np.ndarray, sizes: np.ndarray, s: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many sets of one band beyond SMALL, at once: keys, roles and each key's set. e: elements, set by set."""
    keys, roles, owners = [], [], []
    k = len(sizes)
    own = int(s.band(int(sizes[0])))
    doc = K.runs(sizes)
    for band in (own, own + 1):
        index = band == own
        top = np.minimum(s.top(sizes), s.low[band + 1] - 1)
        m = s.segments(band)
        need = s.tau(sizes + top) + 1
        probes = top >= s.low[band]
        if not index and not probes.any():
            continue
        cell = doc * m + (e % U64(m)).astype(np.int64)
        size = np.bincount(cell, minlength=k * m)
        order = np.argsort(cell, kind="stable")
        c = np.zeros(len(e) + 1, U64)
        np.cumsum(e[order], out=c[1:])
        stop = np.cumsum(size)
        total = (c[stop] - c[stop - size]).reshape(k, m)
        size = size.reshape(k, m)
        salt = (np.arange(m, dtype=np.int64) + (band << 40)).astype(U64) * U64(0x9E3779B97F4A7C15)
        used = size > 0
        units = used.sum(1)
        # the largest subsets first: rank of each segment within its set
        rank = np.empty((k, m), np.int32)
        np.put_along_axis(rank, np.argsort(-np.minimum(size, 127).astype(np.int8), axis=1, kind="stable"), np.arange(m, dtype=np.int32)[None, :], 1)
        short_probe, short_index = probes & (units < need), (units < s.tau(2 * sizes) + 1) & index
        role = (used * INDEX * index).astype(np.int8)
        role |= ((used & (rank < need[:, None]) & probes[:, None]) * PROBE).astype(np.int8)
        for i in np.flatnonzero(short_probe | short_index):
            role[i, ~used[i]] = INDEX * short_index[i] | PROBE * short_probe[i]
        row, col = np.nonzero(role)
        keys.append(K.mix(total[row, col] ^ salt[col]))
        roles.append(role[row, col])
        owners.append(row)
    return (np.concatenate(keys), np.concatenate(roles), np.concatenate(owners)) if keys else (np.zeros(0, U64), np.zeros(0, np.int8), np.zeros(0, np.int64))


def _parity(e: np.ndarray, n: int) -> bytes:
    """Parity of the elements in each of a power of two of cells, 4 n to 8 n: sets just below the threshold differ in nearly as many bits as elements."""
    bits = max(64, 4 << int(n).bit_length())
    odd = (np.bincount((e >> U64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts: the first text's number, sorted distinct shingles, the set sizes, and set hashes."""
    data, offs = K.buffers(column)
    for lo, hi in K.groups(offs):
        part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = K.word_bounds(part, o)
        h, doc = K.shingles(K.span_hashes(part, starts, ends, lower=True), first, words)
        doc, h = K.distinct(doc, h)
        sizes = np.bincount(doc, minlength=hi - lo)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        e = K.mix(h ^ U64(0x5851F42D4C957F2D))
        ident = K.mix(K.sums(e, edge) + sizes.astype(U64)) & U64(_MASK >> 1)
        yield lo, h, sizes, ident


def _profile(words: int):
    def run(batches):
        for b in batches:
            n, ident, sketch = [], [], []
            for _, h, sizes, ids in _sets(b.column("text"), words):
                e, edge = K.mix(h ^ U64(0x5851F42D4C957F2D)), np.concatenate([[0], np.cumsum(sizes)])
                n.append(sizes)
                ident.append(ids)
                sketch += [_parity(e[edge[i] : edge[i + 1]], int(sizes[i])) for i in range(len(sizes))]
            if n:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(ident).astype(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])

    return run


class Heavy:
    """Signatures with very long lists and the number of parts of each."""

    def __init__(self, keys: list[int], parts: list[int]):
        order = np.argsort(np.array(keys, np.int64).astype(U64))
        self.keys, self.parts = np.array(keys, np.int64).astype(U64)[order], np.array(parts, np.int64)[order]

    def of(self, key: np.ndarray) -> np.ndarray:
        """Each key's place in the table, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def _pack(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_parts: int, heavy: Heavy) -> Iterator[pa.RecordBatch]:
    key, node, n, role = (np.concatenate(x) for x in zip(*parts, strict=True))
    route, at = key, heavy.of(key)
    some = np.flatnonzero(at >= 0)
    if len(some):
        route = key.copy()
        route[some] = K.mix(key[some] + K.mix(node[some].astype(U64)) % heavy.parts[at[some]].astype(U64))
    part = ((route >> U64(33)) % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    stops = np.searchsorted(part[order], np.arange(n_parts + 1))
    key, node, n, role = key[order], node[order], n[order], role[order]
    rows = np.flatnonzero(np.diff(stops)).tolist()
    cols = [[x[stops[i] : stops[i + 1]].tobytes() for i in rows] for x in (key, node, n.astype(np.uint32), role)]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "key", "node", "n", "role"])


def _signed(column: pa.Array, words: int, s: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, nodes, sizes and roles of the texts' sets, each set once in a range of texts."""
    for _, h, sizes, ident in _sets(column, words):
        e, edge = K.mix(h ^ U64(0x5851F42D4C957F2D)), np.concatenate([[0], np.cumsum(sizes)])
        _, once = np.unique(ident, return_index=True)
        once = once[sizes[once] > 0]
        for i in once[sizes[once] < s.low[int(s.band(SMALL + 1))]]:
            key, role = _signatures(e[edge[i] : edge[i + 1]], int(sizes[i]), s)
            yield key, np.full(len(key), ident[i]), np.full(len(key), sizes[i]), role
        large = once[sizes[once] >= s.low[int(s.band(SMALL + 1))]]
        bands = s.band(sizes[large])
        for band in np.unique(bands):
            mine = large[bands == band]
            step = max(1, 400_000 // max(s.segments(int(band) + 1), int(sizes[mine].max())))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                els = np.concatenate([e[edge[i] : edge[i + 1]] for i in some])
                key, role, owner = _signatures_large(els, sizes[some], s)
                yield key, ident[some][owner], sizes[some][owner], role


def _index(words: int, num: int, den: int, n_parts: int, heavy: Heavy):
    """Texts to signature blocks: one row for each part of the key space and about 10 MB of text; more where there are many parts, so that rows do not get too short."""
    most = max(1_000_000, min(64 * n_parts, 6_000_000))

    def run(batches):
        s, held, size = Scheme(num, den), [], 0
        for b in batches:
            for found in _signed(b.column("text"), words, s):
                held.append(found)
                size += len(found[0])
                if size > most:
                    yield from _pack(held, n_parts, heavy)
                    held, size = [], 0
        if held:
            yield from _pack(held, n_parts, heavy)

    return run


def _keys(words: int, num: int, den: int):
    def run(batches):
        s = Scheme(num, den)
        for b in batches:
            for key, node, _, _ in _signed(b.column("text"), words, s):
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(node.astype(np.int64))], ["key", "node"])

    return run


def _group(key, node, n, role, num: int, den: int, heavy: Heavy) -> tuple:
    """Of one part's signatures: the pairs of lists of two, and the longer lists. The members of a heavy list are a part of it, whatever their roles."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    keep = np.zeros(len(key), bool)
    keep[1:] |= same
    keep[:-1] |= same
    keep |= heavy.of(key[order]) >= 0
    order = order[keep]
    key, node, n, role = key[order], node[order], n[order], role[order]
    if not len(key):
        return (np.zeros(0, U64),) * 2 + ([],)
    order = np.lexsort((node, n, key))
    key, node, n, role = key[order], node[order], n[order], role[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(new)
    role = np.bitwise_or.reduceat(role, at)
    key, node, n = key[at], node[at], n[at]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)
    count = np.diff(np.append(start, len(key)))
    some = np.bitwise_or.reduceat(role, start)
    shared = heavy.of(key[start]) >= 0
    live = ((count > 1) & ((some & PROBE) > 0) & ((some & INDEX) > 0)) | shared
    # a list of two is a pair; entries of a list are in order of size and node
    first = start[live & (count == 2) & ~shared]
    first = first[n[first + 1] * num <= n[first] * den]
    pairs = np.unique(np.stack([node[first], node[first + 1]], 1), axis=0) if len(first) else np.zeros((0, 2), U64)
    # longer lists, each once
    big = live & ((count > 2) | shared)
    if not big.any():
        return pairs[:, 0], pairs[:, 1], []
    ident = K.mix(np.add.reduceat(K.mix(node * U64(4) + role.astype(U64)), start))
    ident[shared] = K.mix(key[start][shared])
    _, once = np.unique(ident[big], return_index=True)
    picked = np.flatnonzero(big)[once]
    lists = []
    for i in picked:
        for k, lo in enumerate(range(int(start[i]), int(start[i] + count[i]), ROW)):
            hi = min(lo + ROW, int(start[i] + count[i]))
            lists.append((int(ident[i]) & (_MASK >> 1), k, bool(shared[i]), *(x[lo:hi].astype(t).tobytes() for x, t in ((node, U64), (n, np.uint32), (role, np.int8)))))
    return pairs[:, 0], pairs[:, 1], lists


def _match(num: int, den: int, heavy: Heavy):
    """A part of the key space to candidate pairs (bucket null) and rows of longer lists, packed. place: the row's place in its list."""
    names = ["a", "b", "bucket", "place", "nodes", "sizes", "roles"]

    def run(batches):
        held, part = ([], [], [], []), 0
        for b in batches:
            for i in range(b.num_rows):
                part = b.column("part")[i].as_py()
                for x, c in zip(held, ("key", "node", "n", "role"), strict=True):
                    x.append(b.column(c)[i].as_py())
        if not held[0]:
            return
        cols = [np.frombuffer(b"".join(x), t) for x, t in zip(held, (U64, U64, np.uint32, np.int8), strict=True)]
        del held
        a, b, lists = _group(cols[0], cols[1], cols[2].astype(np.int64), cols[3], num, den, heavy)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), *[pa.nulls(len(a), pa.binary())] * 3], names)
        for lo in range(0, len(lists), 2000):
            bucket, place, shared, *blobs = zip(*lists[lo : lo + 2000], strict=True)
            place = [((part + 1) << 32 if many else 0) + k for k, many in zip(place, shared, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(bucket), pa.int64())] * 2, pa.array(bucket, pa.int64()), pa.array(place, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names)

    return run


def _members(batches):
    """Packed lists to their members."""
    for b in batches:
        for i, bucket in enumerate(b.column("bucket").to_pylist()):
            cols = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("nodes", np.int64), ("sizes", np.uint32), ("roles", np.int8))]
            for lo in range(0, len(cols[0]), 50_000):
                part = [c[lo : lo + 50_000] for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), bucket)), pa.array(part[0]), *(pa.array(c.astype(np.int32)) for c in part[1:])], ["bucket", "node", "n", "role"])


def _folded(x: bytes, bits: int) -> np.ndarray:
    v = np.frombuffer(x, np.uint8)
    while len(v) * 8 > bits:
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return v


def _prune(num: int, den: int):
    """Pairs whose parity sketches differ in more bits than the sets may differ in elements go."""

    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (den - num) // (den + num)
            sa, sb = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = np.zeros(len(na), bool)
            for i in range(len(na)):
                bits = min(len(sa[i]), len(sb[i])) * 8
                ok[i] = np.bitwise_count(_folded(sa[i], bits) ^ _folded(sb[i], bits)).sum() <= most[i]
            yield b.filter(pa.array(ok)).select(["a", "b"])

    return run


def _verify(num: int, den: int):
    """Rows in order of centre and part, the centre's own elements first, to the pairs that pass."""

    def run(batches):
        now, mine = None, np.zeros(0, U64)
        for b in batches:
            a, c, ok = b.column("center").to_pylist(), b.column("member").to_pylist(), np.zeros(b.num_rows, bool)
            part, blobs = b.column("part").to_pylist(), b.column("x")
            for i in range(b.num_rows):
                x = np.frombuffer(blobs[i].as_buffer(), U64)
                if c[i] is None:
                    now, mine = (a[i], part[i]), x.copy()
                    continue
                assert now == (a[i], part[i])
                at = np.searchsorted(mine, x)
                inter = int((mine[np.minimum(at, len(mine) - 1)] == x).sum())
                ok[i] = den * inter >= num * (len(mine) + len(x) - inter)
            yield b.filter(pa.array(ok)).select(["center", "member"])

    return run


def _degrees(num: int, den: int):
    """Rows in order of unit, block and size: the sets of one block of a component or of two. To each set's number of links within the unit (of one block) or to
    the other block (of two). A probe's elements are marked among the unit's; one gather over the sets of fitting size gives all its intersections."""

    def count(cross, rows):
        block, node, blobs = zip(*rows, strict=True)
        node, sizes = np.array(node), np.array([len(x) // 8 for x in blobs])
        vocabulary, e = np.unique(np.frombuffer(b"".join(blobs), U64), return_inverse=True)
        edge, mark, degree = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(vocabulary), bool), np.zeros(len(rows), np.int64)
        cut = block.count(block[0])
        other = sizes[cut:] if cross else sizes
        low = (cut if cross else 0) + np.searchsorted(other, -(-sizes[:cut] * num // den))
        high = (cut if cross else 0) + np.searchsorted(other, sizes[:cut] * den // num, "right")
        for i in range(cut):
            j, k = int(low[i]) if cross else i + 1, int(high[i])
            if j >= k:
                continue
            mine = e[edge[i] : edge[i + 1]]
            mark[mine] = True
            inter = np.add.reduceat(mark.take(e[edge[j] : edge[k]]), edge[j:k] - edge[j], dtype=np.int64)
            mark[mine] = False
            ok = den * inter >= num * (sizes[i] + sizes[j:k] - inter)
            degree[i] += ok.sum()
            degree[j:k] += ok
        some = degree > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some], pa.int64()), pa.array(degree[some], pa.int64())], ["node", "n_links"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            blobs = b.column("x").to_pylist()
            for i, (component, lo, hi, block, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("component", "lo", "hi", "block", "node")), strict=True)):
                if (component, lo, hi) != now and rows:
                    yield count(now[1] != now[2], rows)
                    rows = []
                now = (component, lo, hi)
                rows.append((block, node, blobs[i]))
        if rows:
            yield count(now[1] != now[2], rows)

    return run


def _elements(words: int):
    def run(batches):
        for b in batches:
            nodes, blobs = [], []
            for _, h, sizes, ident in _sets(b.column("text"), words):
                edge = np.concatenate([[0], np.cumsum(sizes)])
                nodes.append(ident)
                blobs += [h[edge[i] : edge[i + 1]].tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).astype(np.int64) if nodes else [], pa.int64()), pa.array(blobs, pa.binary())], ["node", "x"])

    return run


def _noded(words: int):
    """Rows with their set's node as a last column."""

    def run(batches):
        for b in batches:
            nodes = [ident for _, _, _, ident in _sets(b.column("text"), words)]
            yield b.append_column("_node", pa.array(np.concatenate(nodes).astype(np.int64) if nodes else [], pa.int64()))

    return run


def _across(num: int, den: int):
    """Members of two blocks of a list (or of one), ordered by list, blocks and size, to pairs across components that the sketches allow."""

    def pairs(unit, rows):
        node, comp, n, role, block = (np.array(x) for x in list(zip(*rows, strict=True))[:5])
        bits = 8 * min(len(r[5]) for r in rows)
        # one sketch size for the list: its sizes lie within two bands, so this folds once at most
        sketch = np.stack([_folded(r[5], bits) for r in rows]).view(U64)
        cross = unit[1] != unit[2]
        for i in np.flatnonzero(role & PROBE):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * den // num, "right")))
            j = j[(comp[j] != comp[i]) & (role[j] & INDEX > 0) & (not cross or block[j] != block[i])]
            for lo in range(0, len(j), 20_000):
                k = j[lo : lo + 20_000]
                apart = np.bitwise_count(sketch[k] ^ sketch[i]).sum(1, dtype=np.int64)
                k = k[apart <= (n[i] + n[k]) * (den - num) // (den + num)]
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), node[i])), pa.array(node[k])], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for t in batches:
            for bucket, lo, hi, *row in zip(*(t.column(c).to_pylist() for c in ("bucket", "lo", "hi", "node", "comp", "n", "role", "block", "sketch")), strict=True):
                if (bucket, lo, hi) != now and rows:
                    yield from pairs(now, rows)
                    rows = []
                now = (bucket, lo, hi)
                rows.append(row)
        if rows:
            yield from pairs(now, rows)

    return run


class JaccardJoin:
    """Similarity self-join of documents on word shingles.

    similar(docs) returns a row per document: doc_id, n_shingles, component_id, n_links (links of its set to other sets, all of them; with every_link false only
    those that the join followed, which spares a component's sets the comparison with each other). Null text is empty; an empty set links with nothing and is its own component. Words compare with A-Z
    lower-cased. Repeated rows and equal texts share a node; rows that share an id but not the text are linked each by its own text. A row whose doc_id is null keeps its row; it takes
    the component of its set. Extra columns are ignored, so clashing names do no harm. Sets are compared by 64-bit shingle hashes. An empty table gives an empty result.
    heavy, block, pairs, unit: sizes from which on a list, an open list, a centre's pairs and a component are cut; they change no result.
    """

    def __init__(self, words: int = 5, num: int = 75, den: int = 100, rounds: int = 1, heavy: int = HEAVY, counted: int = COUNTED, block: int = BLOCK, pairs: int = PAIRS, every_link: bool = True, unit: int = UNIT):
        self.words, self.num, self.den, self.rounds, self.every_link = words, num, den, rounds, every_link
        self.heavy, self.counted, self.block, self.pairs, self.unit = heavy, counted, block, pairs, unit

    def similar(self, docs: DataFrame) -> DataFrame:
        slim, nodes, links, comp = self._joined(docs)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        degree = self._degree(docs, links, nodes, comp) if self.every_link else self._ends(links)
        return self._rows(slim, nodes, comp, degree).select("doc_id", "n_shingles", "component_id", "n_links")

    def _heavy(self, docs: DataFrame, sets: int) -> Heavy:
        """Signatures of at least heavy sets, by a count over a part of the texts. A list is never longer than there are sets."""
        if sets < self.heavy:
            return Heavy([], [])
        some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(self.counted)) == 0))
        counts = some.mapInArrow(_keys(self.words, self.num, self.den), "key long, node long").distinct().groupBy("key").agg((F.count("*") * self.counted).alias("n"))
        found = counts.where(F.col("n") >= self.heavy).orderBy(F.desc("n"), "key").limit(KNOWN).collect()
        return Heavy([r.key for r in found], [-(-r.n // self.heavy) + 1 for r in found])

    def _joined(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Each row's id, size and node; the nodes; the links that the join followed; the components."""
        spark = docs.sparkSession
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        profile = written(docs.mapInArrow(_profile(self.words), "doc_id long, n_shingles long, node long, sketch binary"), "profile")
        slim = profile.select("doc_id", "n_shingles", "node")
        nodes = written(profile.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x")).select("node", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sketch").alias("sketch")), "nodes")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((profile.agg(F.sum("n_shingles")).first()[0] or 0) // 4_000_000) + 1)
        heavy = self._heavy(docs, nodes.count())
        signed = docs.where("text is not null").mapInArrow(_index(self.words, self.num, self.den, parts, heavy), "part int, key binary, node binary, n binary, role binary")
        schema = "a long, b long, bucket long, place long, nodes binary, sizes binary, roles binary"
        found = written(signed.repartitionById(parts, "part").mapInArrow(_match(self.num, self.den, heavy), schema), "found")
        tried = found.where("bucket is null").select("a", "b").distinct()
        links = written(self._links(docs, tried, nodes), "links")
        comp = components(links)
        packed = found.where("bucket is not null").select("bucket", "place", "nodes", "sizes", "roles").dropDuplicates(["bucket", "place"])
        lists = written(packed.mapInArrow(_members, "bucket long, node long, n int, role int"), "lists")
        rest = lists.join(lists.groupBy("node").agg(F.count("*").alias("degree")), "node")
        for step in range(self.rounds + 1):
            rest = self._open(rest, comp)
            if rest.isEmpty():
                break
            last = step == self.rounds
            more = (self._exhaustive(rest, nodes, parts) if last else self._hubs(rest, step)).distinct()
            more = written(more.join(tried, ["a", "b"], "left_anti"), "candidates")
            new = written(self._links(docs, more, nodes), "links")
            if new.isEmpty():
                continue
            links = links.unionByName(new)
            comp = components(new, comp)
            tried = tried.unionByName(more)
        return slim, nodes, links, comp

    @staticmethod
    def _rows(slim: DataFrame, nodes: DataFrame, comp: DataFrame, degree: DataFrame | None = None) -> DataFrame:
        """doc_id, n_shingles, node and component_id of each row; with degree (node, n_links) also n_links."""
        of = comp.withColumnRenamed("id", "node").join(nodes.select("node", "rep"), "node")
        least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = of.join(least, "component").select("node", "component_id")
        counts = []
        if degree is not None:
            linked, counts = linked.join(degree, "node"), [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
        linked = nodes.select("node", "rep").join(linked, "node", "left").withColumn("component_id", F.coalesce("component_id", "rep")).drop("rep")
        full = slim.where("n_shingles > 0").join(linked, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"), *counts)
        empty = slim.where("n_shingles = 0").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if counts else []))
        return full.unionByName(empty)

    def first_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of docs whose id is the smallest of its component, one for each id; rows without an id stay. Of rows that share an id but not the text,
        those whose text belongs to an earlier document go first."""
        slim, nodes, _, comp = self._joined(docs)
        found = written(self._rows(slim, nodes, comp).select("doc_id", "node", "component_id"), "components")
        # only ids of components of several documents go; a slim anti join spares those that keep to themselves
        ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi"))
        ids = written(ids.where("lo < doc_id or n > 1"), "ids")
        gone, mixed, twice = ids.where("hi < doc_id").select("doc_id"), ids.where("lo < doc_id and hi = doc_id").select("doc_id"), ids.where("lo = doc_id").select("doc_id")
        left = docs.join(self._bounded(gone), "doc_id", "left_anti").select(docs.columns)
        again = ids.where("hi = doc_id").select("doc_id")
        if again.isEmpty():
            return left
        alone = left.join(self._bounded(again), "doc_id", "left_anti").select(docs.columns)
        out = alone.unionByName(left.join(self._bounded(twice), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
        if mixed.isEmpty():
            return out
        stay = found.where("doc_id = component_id").join(mixed, "doc_id", "left_semi").select("doc_id", F.col("node").alias("_node")).distinct()
        schema = T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())])
        some = left.join(self._bounded(mixed), "doc_id", "left_semi").select(docs.columns).mapInArrow(_noded(self.words), schema)
        return out.unionByName(some.join(stay, ["doc_id", "_node"], "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))

    @staticmethod
    def _bounded(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    @staticmethod
    def _open(lists: DataFrame, comp: DataFrame) -> DataFrame:
        """Lists whose members lie in several components, with each member's; a set without links is a component of its own (a negative number)."""
        of = comp.select(F.col("id").alias("node"), F.col("component").alias("comp"))
        member = lists.drop("comp").join(of, "node", "left").withColumn("comp", F.coalesce("comp", -F.col("node") - 1)).select("bucket", "node", "n", "degree", "role", "comp")
        member = written(member, "members")
        open_ = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        return written(member.join(open_, "bucket"), "open")

    def _hubs(self, rest: DataFrame, step: int) -> DataFrame:
        """A list's members against its hub, the member that is in most lists: as a rule the text that the others were made from. Later rounds draw others, by chance and degree."""
        luck = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1000)) + 1.0 if step else F.lit(1.0)
        hub = rest.groupBy("bucket").agg(F.max(F.struct((F.col("degree") * luck).alias("rank"), "node", "n", "comp")).alias("hub"))
        n, m = F.col("n"), F.col("hub.n")
        pairs = rest.join(hub, "bucket").where((F.col("comp") != F.col("hub.comp")) & (F.greatest(n, m) * self.num <= F.least(n, m) * self.den))
        first = (n < m) | ((n == m) & (F.col("node") < F.col("hub.node")))
        return pairs.select(F.when(first, F.col("node")).otherwise(F.col("hub.node")).alias("a"), F.when(first, F.col("hub.node")).otherwise(F.col("node")).alias("b"))

    def _exhaustive(self, rest: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
        """All that is left: pairs of a list across components whose sketches allow a link. A list of several blocks gives a unit for each two of them."""
        blocks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        rest = rest.select("bucket", "node", "comp", "n", "role").join(blocks, "bucket").join(nodes.select("node", "sketch"), "node")
        rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        rest = rest.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n", "node")
        return rest.select("bucket", "lo", "hi", "node", "comp", "n", "role", "block", "sketch").mapInArrow(_across(self.num, self.den), "a long, b long")

    @staticmethod
    def _ends(links: DataFrame) -> DataFrame:
        return links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))

    def _degree(self, docs: DataFrame, links: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
        """The number of links of each linked set. Components are complete, so all partners of a set are in its own. A component whose pairs are all known links is
        counted from them. The others are cut into blocks by band of size (partners are in the same band or the next) and hash; a set travels once to each
        two blocks, and only numbers come back: no pair becomes a row."""
        of = comp.withColumnRenamed("id", "node")
        known = self._ends(links).join(of, "node")
        whole = known.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n_links").alias("ends"))
        rest = written(whole.where("ends < sets * (sets - 1)").select("component"), "incomplete")
        done = known.join(rest, "component", "left_anti").select("node", "n_links")
        if rest.isEmpty():
            return done
        sized = of.join(rest, "component").join(nodes.select("node", "rep", "n"), "node")
        fill = F.ceil(F.greatest(F.count("*") / self.unit, F.sum("n") / UNIT_ELEMENTS)).cast("int").alias("fill")
        # wider than the ratio of two sizes that can link by more than a logarithm's error
        width = math.log(self.den / self.num) * 1.0001 if self.num < self.den else 1.0
        small = sized.groupBy("component").agg(fill)
        banded = sized.join(small, "component").withColumn("band", F.when(F.col("fill") > 1, F.floor(F.log("n") / width).cast("int")).otherwise(0)).drop("fill")
        cut = written(banded.groupBy("component", "band").agg(fill), "blocks")
        place = banded.join(cut, ["component", "band"]).select("component", "node", "rep", "n", "band", F.pmod(F.xxhash64("node"), "fill").cast("int").alias("cell"), "fill")
        near = cut.select("component", F.col("band").alias("band2"), F.col("fill").alias("fill2"))
        # a set's band against itself, the one below and the one above, as an equi join on the explored band
        reach = place.withColumn("band2", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).join(near, ["component", "band2"])
        reach = reach.withColumn("cell2", F.explode(F.sequence(F.lit(0), F.col("fill2") - 1)))
        mine, their = (F.shiftleft(F.col(b).cast("long"), 32) + F.col(c) for b, c in (("band", "cell"), ("band2", "cell2")))
        need = written(reach.select("component", F.least(mine, their).alias("lo"), F.greatest(mine, their).alias("hi"), mine.alias("block"), "n", "node", "rep"), "need")
        ids = self._bounded(need.select(F.col("rep").alias("doc_id")).distinct())
        sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_elements(self.words), "node long, x binary").join(need.select("node").distinct(), "node", "left_semi")
        flat = need.drop("rep").join(written(sets.dropDuplicates(["node"]), "sets"), "node")
        flat = flat.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "block", "n", "node")
        counted = flat.mapInArrow(_degrees(self.num, self.den), "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
        return done.unionByName(counted)

    def _links(self, docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs whose sets pass the threshold, as nodes a > b."""
        left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        kept = written(pairs.join(left, "a").join(right, "b").mapInArrow(_prune(self.num, self.den), "a long, b long"), "pairs")
        degree = kept.select(F.col("a").alias("node")).union(kept.select("b")).groupBy("node").agg(F.count("*").alias("d"))
        need = written(degree.join(nodes.select("node", "rep"), "node"), "need")
        ids, of = need.select(F.col("rep").alias("doc_id")).distinct(), need.select("node", "d")
        if need.count() <= BROADCAST_ROWS:
            ids, of = F.broadcast(ids), F.broadcast(of)
        # rows that share an id may have other texts
        sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_elements(self.words), "node long, x binary").join(of.select("node"), "node", "left_semi")
        sets = written(sets.dropDuplicates(["node"]), "sets")
        both = kept.join(of.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(of.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
        a_first = F.col("da") >= F.col("db")
        both = both.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("center"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("da", "db").alias("d"))
        both = both.select("center", F.pmod(F.xxhash64("member"), F.ceil(F.col("d") / self.pairs)).cast("int").alias("part"), "member")
        member = both.join(sets.withColumnRenamed("node", "member"), "member").select("center", "part", "member", "x")
        center = both.select("center", "part").distinct().join(sets.withColumnRenamed("node", "center"), "center").select("center", "part", F.lit(None).cast("long").alias("member"), "x")
        units = member.unionByName(center).repartition("center", "part").sortWithinPartitions("center", "part", "member")  # null comes first
        good = units.mapInArrow(_verify(self.num, self.den), "center long, member long")
        return good.select(F.greatest("center", "member").alias("a"), F.least("center", "member").alias("b"))
