import random
import re

import numpy as np
import pyarrow as pa

from kinetrail.llm import kernels as K
from kinetrail.llm.decontaminate import Decontaminate, Items, Walks, distance


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (w != x))
    return min(row)


def test_distance():
    rng = random.Random(1)
    for _ in range(200):
        item, text = ([rng.randrange(5) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert distance(item, text) == brute_distance(item, text)


def test_corpus_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in Decontaminate().hits(docs, bench).collect()}
    want = {}
    texts = [(r.doc_id, words(r.text)) for r in docs.collect()]
    for b in bench.collect():
        w = words(b.text)
        most = int(0.3 * len(w))
        for doc, text in texts:
            if sum(x in set(text) for x in w) >= len(w) - most and (e := brute_distance(w, text)) <= most:
                want[doc, b.item_id] = e
    assert want and got == want


def test_recall_under_edits(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(15, 58)))) for i in range(100)]
    docs, planted = [], set()
    for i, text in bench:
        w = text.split()
        for _ in range(int(0.25 * len(w))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["edited"], [w[k], "extra"]])
        e = brute_distance(text.split(), w)
        if e <= int(0.3 * len(text.split())):
            planted.add((i, i))
        pad = [rng.choice(vocab) for _ in range(300)]
        docs.append((i, " ".join(pad[:150] + w + pad[150:])))
    docs += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(300))) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in Decontaminate().hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(planted & got) >= 0.97 * len(planted) and not got - {(i, i) for i in range(100)}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, ""), (4, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, BETA - gamma y", 1), (1, "x Alpha, BETA - gamma y", 1), (2, None, 2), (3, "", 3), (4, "one two other four five six seven", 4), (5, "alpha gamma", 5), (6, "q " * 200_000, 6)], "doc_id long, text string, item_id long")
    op = Decontaminate()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in op.hits(docs, bench).collect()) == [(1, 1, 0), (1, 1, 0), (4, 4, 1)]
    left = op.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6]
    assert op.hits(docs.limit(0), bench).count() == 0 and op.clean(docs, bench.limit(0)).count() == 7


def test_no_passage_is_missed():
    """All passages with exactly the allowed substitutions are found, whatever the item's length."""
    rng = np.random.default_rng(2)
    for m in (5, 13, 14, 15, 16, 17, 20, 30, 45, 60):
        items = [[f"w{i}x{j}" for j in range(m)] for i in range(100)]
        found = Items([(i, " ".join(w)) for i, w in enumerate(items)], 0.3, Walks())
        for even in (False, True):
            texts, edits = [], int(0.3 * m)
            for w in items:
                places = ((np.arange(edits) + 0.5) * m / edits).astype(int) if even else rng.choice(m, edits, replace=False)
                body = [f"z{rng.integers(1 << 40)}" if j in places else x for j, x in enumerate(w)]
                texts.append(" ".join([f"a{rng.integers(1 << 40)}" for _ in range(20)] + body + [f"b{rng.integers(1 << 40)}" for _ in range(20)]))
            got = {(d, t): e for d, t, e, _ in found.search(pa.array(texts, pa.large_string()))}
            assert got == {(i, i): edits for i in range(100)}, (m, even)


def test_recall_of_the_walks_alone():
    """Without the pieces: at least 0.95 of the passages with a fifth of their words edited, 0.85 with the allowed 30 %, for each size."""
    rng = np.random.default_rng(0)
    for m in (14, 16, 24, 40, 60):
        for share, least in ((0.1, 0.98), (0.2, 0.95), (0.3, 0.85)):
            items = [[f"w{i}x{j}" for j in range(m)] for i in range(200)]
            found = Items([(i, " ".join(w)) for i, w in enumerate(items)], 0.3, Walks())
            found.runs = set()
            texts = []
            for w in items:
                for k in sorted(rng.choice(m, int(share * m), replace=False), reverse=True):
                    w = [*w[:k], f"z{rng.integers(1 << 40)}", *w[k + 1 :]]
                texts.append(" ".join([f"a{rng.integers(1 << 40)}" for _ in range(20)] + w + [f"b{rng.integers(1 << 40)}" for _ in range(20)]))
            got = {d for d, t, _, _ in found.search(pa.array(texts, pa.large_string())) if d == t}
            assert len(got) >= least * 200, (m, share, len(got))


def test_walks_against_single_steps():
    """Keys by powers of the walk equal a pointer that takes one step after the other."""
    rng = np.random.default_rng(4)
    words, walks = rng.integers(1, 1 << 62, 90).astype(np.uint64), Walks()
    classes = [3, 5, 7]
    found = list(walks.keys(words, classes))
    for r, salt in enumerate(walks.salts):
        bits = [int(x) & 0xFF for x in K.mix(words ^ salt)] + [0]
        for k, c in enumerate(classes):
            got_class, key, reach = found[r * len(classes) + k]
            assert got_class == c and len(walks.steps(c, r)) == walks.samples
            for i in range(90):
                at, step, read = i, 0, []
                for s in walks.steps(c, r):
                    while step < s:
                        at += bits[at] >> (step % 8) & 1
                        step += 1
                    read.append(at)
                x = int(salt) ^ c
                for p in read:
                    x = (x * 0xC2B2AE3D27D4EB4F + (int(words[p]) if p < 90 else 0)) % (1 << 64)
                assert key[i] == K.mix(np.array([x], np.uint64))[0] and reach[i] == read[-1] - i


def test_blocks(spark, monkeypatch):
    """Items in blocks by number and by bytes, equal items once: the hits of one block."""
    from kinetrail.llm import decontaminate as M

    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)] * 2 + [(99, "long " * 3000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "a b " + " ".join(f"w{i}x{j}" for j in range(20)) + " c") for i in range(40)], "doc_id long, text string")
    want = [(i, i) for i in range(30)]
    for items, size in ((20_000, 1 << 25), (4, 1 << 25), (20_000, 1000)):
        monkeypatch.setattr(M, "BLOCK_ITEMS", items)
        monkeypatch.setattr(M, "BLOCK_BYTES", size)
        assert sorted((r.doc_id, r.item_id) for r in Decontaminate().hits(docs, bench).collect()) == want
        assert sorted(r.doc_id for r in Decontaminate().clean(docs, bench).collect()) == list(range(30, 40))
