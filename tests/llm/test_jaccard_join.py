import random

from brute import jaccard_components, jaccard_degrees

from kinetrail.llm import components as C
from kinetrail.llm.jaccard_join import JaccardJoin
from kinetrail.llm.store import written


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_corpus_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = jaccard_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows(JaccardJoin().similar(docs)) == want


def test_random_small_sets_at_the_threshold(spark):
    """Sets of 1 to 60 shingles, edited at random: many pairs lie just at the threshold, in every band of small sizes."""
    rng, docs = random.Random(7), []
    for g in range(150):
        base = [f"w{g}_{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 64))]
        for _ in range(rng.randrange(1, 5)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.choice([0, len(text) - 1, rng.randrange(len(text))])
                text[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
                text = text or ["x"]
            docs.append((len(docs), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(JaccardJoin().similar(df)) == jaccard_components(docs)


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "A b"), (9, "a B"), (10, "a b c"), (11, "q " * 50_000), (12, "q " * 9)]
    df = spark.createDataFrame([(*d, d[0], "z") for d in docs], "doc_id long, text string, node long, part string")
    got = rows(JaccardJoin().similar(df))
    assert got == {5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (1, 10), 11: (1, 11), 12: (1, 11)}
    assert JaccardJoin().similar(df.limit(0)).count() == 0
    twice = JaccardJoin().similar(df.union(df).drop("node"))
    assert twice.count() == 16 and rows(twice) == got


def edited(rng, n, size):
    """Texts made from one by a few edits, many of them linked only through others, and texts that share words but no link."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 1 + size // 14)):
            w[rng.randrange(size)] = f"e{i}x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_cut_lists_change_nothing(spark):
    """Heavy signatures dealt over parts, open lists in blocks and centres in parts, all from a few members on: the result of brute force."""
    rng = random.Random(11)
    texts = [t for size in (12, 30, 90, 200) for _ in range(2) for t in edited(rng, 60, size)]
    common = [f"c{i}" for i in range(40)]
    texts += [" ".join(common + [f"o{i}x{j}" for j in range(30)]) for i in range(60)]
    docs = list(enumerate(texts))
    want = jaccard_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for join in (JaccardJoin(heavy=5, counted=1, block=7, pairs=3), JaccardJoin(heavy=5, counted=2, block=1000), JaccardJoin(rounds=0, block=5), JaccardJoin()):
        assert rows(join.similar(df)) == want


def test_ids_shared_by_different_texts(spark):
    rng = random.Random(3)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(40)] for x in "abc")
    near = [*b[:-1], "other"]
    data = [(1, a), (2, a), (2, b), (3, near), (3, near), (4, c), (4, c), (5, near), (6, c), (6, a)]
    df = spark.createDataFrame([(i, " ".join(w), k) for k, (i, w) in enumerate(data)], "doc_id long, text string, node int")
    got = sorted((r.doc_id, r.component_id) for r in JaccardJoin().similar(df).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 2), (4, 4), (4, 4), (5, 2), (6, 1), (6, 4)]
    kept = JaccardJoin().first_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "a"), (2, "b"), (4, "c")]


def test_every_link(spark):
    """Exact numbers of links, inside components too, with lists and centres in parts or whole; components stay."""
    rng = random.Random(5)
    texts = [t for size in (12, 30, 90) for t in edited(rng, 50, size)]
    texts += texts[:9] + [None, ""] + [" ".join(f"d{i % 90 + (i > 80)}x" for i in range(k, k + 100)) for k in range(6)]
    texts += [" ".join([f"z{j}" for j in range(60)] + [f"t{i}"]) for i in range(60)]
    docs = list(enumerate(texts))
    want, degree = jaccard_components(docs), jaccard_degrees(docs)
    assert max(degree.values()) == 59
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for join in (JaccardJoin(every_link=True), JaccardJoin(heavy=5, counted=1, block=7, pairs=3, every_link=True, unit=7)):
        got = join.similar(df)
        assert rows(got) == want and {r.doc_id: r.n_links for r in got.collect()} == degree


def test_links_of_a_component_of_many_sizes(spark):
    """Nested texts make one component over many bands of size; blocks of any size give the same numbers."""
    words, texts, n = [f"w{i}" for i in range(2000)], [], 12
    while n < 1500:
        texts += [" ".join(words[:n]), " ".join(words[: n - 1] + [f"x{n}"]), " ".join([f"y{n}"] + words[1:n])]
        n = n + max(1, n // 9)
    docs = list(enumerate(texts))
    want, degree = jaccard_components(docs), jaccard_degrees(docs)
    assert {c for _, c in want.values()} == {0} and max(degree.values()) > 8
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for unit in (1, 4, 1000):
        got = JaccardJoin(unit=unit).similar(df)
        assert rows(got) == want and {r.doc_id: r.n_links for r in got.collect()} == degree


def test_first_of_each_counts_no_links(spark, monkeypatch):
    monkeypatch.setattr(JaccardJoin, "_degree", None)
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h")], "doc_id long, text string")
    assert sorted(r.doc_id for r in JaccardJoin().first_of_each(df).collect()) == [1, 3]


def test_components_end_with_the_stars(spark, monkeypatch):
    """No round that only shows that nothing changes; later links add to known components. Against a plain search."""
    rounds = []
    monkeypatch.setattr(C, "written", lambda df, name: rounds.append(name) or written(df, name))

    def found(pairs, known=None):
        rounds.clear()
        return C.components(spark.createDataFrame(pairs, "a long, b long"), known)

    def plain(pairs):
        of = {x: x for p in pairs for x in p}
        for _ in range(len(of)):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    def same(got, pairs):
        out = got.collect()
        assert dict(out) == plain(pairs) and len(out) == len(dict(out))

    star = [(i, 3) for i in range(4, 40)] + [(51, 50), (52, 50)]
    known = found(star)
    same(known, star)
    assert len(rounds) == 1
    more = [(3, 1), (50, 10), (53, 51), (60, 59)]
    same(found(more, known), star + more)
    chain = [(i + 1, i) for i in range(100, 130)] + [(117, 100)]
    same(found(chain), chain)
    chance = random.Random(3)
    some = [tuple(sorted(chance.sample(range(120), 2), reverse=True)) for _ in range(110)]
    same(found(some[60:], found(some[:60])), some)
    same(found([]), [])


def test_first_of_each_needs_no_numbers_of_links(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "x y z"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(JaccardJoin, "_ends", staticmethod(lambda *_: 1 / 0))
    assert sorted(r.doc_id for r in JaccardJoin().first_of_each(df).collect()) == [1, 3, 4]
