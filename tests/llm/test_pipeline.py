"""The pipeline against the operators' own brute-force versions, stage by stage."""

import corpus_pipeline as P
from brute import jaccard_components
from test_decontaminate import brute_distance, words

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, D)
        if name != "sharding":
            assert out.columns == docs.columns
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], out.schema)
    q = {r.doc_id: r.text for r in kept["quality_classifier"]}
    comp = jaccard_components(list(q.items()))
    near = {r.doc_id: r.text for r in kept["near_duplicates"]}
    assert set(near) == {d for d, (_, c) in comp.items() if d == c}
    bench = [words(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]

    def leaked(text):
        w = words(text)
        return any(sum(x in set(w) for x in b) >= len(b) - int(0.3 * len(b)) and brute_distance(b, w) <= int(0.3 * len(b)) for b in bench)

    clean = {r.doc_id for r in kept["decontamination"]}
    assert clean == {d for d, t in near.items() if not leaked(t)} and clean != set(near)
    assert {r.doc_id for r in kept["mixing"]} == clean and len(kept["mixing"]) >= len(clean)
    assert sorted(r.doc_id for r in kept["sharding"]) == sorted(r.doc_id for r in kept["mixing"])


def test_run(spark):
    out = P.run(spark, D)
    assert out.count() > 100 and {"shard", "slot", "grown_shard"} <= set(out.columns)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, shard string, node long, y string, quality string, domain string, _g int"


def test_odd_rows(spark):
    """Null and empty texts, repeated rows, ids shared by different texts, a very long text and columns that clash, stage by stage."""
    clean = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").where("doc_id % 7 = 0").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"{w}{i}" for i in range(20_000) for w in ("anon", "thela"))
    rows = [(1, None), (2, ""), (3, " \n"), (None, clean[0]), (None, None), (4, clean[1]), (4, clean[1]), (5, clean[1]), (6, clean[2]), (6, clean[3]), (7, long), (8, long), (9, f"{clean[4]} {item} {clean[5]}"), (10, clean[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, "y", "q", "d", 3) for i, t in rows], EXTRA).repartition(3)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), D).count() == 0, name

    def ids(df):
        return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))

    near = P.near_duplicates(spark, docs, D)
    assert ids(near) == [None, None, 1, 2, 3, 4, 6, 7, 9, 10]
    kept = P.decontamination(spark, near, D)
    assert ids(kept) == [None, None, 1, 2, 3, 4, 6, 7, 10]
    mixed = P.mixing(spark, kept, D)
    assert set(ids(mixed)) == set(ids(kept)) and [ids(mixed).count(i) for i in (1, 2, 3)] == [1, 1, 1]
    out = P.sharding(spark, mixed, D)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot", "grown_shard"] and ids(out) == ids(mixed)
    slots = {}
    for r in out.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    scored = P.quality(spark, docs, D).collect()
    assert len({sum(r.doc_id == i for r in scored) for i in (1, 2, 3)}) == 1 and sum(r.doc_id == 4 for r in scored) in (0, 2)
    assert P.sharding(spark, docs.limit(0), D).count() == 0


def test_empty_labels_and_items(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{D}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.quality(spark, docs, str(tmp_path)).count() == docs.count() == P.decontamination(spark, docs, str(tmp_path)).count()
    assert P.mixing(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.count()
