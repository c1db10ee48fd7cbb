"""Small cases worked out by hand from the operators' definitions."""

import pytest
from pyspark.sql import functions as F

from kinetrail.functions import actions as FA, text as FT
from kinetrail.operators import annotations as A, mixtures as X, samples as M, standardize as Z, stats as S, windows as W


def frame(spark, values, col="x"):
    return spark.createDataFrame([(1, i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"traj long, t long, {col}")


def column(df, c):
    return [r[0] for r in df.orderBy("t").select(c).collect()]


def test_history_and_chunk(spark):
    df = frame(spark, [0.0, 10.0, 20.0, 30.0, 40.0], "x double")
    assert column(df, W.history("x", 3)) == [[0, 0, 0], [0, 0, 10], [0, 10, 20], [10, 20, 30], [20, 30, 40]]
    assert column(df, W.pad_mask(3))[:3] == [[False, False, True], [False, True, True], [True, True, True]]
    chunks = column(df.withColumn("c", W.chunk("x", 4)), "c")
    assert chunks[0] == [0, 10, 20, 30] and chunks[2] == [20, 30, 40, 40] and chunks[4] == [40] * 4
    assert column(df.withColumn("c", W.chunk("x", 1)), "c") == [[v] for v in (0, 10, 20, 30, 40)]


def test_neutral(spark):
    df = frame(spark, [([float(i), i / 10],) for i in range(1, 5)], "a array<double>").withColumn("goal", W.last_step()).withColumn("c", W.chunk("a", 3))
    out = column(df.withColumn("c", W.neutral(F.col("c"), F.col("goal"), [False, True])), "c")
    assert out[2] == [[3, 0.3], [4, 0.4], [0, 0.4]] and out[3] == [[4, 0.4], [0, 0.4], [0, 0.4]]


def test_statistics_and_normalisation(spark):
    df = frame(spark, [([v],) for v in (0.0, 1.0, 2.0, 3.0, 4.0, 10.0)], "action array<double>")
    s = S.statistics(df, "action", by=["traj"])
    r = s.first()
    assert [round(x, 6) for x in (r["mean"], r["std"], r.q01, r.q99)] == [3.333333, 3.248931, 0.05, 9.7]
    got = column(S.normalize(df, "action", s, "bounds_q99", [True], ["traj"]).withColumn("v", F.round(F.col("action")[0], 6)), "v")
    assert got == [-1, -0.803109, -0.595855, -0.388601, -0.181347, 1]
    flat = frame(spark, [([5.0],), ([5.0],)], "action array<double>")
    assert column(S.normalize(flat, "action", S.statistics(flat, "action", ["traj"]), "bounds", [False], ["traj"]), "action") == [[0], [0]]
    with pytest.raises(ValueError):
        S.normalize(df, "action", s, "other", [True], ["traj"])


@pytest.mark.parametrize(("values", "want"), [([0.97, 0.5, 0.02, 0.6, 0.7, 1.0, 0.4], [1, 0, 0, 1, 1, 1, 0.4])])
def test_binarize(spark, values, want):
    assert column(frame(spark, values, "g double").withColumn("o", W.binarize_gripper("g")), "o") == want


@pytest.mark.parametrize(("values", "want"), [([0, 0, 1, 0, -1, 0], [1, 1, 0, 0, 1, 1]), ([0, 0], [1, 1]), ([-1, 0, 0.05], [1, 1, 1])])
def test_relative(spark, values, want):
    assert column(frame(spark, [float(v) for v in values], "g double").withColumn("o", W.relative_to_absolute("g")), "o") == want


@pytest.mark.parametrize(("idle", "want"), [("TFFTFTTTFT", [(0, 4), (8, 9)]), ("TFTTF", [(0, 4)]), ("TTT", []), ("TTTFTTT", [(3, 3)])])
def test_segments(spark, idle, want):
    # a step moves by one unless idle; step 0 is idle by definition
    x, rows = 0.0, []
    for i, c in enumerate(idle):
        x += (c == "F") * 1.0
        rows.append((1, i, x, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "ep long, t long, x double, y double, z double, gripper double")
    seg = W.action_segments(df, 0.5, 0.5, 3).where("seg is not null").groupBy("seg").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    assert sorted((r.a, r.b) for r in seg.collect()) == want


def test_atomic_labels(spark):
    pos = [(0, 0, 0), (0.05, 0, 0), *[(0.1, 0, 0.05)] * 5, (0.1, 0.05, 0.05)]
    grip = [1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([(1, i, *map(float, p), float(g)) for i, (p, g) in enumerate(zip(pos, grip, strict=True))], "ep long, t long, x double, y double, z double, gripper double")
    out = W.atomic_labels(df, 0.01, 0.01, 3, 0.2, 0.0).orderBy("t").select("action", "direction", W.sentence("left", F.col("action"), F.col("direction")).alias("s")).collect()
    assert [(r.action, r.direction) for r in out] == [("move", "right_up")] * 3 + [("grasp", "")] + [("idle", "")] * 3 + [("move", "")]
    assert out[0].s == "Move the left gripper to the upper-right." and out[7].s == W.UNKNOWN


def test_frame_indices(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.middle(4, F.lit(10))) == [0, 3, 5, 8] and one(X.middle(8, F.lit(10))) == [0, 1, 2, 3, 5, 6, 7, 8] and one(X.middle(5, F.lit(3))) == [0, 1, 2, 2, 2]
    assert one(X.at_rate(0.5, F.lit(100), F.lit(10.0))) == [10, 30, 50, 70, 90] and one(X.at_rate(2, F.lit(30), F.lit(10.0))) == [2, 8, 12, 18, 22, 28]
    assert one(X.evenly(16, F.lit(50))) == [0, 3, 6, 9, 13, 16, 19, 22, 26, 29, 32, 35, 39, 42, 45, 49]


@pytest.mark.parametrize(("w", "h", "largest", "smallest", "stride", "pixels", "n", "want"), [(640, 480, 980, 378, 14, 2007040, 1, (644, 476, 1564)), (640, 480, 980, 378, 14, 2007040, 8, (532, 392, 1064)), (320, 240, 980, 378, 14, 2007040, 1, (504, 378, 972)), (320, 240, 1024, 512, 16, 1806336, 1, (688, 512, 1376)), (2000, 1000, 980, 378, 14, 2007040, 1, (980, 490, 2450))])
def test_resize(spark, w, h, largest, smallest, stride, pixels, n, want):
    r = M.resized(spark.createDataFrame([(w, h, n)], "w int, h int, n int"), "w", "h", largest, smallest, stride, pixels, "n").first()
    assert (r.new_w, r.new_h, r.patches) == want


def test_action_tokens(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, -0.5, 0.0, 0.5, 0.999, 1.0, -7.0, 7.0)], "v double")
    assert [r[0] for r in df.select(FA.digitize(F.col("v"))).collect()] == [1, 64, 128, 192, 255, 256, 1, 256]
    centres = [round(r[0], 6) for r in spark.createDataFrame([(1,), (128,), (256,)], "d int").select(FA.token_centre(F.col("d"))).collect()]
    assert centres == [-0.996078, 0.0, 0.996078]


def test_allocation_and_mixture(spark):
    assert X.allocate(8, [0.6, 0.3, 0.05, 0.05]) == [4, 2, 1, 1] and X.allocate(5, [0.5, 0.3, 0.2]) == [2, 2, 1]
    with pytest.raises(ValueError):
        X.allocate(1, [0.5, 0.5])
    df = X.mixture_weights(spark.createDataFrame([(1.0, 100), (1.0, 300), (0.5, 400)], "w double, n long"), "w", "n")
    assert [round(r.norm, 6) for r in df.orderBy("n").collect()] == [0.166667, 0.5, 0.333333]
    assert X.epoch_length(df, "w", "n", "norm").first().epoch == 600
    assert X.epoch_length(df.where("w < 1"), "w", "n", "norm").first().epoch is None


SIZES = [("a", 40), ("b", 30), ("c", 50), ("d", 25), ("e", 120), ("f", 60), ("g", 20)]


def test_packing(spark):
    df = spark.createDataFrame([(0, i, n) for i, (_, n) in enumerate(SIZES)], "shard long, sample long, size long")
    name = lambda rows: {b: "".join(SIZES[r.sample][0] for r in rows if r.batch == b) for b in {r.batch for r in rows}}
    full = M.packs_with_buffer(df, "shard", "sample", "size", 90, 100, 100, 50, 1).orderBy("batch", "sample").collect()
    assert name(full) == {0: "abd", 1: "cg", -1: "f"}
    bare = M.greedy_packs(df, "shard", "sample", "size", 90, 100, 100).orderBy("batch", "sample").collect()
    assert name(bare) == {0: "ab", 1: "df"}


def test_elements(spark):
    df = spark.createDataFrame([(1, 0, "human", "<image>\nWhat is it?"), (1, 1, "gpt", "A cup"), (1, 2, "system", "x")], "conv_id long, turn long, role string, value string")
    got = [(r.type, r.has_loss, r.text) for r in M.elements(df, F.lit(1)).orderBy("seq").collect()]
    assert got == [("image", 0, None), ("text", 0, "What is it?"), ("text", 1, "A cup")]


def test_asof_and_goal(spark):
    keys = spark.createDataFrame([(1, 0.0, "a", 120), (1, 2.5, "b", 120), (1, 10.0, "c", 120)], "ep long, key double, sub string, len long")
    steps = spark.createDataFrame([(1, 30, 3.0), (1, 0, -1.0)], "ep long, t long, time double")
    assert {(r.t, r.key, r["sub"]) for r in A.latest_key(steps, keys, "ep", "time", "key", "sub").collect()} == {(30, 2.5, "b"), (0, 0.0, "a")}
    assert [r.goal for r in A.goal_frames(keys, "ep", "key", 10.0, "len").orderBy("key").collect()] == [24, 99, 119]


def test_range_join_and_subtasks(spark):
    frames = spark.createDataFrame([(1, i) for i in range(6)], "ep long, t long")
    seg = spark.createDataFrame([(1, 0, 0, 2, "A"), (1, 1, 2, 3, "B")], "ep long, seg long, start long, stop long, label string")
    assert column(A.label_frames(frames, seg, "ep", "x"), "label") == list("AABBBB")
    df = S.subtask_sequence(frame(spark, ["grasp", "grasp", "place", "grasp"], "s string"), "s")
    assert column(df, "idx") == [0, 0, 1, 2] and column(df, "total")[0] == ["grasp", "place", "grasp"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(A.json_part(F.lit("Sure ```json\n[1, 2]\n``` done"))) == "[1, 2]" and one(A.json_part(F.lit("none"))) is None
    assert one(A.parsed_json(F.lit("{'a': 1, // one\n}"), "struct<a:int>")["a"]) == 1
    assert one(A.canonical(F.lit(" A, <x> b!  c. "), keep="<x>")) == "A <x> b c"
    assert one(FT.between_marks(F.lit("a<|im_start|>said<|im_end|>b"))) == "said" and one(FT.before_nul(F.lit("ab\x00cd"))) == "ab"
    assert one(FT.scene_instruction(F.lit("Pick UP!?\nnow.."))) == "pick up!? now" and one(FT.scene_instruction(F.lit("..."))) == "interact with any object"
    assert one(A.adjacent_distinct(F.array(*map(F.lit, ["a", "", "a", "b", "a"])))) == ["a", "b", "a"]


def test_geometry(spark):
    import math

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    m = FA.euler_to_matrix(F.lit(0.3), F.lit(-0.2), F.lit(0.5))
    eye = one(FA.product(m, FA.transposed(m)))
    assert all(math.isclose(v, float(i % 4 == 0), abs_tol=1e-12) for i, v in enumerate(eye)) and len(one(FA.matrix_to_rot6d(m))) == 6
    assert [round(v, 6) for v in one(FA.quaternion_to_euler(F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.25)), F.lit(math.cos(0.25))))] == [0, 0, 0.5]
    assert one(FA.schedule(3)) == [1, 0.5, 0] and len(one(FA.sinusoid(F.lit(2.0), 8))) == 8 and one(FA.norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5


def test_every_spec_builds(spark):
    """Each source's spec gives an action on a source that has the columns it names."""
    for name, spec in Z.SPECS.items():
        cols = {p.column for p in spec.action if p.column} | {p.column for _, parts in spec.state for p in parts if p.column} | ({spec.relabel} if spec.relabel else set())
        df = spark.range(4).select(F.lit(1).cast("long").alias("traj"), F.col("id").alias("t"), *(F.array(*(F.lit(i / 16) + F.col("id") / 10 for i in range(16))).alias(c) for c in sorted(cols)), F.lit("go").alias("natural_language_instruction"))
        out = Z.standardize(df, spec)
        assert out.select(F.size("action").alias("n")).first().n > 0, name
        assert dict(out.dtypes)["action"] == "array<double>", name


def test_checks(spark):
    with pytest.raises(Exception, match="goal offset"):
        spark.range(1).select(S.offset_of(F.lit(9), {1: 2})).collect()
    with pytest.raises(Exception, match="loss reduction"):
        spark.range(1).select(M.loss_weight(F.lit(3), F.lit("other"))).collect()


def plain(part, row, side):
    """A part of a spec by plain Python on one step: columns by side."""
    import math

    if part.op in ("zeros", "ones"):
        return [float(part.op == "ones")] * part.n
    x = row[side][part.column] if part.column in row[side] else row["observation" if side == "action" else "action"][part.column]
    x = (x if isinstance(x, list) else [x])[part.start : part.stop]
    if part.op == "euler":
        a, b, c, w = x[:4]
        return [math.atan2(2 * (w * a + b * c), 1 - 2 * (a * a + b * b)), math.asin(max(-1, min(1, 2 * (w * b - c * a)))), math.atan2(2 * (w * c + a * b), 1 - 2 * (b * b + c * c))]
    if "clip" in part.op:
        x = [max(0.0, min(1.0, v)) for v in x]
    return [1 - v for v in x] if "invert" in part.op else x


def test_every_spec_by_value(spark):
    """Each source's action and states on structs of an action's and an observation's side, whose columns of one name differ; grippers are scalars. Registered names lead to the specs."""
    from pyspark.sql import types as T

    from kinetrail.operators import registry as G

    assert set(G.TRANSFORMS.values()) == set(Z.SPECS) and len(G.TRANSFORMS) == 73 and len(G.CONFIGS) == 70 and len(G.GOALS) == 21
    scalars = {"open_gripper", "gripper_closedness_action", "gripper_position", "gripper", "gripper_width", "state_gripper_pose"}
    for name, spec in Z.SPECS.items():
        if any(p.op in ("binarize", "relative") for p in spec.action):
            continue
        sides = {"action": {p.column for p in spec.action if p.column} - {"state", "action"}, "observation": {p.column for _, x in spec.state for p in x if p.column} | {p.column for p in spec.action if p.column == "state"} | ({spec.relabel} if spec.relabel else set())}
        flat = any(p.column == "action" for p in spec.action)
        shape = {(s, c): c in scalars for s, x in sides.items() for c in x}
        rows = []
        for t in range(5):
            r = {s: {c: (t + k) / 7 if shape[s, c] else [math_value(t, i, k, s) for i in range(16)] for k, c in enumerate(sorted(x))} for s, x in sides.items()}
            r["action"] |= {"action": [math_value(t, i, 9, "a") for i in range(16)]} if flat else {}
            rows.append(r)
        side = lambda s: T.StructType([T.StructField(c, T.DoubleType() if shape[s, c] else T.ArrayType(T.DoubleType())) for c in sorted(sides[s])])  # noqa: B023, E731
        action = T.ArrayType(T.DoubleType()) if flat else side("action")
        schema = T.StructType([T.StructField("traj", T.LongType()), T.StructField("t", T.LongType()), T.StructField("action", action), T.StructField("observation", side("observation")), T.StructField("natural_language_instruction", T.StringType())])
        data = [(1, t, r["action"]["action"] if flat else tuple(r["action"][c] for c in sorted(sides["action"])), tuple(r["observation"][c] for c in sorted(sides["observation"])), "go") for t, r in enumerate(rows)]
        if flat and sides["action"]:
            continue
        out = Z.standardize(spark.createDataFrame(data, schema), spec).orderBy("t").collect()
        used = rows[1:] if spec.drop else rows
        for i, got in enumerate(out):
            want = [v for p in spec.action for v in plain(p, used[i], "action")]
            if spec.relabel:
                want[:6] = [b - a for a, b in zip(used[i]["observation"][spec.relabel][:6], used[i + 1]["observation"][spec.relabel][:6], strict=True)]
            assert got.action == pytest.approx(want), name
            for state, parts in spec.state:
                assert got[state] == pytest.approx([v for p in parts for v in plain(p, used[i], "observation")]), (name, state)
        assert len(out) == len(used) - bool(spec.relabel)


def math_value(t, i, k, side):
    return ((t * 31 + i * 7 + k * 13 + len(side)) % 23) / 23


def test_registry(spark):
    from kinetrail.operators import registry as G

    s = G.settings("bridge_orig", views=("primary", "wrist"), depth=True)
    assert s["images"] == {"primary": "image_0", "wrist": None} and s["states"] == ("EEF_state", None, "gripper_state") and s["spec"] == "bridge_orig"
    assert s["absolute_action_mask"] == [False] * 6 + [True] and "depths" in s and G.settings("droid")["chunk_filter"] == "zero_action"
    with pytest.raises(ValueError, match="JOINT_POS"):
        G.settings("roboset")
    with pytest.raises(ValueError, match="views"):
        G.settings("kuka", views=("top",))
    with pytest.warns(UserWarning, match="berkeley_rpt"):
        names = [(x["name"], w) for x, w in G.mixture("rtx_franka")]
    assert names[3] == ("taco_play", 2.0) and len(names) == len({n for n, _ in names}) == 23
    assert [(x["name"], w) for x, w in G.mixture("toto")] == [("toto", 1.0)]
    got = spark.createDataFrame([("kuka",), ("toto",)], "d string").select(S.offset_of(F.col("d"), G.GOALS).alias("k")).collect()
    assert [r.k for r in got] == [30, 60]
    with pytest.raises(Exception, match="goal offset"):
        spark.range(1).select(S.offset_of(F.lit("cmu_stretch"), G.GOALS)).collect()


def test_segments_beyond_the_episode(spark):
    frames = spark.createDataFrame([(1, i) for i in range(4)], "ep long, t long")
    seg = spark.createDataFrame([(1, 0, -5, 1, "a"), (1, 1, 3, 3_000_000_000, "b"), (1, 2, 90, 99, "c")], "ep long, seg int, start long, stop long, label string")
    assert column(A.label_frames(frames, seg, "ep", "x"), "label") == list("aaab")


def test_group_packer(spark):
    """Mandatory groups first, draws by weight, skipped and lost samples, and a run cut in two goes on as one."""
    limits = M.Limits(expected=90, most=100, per_sample=60, prefer=40, buffer=2)
    packer = M.GroupPacker([M.Group("a", 3.0), M.Group("b", 1.0, mandatory=True)], limits, seed=5)
    samples = {"a": [(i, 10 + i * 7 % 55) for i in range(40)], "b": [(100 + i, (i * 20) % 70 + 1) for i in range(9)]}
    whole = list(packer.batches(0, samples, 30))
    sizes = dict(samples["a"] + samples["b"])
    for batch, _ in whole:
        assert batch[0][0] == "b" and batch[0][2] < 60 and sum(x[2] for x in batch) <= 100 and all(x[2] == sizes[x[1]] and x[2] <= 60 for x in batch)
    assert sum(sum(x[2] for x in b) >= 90 for b, _ in whole) > 10
    drawn = [x[0] for b, _ in whole for x in b[1:]]
    assert 0.6 < drawn.count("a") / len(drawn) < 0.9
    first = list(packer.batches(0, samples, 12))
    rest = list(packer.batches(0, samples, 18, first[-1][1]))
    assert first + rest == whole
    rows = [(s, g, i, n) for s in (0, 1) for g, x in samples.items() for i, n in x]
    df = spark.createDataFrame(rows, "shard long, kind string, sample long, size long")
    got = packer.packed(df, "shard", "kind", "sample", "size", 30).where("shard = 0").orderBy("batch", "pos").collect()
    assert [(r.group, r.sample, r["size"]) for r in got] == [x for b, _ in whole for x in b] and sum(r.state is not None for r in got) == 30
    with pytest.raises(ValueError, match="fits"):
        next(packer.batches(0, {"a": [(1, 61)], "b": [(2, 5)]}, 1))
    with pytest.raises(ValueError, match="weights"):
        M.GroupPacker([M.Group("a", 0.0)], limits)
    assert M.groups_of({"x": {"dataset_names": ["d"], "weight": 2, "is_mandatory": True}}) == [M.Group("x", 2.0, True)]


def test_loss_tokens(spark):
    """Items with their marks: a text of two tokens, an image of three, an action of two, a text without loss, one without tokens."""
    items = spark.createDataFrame([(1, "text", 1, 4, 0), (1, "vae_image", 1, 5, 4), (1, "action", 1, 4, 9), (1, "text", 0, 5, 13), (1, "text", 1, 1, 18), (1, "vae_image", 1, 2, 19)], "conv long, type string, loss int, n_tokens int, start long")
    got = {k: sorted(r.token for r in M.loss_tokens(items, k).collect()) for k in ("ce", "mse", "l1")}
    assert got == {"ce": [0, 1, 2], "mse": [5, 6, 7], "l1": [10, 11]}


def test_quantiles(spark):
    """Two passes give the same as sorting: many, few, one and equal values, nulls and NaN; several groups."""
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=30_000), 1: rng.integers(0, 5, 5000).astype(float), 2: np.array([2.5]), 3: np.full(400, 7.0), 4: rng.exponential(size=57), 5: np.array([1.0, 9.0])}
    rows = [(g, float(x)) for g, x in groups.items() for x in x] + [(0, None), (1, float("nan")), (6, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(7)
    shares = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "end": 1.0}
    got = {r.g: r for r in S.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert [got[g][n] for n in shares] == pytest.approx([np.quantile(x, p) for p in shares.values()], rel=1e-12)


def test_packs_are_streamed(spark):
    """Shards that share a task, of text keys, and batches that cross Arrow batches: the same as a plain loop."""
    rows = [(f"s{k}", i, (i * 37 + k * 11) % 70 + 1) for k in range(5) for i in range(3000)]
    df = spark.createDataFrame(rows, "shard string, sample long, size long").repartition(6)
    for buffer, prefer in ((0, 0), (3, 50)):
        got = sorted((r.shard, r.sample, r.batch, r["size"]) for r in M.packs_with_buffer(df.coalesce(1), "shard", "sample", "size", 90, 100, 65, prefer, buffer).collect())
        want = []
        for k in range(5):
            todo, held, cur, batch = [(i, n) for s, i, n in rows if s == f"s{k}"], [], 0, 0
            while todo or (cur < prefer and held):
                old = cur < prefer and bool(held)
                i, n = (held if old else todo).pop(0)
                if n > 65:
                    continue
                if cur + n > 100:
                    if not old and len(held) < buffer:
                        held.append((i, n))
                    else:
                        cur, batch = 0, batch + 1
                    continue
                want.append((f"s{k}", i, batch, n))
                cur += n
                if cur >= 90:
                    cur, batch = 0, batch + 1
            want += [(f"s{k}", i, -1 - j, n) for j, (i, n) in enumerate(held)]
        assert got == sorted(want)
    assert M.greedy_packs(df.limit(0), "shard", "sample", "size", 90, 100, 65).count() == 0


def test_clips_and_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.clipped(F.array(F.lit(0), F.lit(3)), F.lit(1.5), F.lit(10.0))) == [15, 18] and one(X.clip_length(F.lit(1.5), F.lit(4.0), F.lit(10.0))) == 25
    df = spark.range(5000).select("id", (F.pmod(F.col("id") * 7919, F.lit(100)) / 10).alias("key")).repartition(5)
    got = [(r.key, r.id) for r in X.numbered_by(df, "key", "id", parts=13).orderBy("pos").collect()]
    assert got == sorted(got) and X.numbered_by(df, "key", "id", parts=13).agg(F.max("pos")).first()[0] == 5000
    assert X.numbered_by(df.limit(0), "key").count() == 0


def test_samples_of_odd_episodes(spark):
    """Episodes that never move, lack a sidecar, have an empty one or no instruction go; null labels, one step and a step before every subtask are defined."""
    from kinetrail.operators import episodes as E

    rows = [(ep, t, [0.0 if ep == 1 or t < first else 1.0], [float(t)], None, "Lift") for ep, n, first in ((1, 4, 9), (2, 4, 2), (3, 4, 2), (4, 4, 2), (5, 2, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "ep long, t long, state array<double>, action array<double>, left string, right string")
    plan = {"9.0": (["a"], "late"), "10.5": (None, None)}
    side = spark.createDataFrame([(1, 1.0, plan, ["go"]), (2, 1.0, plan, ["go"]), (4, 1.0, {}, ["go"]), (5, None, plan, ["go", "run"])], "ep long, fps double, reasoning map<string, struct<plan: array<string>, subtask: string>>, seen array<string>")
    got = {r.ep: r for r in E.simulated_samples(df, side, "ep", 1, 3, 3, F.lit(0), F.lit(1)).collect()}
    assert set(got) == {2, 5}
    a, b = got[2], got[5]
    assert (a.step, a.instruction, a.goal, a.frames, a.mask, a.actions, a.state) == (1, "go", 3, [0, 0, 1], [False, False, True], [[1.0], [2.0], [3.0]], [0.0])
    assert "late" in a.thought and "[LEFT]: \n[RIGHT]: Lift\n" in a.thought
    assert (b.step, b.instruction, b.frames, b.actions, b.state_mean, b.n_steps) == (0, "run", [0, 0, 0], [[0.0], [1.0], [1.0]], [0.5], 2)
    r = {r.ep: r for r in E.robot_samples(df, "fold", "ep", 1, 3, F.lit(1), chunk=3).collect()}
    assert set(r) == {2, 3, 4, 5} and r[3].thought == "[LEFT]: none; [RIGHT]: lift" and (r[3].step, r[3].goal, r[3].mask) == (2, 3, [False, True, True])


def test_nested_errors(spark):
    from kinetrail.functions import nested as N

    df = spark.sql("select named_struct('a', true, 'b', array(1.5D, 2D), 'c', array('x')) as s")
    with pytest.raises(ValueError, match="boolean"):
        N.mapped(df, "s", N.padding)
    assert df.select(N.mapped(df, "s.b", N.padding).alias("x")).first().x == [0.0, 0.0]
    assert df.select(N.merged(df, "s", "s").alias("x")).first().x.c == ["x"]
