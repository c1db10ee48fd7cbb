import io
import json
import tarfile

from pyspark.sql import functions as F

from kinetrail.sources import readers as R, writers as Wr


def test_tar(spark, tmp_path):
    d = tmp_path / "shards"
    d.mkdir()
    for k in range(3):
        with tarfile.open(d / f"{k}.tar", "w") as tar:
            for name, data in ((f"s{k}.json", json.dumps({"a": k}).encode()), (f"s{k}.jpg", b"\xff\xd8"), (f"bad{k}.json", b"{")):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (d / "9.tar").write_bytes(b"not a tar")
    rows = R.tar_samples(spark, [str(d)]).collect()
    assert sorted(r.key for r in rows if r.json) == ["s0", "s1", "s2"] and sum(r.error is not None for r in rows) == 4
    assert R.list_files(spark, [str(d)], "*.tar", 2).count() == 2 and R.list_files(spark, [str(d)], "*.tar", -1).count() == 4


def test_sidecars_and_poses(spark, tmp_path):
    (tmp_path / "episode1_subtask.json").write_text(json.dumps({"fps": 5, "reasoning": {"0.0": {"plan": ["a", "b"], "subtask": "a"}}}))
    (tmp_path / "episode1.json").write_text(json.dumps({"seen": ["do it", "now"]}))
    (tmp_path / "episode2_subtask.json").write_text(json.dumps({"fps": 5, "reasoning": {}}))
    (tmp_path / "episode3.json").write_text(json.dumps({"seen": ["x"]}))
    got = R.sidecars(spark, str(tmp_path)).collect()
    assert [(r.episode, r.fps, r.seen[0], r.reasoning["0.0"].subtask) for r in got] == [("episode1", 5.0, "do it", "a")]
    pose = tmp_path / "pose.json"
    pose.write_text(json.dumps({k: [[0, 1, 2], [3, 4, 5]] if "pose" in k else [0.1, 0.2] for k in ("left_endpose", "left_gripper", "right_endpose", "right_gripper")}))
    assert [(r.t, r.left_endpose[0], r.right_gripper) for r in R.endposes(spark, str(pose)).orderBy("t").collect()] == [(0, 0.0, 0.1), (1, 3.0, 0.2)]


def test_recipe():
    text = "group_a:\n  dataset_names:\n  - one\n  - two\n  image_args:\n    size: 980\n    stride: 14\n  weight: 0.5  # share\n  is_mandatory: true\n  num_used_data: [10, -1]\ngroup_b:\n  weight: 1\n"
    got = R.recipe(text)
    assert got["group_a"]["dataset_names"] == ["one", "two"] and got["group_a"]["image_args"] == {"size": 980, "stride": 14}
    assert got["group_a"]["weight"] == 0.5 and got["group_a"]["is_mandatory"] is True and got["group_a"]["num_used_data"] == [10, -1] and got["group_b"] == {"weight": 1}


def test_statistics_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for parts in (["a", "b"], ["a", "b"], ["a", "c"]):
        assert R.cached_statistics(spark, str(tmp_path), parts, compute).count() == 3
    assert len(calls) == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], None)], "k int, l array<string>, s string")
    assert Wr.as_text(df).first().asDict() == {"k": "1", "l": '["a"]', "s": ""}
    out = str(tmp_path / "o")
    assert Wr.write_new(spark.range(3).withColumnRenamed("id", "ep"), out, "ep").count() == 3
    Wr.write_new(spark.range(5).withColumnRenamed("id", "ep"), out, "ep")
    assert sorted(r.ep for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    steps = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b")], "traj long, t long, s string")
    r = Wr.episode_plans(steps, "traj", "s", 10.0).first()
    assert r.reasoning["0.0"].plan == ["a", "b"] and r.reasoning["0.2"].subtask == "b"
    assert spark.range(1).select(Wr.frame_name(F.lit(7))).first()[0] == "frame_00007.jpg"
    frames = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "ep long, frame_id int, current_subtask string")
    Wr.write_annotations(spark.createDataFrame([(1, "a table")], "ep long, scene_description string"), frames, "ep", str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j")).first()
    assert [f.current_subtask for f in back.frame_annotations] == ["a", "b"]


def test_poses_and_statistics_as_json(spark, tmp_path):
    from kinetrail.operators.stats import statistics
    from kinetrail.sources.writers import write_poses, write_statistics

    poses = spark.createDataFrame([(1, 1, [2.0], 0.2), (1, 0, [1.0], 0.1), (2, 0, [3.0], 0.3)], "ep long, t long, left_endpose array<double>, left_gripper double")
    write_poses(poses, str(tmp_path / "p"))
    got = {r.ep: (r.left_endpose, r.left_gripper) for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got == {1: ([[1.0], [2.0]], [0.1, 0.2]), 2: ([[3.0]], [0.3])}
    df = spark.createDataFrame([("d", [1.0, 2.0]), ("d", [3.0, 2.0])], "name string, action array<double>")
    write_statistics(statistics(df, "action", ["name"]), "name", str(tmp_path / "s"))
    r = spark.read.json(str(tmp_path / "s")).first()
    assert r.name == "d" and r.action["mean"] == [2.0, 2.0] and r.action["max"] == [3.0, 2.0]


def test_episode_rows(spark, tmp_path):
    """Rows of each file, 0 for one that cannot be read."""
    from kinetrail.sources.readers import episode_rows

    for name, n in (("a", 5), ("b", 2)):
        spark.range(n).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "c.parquet").write_bytes(b"no parquet")
    got = {r.path.rsplit("/", 1)[1]: r.rows for r in episode_rows(spark, str(tmp_path), "id long").collect()}
    assert got == {"a.parquet": 5, "b.parquet": 2, "c.parquet": 0}


def test_frames_to_write(spark):
    from kinetrail.sources.writers import extracted

    df = spark.createDataFrame([(1, 4), (2, 2), (3, 0)], "v long, n long")
    of = lambda **x: sorted((r.v, r.frame) for r in extracted(df, "v", "n", **x).collect())
    assert of() == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)] and of(start=2, most=1) == [(1, 2)]
