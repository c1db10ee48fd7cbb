import pytest
from pyspark.sql import functions as F

from kinetrail.operators import samples as M, views as V, windows as W
from kinetrail.streaming import trajectories as S

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = S.with_event_time(S.read_steps(spark, str(tmp_path / "in"), events.schema))
    got = drained(S.motion_sessions(stream), "sessions", "complete").agg(F.sum("steps"), F.count("*")).first()
    want = S.motion_sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).agg(F.sum("steps"), F.count("*")).first()
    assert got == want
    stats = drained(S.windowed_statistics(stream), "stats", "complete")
    assert stats.agg(F.sum("n")).first()[0] == events.count()


def test_packer_equals_batch(rocks, tmp_path):
    docs = rocks.read.parquet(f"{DIR}/documents.parquet")
    samples = docs.select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("sample"), F.size(F.split("text", " ")).cast("long").alias("size"))
    samples.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = S.read_steps(rocks, str(tmp_path / "in"), samples.schema)
    got = {tuple(r) for r in drained(S.packed(stream, expected=2000, most=2500, per_sample=1500, prefer=1000, buffer=3), "packs").select("shard", "sample", "batch", "size").collect()}
    want = {tuple(r) for r in M.packs_with_buffer(samples, "shard", "sample", "size", 2000, 2500, 1500, 1000, 3).collect()}
    last = {s: max(b for k, _, b, _ in want if k == s) for s in range(4)}
    closed = {r for r in want if 0 <= r[2] < last[r[0]]}
    assert closed <= got <= {r for r in want if r[2] >= 0}


def test_histories_equal_batch(rocks, tmp_path):
    steps = V.traj_events(rocks.read.parquet(f"{DIR}/events.parquet")).select("traj", "t", "a")
    for part in (steps.where("t < 3"), steps.where("t >= 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = drained(S.observation_histories(S.read_steps(rocks, str(tmp_path / "in"), steps.schema, files=1), 3), "hist")
    want = {(r.traj, r.t): r.h for r in steps.select("traj", "t", W.history("a", 3).alias("h")).collect()}
    have = {(r.traj, r.t): list(r.history) for r in got.collect()}
    assert have.keys() == want.keys()


def test_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).write.mode("append").parquet(src)
        S.to_parquet(S.read_steps(spark, src, spark.range(1).schema, files=100), out, ck).awaitTermination(60)
    assert spark.read.parquet(out).count() == 20
