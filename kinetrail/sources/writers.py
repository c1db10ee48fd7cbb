"""Writers: JSON labels, annotations with NULL as empty text, partitioned output that skips what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def as_text(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, nulls as empty text; other columns as text."""
    def one(f: T.StructField):
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.coalesce(F.to_json(f.name) if nested else F.col(f.name).cast("string"), F.lit("")).alias(f.name)

    return df.select(*map(one, df.schema.fields))


def write_annotations(scenes: DataFrame, frames: DataFrame, by: str, path: str) -> None:
    """One JSON object for each episode: scene_description and frame_annotations in order of frame_id."""
    cols = [c for c in frames.columns if c != by]
    rows = frames.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("frame_id", *(c for c in cols if c != "frame_id")))).alias("frame_annotations"))
    scenes.join(rows, by, "left").select(by, "scene_description", "frame_annotations").write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Frame labels: frame as text, [action, direction] of each arm, and each arm's sentence."""
    arm = lambda a: F.array(f"{a}_action", f"{a}_direction").alias(f"{a}_arm")
    labels.select("ep", F.col("t").cast("string").alias("frame"), arm("left"), arm("right"), F.col("left_sentence").alias("left_arm_discription"), F.col("right_sentence").alias("right_arm_discription")).write.mode("overwrite").json(path)


def frame_name(number):
    return F.format_string("frame_%05d.jpg", number)


def write_new(df: DataFrame, path: str, by: str) -> DataFrame:
    """Appends only the groups that the output does not hold yet; returns what was written."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(by).distinct(), by, "left_anti")
    df.write.mode("append").parquet(path)
    return df


def episode_plans(df: DataFrame, by: str, label: str, fps: float) -> DataFrame:
    """Frame labels to the episodes' reasoning: seconds (as text) of each subtask's start -> what is left to do and the subtask."""
    from kinetrail.operators.stats import subtask_sequence
    from kinetrail.operators.windows import changed

    df = subtask_sequence(df, label, by).withColumn("_c", changed(label, by=by)).where("_c = 1")
    entry = F.struct((F.col("t") / fps).cast("string").alias("key"), F.struct(F.slice("total", F.col("idx").cast("int") + 1, 10_000).alias("plan"), F.col(label).alias("subtask")).alias("value"))
    return df.groupBy(by).agg(F.map_from_entries(F.collect_list(entry)).alias("reasoning")).withColumn("fps", F.lit(float(fps)))


def _field(name: str):
    return lambda x: x[name]


def write_poses(poses: DataFrame, path: str) -> None:
    """One JSON object for each episode (ep, t, left_endpose, left_gripper, right_endpose, right_gripper by step): its lists in order of t."""
    sides = [c for c in poses.columns if c not in ("ep", "t")]
    rows = poses.groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("t", *sides))).alias("_x"))
    rows.select("ep", *(F.transform("_x", _field(c)).alias(c) for c in sides)).write.mode("overwrite").json(path)


def write_statistics(stats: DataFrame, by: str, path: str) -> None:
    """One JSON object for each dataset: mean, std, max, min, q01 and q99 as lists over the dimensions. stats: from operators.stats.statistics."""
    names = ("mean", "std", "max", "min", "q01", "q99")
    rows = stats.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dim", *names))).alias("_x"))
    rows.select(by, F.struct(*(F.transform("_x", _field(c)).alias(c) for c in names)).alias("action")).write.mode("overwrite").json(path)


def extracted(videos: DataFrame, by: str, frames: str, start: int = 0, most: int = -1) -> DataFrame:
    """Frames to write of each video: (by, frame, name), from start on and at most so many (-1: all)."""
    stop = F.col(frames) - 1 if most <= 0 else F.least(F.col(frames) - 1, F.lit(start + most - 1))
    rows = videos.where(F.col(frames) > start).select(by, F.explode(F.sequence(F.lit(start).cast("long"), stop.cast("long"))).alias("frame"))
    return rows.withColumn("name", frame_name(F.col("frame")))


def json_texts(x):
    """A list of texts as JSON with a space after each comma."""
    one = F.transform(x, lambda v: F.to_json(F.array(v)))
    return F.concat(F.lit("["), F.array_join(F.transform(one, lambda v: v.substr(F.lit(2), F.length(v) - 2)), ", "), F.lit("]"))


def annotation_arrays(frames: DataFrame, by: str) -> DataFrame:
    """What an episode's annotations are written as: total_subtasks of its first frame, and in order of frame_id current_subtask, current_subtask_index, remaining_subtasks (JSON text) and
    moving_instruction. frames: by, frame_id, total_subtasks, current_subtask, current_subtask_index, remaining_subtasks, moving_instruction. An episode must fit a row, as it does in its file."""
    names = ("current_subtask", "current_subtask_index", "remaining_subtasks", "moving_instruction")
    some = frames.withColumn("current_subtask_index", F.col("current_subtask_index").cast("int")).withColumn("remaining_subtasks", json_texts(F.col("remaining_subtasks")))
    rows = some.groupBy(by).agg(F.min_by("total_subtasks", "frame_id").alias("total_subtasks"), F.array_sort(F.collect_list(F.struct("frame_id", *names))).alias("_x"))
    return rows.select(by, "total_subtasks", *(F.transform("_x", _field(c)).alias(c) for c in names))
