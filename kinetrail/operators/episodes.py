"""An episode to one training sample at a drawn step: state, moments, action chunk, image history, thought and goal, with one exchange of the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetrail.functions import text as T
from kinetrail.operators.annotations import cleaned
from kinetrail.operators.views import steps


def _drawn(df: DataFrame, by: str, state: str, dims: int, least: float, draw: Column, chunk: int) -> DataFrame:
    """One row for each episode that moves: n_steps, first (its first step that differs from step 0 by more than least), step (drawn from first - 1 on), state and arms' labels there, moments of all states,
    actions and labels of the next chunk steps (fewer at the end)."""
    start = F.first(state).over(steps(by=by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_m", F.exists(F.zip_with(state, start, lambda a, b: F.abs(a - b)), lambda x: x > least))
    whole = Window.partitionBy(by)
    df = df.withColumn("first", F.min(F.when(F.col("_m"), F.col("t"))).over(whole)).withColumn("n_steps", F.count("*").over(whole)).where("first is not null")
    df = df.withColumn("step", F.col("first") - 1 + F.pmod(draw, F.col("n_steps") - F.col("first") + 1))
    ahead = (F.col("t") >= F.col("step")) & (F.col("t") < F.col("step") + chunk)
    now = lambda c: F.max(F.when(F.col("t") == F.col("step"), F.col(c))).alias(c)
    dim = [F.element_at(state, i + 1) for i in range(dims)]
    row = df.groupBy(by).agg(
        *(F.first(c).alias(c) for c in ("n_steps", "first", "step")), now(state), now("left"), now("right"),
        F.array(*map(F.avg, dim)).alias("state_mean"), F.array(*map(F.stddev_pop, dim)).alias("state_std"), F.array(*(F.sqrt(F.avg(x * x)) for x in dim)).alias("state_norm"),
        F.array_sort(F.collect_list(F.when(ahead, F.struct("t", "action", "left", "right")))).alias("_x"),
    )
    part = lambda c: F.transform("_x", lambda x: x[c])
    actions = part("action")
    actions = F.concat(actions, F.array_repeat(F.element_at(actions, -1), F.lit(chunk) - F.size(actions)))
    return row.withColumn("actions", actions).withColumn("lefts", part("left")).withColumn("rights", part("right")).drop("_x")


def _images(history: int) -> tuple[Column, Column]:
    """Steps of the images up to the drawn one, the first of them in front of a short history; and which are real, counted from the step before the first move."""
    at = F.sequence(F.greatest(F.col("step") - history + 1, F.lit(0)), F.col("step"))
    frames = F.concat(F.array_repeat(F.get(at, F.lit(0)), F.lit(history) - F.size(at)), at)
    real = F.least(F.col("step") - F.col("first") + 2, F.lit(history))
    return frames.alias("frames"), F.transform(F.sequence(F.lit(1), F.lit(history)), lambda i: i > F.lit(history) - real).alias("mask")


_OUT = ("n_steps", "step", "state", "state_mean", "state_std", "state_norm", "actions")


def simulated_samples(df: DataFrame, sidecars: DataFrame, by: str, dims: int, chunk: int, history: int, draw: Column, pick: Column, least: float = 0.01) -> DataFrame:
    """Steps (by, t, state, action, left, right) and sidecars (by, fps, reasoning: seconds as text -> plan and subtask, seen) to samples: n_steps, step, instruction, state, its moments, actions,
    frames, mask, thought and goal. draw and pick are longs that may use by's column: they give the step and the instruction. Episodes that do not move by more than least or miss a sidecar, instruction or
    reasoning go. The subtask is the latest that has begun (the first before that), its goal the frame before the next begins, else the last. Labels that are null count as empty texts."""
    side = sidecars.where((F.size("reasoning") > 0) & (F.size("seen") > 0)).select(by, F.coalesce(F.col("fps"), F.lit(10.0)).alias("fps"), "reasoning", "seen")
    df = df.withColumn("left", F.coalesce("left", F.lit(""))).withColumn("right", F.coalesce("right", F.lit("")))
    row = _drawn(df, by, "state", dims, least, draw, chunk).join(side, by)
    entries = F.array_sort(F.transform(F.map_entries("reasoning"), lambda e: F.struct(e["key"].cast("double").alias("s"), e["value"].alias("v"))))
    row = row.withColumn("_e", entries).withColumn("_i", F.greatest(F.size(F.filter("_e", lambda e: e["s"] <= F.col("step") / F.col("fps"))), F.lit(1)))
    now, ahead = F.element_at("_e", F.col("_i"))["v"], F.get("_e", F.col("_i"))["s"]
    goal = F.coalesce((ahead * F.col("fps")).cast("long"), F.col("n_steps")) - 1
    goal = F.greatest(F.lit(0), F.least(goal, F.col("n_steps") - 1)).cast("long").alias("goal")
    thought = T.subtask_thought(F.array_join(F.coalesce(now["plan"], F.array().cast("array<string>")), "\n"), F.coalesce(now["subtask"], F.lit("")), F.col("left"), F.col("right"))
    told = F.get("seen", F.pmod(pick, F.size("seen")).cast("int")).alias("instruction")
    return row.select(by, *_OUT, told, *_images(history), thought.alias("thought"), goal)


def robot_samples(df: DataFrame, instruction: str, by: str, dims: int, history: int, draw: Column, chunk: int = 50, least: float = 0.01) -> DataFrame:
    """The same for recordings of a robot: one instruction for all, the arms' labels over the whole chunk as thought, and the frame a chunk ahead (the last at most) as goal."""
    df = df.withColumn("left", cleaned(F.coalesce("left", F.lit("")))).withColumn("right", cleaned(F.coalesce("right", F.lit(""))))
    row = _drawn(df, by, "state", dims, least, draw, chunk)
    goal = F.least(F.col("step") + chunk, F.col("n_steps") - 1).alias("goal")
    return row.select(by, *_OUT, F.lit(instruction).alias("instruction"), *_images(history), T.arms_thought(F.col("lefts"), F.col("rights")).alias("thought"), goal)
