"""Windows over trajectories: histories, chunks, goals, gripper clean-up, relabelling, runs and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetrail.operators.views import steps


def history(col: str, size: int, by: str = "traj") -> Column:
    """The last size values up to this step; the trajectory's first value fills the front."""
    got = F.collect_list(col).over(steps(by=by).rowsBetween(1 - size, 0))
    return F.concat(F.array_repeat(got[0], F.lit(size) - F.size(got)), got)


def pad_mask(size: int) -> Column:
    """Which entries of a history are real: index t - size + 1 + i >= 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.col("t") - size + 1 + i >= 0)


def last_step(by: str = "traj") -> Column:
    return F.max("t").over(Window.partitionBy(by))


def chunk(col: str, size: int, goal: Column | None = None, by: str = "traj") -> Column:
    """Values of steps t .. t + size - 1, clamped to the goal step (the trajectory's last by default)."""
    ahead = F.collect_list(col).over(steps(by=by).rowsBetween(0, size - 1))
    goal = last_step(by) if goal is None else goal
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.element_at(ahead, (F.greatest(F.least(F.col("t") + i, goal) - F.col("t"), F.lit(0)) + 1).cast("int")))


def neutral(chunks: Column, goal: Column, absolute: list[bool]) -> Column:
    """Past the goal, relative dimensions of a chunk's actions are 0 and absolute ones keep the clamped value."""
    mask = F.array(*map(F.lit, absolute))
    return F.transform(chunks, lambda a, i: F.when(F.col("t") + i > goal, F.zip_with(a, mask, lambda v, m: F.when(m, v).otherwise(0.0))).otherwise(a))


def at_step(df: DataFrame, target: Column, value: str, alias: str, by: str = "traj") -> DataFrame:
    """Adds the value of another step of the same trajectory: an equi join on (trajectory, step)."""
    there = df.select(F.col(by), F.col("t").alias("_target"), F.col(value).alias(alias))
    return df.withColumn("_target", target.cast("long")).join(there, [by, "_target"]).drop("_target")


def binarize_gripper(g: str, by: str = "traj") -> Column:
    """Open and closed readings become 1 and 0; in between, the next settled reading counts, at the end the last raw one."""
    flag = F.when(F.col(g) > 0.95, 1.0).when(F.col(g) < 0.05, 0.0)
    ahead = steps(by=by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.coalesce(F.first(flag, ignorenulls=True).over(ahead), F.last(g).over(ahead))


def relative_to_absolute(a: str, by: str = "traj") -> Column:
    """Relative gripper commands to an absolute state in {0, 1}: close is negative; before the first command the opposite of it holds."""
    move = F.when(F.col(a) < -0.1, 1.0).when(F.col(a) > 0.1, -1.0)
    w = steps(by=by)
    state = F.coalesce(F.last(move, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), -F.first(move, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))
    return state / 2 + 0.5


def changed(*cols: str, by: str, order: str = "t") -> Column:
    """1 where any of the columns differs from the step before (nulls compare equal), else 0; the first step counts as a change."""
    w = Window.partitionBy(by).orderBy(order)
    diff = F.lit(False)
    for c in cols:
        diff = diff | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return (diff | (F.row_number().over(w) == 1)).cast("int")


def run_id(*cols: str, by: str, order: str = "t") -> tuple[Column, Column]:
    """(change flag, running number) — the flag must be a column before the running sum can use it."""
    return changed(*cols, by=by, order=order), F.sum("_change").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def with_runs(df: DataFrame, *cols: str, by: str, alias: str, order: str = "t") -> DataFrame:
    flag, number = run_id(*cols, by=by, order=order)
    return df.withColumn("_change", flag).withColumn(alias, (number - 1).cast("long")).drop("_change")


def carried(value: Column, by: str, default, order: str = "t") -> Column:
    """Last valid value so far (null is invalid), default before the first."""
    return F.coalesce(F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(default))


def frame_deltas(df: DataFrame, by: str = "ep") -> DataFrame:
    """Adds dx, dy, dz, speed, dg against the step before; 0 at the first."""
    w = steps(by=by)
    for c, d in (("x", "dx"), ("y", "dy"), ("z", "dz"), ("gripper", "dg")):
        df = df.withColumn(d, F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    return df.withColumn("speed", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))


def action_segments(df: DataFrame, velocity: float, gripper: float, min_idle: int, by: str = "ep") -> DataFrame:
    """Adds idle, and seg: the number of the action segment, null on long idle runs and in idle episodes. Idle runs of min_idle steps or more separate segments."""
    still = (F.col("speed") < velocity) & (F.abs("dg") < gripper) | (F.col("t") == 0)
    df = with_runs(frame_deltas(df, by).withColumn("idle", still), "idle", by=by, alias="run")
    long = F.col("idle") & (F.count("*").over(Window.partitionBy(by, "run")) >= min_idle)
    df = df.withColumn("long", long).withColumn("all_idle", F.min("idle").over(Window.partitionBy(by)))
    before = F.sum(F.col("long").cast("int")).over(steps(by=by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("seg", F.when(~F.col("long") & ~F.col("all_idle"), before)).drop("run")


def direction(dx: str, dy: str, dz: str, ratio: float, eps: float) -> Column:
    """Axes that carry at least ratio of a displacement, in the order x, y, z, joined by _; empty below eps or without displacement."""
    total = F.sqrt(F.col(dx) * F.col(dx) + F.col(dy) * F.col(dy) + F.col(dz) * F.col(dz))
    part = [F.when(F.try_divide(F.abs(c), total) >= ratio, F.when(F.col(c) > 0, up).otherwise(down)) for c, up, down in ((dx, "right", "left"), (dy, "forward", "backward"), (dz, "up", "down"))]
    return F.when(total < eps, "").otherwise(F.concat_ws("_", *part))


def atomic_labels(df: DataFrame, velocity: float, gripper: float, min_idle: int, ratio: float, eps: float, by: str = "ep") -> DataFrame:
    """Adds action (idle, grasp, release or move) and direction of each step. A move's direction is that of its run's displacement after its first step."""
    df = action_segments(df, velocity, gripper, min_idle, by)
    act = F.when(F.col("seg").isNull(), "idle").when((F.col("dg") <= -gripper) & (F.col("t") >= 1), "grasp").when((F.col("dg") >= gripper) & (F.col("t") >= 1), "release").otherwise("move")
    df = with_runs(df.withColumn("action", act), "action", "seg", by=by, alias="sub")
    w = Window.partitionBy(by, "sub")
    df = df.withColumn("first", F.min("t").over(w))
    for d in ("dx", "dy", "dz"):
        df = df.withColumn(f"sum_{d}", F.sum(F.when(F.col("t") > F.col("first"), F.col(d)).otherwise(0.0)).over(w))
    return df.withColumn("direction", F.when(F.col("action") == "move", direction("sum_dx", "sum_dy", "sum_dz", ratio, eps)).otherwise(""))


#: Where a gripper goes, by direction.
PLACES = {
    "up": "upper", "down": "lower", "left": "left", "right": "right", "forward": "front", "backward": "back",
    "left_up": "upper-left", "right_up": "upper-right", "left_down": "lower-left", "right_down": "lower-right",
    "left_forward": "front-left", "right_forward": "front-right", "left_backward": "back-left", "right_backward": "back-right",
    "backward_up": "upper-back", "backward_down": "lower-back", "forward_up": "upper-front", "forward_down": "lower-front",
    "left_forward_up": "upper-left-front", "right_forward_up": "upper-right-front", "left_backward_up": "upper-left-back", "right_backward_up": "upper-right-back",
    "left_forward_down": "lower-left-front", "right_forward_down": "lower-right-front", "left_backward_down": "lower-left-back", "right_backward_down": "lower-right-back",
}
UNKNOWN = "Unknown action."


def sentences(arm: str) -> dict[tuple[str, str], str]:
    """Sentence of each (action, direction) of an arm; other pairs have none."""
    still = {("idle", ""): f"Keep the {arm} arm idle.", ("grasp", ""): f"Close the {arm} gripper.", ("release", ""): f"Open the {arm} gripper."}
    return still | {("move", d): f"Move the {arm} gripper to the {place}." for d, place in PLACES.items()}


def sentence(arm: str, action: Column, direction_: Column) -> Column:
    """The sentence of an arm's label, by a lookup in a constant map."""
    table = F.create_map(*(F.lit(x) for (a, d), s in sentences(arm).items() for x in (f"{a}|{d}", s)))
    return F.coalesce(table[F.concat(action, F.lit("|"), direction_)], F.lit(UNKNOWN))
