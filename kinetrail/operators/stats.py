"""Statistics, normalisation, trajectory filters and small helpers of the trajectory operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetrail.operators.views import steps
from kinetrail.operators.windows import changed

#: Rows of statistics (datasets) up to which they are broadcast.
MAX_DATASETS = 10_000
#: Draws that one call may ask for.
MAX_DRAWS = 1_000_000


def small(df: DataFrame, rows: int = MAX_DATASETS) -> DataFrame:
    """A table with a broadcast hint if it has at most so many rows, else without one: Spark then joins by a shuffle. The count's work is kept in the session's cache, as the table is small if it is used."""
    df = df.persist()
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    df.unpersist()
    return df


#: Rank error of the sketches that bracket a quantile, as a share of the rows, and how far the bracket reaches.
SKETCH, REACH = 10_000, 3e-4


def quantiles(long: DataFrame, by: list[str], v: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation by group, in two passes: mergeable sketches bracket each quantile, then the rows below a bracket are counted and only the different values inside are ranked.
    So no aggregation buffer holds a group's values. Nulls and NaN are left out."""
    long = long.where(F.col(v).isNotNull() & ~F.isnan(v)).select(*by, F.col(v).cast("double").alias("_v"))
    edges = [e for p in shares.values() for e in (max(p - REACH, 0.0), min(p + REACH, 1.0))]
    brackets = long.groupBy(*by).agg(F.percentile_approx("_v", edges, SKETCH).alias("_e"), F.count("*").alias("_n"))
    near = long.join(small(brackets), by)
    names = list(shares)
    cut = [(F.col("_e")[2 * i], F.col("_e")[2 * i + 1]) for i in range(len(names))]
    side = lambda lo, hi: F.when(F.col("_v") < lo, -1).when(F.col("_v") > hi, 1).otherwise(0)
    sides = F.array(*(F.struct(F.lit(i).alias("i"), side(lo, hi).alias("side")) for i, (lo, hi) in enumerate(cut)))
    near = near.select(*by, "_n", "_v", F.explode(sides).alias("_x")).select(*by, "_n", "_v", "_x.i", "_x.side")
    # inside a bracket all different values; below it their count and the largest, above it the least, as the two ranks of a quantile can lie on both sides of an edge
    value = F.when(F.col("side") == 0, F.col("_v"))
    counts = near.groupBy(*by, "i", "side", value.alias("_k")).agg(F.max("_n").alias("_n"), F.count("*").alias("_c"), F.when(F.col("side") < 0, F.max("_v")).otherwise(F.min("_v")).alias("_v"))
    w = Window.partitionBy(*by, "i").orderBy("side", "_v")
    counts = counts.withColumn("_hi", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lo", F.col("_hi") - F.col("_c"))
    share = F.array(*(F.lit(float(p)) for p in shares.values()))[F.col("i")]
    at = share * (F.col("_n") - 1)
    holds = lambda r: F.max(F.when((F.col("side") == 0) & (F.col("_lo") <= r) & (F.col("_hi") > r) | (F.col("side") < 0) & (F.col("_hi") - 1 == r) | (F.col("side") > 0) & (F.col("_lo") == r), F.col("_v")))
    found = counts.withColumn("_at", at).groupBy(*by, "i").agg(holds(F.floor("_at")).alias("_a"), holds(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    got = F.when(F.col("_f") == 0, F.col("_a")).otherwise((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("i") == i, got)).alias(n) for i, n in enumerate(names)))


def statistics(df: DataFrame, action: str, by: list[str] | None = None, exact: bool = True, quantiled: bool = True) -> DataFrame:
    """By dimension of a vector column (dim): mean, population std, max, min and 1 % and 99 % quantiles, exact (in a second pass) or by mergeable sketches; null if not
    quantiled, as the modes normal and bounds do not need them."""
    v, keys = F.col("v"), [*(by or []), "dim"]
    q = (lambda p: F.percentile_approx(v, p, SKETCH)) if quantiled and not exact else (lambda p: F.lit(None).cast("double"))
    long = df.select(*(by or []), F.posexplode(action).alias("dim", "v"))
    out = long.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), q(0.01).alias("q01"), q(0.99).alias("q99"))
    if not (quantiled and exact):
        return out
    return out.drop("q01", "q99").join(small(quantiles(long, keys, "v", {"q01": 0.01, "q99": 0.99})), keys, "left")


def normalize(df: DataFrame, action: str, stats: DataFrame, mode: str, mask: list[bool], by: list[str]) -> DataFrame:
    """Normalises a vector column by its dataset's statistics. normal: (x - mean) / (std + 1e-8); bounds and bounds_q99: to [-1, 1] between min and max or the
    quantiles, clipped. Unmasked dimensions keep their value, but in the bounds modes a dimension whose min equals its max becomes 0 even so."""
    wide = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std", "min", "max", "q01", "q99"))).alias("_s"))
    if mode == "normal":
        def one(x: Column, s: Column) -> Column:
            return (x - s["mean"]) / (s["std"] + 1e-8)
    elif mode in ("bounds", "bounds_q99"):
        low, high = ("min", "max") if mode == "bounds" else ("q01", "q99")

        def one(x: Column, s: Column) -> Column:
            return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (x - s[low]) / (s[high] - s[low] + 1e-8) - 1))
    else:
        raise ValueError(f"unknown normalisation {mode!r}")
    flags = F.array(*map(F.lit, mask))

    def at(x: Column, i: Column) -> Column:
        s = F.get("_s", i)
        value = F.when(F.get(flags, i), one(x, s)).otherwise(x)
        return value if mode == "normal" else F.when(s["min"] == s["max"], 0.0).otherwise(value)

    return df.join(small(wide), by).withColumn(action, F.transform(action, at)).drop("_s")


def offset_of(key: Column, offsets: dict) -> Column:
    """A constant of a small table by key (text, as a dataset's name, or numbers); an unknown key is an error."""
    table = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    kind = "string" if isinstance(next(iter(offsets), ""), str) else "int"
    return F.coalesce(table[key.cast(kind)], F.raise_error(F.lit("no goal offset for this dataset")).cast("int"))


def still_trim(df: DataFrame, state: str, least: float, by: str = "traj") -> DataFrame:
    """Steps from one before the first that differs from the trajectory's first state by more than least in any dimension; first_idx is that step. Trajectories that never do go."""
    first = F.first(state).over(steps(by=by).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_moved", F.exists(F.zip_with(state, first, lambda a, b: F.abs(a - b)), lambda x: x > least))
    df = df.withColumn("first_idx", F.min(F.when(F.col("_moved"), F.col("t"))).over(Window.partitionBy(by)))
    return df.where(F.col("t") >= F.col("first_idx") - 1).drop("_moved")


def keep_if_any(df: DataFrame, test: Column, by: str = "traj") -> DataFrame:
    """Whole trajectories with a step that passes."""
    return df.withColumn("_any", F.max(test).over(Window.partitionBy(by))).where("_any").drop("_any")


def keep_if_bounded(df: DataFrame, vector: str, most: float, by: str = "traj") -> DataFrame:
    """Whole trajectories whose values all stay within most."""
    ok = F.forall(vector, lambda x: F.abs(x) <= most)
    return df.withColumn("_all", F.min(ok).over(Window.partitionBy(by))).where("_all").drop("_all")


def moves(vector: str, zero: list[float], least: float) -> Column:
    """Whether any of the first dimensions differs from its rest value."""
    rest = F.array(*map(F.lit, zero))
    return F.exists(F.zip_with(F.slice(vector, 1, len(zero)), rest, lambda a, b: F.abs(a - b)), lambda x: x > least)


def drop_first(df: DataFrame) -> DataFrame:
    """Without the first step; the others are renumbered."""
    return df.where("t > 0").withColumn("t", F.col("t") - 1)


def relabel_from_state(df: DataFrame, action: str, state: str, dims: int, by: str = "traj") -> DataFrame:
    """The first dims of an action become the next state's difference; the last step goes."""
    ahead = F.lead(state).over(steps(by=by))
    diff = F.zip_with(F.slice("_next", 1, dims), F.slice(state, 1, dims), lambda a, b: a - b)
    rest = F.slice(action, dims + 1, 1000)
    return df.withColumn("_next", ahead).where("_next is not null").withColumn(action, F.concat(diff, rest)).drop("_next")


def pad_mask_dict(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds pad_mask_dict: which columns are real. Empty strings are padding; other types are always real."""
    strings = {c for c, kind in df.dtypes if kind == "string"}
    flags = [F.length(F.coalesce(F.col(c), F.lit(""))) > 0 if c in strings else F.lit(True) for c in cols]
    return df.withColumn("pad_mask_dict", F.create_map(*(x for c, f in zip(cols, flags, strict=True) for x in (F.lit(c), f))))


def proprio_or_zeros(proprio: str, action: str) -> Column:
    return F.coalesce(F.col(proprio), F.transform(action, lambda x: F.lit(0.0)))


#: Labels that mean nothing.
INVALID_LABELS = ("", "idle", "unknown", "none", "no action", "n/a", "nothing")


def valid_label(col: str) -> Column:
    """The label, or null if it says nothing."""
    return F.when(~F.lower(F.trim(F.coalesce(F.col(col), F.lit("")))).isin(*INVALID_LABELS), F.col(col))


def subtask_sequence(df: DataFrame, label: str, by: str = "traj") -> DataFrame:
    """Adds idx, the number of the subtask at each step, and total, the trajectory's subtasks in order (one for each change)."""
    w = Window.partitionBy(by)
    df = df.withColumn("_c", changed(label, by=by))
    df = df.withColumn("idx", (F.sum("_c").over(steps(by=by).rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    runs = F.sort_array(F.collect_list(F.when(F.col("_c") == 1, F.struct("t", F.col(label).alias("label")))).over(w))
    return df.withColumn("total", F.transform(runs, lambda r: r["label"])).drop("_c")


#: Parts of the whole weight by which draws meet the items.
CELLS = 10_000


def draw_by_weight(items: DataFrame, key: str, weight: str, n: int, draw: Callable[[Column], Column]) -> DataFrame:
    """n draws with replacement in proportion to integer weights: (i, key). draw(i) gives a long, taken modulo the total. Weights are one row for each item; their
    running sums are made in blocks, so no task needs them all. An item meets the draws of the cells that its weight covers, by an equi join."""
    if n > MAX_DRAWS:
        raise ValueError(f"at most {MAX_DRAWS} draws in one call")
    blocks = items.withColumn("_b", F.floor(F.col(key) / 1000))
    sums = blocks.groupBy("_b").agg(F.sum(weight).alias("_n"))
    base = sums.withColumn("_base", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    total = base.agg(F.sum("_n").alias("total"))
    inside = F.sum(weight).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    cell = lambda c: F.expr(f"({c} * {CELLS}) div total")
    spans = blocks.join(base, "_b").withColumn("_hi", F.col("_base") + inside).withColumn("_lo", F.col("_hi") - F.col(weight)).where(F.col(weight) > 0)
    spans = spans.join(F.broadcast(total)).withColumn("_cell", F.explode(F.sequence(cell("_lo"), cell("(_hi - 1)"))))
    draws = items.sparkSession.range(n).withColumnRenamed("id", "i").join(F.broadcast(total)).withColumn("_u", F.pmod(draw(F.col("i")), F.col("total")))
    draws = draws.select("i", "_u", cell("_u").alias("_cell"))
    return spans.join(F.broadcast(draws), "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("i", key)
