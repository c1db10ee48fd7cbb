"""Mixtures of datasets, sharding, splits, frame sampling and file lists."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """The first entry of each name."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("_r = 1").drop("_r")


def mixture_weights(df: DataFrame, weight: str, size: str | None) -> DataFrame:
    """Adds norm: weights, times sizes if balanced, as shares. A mixture is a small table, so one task may sum it."""
    w = F.col(weight) * (F.col(size) if size else F.lit(1.0))
    total = df.agg(F.sum(w).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("norm", w / F.col("_total")).drop("_total")


def epoch_length(df: DataFrame, raw: str, size: str, norm: str) -> DataFrame:
    """Steps until every dataset of raw weight 1 has been seen once; null if there is none."""
    return df.agg(F.floor(F.max(F.when(F.col(raw) == 1.0, F.col(size) / F.col(norm)))).alias("epoch"))


def choose(df: DataFrame, draws: DataFrame, key: str, weight: str, u: str) -> DataFrame:
    """Weighted choice: each draw u in [0, 1) gets the first entry whose cumulative share exceeds it. The entries are one bounded array that every draw searches, so draws are not shuffled."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.select(F.col(key).alias("k"), F.sum(weight).over(w).alias("c")).agg(F.sort_array(F.collect_list(F.struct("c", "k"))).alias("_e"))
    hit = F.filter("_e", lambda e: e["c"] > F.col(u) * F.element_at("_e", -1)["c"])
    return draws.crossJoin(F.broadcast(cum)).withColumn(key, F.get(hit, F.lit(0))["k"]).drop("_e")


def contiguous_shard(rank: Column, total: Column, world: int, workers: int) -> Column:
    """Contiguous shares of a list for world x workers readers; the tails that do not divide are dropped (null)."""
    per = F.floor(total / world)
    mine = F.floor(per / workers)
    at = rank - F.floor(rank / per) * per
    return F.when((rank < per * world) & (at < mine * workers), F.floor(rank / per) * workers + F.floor(at / mine)).cast("long")


def split_boundary(df: DataFrame, by: str, order: str, share: float = 0.95) -> DataFrame:
    """Adds split: train for the first round(share * n) rows of each dataset in stored order, else val."""
    w = Window.partitionBy(by)
    rank, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return df.withColumn("split", F.when(rank <= F.round(share * n), "train").otherwise("val"))


def first_n(df: DataFrame, by: list[str], order: str, n: int | None) -> DataFrame:
    """The first n rows of each directory; n null or negative: all."""
    if n is None or n < 0:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def allocate(n: int, weights: list[float]) -> list[int]:
    """n threads over weights: at least one each, whole parts next, then the largest remainders. A share below one takes its one first and leaves the rest to the others."""
    if n < len(weights) or any(w < 0 for w in weights):
        raise ValueError("every weight needs a thread and must not be negative")
    total = sum(weights)
    shares, out, free = [w / total for w in weights], [0] * len(weights), n
    while True:
        open_ = [i for i, s in enumerate(shares) if not out[i]]
        low = [i for i in open_ if shares[i] * free < 1]
        if not low:
            break
        for i in low:
            out[i] = 1
        free -= len(low)
        rest = sum(shares[i] for i in open_ if not out[i])
        if rest <= 0:
            break
        shares = [0.0 if out[i] else s / rest for i, s in enumerate(shares)]
    exact = [s * free if not out[i] else 0.0 for i, s in enumerate(shares)]
    whole = [math.floor(x) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (whole[i] - exact[i], -i))  # of equal remainders, the later first
    left = free - sum(whole)
    return [out[i] + whole[i] + (1 if i in order[:left] else 0) for i in range(len(weights))]


def evenly(n: int, frames: Column) -> Column:
    """n indices evenly from 0 to frames - 1, cut to whole numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (frames - 1) / F.lit(float(max(n - 1, 1)))).cast("int"))


def middle(n: int, frames: Column) -> Column:
    """The middle of each of n intervals between cut even points; shorter videos repeat their last index."""
    m = F.least(F.lit(n), frames)
    cut = lambda i: F.floor(i * frames.cast("double") / m).cast("int")
    got = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.floor((cut(i) + cut(i + 1) - 1) / 2).cast("int"))
    return F.concat(got, F.array_repeat(F.element_at(got, -1), F.lit(n) - m))


def at_rate(rate: float, frames: Column, fps: Column, most: int | None = None) -> Column:
    """Frames at the middles of 1 / rate seconds: half-even rounding, below the length, at most ``most``."""
    delta = 1.0 / rate
    seconds = frames / fps
    got = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(seconds * rate).cast("int"), F.lit(0))), lambda k: F.bround((k + 0.5) * delta * fps).cast("int"))
    got = F.filter(got, lambda i: i < frames)
    return F.slice(got, 1, most) if most else got


def frame_number(path: Column) -> Column:
    """Number before .jpg, -1 without one."""
    x = F.regexp_extract(path, r"_(\d+)\.jpg$", 1)
    return F.when(x == "", -1).otherwise(x.cast("int"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _ranges(n: int, frames: Column) -> Column:
    """First and last frame of each of n intervals between cut even points, of at most as many as there are frames."""
    m = F.least(F.lit(n), frames)
    cut = lambda i: F.floor(i * frames.cast("double") / m).cast("int")
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(cut(i).alias("a"), (cut(i + 1) - 1).alias("z")))


def _padded(got: Column, n: int) -> Column:
    return F.concat(got, F.array_repeat(F.element_at(got, -1), F.greatest(F.lit(n) - F.size(got), F.lit(0))))


def from_start(n: int, frames: Column, offset: int) -> Column:
    """The frame offset after the first of each of n intervals; shorter videos repeat their last index."""
    return _padded(F.transform(_ranges(n, frames), lambda r: r["a"] + offset), n)


def at_random(n: int, frames: Column, draw: Callable[[Column], Column]) -> Column:
    """A drawn frame of each of n intervals, their last frames excepted. If an interval has one frame only, all come from a draw without replacement, in order. draw(i) gives a
    non-negative long for i; shorter videos repeat their last index."""
    ranges = _ranges(n, frames)
    inside = F.transform(ranges, lambda r, i: (r["a"] + F.pmod(draw(i), (r["z"] - r["a"]).cast("long"))).cast("int"))
    order = F.sort_array(F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.struct(draw(i + n).alias("u"), i.alias("i"))))
    loose = F.array_sort(F.transform(F.slice(order, F.lit(1), F.least(F.lit(n), frames)), lambda x: x["i"].cast("int")))
    return _padded(F.when(F.exists(ranges, lambda r: r["z"] <= r["a"]), loose).otherwise(inside), n)


def clipped(indices: Column, start: Column, fps: Column) -> Column:
    """Indices inside a clip that begins at start seconds, as indices of the whole video."""
    return F.transform(indices, lambda i: (i + F.floor(start * fps)).cast("int"))


def clip_length(start: Column, stop: Column, fps: Column) -> Column:
    return F.floor((stop - start) * fps).cast("int")


def repeated_to(paths: DataFrame, by: str, path: str, n: int) -> DataFrame:
    """n paths of each directory: its list in order, from the start again as often as needed (k: which time)."""
    w = Window.partitionBy(by)
    df = paths.withColumn("_r", F.row_number().over(w.orderBy(path))).withColumn("_n", F.count("*").over(w))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{n}L div _n"))))
    return df.where(F.col("k") * F.col("_n") + F.col("_r") <= n).drop("_r", "_n")


def numbered_by(df: DataFrame, key: str, *ties: str, parts: int = 200) -> DataFrame:
    """Adds pos, the 1-based place in the order of a numeric key, without one task for all rows: ranges between approximate quantiles of the key are numbered each by
    itself, after the rows of the ranges before. The edges change the ranges, not the places."""
    edges = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001)))
    part = F.lit(0)
    if edges:
        part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key)))
    df = df.withColumn("_part", part)
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # at most parts rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key, *ties))
    return df.join(F.broadcast(base), "_part").withColumn("pos", (inside + F.col("_base")).cast("long")).drop("_part", "_base")


def pieces(total: Column, u: Column, draw: Callable[[Column], Column], decay: float = 1.0) -> Column:
    """A random split of a whole number from 1 on into positive parts. u in [0, 1) gives their number: evenly among 1 .. total, or by weights that fall by decay from each to the next. The cuts are the places
    whose draw(i) is least, so the parts depend on u and draw only."""
    if decay == 1.0:
        n = F.floor(u * total)
    else:
        n = F.floor(F.log(1 - u * (1 - F.pow(F.lit(decay), total))) / F.log(F.lit(decay)))
    n = F.greatest(F.least(n.cast("int"), total - 1), F.lit(0))
    places = F.filter(F.sequence(F.lit(0), total - 1), lambda i: i > 0)
    order = F.array_sort(F.transform(places, lambda i: F.struct(draw(i).alias("u"), i.alias("i"))))
    cuts = F.array_sort(F.transform(F.slice(order, F.lit(1), n), lambda x: x["i"]))
    ends = F.concat(cuts, F.array(total))
    return F.transform(ends, lambda e, k: e - F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)))
