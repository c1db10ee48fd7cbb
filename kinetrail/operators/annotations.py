"""Annotation operators: as-of and range joins, fuzzy matches, tolerant JSON, text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_key(steps: DataFrame, keys: DataFrame, by: str, time: str, key: str, value: str) -> DataFrame:
    """Backward as-of join: each step gets the value of the latest key not after it, or of the first key. Both sides become one ordered stream, so there is no range join: one exchange and sort on by."""
    left = steps.withColumn("_k", F.lit(None).cast("double")).withColumn("_v", F.lit(None).cast("string")).withColumn("_o", F.col(time)).withColumn("_side", F.lit(1))
    right = keys.select(by, F.col(key).cast("double").alias("_o"), F.col(key).cast("double").alias("_k"), F.col(value).cast("string").alias("_v"), F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_o", "_side")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    for c in ("_k", "_v"):
        both = both.withColumn(c + "2", F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead)))
    return both.where("_side = 1").withColumnRenamed("_k2", key).withColumnRenamed("_v2", value).drop("_k", "_v", "_o", "_side")


def goal_frames(keys: DataFrame, by: str, key: str, fps: float, length: str) -> DataFrame:
    """Adds goal: the frame before the next key, the last frame for the last key, kept within the episode."""
    ahead = F.lead(key).over(Window.partitionBy(by).orderBy(key))
    raw = F.when(ahead.isNull(), F.col(length) - 1).otherwise((ahead * fps).cast("long") - 1)
    return keys.withColumn("goal", F.greatest(F.lit(0), F.least(raw, F.col(length) - 1)).cast("long"))


def label_frames(frames: DataFrame, segments: DataFrame, by: str, default: str) -> DataFrame:
    """Range join of frames with segments [start, stop] (by, seg, start, stop, label): the last segment wins, gaps carry the label forward. Segments become
    rows of their frames, cut to the frames that the episode has, so the join is an equi join."""
    ends = frames.groupBy(by).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    cut = segments.join(ends, by).withColumn("_a", F.greatest("start", "_first").cast("long")).withColumn("_z", F.least("stop", "_last").cast("long")).where("_a <= _z")
    rows = cut.select(by, "seg", "label", F.explode(F.sequence("_a", "_z")).alias("t"))
    best = rows.groupBy(by, "t").agg(F.max(F.struct("seg", "label")).alias("b")).select(by, "t", F.col("b.label").alias("hit"))
    w = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return frames.join(best, [by, "t"], "left").withColumn("label", F.coalesce(F.last("hit", ignorenulls=True).over(w), F.lit(default))).drop("hit")


def fuzzy_match(said: str, valid: str) -> Column:
    """The valid label that equals what was said, else the first that contains it or lies in it, case aside; null if none does."""
    low = F.lower(F.trim(F.col(said)))
    near = F.filter(F.col(valid), lambda v: F.lower(v).contains(low) | low.contains(F.lower(v)))
    return F.when(F.array_contains(valid, F.col(said)), F.col(said)).otherwise(F.get(near, F.lit(0)))


def json_part(text: Column) -> Column:
    """The outermost object or list in a model's answer, without code fences; null if there is none."""
    x = F.trim(F.regexp_replace(text, r"```[a-z]*", ""))
    x = F.regexp_extract(x, r"(?s)\{.*\}|\[.*\]", 0)
    return F.when(x.rlike(r"(?s)^(\{.*\}|\[.*\])$"), x)


def lenient_json(text: Column) -> Column:
    """Double quotes for single ones, no comments, no commas before a closing bracket."""
    x = F.replace(text, F.lit("'"), F.lit('"'))
    x = F.regexp_replace(x, r"(?s)/\*.*?\*/", "")
    x = F.regexp_replace(x, r"//[^\n]*", "")
    return F.regexp_replace(x, r",\s*([}\]])", "$1")


def parsed_json(text: Column, schema: str) -> Column:
    """The answer parsed, strictly first, then leniently; null if both fail."""
    part = json_part(text)
    whole = F.when(F.try_parse_json(part).isNotNull(), F.from_json(part, schema))
    fixed = lenient_json(part)
    return F.coalesce(whole, F.when(F.try_parse_json(fixed).isNotNull(), F.from_json(fixed, schema)))


def cleaned(text: Column) -> Column:
    """Lower case, without NULs, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("\x00"), F.lit(""))), r"\s+", " "))


def adjacent_distinct(arr: Column) -> Column:
    """Without empty entries and without those equal to the one before."""
    full = F.filter(arr, lambda x: x != "")
    return F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, i - 1)))


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def canonical(text: Column, keep: str | None = None) -> Column:
    """Without ASCII punctuation, white space runs as one space, trimmed; a kept string survives as it is."""
    def bare(x: Column) -> Column:
        return F.translate(x, PUNCTUATION, "")

    if keep:
        text = F.array_join(F.transform(F.split(text, "\\Q" + keep + "\\E"), bare), keep)
    else:
        text = bare(text)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Labels that a list of subtasks must not contain.
NO_SUBTASK = ("idle", "none", "unknown", "")


def clean_subtasks(arr: Column) -> Column:
    return F.filter(arr, lambda x: ~F.lower(F.trim(x)).isin(*NO_SUBTASK))
