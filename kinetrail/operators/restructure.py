"""Standard trajectories in the shape that training reads: views, proprioception, masks and language under fixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def restructured(df: DataFrame, settings: dict, states: str = "") -> DataFrame:
    """by, t, then image_<view> and depth_<view> (empty where the dataset has none), proprio (its state columns after each other, padding is one 0), timestep, language, action as floats,
    dataset_name and absolute_action_mask. settings: from registry.settings; a state column may be a scalar or an array, and stands under its own name or behind the prefix states.
    """
    types = dict(df.dtypes)

    def column(name: str | None, empty):
        return empty if name is None else F.col(f"`{name}`")

    views = [column(c, F.lit(b"")).alias(f"image_{v}") for v, c in settings["images"].items()]
    views += [column(c, F.lit(b"")).alias(f"depth_{v}") for v, c in settings.get("depths", {}).items()]
    parts = []
    for name in settings.get("states") or ():
        if name is None:
            parts.append(F.array(F.lit(0.0)))
        else:
            full = states + name.replace("/", "_")
            parts.append(F.col(full) if types[full].startswith("array") else F.array(F.col(full)))
    proprio = [F.concat(*(p.cast("array<float>") for p in parts)).alias("proprio")] if parts else []
    language = [F.coalesce(F.col(settings["language"]), F.lit("")).alias("language")] if settings.get("language") else []
    mask = F.array(*map(F.lit, settings["absolute_action_mask"])).alias("absolute_action_mask")
    return df.select("traj", "t", *views, *proprio, F.col("t").cast("int").alias("timestep"), *language, F.col("action").cast("array<float>").alias("action"), F.lit(settings["name"]).alias("dataset_name"), mask)
