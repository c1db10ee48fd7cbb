"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetrail.operators import views, windows
from kinetrail.plans import episodes, extra, mixing_sources, samples, trajectories  # noqa: F401
from kinetrail.plans.registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of three observations with its mask and the next four actions, for each step of each trajectory."""
    df = views.traj_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.select("traj", "t", windows.history("a", 3).alias("history"), windows.pad_mask(3).alias("pad_mask"), windows.chunk("a", 4).alias("actions"), F.col("prim").alias("language"))
