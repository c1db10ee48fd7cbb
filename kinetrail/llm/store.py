"""Written tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package. Where PYTHONPATH names its folder, as on a cluster that has it installed, there is nothing to do; else a zip
    goes along with the session, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped or _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kinetrail-zip-"), "kinetrail.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "kinetrail")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and everything runs in one process (tests) a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="kinetrail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, reread from Parquet: lost executors cost a reread, not the lineage. Codec: zstd, few bytes in the store."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinetrail/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
