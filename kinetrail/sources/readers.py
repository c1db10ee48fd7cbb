"""Readers: tar shards, JSON lists and sidecars, episode tables, recipes and cached statistics."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinetrail.operators.mixtures import first_n


def list_files(spark: SparkSession, folders: list[str], pattern: str, n: int | None = None, recursive: bool = False) -> DataFrame:
    """path, dir and length of the files of each folder, sorted; the first n of each (null or negative: all). Only listings are read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folders).select("path", "length")
    return first_n(df.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), ["dir"], "path", n)


def tar_samples(spark: SparkSession, folders: list[str], n: int | None = None) -> DataFrame:
    """Samples of tar shards: url, key, json (text), jpg (bytes), error. Members are grouped by name up to the first dot; a member that cannot be read leaves a row with its error, and the rest goes on."""
    paths = list_files(spark, folders, "*.tar", n).select("path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folders).join(paths, "path", "left_semi").select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                groups: dict[str, dict] = {}
                error = None
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for member in tar:
                            if member.isfile():
                                key, _, ext = member.name.partition(".")
                                groups.setdefault(key, {})[ext.lower()] = tar.extractfile(member).read()
                except tarfile.TarError as e:
                    error = str(e)
                rows = []
                for key, parts in groups.items():
                    try:
                        text = json.dumps(json.loads(parts["json"])) if "json" in parts else None
                        rows.append((path, key, text, parts.get("jpg"), None))
                    except ValueError as e:
                        rows.append((path, key, None, parts.get("jpg"), str(e)))
                if error:
                    rows.append((path, None, None, None, error))
                yield pd.DataFrame(rows, columns=["url", "key", "json", "jpg", "error"])

    return files.mapInPandas(read, "url string, key string, json string, jpg binary, error string")


def episode_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """path and rows of each Parquet file of a folder; 0 for one that cannot be read. Counts come from the files' footers, as no column is read."""
    files = list_files(spark, [folder], "*.parquet").select("path")
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(folder).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return files.withColumn("_p", name("path")).join(rows.select(name("path").alias("_p"), "rows"), "_p", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"))


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON list (or one object) in a file, as rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def labelled_videos(labels: DataFrame, folder: str, seed: int | None = None, n: int | None = None) -> DataFrame:
    """id, label and video path; shuffled by a seeded hash if asked for, first n."""
    df = labels.select("id", "label", F.concat(F.lit(folder.rstrip("/") + "/"), "id", F.lit(".webm")).alias("video"))
    df = df.orderBy(F.xxhash64(F.lit(seed), "id")) if seed is not None else df.orderBy("id")
    return df.limit(n) if n is not None and n >= 0 else df


def endposes(spark: SparkSession, path: str) -> DataFrame:
    """Columnar pose JSON to steps: file, t, left_endpose, left_gripper, right_endpose, right_gripper. A file without one of them is an error."""
    arms = ["left_endpose array<array<double>>", "left_gripper array<double>", "right_endpose array<array<double>>", "right_gripper array<double>"]
    names = [a.split()[0] for a in arms]
    df = spark.read.schema(", ".join(arms)).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    for c in names:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} in "), "file"))).otherwise(F.col(c)))
    return df.select("file", F.posexplode(F.arrays_zip(*names)).alias("t", "x")).select("file", "t", "x.*")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes with both sidecars: episode, fps, reasoning (seconds -> plan, subtask), seen instructions."""
    def of(glob: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").json(folder).withColumn("episode", F.regexp_extract(F.input_file_name(), r"(episode\d+)", 1))

    sub = of("episode*_subtask.json", "fps double, reasoning map<string, struct<plan: array<string>, subtask: string>>").where(F.size("reasoning") > 0)
    told = of("episode*[0-9].json", "seen array<string>").where("seen is not null")
    return sub.select("episode", F.coalesce("fps", F.lit(10.0)).alias("fps"), "reasoning").join(told.select("episode", "seen"), "episode")


def recipe(text: str) -> dict[str, dict]:
    """A mixture recipe: groups of settings in two-level YAML (maps, lists in brackets or dashes, scalars)."""
    out: dict[str, dict] = {}
    group, key = None, None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- "):
            target = out[group]
            if not isinstance(target.get(key), list):
                target[key] = []
            target[key].append(_scalar(body[2:]))
            continue
        name, _, value = body.partition(":")
        if not indent:
            group, key = name, None
            out[group] = {}
        elif indent <= 2 or key is None or not isinstance(out[group].get(key), dict):
            key = name
            out[group][key] = _scalar(value) if value.strip() else {}
        else:
            out[group][key][name] = _scalar(value)
    return out


def _scalar(x: str):
    x = x.strip()
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(v) for v in x[1:-1].split(",") if v.strip()]
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    if x.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x.strip("'\"")


def statistics_key(*parts: str) -> Column:
    """Name of cached statistics: a digest of what they depend on."""
    return F.sha2(F.concat_ws("\x1f", *map(F.lit, parts)), 256)


def cached_statistics(spark: SparkSession, folder: str, parts: list[str], compute) -> DataFrame:
    """Statistics from the cache if the same dependencies were seen, else computed and written there."""
    key = spark.range(1).select(statistics_key(*parts).alias("k")).first().k
    path = f"{folder.rstrip('/')}/statistics_{key}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def annotated(frames: DataFrame, client, columns: str) -> DataFrame:
    """Frames sent to a vision-language client: client is a function from a batch (pandas) to a batch of the given columns; in tests a table of canned answers."""
    return frames.mapInPandas(lambda batches: (client(b) for b in batches), columns)
