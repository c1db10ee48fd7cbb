"""Streams of steps and samples: sessions, windowed statistics, the sample packer and the observation buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_steps(spark, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream over the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_event_time(df: DataFrame, col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The event time as TIMESTAMP with a watermark; later rows may be dropped by aggregations."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, late)


def motion_sessions(df: DataFrame, by: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Sessions of a trajectory: steps with no longer gap between them. by, start, stop, steps, total."""
    return df.groupBy(by, F.session_window("ts", gap)).agg(F.count("*").alias("steps"), F.sum("value").alias("total")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "steps", "total")


def windowed_statistics(df: DataFrame, by: str = "event_type", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count, mean, extremes and spread of the action by event-time window."""
    return df.groupBy(F.window("ts", width, slide or width), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std")).select(F.col("window.start").alias("start"), by, "n", "mean", "min", "max", "std")


class Packer(StatefulProcessor):
    """The greedy packer as a stateful operator: the open batch and the first-in first-out buffer of a shard are its state; closed batches are its output."""

    def __init__(self, expected: int, most: int, per_sample: int, prefer: int = 0, buffer: int = 0):
        self.expected, self.most, self.per_sample, self.prefer, self.buffer = expected, most, per_sample, prefer, buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "cur long, batch long")
        pair = T.StructType([T.StructField("sample", T.LongType()), T.StructField("size", T.LongType())])
        self.open = handle.getListState("open", pair)
        self.held = handle.getListState("held", pair)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cur, batch = self.now.get() if self.now.exists() else (0, 0)
        open_, held = [tuple(x) for x in self.open.get()], [tuple(x) for x in self.held.get()]
        fresh = pd.concat(list(rows)).sort_values("sample")
        queue, at, out = list(zip(fresh["sample"].tolist(), fresh["size"].tolist(), strict=True)), 0, []

        def close():
            nonlocal open_, cur, batch
            out.extend((key[0], s, batch, n) for s, n in open_)
            open_, cur, batch = [], 0, batch + 1

        while True:
            old = cur < self.prefer and bool(held)
            if old:
                sample, n = held.pop(0)
            elif at < len(queue):
                sample, n = queue[at]
                at += 1
            else:
                break
            if n > self.per_sample:
                continue
            if cur + n > self.most:
                if len(held) < self.buffer and not old:
                    held.append((sample, n))
                else:
                    close()
                continue
            open_.append((sample, n))
            cur += n
            if cur >= self.expected:
                close()
        self.now.update((cur, batch))
        for state, value in ((self.open, open_), (self.held, held)):
            state.put(value) if value else state.clear()
        yield pd.DataFrame(out, columns=["shard", "sample", "batch", "size"])

    def close(self) -> None:
        pass


def packed(stream: DataFrame, **limits) -> DataFrame:
    """stream(shard, sample, size) to closed batches (shard, sample, batch, size). Needs the RocksDB state store."""
    return stream.groupBy("shard").transformWithStateInPandas(Packer(**limits), "shard long, sample long, batch long, size long", "Append", "None")


class ObservationBuffer(StatefulProcessor):
    """The last observations of a trajectory, as an agent sees them: each step leaves with its history, front-filled by the first."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "h array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        past = list(self.past.get()[0]) if self.past.exists() else []
        out = []
        for t, a in pd.concat(list(rows)).sort_values("t")[["t", "a"]].itertuples(index=False):
            past = (past or [a] * (self.size - 1)) + [a]
            past = past[-self.size :]
            out.append((key[0], t, list(past)))
        self.past.update((past,))
        yield pd.DataFrame(out, columns=["traj", "t", "history"])

    def close(self) -> None:
        pass


def observation_histories(stream: DataFrame, size: int) -> DataFrame:
    """stream(traj, t, a) to (traj, t, history)."""
    return stream.groupBy("traj").transformWithStateInPandas(ObservationBuffer(size), "traj long, t long, history array<double>", "Append", "None")


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """A sink that resumes: offsets and state live in the checkpoint, which stands in for saved reader positions. Runs what is there and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
