"""Sharding by a two-pass external shuffle: seeded hashes scatter records into memory-sized buckets, then each bucket is Fisher-Yates shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kinetrail.llm.store import written

#: Fine cells of a shard; buckets are ranges of cells, so one scan both sizes and counts them. If a shard needs more buckets, a second scan counts those.
CELLS = 4096
#: Tasks of the second pass; beyond it a task takes several buckets, one after the other.
TASKS = 50_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest hash of (key, shard): one more shard only takes rows into itself. A null key counts as -1."""
    key = F.coalesce(key.cast("long"), F.lit(-1))
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i")))
    return F.array_max(draws)["i"].cast("int")


def permutation(n: int, seed: list[int]) -> np.ndarray:
    """Fisher-Yates: for i from the last down, swap i with a uniform j <= i (drawn at once)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = list(range(n))
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist() if n else []
    for i in range(n - 1, 0, -1):
        j = draws[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


class Sharding:
    """shuffled(docs): the records with shard (law ``key``: the id and the number of shards decide), slot (gapless in a shard) and grown_shard.

    Pass one scatters by hashes into buckets of about bucket_bytes, as many as the rows' bytes need; a bucket's rows are put in an order that depends on their
    contents only, so a task that runs again gives the same slots. Pass two shuffles each bucket in memory. The first slot of each bucket travels along as a row of its own:
    nothing is collected but the total of bytes. Null ids share a shard, but texts still spread them over its buckets; rows alike in id and text are
    interchangeable and share a bucket, however many they are. Null texts count as empty; extra columns are kept (shard, slot and grown_shard replace columns so
    named); an empty table gives an empty result. write() writes one folder for each shard.
    """

    def __init__(self, shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 20240229, cells: int = CELLS):
        self.shards, self.bucket_bytes, self.seed, self.cells = shards, bucket_bytes, seed, cells

    def _counted(self, rows: DataFrame, cells: int) -> DataFrame:
        """shard, cell, n, bytes: cells are equal ranges of the upper half of the hash."""
        return written(rows.groupBy("shard", self._cell(cells).alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cells")

    @staticmethod
    def _cell(cells: int) -> Column:
        return F.shiftrightunsigned(F.shiftrightunsigned(F.col("h"), 32) * F.lit(cells).cast("long"), 32)

    def shuffled(self, docs: DataFrame) -> DataFrame:
        seed = self.seed
        docs = docs.drop("shard", "slot", "grown_shard")
        names = docs.columns
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        record = F.struct(*(F.col(f"`{c}`") for c in names))
        sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8) for f in docs.schema.fields]
        rows = docs.select(record.alias("record"), shard_of(F.col("doc_id"), self.shards, seed).alias("shard"), shard_of(F.col("doc_id"), self.shards + 1, seed).alias("grown"), F.xxhash64(F.lit(seed + 1), "doc_id", text).alias("h"), sum(sizes[1:], sizes[0]).cast("long").alias("size"))
        cells, table = self.cells, self._counted(rows, self.cells)
        total = table.agg(F.sum("bytes")).first()[0] or 0
        buckets = max(1, -(-total // (self.shards * self.bucket_bytes)))
        if buckets > cells:
            cells, table = buckets, self._counted(rows, buckets)
        bucket = lambda cell: F.expr(f"({cell} * {buckets}L) div {cells}L")
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        heads = table.groupBy("shard", bucket("cell").alias("bucket")).agg(F.sum("n").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        order = F.xxhash64("record") if not any(isinstance(f.dataType, T.MapType) for f in docs.schema.fields) else F.col("h")
        dealt = rows.withColumn("cell", self._cell(cells)).select("record", "shard", "grown", "h", bucket("cell").alias("bucket"), order.alias("tie"), F.lit(None).cast("long").alias("base"))
        first = heads.select(F.lit(None).cast(dealt.schema["record"].dataType).alias("record"), "shard", F.lit(None).cast("int").alias("grown"), F.lit(None).cast("long").alias("h"), "bucket", F.lit(None).cast("long").alias("tie"), "base")
        groups = self.shards * buckets
        parts = min(groups, TASKS)
        # a task's buckets follow each other; nulls sort first, so a bucket's first row is its base
        of = F.expr(f"cast(((shard * {buckets}L + bucket) * {parts}L) div {groups}L as int)")
        dealt = dealt.unionByName(first).repartitionById(parts, of).sortWithinPartitions("shard", "bucket", F.col("base").isNull(), "h", "tie")
        schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType())])

        def emit(held, key):
            table = pa.Table.from_batches(held).combine_chunks()
            shard, bucket = key
            base, table = table.column("base")[0].as_py(), table.slice(1)
            table = table.take(pa.array(permutation(table.num_rows, [seed, shard, bucket])))
            slots = pa.array(np.arange(table.num_rows) + base)
            for b in table.append_column("slot", slots).to_batches(max_chunksize=5000):
                record = b.column("record")
                yield pa.RecordBatch.from_arrays([*(record.field(i) for i in range(len(names))), b.column("shard"), b.column("slot"), b.column("grown")], [*names, "shard", "slot", "grown_shard"])

        def run(batches):
            now, held = None, []
            for b in batches:
                shard, bucket = b.column("shard").to_numpy(), b.column("bucket").to_numpy()
                edges = np.flatnonzero((shard[1:] != shard[:-1]) | (bucket[1:] != bucket[:-1])) + 1
                for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                    if lo == hi:
                        continue
                    key = (int(shard[lo]), int(bucket[lo]))
                    if key != now and held:
                        yield from emit(held, now)
                        held = []
                    now = key
                    held.append(b.slice(lo, hi - lo))
            if held:
                yield from emit(held, now)

        return dealt.select("record", "shard", "grown", "bucket", "base").mapInArrow(run, schema)

    def write(self, docs: DataFrame, path: str) -> None:
        """shard=0, shard=1, ... with rows in slot order inside each bucket's files."""
        self.shuffled(docs).write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of the query op9."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
