"""Conversations and episodes to elements, sequence plans, token counts and packed batches."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ELEMENT = "struct<turn:bigint,pos:int,sub:int,type:string,has_loss:int,text:string,ref:int>"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def elements(turns: DataFrame, images: Column | None, key: str = "conv_id", gpt: str = "text", gpt_loss: int = 1, goal: bool = False) -> DataFrame:
    """Rows (key, turn, pos, sub, type, has_loss, text, ref) in order of a conversation.

    A human text with image marks is split on them: each piece that is not blank becomes a trimmed text without loss, and after each piece but the last stands an image
    while there are images (images null: always). A human text without marks is kept as it is. gpt turns become one element of type
    gpt; other roles are ignored. ref numbers the images. goal adds a goal image after a conversation's last element.
    """
    human = turns.where("role = 'human'").select(key, "turn", F.split("value", "<image>", -1).alias("pieces"), *([images.alias("cap")] if images is not None else []))
    human = human.select("*", F.posexplode("pieces").alias("pos", "piece")).withColumn("k", F.size("pieces"))
    text = human.where((F.col("k") == 1) | (stripped(F.col("piece")) != "")).select(key, "turn", "pos", F.lit(0).alias("sub"), F.lit("text").alias("type"), F.lit(0).alias("has_loss"), F.when(F.col("k") == 1, F.col("piece")).otherwise(stripped(F.col("piece"))).alias("text"))
    marks = human.where(F.col("pos") != F.col("k") - 1)
    image = marks.select(key, "turn", "pos", F.lit(1).alias("sub"), F.lit("image").alias("type"), F.lit(0).alias("has_loss"), F.lit(None).cast("string").alias("text"), *(["cap"] if images is not None else []))
    if images is not None:
        order = Window.partitionBy(key).orderBy("turn", "pos")
        image = image.withColumn("n", F.row_number().over(order)).where("n <= cap").drop("n", "cap")
    answer = turns.where("role = 'gpt'").select(key, "turn", F.lit(0).alias("pos"), F.lit(0).alias("sub"), F.lit(gpt).alias("type"), F.lit(gpt_loss).alias("has_loss"), F.col("value").alias("text"))
    out = text.unionByName(image).unionByName(answer)
    if goal:
        out = out.unionByName(turns.groupBy(key).agg((F.max("turn") + 1).alias("turn")).select(key, "turn", F.lit(0).alias("pos"), F.lit(0).alias("sub"), F.lit("goal_image").alias("type"), F.lit(1).alias("has_loss"), F.lit(None).cast("string").alias("text")))
    w = Window.partitionBy(key).orderBy("turn", "pos", "sub")
    seen = F.sum(F.when(F.col("type").isin("image", "goal_image"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("ref", F.when(F.col("type").isin("image", "goal_image"), (seen - 1).cast("int"))).withColumn("seq", (F.row_number().over(w) - 1).cast("int"))


def token_count(text: Column) -> Column:
    """Token stand-in of the queries: words, and marks one by one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"))


def sequence_plan(el: DataFrame, patch_tokens: int, latent_tokens: int, action_tokens: int, key: str = "conv_id") -> DataFrame:
    """Elements to plan items (key, item, type, enable_cfg, loss, n_tokens). A text of n tokens takes n + 2 and vanishes if it has none; an image gives one vit item; an image with loss a noised
    vae, a clean vae and a vit; an action one item. Images and actions have a start and an end token."""
    n = token_count(F.col("text"))

    def item(kind: str, loss, size) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(1).alias("enable_cfg"), (loss if isinstance(loss, Column) else F.lit(loss)).cast("int").alias("loss"), (size if isinstance(size, Column) else F.lit(size)).cast("int").alias("n_tokens"))

    text = F.when(n > 0, F.array(item("text", F.col("has_loss"), n + 2))).otherwise(F.array().cast("array<struct<type:string,enable_cfg:int,loss:int,n_tokens:int>>"))
    vit = item("vit_image", 0, patch_tokens + 2)
    plan = F.when(F.col("type") == "text", text).when(F.col("type") == "action", F.array(item("action", F.col("has_loss"), action_tokens + 2)))
    plan = plan.when(F.col("has_loss") == 1, F.array(item("vae_image", 1, latent_tokens + 2), item("vae_image", 0, latent_tokens + 2), vit)).otherwise(F.array(vit))
    rows = el.select(key, "seq", F.posexplode(plan).alias("sub", "p")).select(key, "seq", "sub", "p.*")
    w = Window.partitionBy(key).orderBy("seq", "sub")
    return rows.withColumn("item", (F.row_number().over(w) - 1).cast("int")).drop("seq", "sub")


def divisible(v: Column, stride: int) -> Column:
    """Rounded half to even to a multiple of stride, at least one stride."""
    return F.greatest(F.lit(stride), F.bround(v / stride) * stride).cast("long")


def resized(df: DataFrame, w: str, h: str, largest: int, smallest: int, stride: int, pixels: int, images: str) -> DataFrame:
    """Adds new_w, new_h, patches: longest side at most largest, shortest at least smallest, pixels shared by the images; each change keeps sides multiples of stride."""
    scale = F.greatest(F.least(F.lit(float(largest)) / F.greatest(w, h), F.lit(1.0)), F.lit(float(smallest)) / F.least(w, h))
    df = df.withColumn("_s", scale).withColumn("new_w", divisible(F.bround(F.col(w) * F.col("_s")), stride)).withColumn("new_h", divisible(F.bround(F.col(h) * F.col("_s")), stride))
    budget = F.lit(float(pixels)) / F.col(images)
    for test, value in ((F.col("new_w") * F.col("new_h") > budget, budget / (F.col("new_w") * F.col("new_h"))), (F.greatest("new_w", "new_h") > largest, F.lit(float(largest)) / F.greatest("new_w", "new_h"))):
        df = df.withColumn("_s", F.when(test, value).otherwise(1.0)).withColumn("_t", test)
        for c in ("new_w", "new_h"):
            df = df.withColumn(c, F.when(F.col("_t"), divisible(F.bround(F.col(c) * F.col("_s")), stride)).otherwise(F.col(c)))
    return df.withColumn("patches", F.expr(f"new_w * new_h div {stride * stride}")).drop("_s", "_t")


def _streamed_packs(samples: DataFrame, shard: str, order: str, size: str, expected: int, most: int, per_sample: int, prefer: int, buffer: int) -> DataFrame:
    """The packer over sorted rows, in Arrow batches: a task holds the length of the open batch and the buffer, however long a shard is."""
    import pyarrow as pa

    def run(batches):
        now, held, cur, batch = None, deque(), 0, 0
        out: list[tuple] = []

        def take(sample, n, fresh):
            nonlocal cur, batch
            if n > per_sample:
                return
            if cur + n > most:
                if fresh and len(held) < buffer:
                    held.append((sample, n))
                else:
                    cur, batch = 0, batch + 1
                return
            out.append((now, sample, batch, n))
            cur += n
            if cur >= expected:
                cur, batch = 0, batch + 1

        def drained():
            while cur < prefer and held:
                take(*held.popleft(), False)

        for b in batches:
            for key, sample, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if key != now:
                    out += [(now, s, -1 - i, k) for i, (s, k) in enumerate(held)]
                    held.clear()
                    now, cur, batch = key, 0, 0
                take(sample, n, True)
                drained()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[shard, "sample", "batch", "size"])
                out = []
        if held:
            rest = [(now, s, -1 - i, k) for i, (s, k) in enumerate(held)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rest, strict=True), (b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[shard, "sample", "batch", "size"])

    kind = dict(samples.dtypes)[shard]
    some = samples.select(shard, F.col(order).cast("long").alias("sample"), F.col(size).cast("long").alias("size"))
    return some.repartition(shard).sortWithinPartitions(shard, "sample").mapInArrow(run, f"`{shard}` {kind}, sample long, batch int, size long")


def greedy_packs(samples: DataFrame, shard: str, order: str, size: str, expected: int, most: int, per_sample: int) -> DataFrame:
    """Greedy packing without a buffer, shard by shard in order: (shard, sample, batch, size). Samples over per_sample are skipped; one that would overflow closes the batch and is lost; a
    batch that reaches expected closes. Shards are the unit of parallelism; a task holds none of their rows."""
    return _streamed_packs(samples, shard, order, size, expected, most, per_sample, 0, 0)


def packs_with_buffer(samples: DataFrame, shard: str, order: str, size: str, expected: int, most: int, per_sample: int, prefer: int, buffer: int) -> DataFrame:
    """The packer with its first-in first-out buffer: (shard, sample, batch, size). While a batch is shorter than prefer, buffered samples come first. A fresh sample that would overflow is buffered if there is
    room; otherwise the batch closes and the sample is lost. What is buffered at the end of a shard is reported with batch -1 - n, what is open with the open batch's number."""
    return _streamed_packs(samples, shard, order, size, expected, most, per_sample, prefer, buffer)


def offsets(items: DataFrame, batch: list[str], *order: str) -> DataFrame:
    """Adds start: tokens of the batch before this item, and rope_start: position ids used before it. Text advances by its tokens, an image or action by one unless it has loss."""
    w = Window.partitionBy(*batch).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    advance = F.when(F.col("type") == "text", F.col("n_tokens")).when((F.col("type") == "vit_image") | (F.col("loss") == 0), 1).otherwise(0)
    return items.withColumn("start", F.sum("n_tokens").over(past) - F.col("n_tokens")).withColumn("_a", advance).withColumn("rope_start", F.sum("_a").over(past) - F.col("_a")).drop("_a")


def attention_mode(kind: str = "type", loss: str = "loss") -> Column:
    """causal for text, full for images and actions, noise where they have loss."""
    return F.when(F.col(kind) == "text", "causal").when((F.col(kind) != "vit_image") & (F.col(loss) == 1), "noise").otherwise("full")


def attended(items: DataFrame, sample: str, order: str) -> DataFrame:
    """Query-key pairs of each sample in closed form: inside a split n(n + 1) / 2 if causal, else n * n; and all tokens of earlier splits that are not noise."""
    mode = attention_mode()
    w = Window.partitionBy(sample).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_tokens").cast("long")
    seen = F.coalesce(F.sum(F.when(mode != "noise", n).otherwise(0)).over(w), F.lit(0))
    own = F.when(mode == "causal", F.expr("cast(n_tokens as bigint) * (n_tokens + 1) div 2")).otherwise(n * n)
    return items.withColumn("_p", own + n * seen).groupBy(sample).agg(F.sum("_p").alias("pairs"))


def loss_weight(n: Column, kind: Column) -> Column:
    """0 for no tokens; token: 1, sample: 1 / n, square: 1 / sqrt(n); anything else is an error."""
    return F.when(n == 0, 0.0).when(kind == "token", 1.0).when(kind == "sample", 1.0 / n).when(kind == "square", 1.0 / F.sqrt(n.cast("double"))).otherwise(F.raise_error(F.lit("unknown loss reduction")).cast("double"))


def loss_tokens(items: DataFrame, kind: str) -> DataFrame:
    """Adds token, the place in its batch of each token that a loss reads. ce: all but the last of a text with loss (each predicts the next); mse: an image with loss, l1: an action with
    loss, both without their start and end token. items: from offsets()."""
    kinds = {"ce": ("text", 0, 2), "mse": ("vae_image", 1, 2), "l1": ("action", 1, 2)}
    name, skip, last = kinds[kind]
    some = items.where((F.col("type") == name) & (F.col("loss") == 1) & (F.col("n_tokens") > skip + 1))
    start = F.col("start").cast("long")
    return some.withColumn("token", F.explode(F.sequence(start + skip, start + F.col("n_tokens") - last)))


def video_items(prompt_tokens: Column, latent_tokens: int, patch_tokens: int, frames: int = 3) -> Column:
    """Plan of a video-prediction sample, as an array of (type, loss, n_tokens): a clean vae and a vit item for each shown frame, the prompt if it has tokens, then the frame to predict as noised vae, clean
    vae and vit. Marks are counted in."""

    def item(kind: str, loss: int, n) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(loss).alias("loss"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n_tokens"))

    clean = [item("vae_image", 0, latent_tokens + 2), item("vit_image", 0, patch_tokens + 2)]
    text = F.filter(F.array(item("text", 0, prompt_tokens + 2)), lambda x: x["n_tokens"] > 2)
    return F.concat(F.array(*clean * frames), text, F.array(item("vae_image", 1, latent_tokens + 2), *clean))


def cache_ranges(df: DataFrame, by: list[str], order: str, kept: str, fresh: str, rope: str, text: bool) -> DataFrame:
    """Index ranges of a packed forward pass over a key-value cache: each row brings kept cached and fresh new tokens. Adds kv_start (its cached tokens among all, kept of them), query_start (its new tokens among
    all, fresh of them), packed_start (its new tokens among the new ones), new_length and new_rope; a text moves the position by its tokens, an image by one."""
    past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = F.col(kept) + F.col(fresh)
    df = df.withColumn("kv_start", F.sum(both).over(past) - both).withColumn("packed_start", F.sum(fresh).over(past) - F.col(fresh))
    return df.withColumn("query_start", F.col("kv_start") + F.col(kept)).withColumn("new_length", both).withColumn("new_rope", F.col(rope) + (F.col(fresh) if text else F.lit(1)))


def _unit(*parts: int) -> float:
    """A draw in [0, 1) that depends on its numbers only."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & (1 << 64) - 1)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 29) * 0x94D049BB133111EB & (1 << 64) - 1
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


@dataclass(frozen=True)
class Group:
    """A group of samples for the packer: its share of the draws, and whether every batch begins with one of its samples."""

    name: str
    weight: float
    mandatory: bool = False


@dataclass(frozen=True)
class Limits:
    """Tokens from which on a batch is given out, at most in a batch and in a sample; a batch shorter than prefer takes buffered samples first, of which there are at most buffer."""

    expected: int
    most: int
    per_sample: int
    prefer: int = 0
    buffer: int = 0


class GroupPacker:
    """Batches from endless groups of samples.

    A batch begins with one sample of each mandatory group. Then a sample comes from the buffer (while the batch is shorter than ``prefer``) or from a group drawn by weight; draws depend on
    seed, shard and their number, so a run is repeatable. Samples of more than per_sample tokens are skipped (of a mandatory group: of so many or more). One that would overflow is buffered
    if it is fresh and there is room, else the batch is given out and the sample is lost. A group that ends begins again.
    """

    def __init__(self, groups: list[Group], limits: Limits, seed: int = 0):
        total = sum(g.weight for g in groups)
        if total <= 0:
            raise ValueError("the groups' weights must sum to more than 0")
        self.groups, self.limits, self.seed = groups, limits, seed
        self.edges = [sum(g.weight for g in groups[: i + 1]) / total for i in range(len(groups))]

    def batches(self, shard: int, samples: dict[str, list[tuple[int, int]]], n: int, at: dict | None = None):
        """n batches, each a list of (group, sample, tokens), with the state after it: {"draws", "places", "buffer"}. at: the state to go on from."""
        limits, at = self.limits, at or {}
        draws, places, held = at.get("draws", 0), dict(at.get("places", {})), deque(tuple(x) for x in at.get("buffer", ()))
        for g in self.groups:
            sizes = [s for _, s in samples.get(g.name, ())]
            fits = any(s < limits.per_sample if g.mandatory else s <= limits.per_sample for s in sizes)
            if (g.weight or g.mandatory) and not fits:
                raise ValueError(f"no sample of {g.name} fits")

        def ahead(group: str) -> tuple[str, int, int]:
            place = places.get(group, 0)
            places[group] = place + 1
            return (group, *samples[group][place % len(samples[group])])

        open_: list[tuple[str, int, int]] = []
        size = 0

        def given():
            return list(open_), {"draws": draws, "places": dict(places), "buffer": list(held)}

        while n:
            if not size:
                for g in self.groups:
                    while g.mandatory:
                        x = ahead(g.name)
                        if x[2] < limits.per_sample:
                            open_.append(x)
                            size += x[2]
                            break
            buffered = size < limits.prefer and bool(held)
            if buffered:
                x = held.popleft()
            else:
                u = _unit(self.seed, shard, draws)
                draws += 1
                x = ahead(self.groups[next((i for i, e in enumerate(self.edges) if u < e), 0)].name)
            if x[2] > limits.per_sample:
                continue
            if size + x[2] > limits.most:
                if len(held) < limits.buffer and not buffered:
                    held.append(x)
                    continue
            else:
                open_.append(x)
                size += x[2]
                if size < limits.expected:
                    continue
            yield given()
            open_, size, n = [], 0, n - 1

    def packed(self, samples: DataFrame, shard: str, group: str, order: str, size: str, n: int, states: dict[int, dict] | None = None) -> DataFrame:
        """n batches of each shard: (shard, batch, pos, group, sample, size, state); state (JSON) stands at a batch's last sample. A shard's ids and sizes fit a task; shards are the unit of
        parallelism. states: by shard, to go on from."""
        import pandas as pd

        packer, states = self, states or {}

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            mine = int(pdf[shard].iloc[0])
            by = {g: list(zip(x[order].tolist(), x[size].tolist(), strict=True)) for g, x in pdf.groupby(group)}
            rows = []
            for b, (batch, state) in enumerate(packer.batches(mine, by, n, states.get(mine))):
                rows += [(mine, b, i, *x, json.dumps(state) if i == len(batch) - 1 else None) for i, x in enumerate(batch)]
            return pd.DataFrame(rows, columns=["shard", "batch", "pos", "group", "sample", "size", "state"])

        some = samples.select(F.col(shard).cast("long").alias(shard), F.col(group).cast("string").alias(group), F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
        return some.groupBy(shard).applyInPandas(pack, "shard long, batch int, pos int, group string, sample long, size long, state string")


def groups_of(recipe: dict[str, dict]) -> list[Group]:
    """The groups of a mixture recipe (sources.readers.recipe), in its order."""
    if missing := [name for name, x in recipe.items() if not x.get("dataset_names")]:
        raise ValueError(f"groups without dataset_names: {missing}")
    return [Group(name, float(x.get("weight") or 0.0), bool(x.get("is_mandatory"))) for name, x in recipe.items()]
