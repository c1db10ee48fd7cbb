"""Canonical trajectory, pose and dialogue views over the driver tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def steps(*order: str, by: str = "traj"):
    """The one window that trajectory operators share, so that a chain of them needs one exchange and sort."""
    return Window.partitionBy(by).orderBy(*(order or ("t",)))


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Adds t, the 0-based step of a row in its trajectory. order must be unique within by."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def traj_events(events: DataFrame) -> DataFrame:
    """Scalar actions: traj, t, a, g (gripper in [0, 1)), prim, event_id."""
    k = F.get_json_object("props", "$.k").cast("double") / 100
    return numbered(events.withColumnRenamed("user_id", "traj"), "traj", "ts", "event_id").select("traj", "t", F.col("value").alias("a"), k.alias("g"), F.col("event_type").alias("prim"), "event_id")


TRAJ_EVENTS = """ev AS (SELECT user_id AS traj, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS a,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS g, event_type AS prim, event_id FROM events)"""


def traj_order(lineitem: DataFrame) -> DataFrame:
    """Vector actions of width four: traj, t, q, p, d, x and action. Negative zero counts as zero."""
    df = numbered(lineitem.withColumnRenamed("l_orderkey", "traj"), "traj", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cols = [F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (F.col("l_discount") + 0.0).alias("d"), (F.col("l_tax") + 0.0).alias("x")]
    return df.select("traj", "t", *cols).withColumn("action", F.array("q", "p", "d", "x"))


TRAJ_ORDER = """lo AS (SELECT l_orderkey AS traj, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS t,
  l_quantity AS q, l_extendedprice AS p, l_discount + 0.0 AS d, l_tax + 0.0 AS x FROM lineitem)"""


def poses(events: DataFrame) -> DataFrame:
    """Arm poses: ep, t, x, y, z, gripper."""
    e = traj_events(events)
    return e.select(F.col("traj").alias("ep"), "t", (F.col("a") / 1000).alias("x"), F.col("g").alias("y"), (F.pmod("event_id", F.lit(101)) / 100).alias("z"), F.col("g").alias("gripper"))


POSES = TRAJ_EVENTS + """, po AS (SELECT traj AS ep, t, a / 1000 AS x, g AS y, (event_id % 101) / 100.0::DOUBLE AS z, g AS gripper FROM ev)"""


def dialog(conversations: DataFrame, images: bool = True) -> DataFrame:
    """Turns: conv_id, turn, role (human, gpt or system), value. Every third conversation's first human turn gets an image mark in front, every seventh two."""
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    df = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("value"))
    if not images:
        return df
    first = F.min(F.when(F.col("role") == "human", F.col("turn"))).over(Window.partitionBy("conv_id"))
    marks = F.when(F.col("conv_id") % 7 == 0, "<image> first <image>\n").when(F.col("conv_id") % 3 == 0, "<image>\n").otherwise("")
    return df.withColumn("first", first).withColumn("value", F.when((F.col("role") == "human") & (F.col("turn") == F.col("first")), F.concat(marks, "value")).otherwise(F.col("value"))).drop("first")


DIALOG = """d0 AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role, coalesce(text, '') AS value FROM conversations),
d1 AS (SELECT *, min(CASE WHEN role = 'human' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM d0),
dg AS (SELECT conv_id, turn, role, CASE WHEN role = 'human' AND turn = f THEN
  CASE WHEN conv_id % 7 = 0 THEN '<image> first <image>' || chr(10) WHEN conv_id % 3 = 0 THEN '<image>' || chr(10) ELSE '' END ELSE '' END || value AS value FROM d1)"""


def lcg(x, salt: int = 0):
    """Deterministic draw in [0, 2**31): the same integer arithmetic as in SQL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.pmod((x.cast("long") + salt) * 1103515245 + 12345, F.lit(2147483648))


def lcg_sql(x: str, salt: int = 0) -> str:
    return f"(((({x}) + {salt})::BIGINT * 1103515245 + 12345) % 2147483648)"
