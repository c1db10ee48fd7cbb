"""Queries on whole episodes, index ranges of losses and caches, random splits, nested columns, embeddings of grids, prompts and what is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.functions import actions as FA, nested as N, text as T
from kinetrail.operators import episodes as E, mixtures as X, samples as M, views as V
from kinetrail.operators.views import TRAJ_EVENTS, TRAJ_ORDER, lcg, lcg_sql
from kinetrail.plans.registry import query
from kinetrail.sources import writers as W

EV, LO = TRAJ_EVENTS, TRAJ_ORDER


def r6(x):
    return F.round(x, 6)


_STEPS = f"""{EV}, st AS (SELECT traj, t, a / 1000 AS x, g AS y, a, prim, CASE prim WHEN 'view' THEN '' ELSE prim END AS l, upper(prim) AS r FROM ev),
m AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, count(*) OVER (PARTITION BY traj) AS n FROM st WINDOW w AS (PARTITION BY traj ORDER BY t)),
f AS (SELECT *, min(CASE WHEN abs(x - x0) > 0.01 OR abs(y - y0) > 0.01 THEN t END) OVER (PARTITION BY traj) AS f FROM m),
d AS (SELECT *, CAST(f - 1 + {lcg_sql('traj', 5)} % (n - f + 1) AS BIGINT) AS step FROM f WHERE f IS NOT NULL),
b AS (SELECT traj, any_value(n) AS n_steps, any_value(f) AS first, any_value(step) AS step, max(CASE WHEN t = step THEN x END) AS state0, round(avg(y), 6) AS mean1, round(stddev_pop(y), 6) AS std1,
  round(sqrt(avg(x * x)), 6) AS norm0, max(CASE WHEN t = step THEN l END) AS l, max(CASE WHEN t = step THEN r END) AS r, max(CASE WHEN t = step + 2 THEN a END) AS a2, max(CASE WHEN t = least(step + 4, n - 1) THEN a END) AS a4,
  max(CASE WHEN t = n - 1 THEN a END) AS a_last, list(l ORDER BY t) FILTER (t >= step AND t < step + 5) AS ls, list(lower(r) ORDER BY t) FILTER (t >= step AND t < step + 5) AS rs FROM d GROUP BY traj)"""
_SAMPLE = """traj, n_steps, step, state0, mean1, std1, norm0, CASE WHEN step + 2 > n_steps - 1 THEN a_last ELSE a2 END AS a2, a4, array_to_string([greatest(step - 2, 0), greatest(step - 1, 0), step], ' ') AS frames,
  array_to_string(list_transform([1, 2, 3], lambda i: CASE WHEN i > 3 - least(step - first + 2, 3) THEN '1' ELSE '0' END), '') AS mask"""


def _flat(df):
    a = F.col("actions")
    bits = F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), "")
    return df.select("traj", "n_steps", "step", F.col("state")[0].alias("state0"), r6(F.col("state_mean")[1]).alias("mean1"), r6(F.col("state_std")[1]).alias("std1"), r6(F.col("state_norm")[0]).alias("norm0"), a[2][0].alias("a2"), a[4][0].alias("a4"), F.array_join("frames", " ").alias("frames"), bits.alias("mask"), "instruction", "thought", "goal")


def _steps(t):
    left = F.when(F.col("prim") == "view", "").otherwise(F.col("prim"))
    return V.traj_events(t.events).select("traj", "t", F.array(F.col("a") / 1000, "g").alias("state"), F.array("a", "g").alias("action"), left.alias("left"), F.upper("prim").alias("right"), "prim")


@query(f"""WITH {_STEPS}, kl AS (SELECT traj, list({{'s': CAST(t AS DOUBLE) / 10, 'sub': prim}} ORDER BY t) AS e FROM ev WHERE t % 10 = 3 GROUP BY traj),
j AS (SELECT b.*, e, greatest(len(list_filter(e, lambda k: k.s <= step / 10.0::DOUBLE)), 1) AS i FROM b JOIN kl ON kl.traj = b.traj)
SELECT {_SAMPLE}, CASE traj % 2 WHEN 0 THEN 'go' ELSE 'go on' END AS instruction,
  chr(10) || '<|plan|>' || chr(10) || e[i].sub || chr(10) || 'x' || chr(10) || '<|\\ plan|>' || chr(10) || chr(10) || '<|subtask|>' || chr(10) || e[i].sub || chr(10) || '<|\\ subtask|>' || chr(10) || chr(10)
  || '<|movement|>' || chr(10) || '[LEFT]: ' || l || chr(10) || '[RIGHT]: ' || r || chr(10) || chr(10) || '<|\\ movement|>' || chr(10) || chr(10) AS thought,
  CAST(greatest(0, least(coalesce(CAST(floor(e[i + 1].s * 10) AS BIGINT), n_steps) - 1, n_steps - 1)) AS BIGINT) AS goal FROM j""")
def simulated_samples(t):
    """One sample of each episode that has a subtask's start among its steps."""
    s = _steps(t)
    entry = F.struct((F.col("t") / 10).cast("string").alias("key"), F.struct(F.array("prim", F.lit("x")).alias("plan"), F.col("prim").alias("subtask")).alias("value"))
    side = s.where("t % 10 = 3").groupBy("traj").agg(F.map_from_entries(F.collect_list(entry)).alias("reasoning")).withColumn("fps", F.lit(None).cast("double")).withColumn("seen", F.array(F.lit("go"), F.lit("go on")))
    return _flat(E.simulated_samples(s, side, "traj", 2, 5, 3, lcg("traj", 5), F.col("traj")))


@query(f"""WITH {_STEPS}, c AS (SELECT *, list_filter(ls, lambda v: v <> '') AS lf, list_filter(rs, lambda v: v <> '') AS rf FROM b)
SELECT {_SAMPLE}, 'fold the cloth' AS instruction, '[LEFT]: ' || CASE WHEN len(lf) = 0 THEN 'none' ELSE array_to_string(list_filter(lf, lambda v, i: i = 1 OR v <> lf[i - 1]), ', ') END
  || '; [RIGHT]: ' || CASE WHEN len(rf) = 0 THEN 'none' ELSE array_to_string(list_filter(rf, lambda v, i: i = 1 OR v <> rf[i - 1]), ', ') END AS thought, least(step + 5, n_steps - 1) AS goal FROM c""")
def robot_samples(t):
    return _flat(E.robot_samples(_steps(t), "fold the cloth", "traj", 2, 3, lcg("traj", 5), 5))


_ITEMS = f"{LO}, it AS (SELECT traj, t, CASE t % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'vae_image' ELSE 'action' END AS type, CAST((traj + t) % 2 AS INT) AS loss, CAST(q AS INT) % 6 + 1 AS n_tokens FROM lo), s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY traj ORDER BY t) - n_tokens AS start FROM it)"


@query(f"""WITH {_ITEMS} SELECT traj, 'ce' AS kind, CAST(start + unnest(range(n_tokens - 1)) AS BIGINT) AS token FROM s WHERE type = 'text' AND loss = 1
UNION ALL SELECT traj, 'mse', CAST(start + unnest(range(1, n_tokens - 1)) AS BIGINT) FROM s WHERE type = 'vae_image' AND loss = 1
UNION ALL SELECT traj, 'l1', CAST(start + unnest(range(1, n_tokens - 1)) AS BIGINT) FROM s WHERE type = 'action' AND loss = 1""")
def loss_indexes(t):
    """Places of the tokens that each loss reads."""
    kind = F.when(F.col("t") % 3 == 0, "text").when(F.col("t") % 3 == 1, "vae_image").otherwise("action")
    items = V.traj_order(t.lineitem).select("traj", "t", kind.alias("type"), ((F.col("traj") + F.col("t")) % 2).cast("int").alias("loss"), (F.col("q").cast("int") % 6 + 1).alias("n_tokens"))
    items = M.offsets(items, ["traj"], "t")
    one, *rest = (M.loss_tokens(items, k).select("traj", F.lit(k).alias("kind"), "token") for k in ("ce", "mse", "l1"))
    return one.unionByName(rest[0]).unionByName(rest[1])


@query(f"""WITH {LO}, c AS (SELECT traj, t, CAST(q AS BIGINT) AS kept, t % 4 + 1 AS fresh, CAST(q AS BIGINT) % 9 AS rope FROM lo), w AS (SELECT *, CAST(sum(kept + fresh) OVER v - kept - fresh AS BIGINT) AS kv_start, CAST(sum(fresh) OVER v - fresh AS BIGINT) AS packed_start FROM c WINDOW v AS (PARTITION BY traj ORDER BY t))
SELECT traj, t, kv_start, kv_start + kept AS query_start, packed_start, kept + fresh AS new_length, rope + fresh AS text_rope, rope + 1 AS image_rope FROM w""")
def cache_ranges(t):
    df = V.traj_order(t.lineitem).select("traj", "t", F.col("q").cast("long").alias("kept"), (F.col("t") % 4 + 1).alias("fresh"), (F.col("q").cast("long") % 9).alias("rope"))
    out = M.cache_ranges(df, ["traj"], "t", "kept", "fresh", "rope", True)
    return out.select("traj", "t", "kv_start", "query_start", "packed_start", "new_length", F.col("new_rope").alias("text_rope"), (F.col("rope") + 1).alias("image_rope"))


@query("""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS k FROM documents),
x(pos, type, loss, n_tokens) AS (VALUES (0, 'vae_image', 0, 18), (1, 'vit_image', 0, 66), (2, 'vae_image', 0, 18), (3, 'vit_image', 0, 66), (4, 'vae_image', 0, 18), (5, 'vit_image', 0, 66), (7, 'vae_image', 1, 18), (8, 'vae_image', 0, 18), (9, 'vit_image', 0, 66))
SELECT doc_id, CASE WHEN k = 0 AND pos > 6 THEN pos - 1 ELSE pos END AS pos, type, loss, n_tokens FROM n, x UNION ALL SELECT doc_id, 6, 'text', 0, CAST(k + 2 AS INT) FROM n WHERE k > 0""")
def video_plan(t):
    """Items of a video-prediction sample with a document's text as prompt."""
    return t.documents.select("doc_id", F.posexplode(M.video_items(M.token_count(F.col("text")), 16, 64)).alias("pos", "x")).select("doc_id", "pos", "x.type", "x.loss", "x.n_tokens")


_CUTS = """[k.i FOR k IN list_sort([{{'u': {draw}, 'i': i}} FOR i IN range(1, n)])[:{take}]]"""


def _pieces_sql(take: str) -> str:
    return f"list_sort({_CUTS.format(draw=lcg_sql('doc_id * 100 + i', 3), take=take)})"


@query(f"""WITH b AS (SELECT doc_id, doc_id % 9 + 1 AS n, ({lcg_sql('doc_id', 11)} / 2147483648.0::DOUBLE) AS u FROM documents),
c AS (SELECT doc_id, n, {_pieces_sql('greatest(least(CAST(floor(u * n) AS BIGINT), n - 1), 0)')} AS e, {_pieces_sql('greatest(least(CAST(floor(ln(1 - u * (1 - 0.5::DOUBLE ** n)) / ln(0.5::DOUBLE)) AS BIGINT), n - 1), 0)')} AS f FROM b)
SELECT doc_id, array_to_string(list_append(e, n), ' ') AS even, array_to_string(list_append(f, n), ' ') AS falling FROM c""")
def random_pieces(t):
    """Running sums of a random split of 1 to 9, with evenly drawn and with falling numbers of parts."""
    n, u = (F.col("doc_id") % 9 + 1).cast("int"), lcg("doc_id", 11) / 2147483648.0
    draw = lambda i: lcg(F.col("doc_id") * 100 + i, 3)
    sums = lambda x: F.array_join(F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda a, b: a + b)), " ")
    df = t.documents.select("doc_id", X.pieces(n, u, draw).alias("e"), X.pieces(n, u, draw, 0.5).alias("f"))
    return df.select("doc_id", sums(F.col("e")).alias("even"), sums(F.col("f")).alias("falling"))


@query("SELECT c_custkey, c_name AS name, -1 AS n, c_acctbal AS bal, 'x' AS extra, '' AS p_name, 0 AS p_n, 0.0::DOUBLE AS p_bal FROM customer")
def nested_merge(t):
    """Two structs as one, the later's fields over the earlier's, and padding of its shape."""
    first = F.struct(F.struct(F.col("c_name").alias("name"), F.lit(7).alias("n")).alias("a"), F.col("c_acctbal").alias("bal"))
    second = F.struct(F.struct(F.lit(-1).alias("n"), F.lit("x").alias("extra")).alias("a"))
    df = t.customer.select("c_custkey", first.alias("s"), second.alias("z"))
    df = df.withColumn("m", N.merged(df, "s", "z"))
    df = df.withColumn("p", N.mapped(df, "m", N.padding))
    return df.select("c_custkey", "m.a.name", "m.a.n", "m.bal", "m.a.extra", F.col("p.a.name").alias("p_name"), F.col("p.a.n").alias("p_n"), F.col("p.bal").cast("double").alias("p_bal"))


_FREQ = "power(10000.0::DOUBLE, -{0} / {1}::DOUBLE)"


@query(f"SELECT n_nationkey, k AS i, round(CASE WHEN k < 4 THEN sin(n_nationkey * {_FREQ.format('k', '3.0')}) ELSE cos(n_nationkey * {_FREQ.format('(k - 4)', '3.0')}) END, 6) AS action, round(CASE WHEN k < 4 THEN cos(n_nationkey * {_FREQ.format('k', '4.0')}) ELSE sin(n_nationkey * {_FREQ.format('(k - 4)', '4.0')}) END, 6) AS time FROM nation, range(8) r(k)")
def sinusoid_kinds(t):
    """Embeddings of an action's place and of a time step."""
    x = F.col("n_nationkey").cast("double")
    both = F.arrays_zip(FA.sinusoid(x, 8, reach_end=True).alias("action"), FA.sinusoid(x, 8, cosines_first=True).alias("time"))
    return t.nation.select("n_nationkey", F.posexplode(both).alias("i", "v")).select("n_nationkey", F.col("i").cast("long").alias("i"), r6("v.action").alias("action"), r6("v.time").alias("time"))


@query(f"SELECT n_nationkey, k AS i, round(CASE WHEN k % 4 < 2 THEN sin(p * {_FREQ.format('(k % 2)', '2.0')}) ELSE cos(p * {_FREQ.format('(k % 2)', '2.0')}) END, 6) AS v FROM (SELECT n_nationkey, k, CASE WHEN k < 4 THEN n_nationkey % 5 ELSE n_nationkey // 5 END AS p FROM nation, range(8) r(k))")
def grid_embedding(t):
    """Embedding of a place in a grid of five columns."""
    key = F.col("n_nationkey")
    x = FA.grid_embedding(F.floor(key / 5).cast("double"), (key % 5).cast("double"), 8)
    return t.nation.select("n_nationkey", F.posexplode(x).alias("i", "v")).select("n_nationkey", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


_LEFT = "CASE WHEN prim = 'view' THEN 'No action.' ELSE prim END"


@query(f"""WITH {EV}, x AS (SELECT *, CASE WHEN traj % 3 = 0 THEN ' ' ELSE 'task ' || traj END AS goal FROM ev)
SELECT traj, 'Infer.' || chr(10) || any_value(CASE WHEN traj % 3 = 0 THEN '' ELSE 'The overall goal of the task is: ' || goal || chr(10) || chr(10) END) || '- Image ' || (count(*) + 1) || ': Global motion trajectories of both arms over the entire task' || chr(10) || chr(10)
  || 'Per-frame image and arm actions (low-level, DO NOT copy these!):' || chr(10) || string_agg('Frame ' || t || ':' || chr(10) || '- Frame image: image ' || (t + 1) || chr(10) || '- Left arm action: ' || {_LEFT} || chr(10) || '- Right arm action: ' || upper(prim) || chr(10) || chr(10), '' ORDER BY t) || 'List.' AS first,
  'Go.' || chr(10) || any_value(CASE WHEN traj % 3 = 0 THEN '' ELSE 'My Overall Final Goal: ' || goal || chr(10) || chr(10) END) || 'Input sequence: ' || count(*) || ' frames of my visual sensors and internal state.' || chr(10) || chr(10) || '### MY PLANNED SUBTASK SEQUENCE:' || chr(10) || '1. take' || chr(10) || '2. put' || chr(10)
  || chr(10) || '### MY REGISTERED LOW-LEVEL ARM ACTIONS (Ground Truth):' || chr(10) || string_agg('- Frame ' || t || ': Left: ' || {_LEFT} || '; Right: ' || upper(prim) || chr(10), '' ORDER BY t) || 'List.' AS second FROM x GROUP BY traj""")
def annotation_prompts(t):
    """The two questions on an episode's subtasks."""
    s = _steps(t).groupBy("traj").agg(F.array_sort(F.collect_list(F.struct("t", F.col("t").alias("frame"), "left", "right"))).alias("x"))
    goal = F.when(F.col("traj") % 3 == 0, " ").otherwise(F.concat(F.lit("task "), "traj"))
    frames = F.col("x")
    return s.select("traj", T.subtasks_prompt("Infer.\n", goal, frames, True, "List.").alias("first"), T.segments_prompt("Go.\n", goal, frames, F.array(F.lit("take"), F.lit("put")), "List.").alias("second"))


@query("SELECT n_nationkey, k AS frame, printf('frame_%05d.jpg', k) AS name FROM nation, range(2, 9) r(k) WHERE k < n_nationkey % 13")
def extracted_frames(t):
    """At most seven frames of each video from the third on."""
    return W.extracted(t.nation.select("n_nationkey", (F.col("n_nationkey") % 13).cast("long").alias("frames")), "n_nationkey", "frames", 2, 7)


@query(f"""WITH {EV} SELECT traj, 'a|b' AS total, string_agg(prim, '|' ORDER BY t) AS current, string_agg(CAST(t % 2 AS VARCHAR), '|' ORDER BY t) AS index, string_agg('["' || prim || '", "say \\"b\\""]', '|' ORDER BY t) AS remaining, string_agg('go ' || prim, '|' ORDER BY t) AS moving FROM ev GROUP BY traj""")
def annotation_arrays(t):
    """An episode's annotations as the arrays that are written."""
    remaining = F.array("prim", F.lit('say "b"'))
    df = V.traj_events(t.events).select("traj", F.col("t").alias("frame_id"), F.array(F.lit("a"), F.lit("b")).alias("total_subtasks"), F.col("prim").alias("current_subtask"), (F.col("t") % 2).alias("current_subtask_index"), remaining.alias("remaining_subtasks"), F.concat(F.lit("go "), "prim").alias("moving_instruction"))
    line = lambda c, n: F.array_join(c, "|").alias(n)
    out = W.annotation_arrays(df, "traj")
    return out.select("traj", line("total_subtasks", "total"), line("current_subtask", "current"), line(F.col("current_subtask_index").cast("array<string>"), "index"), line("remaining_subtasks", "remaining"), line("moving_instruction", "moving"))
