"""Trajectory queries: windows, statistics, normalisation, filters, goals, segmentation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinetrail.operators import stats as S, views as V, windows as W
from kinetrail.operators.views import DIALOG, POSES, TRAJ_EVENTS, TRAJ_ORDER, lcg, lcg_sql
from kinetrail.plans.registry import query

EV, LO, PO = TRAJ_EVENTS, TRAJ_ORDER, POSES
_W = "OVER (PARTITION BY traj ORDER BY t"


def r6(x):
    return F.round(x, 6)


@query(f"WITH {LO} SELECT traj, t, q, round(p, 2) AS p, d, x FROM lo")
def traj_number(t):
    return V.traj_order(t.lineitem).select("traj", "t", "q", F.round("p", 2).alias("p"), "d", "x")


@query(f"""WITH {EV}, h AS (SELECT traj, t, list(a) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM ev)
SELECT traj, t, CASE WHEN len(l) < 3 THEN l[1] ELSE l[len(l) - 2] END AS h0, CASE WHEN len(l) < 2 THEN l[1] ELSE l[len(l) - 1] END AS h1, l[len(l)] AS h2,
  t >= 2 AS m0, t >= 1 AS m1, true AS m2 FROM h""")
def obs_history(t):
    df = V.traj_events(t.events).select("traj", "t", W.history("a", 3).alias("h"), W.pad_mask(3).alias("m"))
    return df.select("traj", "t", *(F.col("h")[i].alias(f"h{i}") for i in range(3)), *(F.col("m")[i].alias(f"m{i}") for i in range(3)))


@query(f"""WITH {EV}, h AS (SELECT traj, t, list(a) {_W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM ev)
SELECT traj, t, l[1] AS c0, l[least(2, len(l))] AS c1, l[least(3, len(l))] AS c2, l[least(4, len(l))] AS c3 FROM h""")
def action_chunk(t):
    df = V.traj_events(t.events).select("traj", "t", W.chunk("a", 4).alias("c"))
    return df.select("traj", "t", *(F.col("c")[i].alias(f"c{i}") for i in range(4)))


@query(f"""WITH {LO}, h AS (SELECT traj, t, max(t) OVER (PARTITION BY traj) AS goal, list(q) {_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l,
  list(d) {_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m FROM lo)
SELECT traj, t, i, CASE WHEN t + i > goal THEN 0.0 ELSE l[least(i + 1, len(l))] END AS rel, m[least(i + 1, len(m))] AS abs FROM h, (SELECT unnest([0, 1, 2]) AS i)""")
def neutral_actions(t):
    df = V.traj_order(t.lineitem).withColumn("pair", F.array("q", "d")).withColumn("goal", W.last_step())
    df = df.withColumn("c", W.chunk("pair", 3)).withColumn("c", W.neutral(F.col("c"), F.col("goal"), [False, True]))
    return df.select("traj", "t", F.posexplode("c").alias("i", "v")).select("traj", "t", "i", F.col("v")[0].alias("rel"), F.col("v")[1].alias("abs"))


#: Goal offset of each kind of trajectory, here by traj modulo 4.
GOAL_OFFSETS = {0: 3, 1: 5, 2: 10, 3: 20}
_K = "CASE traj % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 20 END"


@query(f"""WITH {EV}, g AS (SELECT *, least(t + {_K} - 1, max(t) OVER (PARTITION BY traj)) AS goal FROM ev)
SELECT g.traj, g.t, g.goal, e.a AS goal_a FROM g JOIN ev e ON e.traj = g.traj AND e.t = g.goal""")
def goal_observation(t):
    df = V.traj_events(t.events)
    k = S.offset_of(F.pmod("traj", F.lit(4)), GOAL_OFFSETS)
    df = df.withColumn("goal", F.least(F.col("t") + k - 1, W.last_step()).cast("long"))
    return W.at_step(df, F.col("goal"), "a", "goal_a").select("traj", "t", "goal", "goal_a")


@query(f"""WITH {EV}, f AS (SELECT *, first_value(a) OVER (PARTITION BY traj ORDER BY t) AS a0 FROM ev),
g AS (SELECT *, min(CASE WHEN abs(a - a0) > 0.01 THEN t END) OVER (PARTITION BY traj) AS first_idx FROM f)
SELECT traj, t, least(t - (first_idx - 1) + 1, 3) AS valid, least(t - (first_idx - 1) + 1, 3) >= 3 AS m0, least(t - (first_idx - 1) + 1, 3) >= 2 AS m1 FROM g WHERE t >= first_idx - 1""")
def episode_chunk_mask(t):
    df = S.still_trim(V.traj_events(t.events).withColumn("state", F.array("a")), "state", 1e-2)
    valid = F.least(F.col("t") - (F.col("first_idx") - 1) + 1, F.lit(3))
    return df.select("traj", "t", valid.alias("valid"), (valid >= 3).alias("m0"), (valid >= 2).alias("m1"))


@query("""WITH e AS (SELECT label AS traj, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, max(v) AS max, min(v) AS min, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.99), 6) AS q99 FROM e GROUP BY dim""")
def dataset_stats(t):
    df = t.embeddings.select(F.col("label").alias("traj"), F.transform("embedding", lambda v: v.cast("double")).alias("action"))
    s = S.statistics(df, "action")
    return s.select(F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"), r6("std").alias("std"), "max", "min", r6("q01").alias("q01"), r6("q99").alias("q99"))


@query(f"WITH {EV} SELECT prim AS dataset, count(*) AS num_transitions, count(DISTINCT traj) AS num_trajectories FROM ev GROUP BY prim")
def traj_counts(t):
    return V.traj_events(t.events).groupBy(F.col("prim").alias("dataset")).agg(F.count("*").alias("num_transitions"), F.countDistinct("traj").alias("num_trajectories"))


@query(f"WITH {EV} SELECT traj, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(sqrt(avg(a * a)), 6) AS rms FROM ev GROUP BY traj")
def episode_moments(t):
    return V.traj_events(t.events).groupBy("traj").agg(r6(F.avg("a")).alias("mean"), r6(F.stddev_pop("a")).alias("std"), r6(F.sqrt(F.avg(F.col("a") * F.col("a")))).alias("rms"))


_STATS = """s AS (SELECT prim, avg(a) AS mean, stddev_pop(a) AS std, min(a) AS lo, max(a) AS hi, quantile_cont(a, 0.01) AS q01, quantile_cont(a, 0.99) AS q99 FROM ev GROUP BY prim)"""


def _normalized(t, mode, masked=True):
    df = V.traj_events(t.events).withColumn("action", F.array("a", "g"))
    s = S.statistics(df, "action", by=["prim"], quantiled=mode == "bounds_q99")
    return S.normalize(df, "action", s, mode, [True, not masked], by=["prim"]).select("traj", "t", r6(F.col("action")[0]).alias("n0"), r6(F.col("action")[1]).alias("n1"))


@query(f"WITH {EV}, {_STATS} SELECT traj, t, round((a - mean) / (std + 1e-8), 6) AS n0, round(g, 6) AS n1 FROM ev JOIN s USING (prim)")
def normalize_normal(t):
    return _normalized(t, "normal")


@query(f"WITH {EV}, {_STATS} SELECT traj, t, CASE WHEN lo = hi THEN 0.0 ELSE round(greatest(-1, least(1, 2 * (a - lo) / (hi - lo + 1e-8) - 1)), 6) END AS n0, round(g, 6) AS n1 FROM ev JOIN s USING (prim)")
def normalize_bounds(t):
    return _normalized(t, "bounds")


@query(f"WITH {EV}, {_STATS} SELECT traj, t, CASE WHEN lo = hi THEN 0.0 ELSE round(greatest(-1, least(1, 2 * (a - q01) / (q99 - q01 + 1e-8) - 1)), 6) END AS n0, round(g, 6) AS n1 FROM ev JOIN s USING (prim)")
def normalize_q99(t):
    return _normalized(t, "bounds_q99")


@query(f"WITH {EV}, {_STATS} SELECT traj, t, prim, round(a - mean, 6) AS off, round(q99, 6) AS q99 FROM ev JOIN s USING (prim)")
def stats_join(t):
    df = V.traj_events(t.events)
    s = S.statistics(df.withColumn("action", F.array("a")), "action", by=["prim"])
    return df.join(S.small(s.where("dim = 0")), "prim").select("traj", "t", "prim", r6(F.col("a") - F.col("mean")).alias("off"), r6("q99").alias("q99"))


@query("SELECT doc_id, length(coalesce(text, '')) > 0 AS text_real, length(coalesce(lang, '')) > 0 AS lang_real, true AS n_chars_real FROM documents")
def pad_mask(t):
    d = S.pad_mask_dict(t.documents, ["text", "lang", "n_chars"])
    return d.select("doc_id", *(F.col("pad_mask_dict")[c].alias(f"{c}_real") for c in ("text", "lang", "n_chars")))


@query(f"""WITH {EV}, f AS (SELECT *, CASE WHEN g > 0.95 THEN 1.0 WHEN g < 0.05 THEN 0.0 END AS f FROM ev)
SELECT traj, t, coalesce(first_value(f IGNORE NULLS) OVER w, last_value(g) OVER w) AS g FROM f WINDOW w AS (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def gripper_binarize(t):
    return V.traj_events(t.events).select("traj", "t", W.binarize_gripper("g").alias("g"))


@query(f"""WITH {EV}, f AS (SELECT traj, t, CASE WHEN g - 0.5 < -0.1 THEN 1.0 WHEN g - 0.5 > 0.1 THEN -1.0 END AS m FROM ev)
SELECT traj, t, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  -first_value(m IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) / 2 + 0.5 AS g FROM f""")
def gripper_rel2abs(t):
    return V.traj_events(t.events).withColumn("m", F.col("g") - 0.5).select("traj", "t", W.relative_to_absolute("m").alias("g"))


@query(f"WITH {LO}, n AS (SELECT *, lead(q) {_W}) AS nq, lead(d) {_W}) AS nd FROM lo) SELECT traj, t, round(nq - q, 6) AS dq, round(nd - d, 6) AS dd, x FROM n WHERE nq IS NOT NULL")
def bridge_relabel(t):
    df = V.traj_order(t.lineitem).withColumn("state", F.array("q", "d")).withColumn("act", F.array("q", "d", "x"))
    df = S.relabel_from_state(df, "act", "state", 2)
    return df.select("traj", "t", r6(F.col("act")[0]).alias("dq"), r6(F.col("act")[1]).alias("dd"), F.col("act")[2].alias("x"))


@query(f"WITH {EV} SELECT traj, t - 1 AS t, a FROM ev WHERE t > 0")
def drop_first(t):
    return S.drop_first(V.traj_events(t.events)).select("traj", "t", "a")


@query(f"WITH {EV} SELECT traj, t, prim FROM ev WHERE traj IN (SELECT traj FROM ev WHERE a > 480) ")
def skip_unlabeled(t):
    df = V.traj_events(t.events).withColumn("language", F.when(F.col("a") > 480, F.col("prim")).otherwise(""))
    return S.keep_if_any(df, F.col("language") != "").select("traj", "t", "prim")


@query(f"WITH {LO} SELECT traj, t, q FROM lo WHERE traj NOT IN (SELECT traj FROM lo WHERE greatest(abs(q), abs(d), abs(x)) > 45)")
def max_action_filter(t):
    df = V.traj_order(t.lineitem).withColumn("v", F.array("q", "d", "x"))
    return S.keep_if_bounded(df, "v", 45.0).select("traj", "t", "q")


@query(f"WITH {LO} SELECT traj, t, p FROM lo WHERE traj NOT IN (SELECT traj FROM lo WHERE abs(p) > 60000)")
def max_proprio_filter(t):
    df = V.traj_order(t.lineitem).withColumn("proprio", F.array("p"))
    return S.keep_if_bounded(df, "proprio", 60000.0).select("traj", "t", "p")


@query(f"""WITH {EV}, f AS (SELECT *, first_value(g) OVER (PARTITION BY traj ORDER BY t) AS g0 FROM ev), m AS (SELECT traj, min(t) AS first_idx FROM f WHERE abs(g - g0) > 0.2 GROUP BY traj)
SELECT traj, t, first_idx, a FROM f JOIN m USING (traj) WHERE t >= first_idx - 1""")
def still_trim(t):
    return S.still_trim(V.traj_events(t.events).withColumn("state", F.array("g")), "state", 0.2).select("traj", "t", "first_idx", "a")


@query(f"""WITH {LO} SELECT traj, t, d, x FROM lo WHERE abs(d - 0.05) > 1e-5 OR abs(x - 0.04) > 1e-5""")
def zero_action(t):
    df = V.traj_order(t.lineitem).withColumn("v", F.array("d", "x", "q"))
    return df.where(S.moves("v", [0.05, 0.04], 1e-5)).select("traj", "t", "d", "x")


@query(f"""WITH {EV}, m AS (SELECT traj, max(t) OVER (PARTITION BY traj) AS last, t, a, event_id FROM ev),
g AS (SELECT traj, t, least(t + 1 + {lcg_sql('event_id')} % greatest(last - t, 1), last) AS goal FROM m)
SELECT g.traj, g.t, g.goal, e.a AS goal_a FROM g JOIN ev e ON e.traj = g.traj AND e.t = g.goal""")
def goal_uniform(t):
    df = V.traj_events(t.events).withColumn("last", W.last_step())
    goal = F.least(F.col("t") + 1 + F.pmod(lcg("event_id"), F.greatest(F.col("last") - F.col("t"), F.lit(1))), F.col("last"))
    return W.at_step(df.withColumn("goal", goal), F.col("goal"), "a", "goal_a").select("traj", "t", "goal", "goal_a")


@query(f"""WITH {EV}, g AS (SELECT *, max(t) OVER (PARTITION BY traj) AS last, {lcg_sql('event_id', 3)} % 100 < 70 OR prim = 'search' AS keep_image FROM ev)
SELECT traj, t, keep_image AND true AS image_real, NOT keep_image AND prim <> 'search' AS language_real, CASE WHEN keep_image THEN '' ELSE prim END AS language, CASE WHEN keep_image THEN t ELSE last END AS timestep FROM g""")
def task_dropout(t):
    df = V.traj_events(t.events).withColumn("last", W.last_step())
    keep = (F.pmod(lcg("event_id", 3), F.lit(100)) < 70) | (F.col("prim") == "search")
    return df.withColumn("keep", keep).select("traj", "t", F.col("keep").alias("image_real"), (~F.col("keep") & (F.col("prim") != "search")).alias("language_real"), F.when(F.col("keep"), "").otherwise(F.col("prim")).alias("language"), F.when(F.col("keep"), F.col("t")).otherwise(F.col("last")).alias("timestep"))


VEL, DG, IDLE, RATIO = 0.12, 0.2, 2, 0.2
_DELTAS = f"""{PO}, de AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy, coalesce(z - lag(z) OVER w, 0) AS dz, coalesce(gripper - lag(gripper) OVER w, 0) AS dg FROM po WINDOW w AS (PARTITION BY ep ORDER BY t)),
fl AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS speed, (sqrt(dx * dx + dy * dy + dz * dz) < 0.5 AND abs(dg) < 0.4) OR t = 0 AS idle FROM de)"""
_SEGMENTS = f"""{_DELTAS}, c1 AS (SELECT *, CASE WHEN idle IS DISTINCT FROM lag(idle) OVER (PARTITION BY ep ORDER BY t) THEN 1 ELSE 0 END AS ch FROM fl),
c2 AS (SELECT *, sum(ch) OVER (PARTITION BY ep ORDER BY t) AS run FROM c1),
c3 AS (SELECT *, idle AND count(*) OVER (PARTITION BY ep, run) >= {IDLE} AS islong, bool_and(idle) OVER (PARTITION BY ep) AS allidle FROM c2),
c4 AS (SELECT *, CASE WHEN NOT islong AND NOT allidle THEN sum(islong::INT) OVER (PARTITION BY ep ORDER BY t) END AS seg FROM c3)"""


def _segments(t):
    return W.action_segments(V.poses(t.events), 0.5, 0.4, IDLE)


@query(f"WITH {_DELTAS} SELECT ep, t, round(speed, 6) AS speed, round(dg, 6) AS dg, idle FROM fl")
def frame_deltas(t):
    return _segments(t).select("ep", "t", r6("speed").alias("speed"), r6("dg").alias("dg"), "idle")


@query(f"WITH {_SEGMENTS} SELECT ep, CAST(seg AS BIGINT) AS seg, min(t) AS first, max(t) AS last, count(*) AS steps FROM c4 WHERE seg IS NOT NULL GROUP BY ep, seg")
def action_segments(t):
    return _segments(t).where("seg is not null").groupBy("ep", "seg").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("steps"))


_AX = "concat_ws('_', CASE WHEN abs(sx) / nullif(total, 0) >= 0.2 THEN CASE WHEN sx > 0 THEN 'right' ELSE 'left' END END, CASE WHEN abs(sy) / nullif(total, 0) >= 0.2 THEN CASE WHEN sy > 0 THEN 'forward' ELSE 'backward' END END, CASE WHEN abs(sz) / nullif(total, 0) >= 0.2 THEN CASE WHEN sz > 0 THEN 'up' ELSE 'down' END END)"
_ATOMIC = f"""{_SEGMENTS}, a1 AS (SELECT *, CASE WHEN seg IS NULL THEN 'idle' WHEN dg <= -0.4 AND t >= 1 THEN 'grasp' WHEN dg >= 0.4 AND t >= 1 THEN 'release' ELSE 'move' END AS action FROM c4),
a2 AS (SELECT *, CASE WHEN action IS DISTINCT FROM lag(action) OVER w OR seg IS DISTINCT FROM lag(seg) OVER w OR t = 0 THEN 1 ELSE 0 END AS ch2 FROM a1 WINDOW w AS (PARTITION BY ep ORDER BY t)),
a3 AS (SELECT *, sum(ch2) OVER (PARTITION BY ep ORDER BY t) AS sub FROM a2),
a4 AS (SELECT *, min(t) OVER (PARTITION BY ep, sub) AS ft FROM a3),
a5 AS (SELECT *, sum(CASE WHEN t > ft THEN dx ELSE 0 END) OVER (PARTITION BY ep, sub) AS sx, sum(CASE WHEN t > ft THEN dy ELSE 0 END) OVER (PARTITION BY ep, sub) AS sy, sum(CASE WHEN t > ft THEN dz ELSE 0 END) OVER (PARTITION BY ep, sub) AS sz FROM a4),
a6 AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS total FROM a5),
a7 AS (SELECT ep, t, seg, sub, dx, dy, dz, ft, action, CASE WHEN action <> 'move' THEN '' ELSE {_AX} END AS direction FROM a6)"""


def _places():
    return ", ".join(f"('{a}', '{d}', '{s}')" for (a, d), s in W.sentences("left").items())


def _atomic(t):
    return W.atomic_labels(V.poses(t.events), 0.5, 0.4, IDLE, 0.2, 0.0)


@query(f"""WITH {_ATOMIC}, st(action, direction, sentence) AS (VALUES {_places()})
SELECT ep, t, a7.action, a7.direction, coalesce(sentence, 'Unknown action.') AS sentence FROM a7 LEFT JOIN st ON st.action = a7.action AND st.direction = a7.direction""")
def atomic_labels(t):
    return _atomic(t).select("ep", "t", "action", "direction", W.sentence("left", F.col("action"), F.col("direction")).alias("sentence"))


@query(f"""WITH {_ATOMIC} SELECT ep, CAST(sub AS BIGINT) AS sub, round(sum(CASE WHEN t > ft THEN dx ELSE 0 END), 6) AS dx, round(sum(CASE WHEN t > ft THEN dy ELSE 0 END), 6) AS dy FROM a7 GROUP BY ep, sub""")
def segment_displacement(t):
    moved = lambda d: r6(F.sum(F.when(F.col("t") > F.col("first"), F.col(d)).otherwise(0.0))).alias(d)
    return _atomic(t).groupBy("ep", (F.col("sub") + 1).alias("sub")).agg(moved("dx"), moved("dy"))


@query(f"""WITH {EV}, c AS (SELECT *, CASE WHEN prim IS DISTINCT FROM lag(prim) {_W}) THEN 1 ELSE 0 END AS ch FROM ev), r AS (SELECT *, sum(ch) {_W}) AS run FROM c)
SELECT traj, prim, min(t) AS first, max(t) AS last FROM r GROUP BY traj, run, prim""")
def label_runs(t):
    return W.with_runs(V.traj_events(t.events), "prim", by="traj", alias="run").groupBy("traj", "run", "prim").agg(F.min("t").alias("first"), F.max("t").alias("last")).drop("run")


@query(f"""WITH {EV}, c AS (SELECT *, CASE WHEN prim IS DISTINCT FROM lag(prim) {_W}) THEN 1 ELSE 0 END AS ch FROM ev), r AS (SELECT *, sum(ch) {_W}) - 1 AS idx FROM c),
l AS (SELECT traj, list(prim ORDER BY t) AS total FROM r WHERE ch = 1 GROUP BY traj)
SELECT traj, t, prim, CAST(idx AS BIGINT) AS idx, CAST(len(total) AS BIGINT) AS total, array_to_string(total[CAST(idx AS INT) + 1:CAST(idx AS INT) + 3], '|') AS next FROM r JOIN l USING (traj)""")
def subtask_sequence(t):
    return S.subtask_sequence(V.traj_events(t.events), "prim").select("traj", "t", "prim", "idx", F.size("total").cast("long").alias("total"), F.array_join(F.slice("total", F.col("idx").cast("int") + 1, 3), "|").alias("next"))


@query(f"""WITH {EV}, v AS (SELECT *, CASE WHEN prim NOT IN ('view', 'search') THEN prim END AS ok FROM ev)
SELECT traj, t, coalesce(last_value(ok IGNORE NULLS) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'idle') AS sub FROM v""")
def locf_subtask(t):
    said = F.when(F.col("prim").isin("view", "search"), " N/A ").otherwise(F.col("prim"))
    return V.traj_events(t.events).withColumn("said", said).select("traj", "t", W.carried(S.valid_label("said"), "traj", "idle").alias("sub"))


@query(f"WITH {EV} SELECT traj, bool_or(a > 400) AS any_high, bool_and(g < 0.95) AS all_low FROM ev GROUP BY traj")
def any_all(t):
    return V.traj_events(t.events).groupBy("traj").agg(F.bool_or(F.col("a") > 400).alias("any_high"), F.bool_and(F.col("g") < 0.95).alias("all_low"))


@query(f"WITH {EV} SELECT e.traj, e.t, n.a AS next3 FROM ev e JOIN ev n ON n.traj = e.traj AND n.t = e.t + 3")
def positional_self_join(t):
    return W.at_step(V.traj_events(t.events), F.col("t") + 3, "a", "next3").select("traj", "t", "next3")


@query(f"WITH {EV} SELECT traj, t, round(sum(a) {_W}), 4) AS cum FROM ev")
def prefix_sums(t):
    return V.traj_events(t.events).select("traj", "t", F.round(F.sum("a").over(V.steps().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("cum"))


@query(f"WITH {EV} SELECT traj, t, coalesce(CASE WHEN g > 0.5 THEN g END, 0.0) AS p FROM ev")
def proprio_default(t):
    df = V.traj_events(t.events).withColumn("proprio", F.when(F.col("g") > 0.5, F.array("g"))).withColumn("action", F.array("a"))
    return df.select("traj", "t", S.proprio_or_zeros("proprio", "action")[0].alias("p"))


@query(f"""WITH {EV} SELECT traj, t, a FROM (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY {lcg_sql('event_id', 11)}, event_id) AS rn FROM ev) WHERE rn <= 5""")
def subsample(t):
    w = Window.partitionBy("traj").orderBy(lcg("event_id", 11), "event_id")
    return V.traj_events(t.events).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("traj", "t", "a")


@query(f"""WITH {EV}, f AS (SELECT traj, max(t) + 1 AS n, min(CASE WHEN abs(g - g0) > 0.2 THEN t END) - 1 AS lo FROM (SELECT *, first_value(g) OVER (PARTITION BY traj ORDER BY t) AS g0 FROM ev) GROUP BY traj)
SELECT traj, lo + {lcg_sql('traj', 5)} % (n - lo) AS step FROM f WHERE lo IS NOT NULL""")
def random_step(t):
    df = S.still_trim(V.traj_events(t.events).withColumn("state", F.array("g")), "state", 0.2)
    ep = df.groupBy("traj").agg((F.max("t") + 1).alias("n"), (F.max("first_idx") - 1).alias("lo"))
    return ep.select("traj", (F.col("lo") + F.pmod(lcg("traj", 5), F.col("n") - F.col("lo"))).alias("step"))


@query(f"WITH {EV} SELECT traj, t, CASE WHEN {lcg_sql('traj', 9)} % 2 = 0 THEN a ELSE g END AS cam1, CASE WHEN {lcg_sql('traj', 9)} % 2 = 0 THEN g ELSE a END AS cam2 FROM ev")
def camera_swap(t):
    keep = F.pmod(lcg("traj", 9), F.lit(2)) == 0
    return V.traj_events(t.events).select("traj", "t", F.when(keep, F.col("a")).otherwise(F.col("g")).alias("cam1"), F.when(keep, F.col("g")).otherwise(F.col("a")).alias("cam2"))


@query(f"""WITH {EV}, n AS (SELECT traj, count(*) AS len FROM ev GROUP BY traj), c AS (SELECT traj, len, sum(len) OVER (ORDER BY traj) AS hi, sum(len) OVER (ORDER BY traj) - len AS lo, sum(len) OVER () AS total FROM n),
d AS (SELECT i, {lcg_sql('i * 7919', 1)} AS u FROM range(150) r(i))
SELECT i, traj FROM d JOIN c ON (u % CAST(total AS BIGINT)) >= lo AND (u % CAST(total AS BIGINT)) < hi""")
def length_weighted_sample(t):
    lens = V.traj_events(t.events).groupBy("traj").agg(F.count("*").alias("len"))
    return S.draw_by_weight(lens, "traj", "len", 150, lambda i: lcg(i * 7919, 1))


@query(f"WITH {EV} SELECT traj, t, a, g FROM ev")
def scan_standard(t):
    return V.traj_events(t.events).select("traj", "t", "a", "g")
