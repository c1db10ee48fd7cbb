"""Queries on video samples, instructions, JSON defaults, embeddings, rotations and interleaving."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinetrail.functions import actions as FA
from kinetrail.operators import mixtures as X, registry as G, restructure as RS, samples as M, standardize as Z, stats as S, views as V
from kinetrail.operators.views import TRAJ_EVENTS, TRAJ_ORDER, lcg, lcg_sql
from kinetrail.plans.registry import query

EV, LO = TRAJ_EVENTS, TRAJ_ORDER
_W = "OVER (PARTITION BY traj ORDER BY t)"


def r6(x):
    return F.round(x, 6)


@query(f"WITH {EV}, l AS (SELECT traj, t, a AS f0, lead(a, 1) {_W} AS f1, lead(a, 2) {_W} AS f2, lead(a, 5) {_W} AS target FROM ev) SELECT * FROM l WHERE target IS NOT NULL")
def video_prediction(t):
    """Three frames and the one to predict, five after the first, from every start."""
    w = V.steps()
    df = V.traj_events(t.events).select("traj", "t", F.col("a").alias("f0"), F.lead("a", 1).over(w).alias("f1"), F.lead("a", 2).over(w).alias("f2"), F.lead("a", 5).over(w).alias("target"))
    return df.where("target is not null")


_SIDES = "CASE event_id % 3 WHEN 0 THEN '' ELSE 'left ' || event_type END AS l, CASE event_id % 4 WHEN 0 THEN '' ELSE 'right ' || event_type END AS r"


@query(f"SELECT event_id, CASE WHEN l = '' AND r = '' THEN 'No action.' ELSE concat_ws(' ', nullif(l, ''), nullif(r, '')) END AS instruction, l || ' ' || r AS plain FROM (SELECT event_id, {_SIDES} FROM events)")
def moving_instruction(t):
    left = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("left "), "event_type"))
    right = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("right "), "event_type"))
    both = F.concat_ws(" ", F.nullif(left, F.lit("")), F.nullif(right, F.lit("")))
    return t.events.select("event_id", F.when(both == "", "No action.").otherwise(both).alias("instruction"), F.concat(left, F.lit(" "), right).alias("plain"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'alt ' || event_type ELSE 'No action.' END AS text FROM events")
def spelled_either_way(t):
    """One of two spellings of a key; an empty text counts as missing."""
    k = F.col("event_id") % 3
    first = F.when(k == 0, F.col("event_type")).when(k == 1, "")
    second = F.when(k == 1, F.concat(F.lit("alt "), "event_type")).when(k == 2, "")
    return t.events.select("event_id", F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit("No action.")).alias("text"))


@query(f"WITH {EV} SELECT traj, prim, max(t) AS idx FROM ev GROUP BY traj, prim")
def last_index_of(t):
    """Index of each label in a list of subtasks: the last one wins."""
    return V.traj_events(t.events).groupBy("traj", "prim").agg(F.max("t").alias("idx"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, 'unknown' AS action, 0.5::DOUBLE AS confidence FROM events")
def response_defaults(t):
    """Fields of an answer over defaults."""
    given = F.from_json("props", "struct<k:bigint, action:string, confidence:double>")
    return t.events.select("event_id", F.coalesce(given["k"], F.lit(0).cast("long")).alias("k"), F.coalesce(given["action"], F.lit("unknown")).alias("action"), F.coalesce(given["confidence"], F.lit(0.5)).alias("confidence"))


@query(f"WITH {EV} SELECT traj, '[' || string_agg('\"' || prim || '\"', ',' ORDER BY t) || ']' AS plan FROM ev GROUP BY traj")
def json_dump(t):
    first = F.transform(F.sort_array(F.collect_list(F.struct("t", "prim"))), lambda r: r["prim"])
    return V.traj_events(t.events).groupBy("traj").agg(F.to_json(first).alias("plan"))


@query(f"WITH {EV} SELECT traj, 'Task: ' || traj || chr(10) || string_agg(t || '. ' || prim, chr(10) ORDER BY t) || chr(10) || 'List the subtasks.' AS prompt FROM ev GROUP BY traj")
def prompt_builder(t):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("t", "prim"))), lambda r: F.concat(r["t"], F.lit(". "), r["prim"]))
    s = V.traj_events(t.events).groupBy("traj").agg(F.array_join(lines, "\n").alias("body"))
    return s.select("traj", F.concat(F.lit("Task: "), "traj", F.lit("\n"), "body", F.lit("\nList the subtasks.")).alias("prompt"))


@query("SELECT vec_id, 'out ' || vec_id AS said FROM embeddings")
def reply_cut(t):
    from kinetrail.functions.text import between_marks

    text = F.concat(F.lit("x<|im_start|>out "), "vec_id", F.lit("<|im_end|>tail<|im_start|>y"))
    return t.embeddings.select("vec_id", between_marks(text).alias("said"))


@query("""SELECT n_nationkey, k AS i, round(CASE WHEN k < 4 THEN sin(n_nationkey * power(10000.0::DOUBLE, -k / 4.0::DOUBLE)) ELSE cos(n_nationkey * power(10000.0::DOUBLE, -(k - 4) / 4.0::DOUBLE)) END, 6) AS v FROM nation, range(8) r(k)""")
def sinusoid(t):
    x = FA.sinusoid(F.col("n_nationkey").cast("double"), 8)
    return t.nation.select("n_nationkey", F.posexplode(x).alias("i", "v")).select("n_nationkey", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


@query("SELECT k AS i, round(3 * (1 - k / 9.0::DOUBLE) / (1 + 2 * (1 - k / 9.0::DOUBLE)), 6) AS time FROM range(10) r(k)")
def sampler_schedule(t):
    return t.spark.range(1).select(F.posexplode(FA.schedule(10, 3.0)).alias("i", "time")).select(F.col("i").cast("long").alias("i"), r6("time").alias("time"))


@query(f"WITH {LO} SELECT traj, t, round(cos(x) * cos(d), 6) AS m0, round(cos(x) * sin(d) * sin(q) - sin(x) * cos(q), 6) AS m1, round(cos(x) * sin(d) * cos(q) + sin(x) * sin(q), 6) AS m2, round(sin(x) * cos(d), 6) AS m3 FROM lo")
def rotation_six(t):
    m = FA.matrix_to_rot6d(FA.euler_to_matrix(F.col("q"), F.col("d"), F.col("x")))
    return V.traj_order(t.lineitem).withColumn("m", m).select("traj", "t", *(r6(F.col("m")[i]).alias(f"m{i}") for i in range(4)))


@query(f"WITH {LO} SELECT traj, t, round(cos(x) * q + sin(x) * d, 6) AS v0, round(-sin(x) * q + cos(x) * d, 6) AS v1, x AS v2 FROM lo")
def wrist_velocity(t):
    """A base-frame velocity in the frame of a wrist turned about z: the transposed rotation times the velocity."""
    back = FA.transposed(FA.euler_to_matrix(F.lit(0.0), F.lit(0.0), F.col("x")))
    v = [F.col("q"), F.col("d"), F.col("x")]
    df = V.traj_order(t.lineitem).withColumn("b", back)
    out = [sum((F.col("b")[3 * i + k] * v[k] for k in range(1, 3)), F.col("b")[3 * i] * v[0]) for i in range(3)]
    return df.select("traj", "t", r6(out[0]).alias("v0"), r6(out[1]).alias("v1"), out[2].alias("v2"))


@query(f"WITH u AS (SELECT doc_id, source, lang, ({lcg_sql('doc_id', 31)} + 1) / 2147483649.0::DOUBLE AS u FROM documents) SELECT doc_id, row_number() OVER (ORDER BY -ln(u) / CASE lang WHEN 'en' THEN 0.5 WHEN 'fr' THEN 0.3 ELSE 0.2 END, doc_id) AS pos FROM u")
def weighted_interleave(t):
    """Sources mixed by weight: rows in order of an exponential draw over their source's weight, numbered range by range."""
    u = (lcg("doc_id", 31) + 1) / 2147483649.0
    w = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "fr", 0.3).otherwise(0.2)
    df = t.documents.select("doc_id", (-F.log(u) / w).alias("key"))
    return X.numbered_by(df, "key", "doc_id").select("doc_id", "pos")


@query()
def shuffled(t):
    """A seeded shuffle of all frames: a range sort by a hash, no buffer."""
    return V.traj_events(t.events).select("traj", "t").orderBy(F.xxhash64(F.lit(17), "traj", "t"))


@query("SELECT n_nationkey, r, c, CAST(rb * 70 + cb AS BIGINT) AS pos FROM (SELECT n_nationkey, r, c, len(list_filter(range(1, 70), lambda k: k / 70.0::DOUBLE <= r / (n_nationkey % 5 + 1)::DOUBLE)) AS rb, len(list_filter(range(1, 70), lambda k: k / 70.0::DOUBLE <= c / (n_nationkey % 7 + 1)::DOUBLE)) AS cb FROM nation, range(5) a(r), range(7) b(c) WHERE r < n_nationkey % 5 + 1 AND c < n_nationkey % 7 + 1)")
def position_ids_interpolated(t):
    """Patch positions on a fixed grid of 70: the number of grid edges not above the patch's share."""
    key = F.col("n_nationkey").cast("int")
    rows, cols = key % 5 + 1, key % 7 + 1
    grid = t.nation.select("n_nationkey", rows.alias("h"), cols.alias("w"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    bucket = lambda i, n: F.size(F.filter(F.sequence(F.lit(1), F.lit(69)), lambda k: k / F.lit(70.0) <= i / n.cast("double")))
    return grid.select("n_nationkey", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), (bucket(F.col("r"), F.col("h")) * 70 + bucket(F.col("c"), F.col("w"))).cast("long").alias("pos"))


@query(f"WITH {EV} SELECT traj, t, sentence FROM (SELECT traj, t, CASE WHEN g > 0.95 THEN 'closed' WHEN g < 0.05 THEN 'open' ELSE 'moving' END AS sentence FROM ev)")
def move_by_gripper(t):
    g = F.col("g")
    return V.traj_events(t.events).select("traj", "t", F.when(g > 0.95, "closed").when(g < 0.05, "open").otherwise("moving").alias("sentence"))


@query("SELECT vec_id, printf('frame_%05d.jpg', vec_id) AS name, replace('task/' || label || '/x', '/', '_') AS config FROM embeddings")
def file_names(t):
    from kinetrail.sources.writers import frame_name

    return t.embeddings.select("vec_id", frame_name(F.col("vec_id")).alias("name"), F.translate(F.concat(F.lit("task/"), "label", F.lit("/x")), "/", "_").alias("config"))


@query(f"WITH {EV} SELECT traj, count(*) AS n, bool_and(t2 = t) AS ok FROM (SELECT traj, t, row_number() OVER (PARTITION BY traj ORDER BY t) - 1 AS t2 FROM ev) GROUP BY traj")
def contiguous_steps(t):
    """Invariant of every trajectory view: steps run from 0 without gaps."""
    w = Window.partitionBy("traj").orderBy("t")
    return V.traj_events(t.events).withColumn("t2", F.row_number().over(w) - 1).groupBy("traj").agg(F.count("*").alias("n"), F.bool_and(F.col("t2") == F.col("t")).alias("ok"))


@query("SELECT source, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS k FROM documents) GROUP BY source")
def tokens_by_source(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(M.token_count(F.col("text"))).alias("tokens"))


_GOALS = f"goals AS (SELECT * FROM (VALUES {', '.join(f'({i}, {n!r}, {k})' for i, (n, k) in enumerate(G.GOALS.items()))}) v(i, name, goal))"


@query(f"WITH {_GOALS}, {EV}, d AS (SELECT ev.*, name, goal FROM ev JOIN goals ON goals.i = traj % 21) SELECT d.traj, d.t, d.name, least(d.t + goal - 1, max(d.t) OVER (PARTITION BY d.traj)) AS goal FROM d")
def goal_by_dataset(t):
    """Each step's goal by its dataset's name; an unknown name is an error."""
    names = F.array(*map(F.lit, G.GOALS))
    df = V.traj_events(t.events).withColumn("name", F.get(names, F.pmod("traj", F.lit(len(G.GOALS))).cast("int")))
    last = F.max("t").over(Window.partitionBy("traj"))
    return df.select("traj", "t", "name", F.least(F.col("t") + S.offset_of(F.col("name"), G.GOALS) - 1, last).alias("goal"))


_MIXED = ", ".join(f"({m!r}, {i}, {d!r}, {w}::DOUBLE)" for m, x in G.MIXTURES.items() for i, (d, w) in enumerate(x))
_LOADED = ", ".join(f"({n!r}, {G.TRANSFORMS[n]!r}, {c.action_encoding!r})" for n, c in G.CONFIGS.items())


@query(f"""WITH mx AS (SELECT * FROM (VALUES {_MIXED}) v(mixture, pos, name, weight)), ds AS (SELECT * FROM (VALUES {_LOADED}) v(name, spec, enc)),
o AS (SELECT *, row_number() OVER (PARTITION BY mixture, name ORDER BY pos) AS r FROM mx)
SELECT mixture, o.name, spec, CASE enc WHEN 'EEF_POS' THEN 7 ELSE 10 END AS action_size, weight FROM o JOIN ds ON ds.name = o.name WHERE r = 1 AND enc IN ('EEF_POS', 'EEF_R6')""")
def mixture_registry(t):
    """Every mixture's datasets, each once, with spec and weight; those whose actions cannot be loaded are left out."""
    datasets, mixtures = G.tables(t.spark)
    first = X.first_of_name(mixtures.withColumn("k", F.struct("mixture", "name")), "k", "pos").drop("k")
    size = F.when(F.col("action_encoding") == "EEF_POS", G.ACTION_SIZE["EEF_POS"]).when(F.col("action_encoding") == "EEF_R6", G.ACTION_SIZE["EEF_R6"])
    return first.join(F.broadcast(datasets), "name").withColumn("action_size", size).where("action_size is not null").select("mixture", "name", "spec", "action_size", "weight")


@query(f"WITH {LO} SELECT traj, t, CAST(t AS INT) AS timestep, generate_subscripts(p, 1) - 1 AS dim, unnest(p) AS v, name, m FROM (SELECT traj, t, [q, d, x, d, x, q, 0.0, x] AS p, 'bridge_orig' AS name, 'pick' AS m FROM lo)")
def restructure(t):
    """Proprioception of state, padding and gripper, with time step, language and name."""
    v = lambda *c: F.array(*map(F.col, c))
    df = V.traj_order(t.lineitem).select("traj", "t", v("q", "d", "x", "d", "x", "q").alias("EEF_state"), F.col("x").alias("gripper_state"), v("q", "d", "x", "d", "x", "q", "x").alias("action"), F.lit("pick").alias("language_instruction"), F.lit(b"i").alias("image_0"))
    out = RS.restructured(df, G.settings("bridge_orig"))
    return out.select("traj", "t", "timestep", F.posexplode("proprio").alias("dim", "v"), F.col("dataset_name").alias("name"), F.col("language").alias("m")).withColumn("dim", F.col("dim").cast("long")).withColumn("v", F.round(F.col("v").cast("double"), 4))


@query("SELECT dir, path, CAST(k AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS r, count(*) OVER (PARTITION BY dir) AS n FROM (SELECT '/data/' || source || '/ep_' || doc_id || '.tar' AS path, '/data/' || source AS dir FROM documents)), range(121) x(k) WHERE k * n + r <= 120")
def repeat_paths_to_count(t):
    """120 paths of each directory, however few it has."""
    d = F.concat(F.lit("/data/"), "source")
    return X.repeated_to(t.documents.select(F.concat(d, F.lit("/ep_"), "doc_id", F.lit(".tar")).alias("path"), d.alias("dir")), "dir", "path", 120).select("dir", "path", "k")


_LEN = "(n_nationkey * 13 % 40 + 1)"
_CUTS = f"[{{'a': CAST(floor(i * {_LEN}::DOUBLE / least(8, {_LEN})) AS BIGINT), 'z': CAST(floor((i + 1) * {_LEN}::DOUBLE / least(8, {_LEN})) AS BIGINT) - 1}} for i in range(least(8, {_LEN}))]"


@query(f"WITH r AS (SELECT n_nationkey, {_LEN} AS n, {_CUTS} AS rs FROM nation) SELECT n_nationkey, i, CAST(rs[least(i, len(rs) - 1) + 1].a + 1 AS BIGINT) AS frame FROM r, range(8) x(i)")
def frame_from_start(t):
    """One frame after the first of each of eight intervals."""
    frames = (F.col("n_nationkey") * 13 % 40 + 1).cast("int")
    return t.nation.select("n_nationkey", F.posexplode(X.from_start(8, frames, 1)).alias("i", "frame")).select("n_nationkey", F.col("i").cast("long").alias("i"), F.col("frame").cast("long").alias("frame"))


_DRAW = lcg_sql("n_nationkey * 100 + {0}", 7)


@query(f"""WITH r AS (SELECT n_nationkey, {_LEN} AS n, {_CUTS} AS rs FROM nation), f AS (SELECT *, len(list_filter(rs, lambda x: x.z <= x.a)) > 0 AS loose FROM r),
g AS (SELECT n_nationkey, n, CASE WHEN loose THEN list_sort(list_transform(list_sort([{{'u': {_DRAW.format('i + 8')}, 'i': i}} for i in range(n)])[:least(8, n)], lambda x: x.i))
  ELSE [rs[i + 1].a + {_DRAW.format('i')} % (rs[i + 1].z - rs[i + 1].a) for i in range(8)] END AS fr FROM f)
SELECT n_nationkey, i, CAST(fr[least(i, len(fr) - 1) + 1] AS BIGINT) AS frame FROM g, range(8) x(i)""")
def frame_random(t):
    """A drawn frame of each of eight intervals."""
    frames = (F.col("n_nationkey") * 13 % 40 + 1).cast("int")
    got = X.at_random(8, frames, lambda i: lcg(F.col("n_nationkey") * 100 + i, 7))
    return t.nation.select("n_nationkey", F.posexplode(got).alias("i", "frame")).select("n_nationkey", F.col("i").cast("long").alias("i"), F.col("frame").cast("long").alias("frame"))


@query(f"WITH {LO} SELECT traj, t, round(cos(x) * q + sin(x) * d, 6) AS v0, round(-sin(x) * q + cos(x) * d, 6) AS v1, x AS v2, round(cos(x) ** 2 + sin(x) ** 2 * cos(q), 6) AS r0, round(cos(x) * sin(x) * (cos(q) - 1), 6) AS r1, round(-sin(x) * sin(q), 6) AS r2, round(cos(x) * sin(x) * (cos(q) - 1), 6) AS r3, round(sin(x) ** 2 + cos(x) ** 2 * cos(q), 6) AS r4, round(-cos(x) * sin(q), 6) AS r5 FROM lo")
def wrist_action(t):
    """Translation and rotation of a velocity in the frame of a wrist turned about z."""
    z = F.lit(0.0)
    got = FA.in_wrist_frame(F.array("q", "d", "x", "q", z, z), F.array(z, z, z, z, z, F.col("x")))
    df = V.traj_order(t.lineitem).withColumn("w", got)
    return df.select("traj", "t", *(r6(F.col("w")[i]).alias(f"v{i}") for i in range(2)), F.col("w")[2].alias("v2"), *(r6(F.col("w")[3 + i]).alias(f"r{i}") for i in range(6)))


@query(f"WITH {LO} SELECT traj, t, generate_subscripts(x, 1) - 1 AS dim, round(unnest(x), 6) AS v FROM (SELECT traj, t, [q, d, x, x, d, q, 1 - x, q, d, x, x, d, q, q] AS x FROM lo)")
def std_by_side(t):
    """A dataset by its registered name; its action and its state have a column of one name."""
    v = lambda *c: F.array(*map(F.col, c))
    df = V.traj_order(t.lineitem).select("traj", "t", F.struct(v("q", "d", "x").alias("translation"), v("x", "d", "q").alias("rotation"), F.col("x").alias("gripper_position")).alias("action"), F.struct(v("q", "d", "x", "x", "d", "q").alias("cartesian_position"), F.col("q").alias("gripper_position")).alias("observation"))
    out = Z.standardize(df, "droid").withColumn("all", F.concat("action", "proprio"))
    return out.select("traj", "t", F.posexplode("all").alias("dim", "v")).select("traj", "t", F.col("dim").cast("long").alias("dim"), r6("v").alias("v"))
