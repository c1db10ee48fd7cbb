"""Queries on conversations, plans, packing, annotations and text."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinetrail.operators import annotations as A, samples as M, views as V, windows as W
from kinetrail.operators.views import DIALOG, TRAJ_EVENTS, lcg, lcg_sql
from kinetrail.plans.registry import query

EV = TRAJ_EVENTS
_WS = r"'[\s]+'"


def _strip(x):
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _elements(cap: str | None, gpt: str, loss: int, goal: bool = False) -> str:
    limit = f"WHERE n <= {cap}" if cap else ""
    tail = " UNION ALL SELECT conv_id, max(turn) + 1, 0, 0, 'goal_image', 1, NULL FROM dg GROUP BY conv_id" if goal else ""
    return f"""{DIALOG}, hp AS (SELECT conv_id, turn, string_split(value, '<image>') AS pieces FROM dg WHERE role = 'human'),
pc AS (SELECT conv_id, turn, len(pieces) AS k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS pos FROM hp),
tx AS (SELECT conv_id, turn, pos, 0 AS sub, 'text' AS type, 0 AS has_loss, CASE WHEN k = 1 THEN piece ELSE {_strip('piece')} END AS text FROM pc WHERE k = 1 OR {_strip('piece')} <> ''),
im0 AS (SELECT conv_id, turn, pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n FROM pc WHERE pos <> k - 1),
im AS (SELECT conv_id, turn, pos, 1 AS sub, 'image' AS type, 0 AS has_loss, NULL AS text FROM im0 {limit}),
gp AS (SELECT conv_id, turn, 0 AS pos, 0 AS sub, '{gpt}' AS type, {loss} AS has_loss, value AS text FROM dg WHERE role = 'gpt'),
al AS (SELECT * FROM tx UNION ALL SELECT * FROM im UNION ALL SELECT * FROM gp{tail}),
el AS (SELECT conv_id, CAST(row_number() OVER w - 1 AS INT) AS seq, type, has_loss, text, CASE WHEN type IN ('image', 'goal_image') THEN CAST(sum(CASE WHEN type IN ('image', 'goal_image') THEN 1 ELSE 0 END) OVER w - 1 AS INT) END AS ref
  FROM al WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos, sub))"""


_EL = ["conv_id", "seq", "type", "has_loss", "text"]


@query(f"WITH {_elements('1', 'text', 1)} SELECT conv_id, seq, type, has_loss, text FROM el")
def conversation_elements(t):
    return M.elements(V.dialog(t.conversations), F.lit(1)).select(*_EL)


@query(f"WITH {_elements(None, 'action', 1)} SELECT conv_id, seq, type, has_loss, text FROM el")
def elements_uncapped(t):
    return M.elements(V.dialog(t.conversations), None, gpt="action").select(*_EL)


@query(f"WITH {_elements(None, 'action', 0, True)} SELECT conv_id, seq, type, has_loss, text, ref FROM el")
def elements_goal(t):
    return M.elements(V.dialog(t.conversations), None, gpt="action", gpt_loss=0, goal=True).select(*_EL, "ref")


_NTOK = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))"
_PLAN = f"""{_elements('1', 'text', 1, True)}, nt AS (SELECT *, {_NTOK} AS n FROM el),
pl AS (SELECT conv_id, seq, 0 AS sub, 'text' AS type, 1 AS enable_cfg, has_loss AS loss, n + 2 AS n_tokens FROM nt WHERE type = 'text' AND n > 0
  UNION ALL SELECT conv_id, seq, 0, 'vit_image', 1, 0, 66 FROM nt WHERE type IN ('image', 'goal_image') AND has_loss = 0
  UNION ALL SELECT conv_id, seq, 0, 'vae_image', 1, 1, 18 FROM nt WHERE type = 'goal_image' UNION ALL SELECT conv_id, seq, 1, 'vae_image', 1, 0, 18 FROM nt WHERE type = 'goal_image'
  UNION ALL SELECT conv_id, seq, 2, 'vit_image', 1, 0, 66 FROM nt WHERE type = 'goal_image'),
pn AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq, sub) - 1 AS INT) AS item, type, enable_cfg, loss, CAST(n_tokens AS INT) AS n_tokens FROM pl)"""


def _plan(t):
    return M.sequence_plan(M.elements(V.dialog(t.conversations), F.lit(1), goal=True), 64, 16, 8)


@query(f"WITH {_PLAN} SELECT conv_id, item, type, enable_cfg, loss, n_tokens FROM pn")
def sequence_plan(t):
    return _plan(t).select("conv_id", "item", "type", "enable_cfg", "loss", "n_tokens")


@query(f"WITH {_PLAN} SELECT conv_id, CAST(sum(n_tokens) AS BIGINT) AS num_tokens, count(*) AS items FROM pn GROUP BY conv_id HAVING sum(loss) > 0")
def has_loss(t):
    return _plan(t).groupBy("conv_id").agg(F.sum("n_tokens").alias("num_tokens"), F.count("*").alias("items"), F.sum("loss").alias("l")).where("l > 0").drop("l")


@query(f"WITH {_PLAN}, s AS (SELECT conv_id, CAST(sum(n_tokens) AS BIGINT) AS num_tokens, count(*) AS k FROM pn GROUP BY conv_id) SELECT conv_id, num_tokens, num_tokens + 2 * k < 400 AS mandatory FROM s WHERE num_tokens + 2 * k <= 400")
def length_filter(t):
    s = _plan(t).groupBy("conv_id").agg(F.sum("n_tokens").alias("num_tokens"), F.count("*").alias("k"))
    long = F.col("num_tokens") + 2 * F.col("k")
    return s.where(long <= 400).select("conv_id", "num_tokens", (long < 400).alias("mandatory"))


@query(f"WITH {_PLAN} SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN type = 'text' AND loss = 1 THEN n_tokens - 1 ELSE 0 END) AS BIGINT) AS ce, CAST(sum(CASE WHEN type = 'vae_image' AND loss = 1 THEN n_tokens - 2 ELSE 0 END) AS BIGINT) AS mse FROM pn")
def token_totals(t):
    of = lambda kind, off: F.sum(F.when((F.col("type") == kind) & (F.col("loss") == 1), F.col("n_tokens") - off).otherwise(0))
    return _plan(t).agg(F.sum("n_tokens").alias("tokens"), of("text", 1).alias("ce"), of("vae_image", 2).alias("mse"))


@query(f"WITH {_elements('1', 'text', 1)} SELECT conv_id, seq, CAST({_NTOK} AS INT) AS n FROM el WHERE type = 'text' AND {_NTOK} > 0")
def nonempty_tokens(t):
    n = M.token_count(F.col("text"))
    return M.elements(V.dialog(t.conversations), F.lit(1)).where((F.col("type") == "text") & (n > 0)).select("conv_id", "seq", n.alias("n"))


_SAMPLES = "sm AS (SELECT doc_id % 20 AS shard, doc_id AS sample, CAST(len(string_split(text, ' ')) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL)"


def _samples(t):
    return t.documents.where("text is not null").select((F.col("doc_id") % 20).alias("shard"), F.col("doc_id").alias("sample"), F.size(F.split("text", " ", -1)).cast("long").alias("size"))


_PACK = f"""{_SAMPLES}, o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY sample) AS rn FROM sm),
pk AS (SELECT shard, 0::BIGINT AS rn, 0::BIGINT AS cur, 0 AS batch, NULL::BIGINT AS sample, NULL::BIGINT AS size, NULL::INT AS b FROM (SELECT DISTINCT shard FROM sm)
  UNION ALL SELECT o.shard, o.rn, CASE WHEN o.size > 1500 THEN cur WHEN cur + o.size > 2500 THEN 0 WHEN cur + o.size >= 2000 THEN 0 ELSE cur + o.size END,
    CASE WHEN o.size > 1500 THEN batch WHEN cur + o.size > 2500 OR cur + o.size >= 2000 THEN batch + 1 ELSE batch END,
    o.sample, o.size, CASE WHEN o.size <= 1500 AND cur + o.size <= 2500 THEN batch END FROM pk JOIN o ON o.shard = pk.shard AND o.rn = pk.rn + 1)"""


@query(f"WITH RECURSIVE {_PACK} SELECT shard, sample, b AS batch, size FROM pk WHERE b IS NOT NULL")
def pack_greedy(t):
    return M.greedy_packs(_samples(t), "shard", "sample", "size", 2000, 2500, 1500)


_BUFFERED = f"""{_SAMPLES}, xs AS (SELECT shard, list({{'s': sample, 'n': size}} ORDER BY sample) AS x FROM sm GROUP BY shard),
pk AS (SELECT shard, 0 AS k, 0 AS pos, 0::BIGINT AS cur, 0 AS batch, []::STRUCT(s BIGINT, n BIGINT)[] AS held, NULL::BIGINT AS sample, NULL::BIGINT AS size, NULL::INT AS b FROM xs
  UNION ALL SELECT shard, k + 1, CASE WHEN old THEN pos ELSE pos + 1 END,
    CASE WHEN it.n > 1500 OR (cur + it.n > 2500 AND keeps) THEN cur WHEN cur + it.n > 2500 OR cur + it.n >= 2000 THEN 0 ELSE cur + it.n END,
    CASE WHEN it.n > 1500 OR (cur + it.n > 2500 AND keeps) THEN batch WHEN cur + it.n > 2500 OR cur + it.n >= 2000 THEN batch + 1 ELSE batch END,
    CASE WHEN it.n <= 1500 AND cur + it.n > 2500 AND keeps THEN list_append(rest, it) ELSE rest END, it.s, it.n, CASE WHEN it.n <= 1500 AND cur + it.n <= 2500 THEN batch END
  FROM (SELECT *, NOT old AND len(held) < 3 AS keeps, CASE WHEN old THEN held[1] ELSE x[pos + 1] END AS it, CASE WHEN old THEN held[2:] ELSE held END AS rest
    FROM (SELECT pk.*, xs.x, pk.cur < 1000 AND len(pk.held) > 0 AS old FROM pk JOIN xs ON xs.shard = pk.shard) WHERE old OR pos < len(x))),
last AS (SELECT shard, max_by(held, k) AS held FROM pk GROUP BY shard)"""


@query(f"WITH RECURSIVE {_BUFFERED} SELECT shard, sample, b AS batch, size FROM pk WHERE b IS NOT NULL UNION ALL SELECT shard, held[i].s, CAST(-i AS INT), held[i].n FROM last, range(1, 4) r(i) WHERE i <= len(held)")
def pack_buffered(t):
    return M.packs_with_buffer(_samples(t), "shard", "sample", "size", 2000, 2500, 1500, 1000, 3)


@query(f"""WITH {_PLAN}, a AS (SELECT *, CASE WHEN type = 'text' THEN n_tokens WHEN type = 'vit_image' OR loss = 0 THEN 1 ELSE 0 END AS adv FROM pn)
SELECT conv_id, item, CAST(sum(n_tokens) OVER w - n_tokens AS BIGINT) AS start, CAST(sum(adv) OVER w - adv AS BIGINT) AS rope_start,
  CASE WHEN type = 'text' THEN 'causal' WHEN type <> 'vit_image' AND loss = 1 THEN 'noise' ELSE 'full' END AS attn FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY item)""")
def pack_offsets(t):
    return M.offsets(_plan(t), ["conv_id"], "item").select("conv_id", "item", "start", "rope_start", M.attention_mode().alias("attn"))


@query(f"""WITH {_PLAN}, s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY item) - n_tokens AS start FROM pn)
SELECT conv_id, CAST(start + unnest(range(n_tokens - 1)) AS BIGINT) AS token, round(1.0 / sqrt(n_tokens - 1), 6) AS weight FROM s WHERE type = 'text' AND loss = 1""")
def ce_weights(t):
    s = M.offsets(_plan(t), ["conv_id"], "item").where("type = 'text' and loss = 1")
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 2)))
    return s.select("conv_id", (F.col("start") + F.col("i")).alias("token"), F.round(M.loss_weight(F.col("n_tokens") - 1, F.lit("square")), 6).alias("weight"))


@query(f"""WITH {_PLAN}, m AS (SELECT *, type <> 'text' AND type <> 'vit_image' AND loss = 1 AS noise FROM pn),
q AS (SELECT *, coalesce(sum(CASE WHEN noise THEN 0 ELSE n_tokens END) OVER (PARTITION BY conv_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m)
SELECT conv_id, CAST(sum(CASE WHEN type = 'text' THEN n_tokens::BIGINT * (n_tokens + 1) // 2 ELSE n_tokens::BIGINT * n_tokens END + n_tokens * seen) AS BIGINT) AS pairs FROM q GROUP BY conv_id""")
def attn_pairs(t):
    return M.attended(_plan(t), "conv_id", "item")


@query(f"WITH {_PLAN}, s AS (SELECT conv_id, CAST(sum(n_tokens) AS BIGINT) AS n FROM pn GROUP BY conv_id) SELECT conv_id, n AS len, 'split' AS kind FROM s UNION ALL SELECT conv_id, 4096 - n, 'pad' FROM s WHERE n < 4096")
def flex_pad(t):
    s = _plan(t).groupBy("conv_id").agg(F.sum("n_tokens").alias("n"))
    return s.select("conv_id", F.explode(F.array(F.struct(F.col("n").alias("len"), F.lit("split").alias("kind")), F.struct((4096 - F.col("n")).alias("len"), F.lit("pad").alias("kind")))).alias("x")).select("conv_id", "x.len", "x.kind").where("kind = 'split' or len > 0")


@query(f"WITH {_SAMPLES} SELECT shard, round(sum(size * w) / sum(w), 6) AS weighted, round(CAST(sum(size) AS DOUBLE) / count(*), 6) AS plain, max(size) AS largest FROM (SELECT *, 1.0 / sqrt(size) AS w FROM sm) GROUP BY shard")
def rank_reduce(t):
    s = _samples(t).withColumn("w", M.loss_weight(F.col("size"), F.lit("square")))
    return s.groupBy("shard").agg(F.round(F.sum(F.col("size") * F.col("w")) / F.sum("w"), 6).alias("weighted"), F.round(F.sum("size") / F.count("*"), 6).alias("plain"), F.max("size").alias("largest"))


@query("SELECT vec_id, n, round(CASE WHEN n = 0 THEN 0 WHEN vec_id % 3 = 0 THEN 1 WHEN vec_id % 3 = 1 THEN 1.0 / n ELSE 1.0 / sqrt(n) END, 6) AS weight FROM (SELECT vec_id, vec_id % 50 AS n FROM embeddings)")
def len2weight(t):
    n = F.col("vec_id") % 50
    kind = F.when(F.col("vec_id") % 3 == 0, "token").when(F.col("vec_id") % 3 == 1, "sample").otherwise("square")
    return t.embeddings.select("vec_id", n.alias("n"), F.round(M.loss_weight(n, kind), 6).alias("weight"))


def _steps_sql(n):
    return f"(o_orderkey * 37 + {n}) % 1900 + 60"


_RS = """r0 AS (SELECT o_orderkey, (o_orderkey * 37 + 11) % 1900 + 60 AS w, (o_orderkey * 53 + 7) % 1400 + 60 AS h, o_orderkey % 4 + 1 AS imgs FROM orders),
r1 AS (SELECT *, greatest(least(980.0::DOUBLE / greatest(w, h), 1.0), 378.0::DOUBLE / least(w, h)) AS s FROM r0),
r2 AS (SELECT *, greatest(14, round_even(round_even(w * s, 0) / 14, 0) * 14) AS a, greatest(14, round_even(round_even(h * s, 0) / 14, 0) * 14) AS b FROM r1),
r3 AS (SELECT *, a * b > 2007040.0::DOUBLE / imgs AS over, 2007040.0::DOUBLE / imgs / (a * b) AS s2 FROM r2),
r4 AS (SELECT *, CASE WHEN over THEN greatest(14, round_even(round_even(a * s2, 0) / 14, 0) * 14) ELSE a END AS c, CASE WHEN over THEN greatest(14, round_even(round_even(b * s2, 0) / 14, 0) * 14) ELSE b END AS d FROM r3),
r5 AS (SELECT *, greatest(c, d) > 980 AS over2, 980.0::DOUBLE / greatest(c, d) AS s3 FROM r4),
r6 AS (SELECT o_orderkey, w, h, imgs, CAST(CASE WHEN over2 THEN greatest(14, round_even(round_even(c * s3, 0) / 14, 0) * 14) ELSE c END AS BIGINT) AS new_w, CAST(CASE WHEN over2 THEN greatest(14, round_even(round_even(d * s3, 0) / 14, 0) * 14) ELSE d END AS BIGINT) AS new_h FROM r5)"""


def _resized(t):
    k = F.col("o_orderkey")
    df = t.orders.select("o_orderkey", (F.pmod(k * 37 + 11, F.lit(1900)) + 60).alias("w"), (F.pmod(k * 53 + 7, F.lit(1400)) + 60).alias("h"), (F.pmod(k, F.lit(4)) + 1).alias("imgs"))
    return M.resized(df, "w", "h", 980, 378, 14, 14 * 14 * 10240, "imgs")


@query(f"WITH {_RS} SELECT o_orderkey, new_w, new_h, new_w * new_h // 196 AS patches FROM r6")
def resize_plan(t):
    return _resized(t).select("o_orderkey", "new_w", "new_h", "patches")


@query(f"WITH {_RS} SELECT o_orderkey % 64 AS batch, max(new_h) AS h, max(new_w) AS w FROM r6 GROUP BY o_orderkey % 64")
def batch_max_shape(t):
    return _resized(t).groupBy((F.col("o_orderkey") % 64).alias("batch")).agg(F.max("new_h").alias("h"), F.max("new_w").alias("w"))


@query("SELECT n_nationkey, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(r * 70 + c AS INT) AS pos FROM nation, range(25) a(r), range(25) b(c) WHERE r < n_nationkey % 5 + 1 AND c < n_nationkey % 7 + 1")
def position_ids(t):
    key = F.col("n_nationkey").cast("int")
    grid = t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), key % 5)).alias("r"), F.sequence(F.lit(0), key % 7).alias("cs"))
    return grid.select("n_nationkey", "r", F.explode("cs").alias("c")).withColumn("pos", F.col("r") * 70 + F.col("c"))


@query(f"WITH {EV} SELECT traj, t, d, 32000 + d - 257 AS token FROM (SELECT traj, t, CAST(len(list_filter(edges, lambda e: e <= v)) AS INT) AS d FROM (SELECT traj, t, greatest(-1, least(1, a / 200 - 1)) AS v, list_transform(range(256), lambda i: -1 + i * (2.0::DOUBLE / 255)) AS edges FROM ev))")
def action_tokens(t):
    from kinetrail.functions.actions import action_token, digitize

    d = digitize(F.col("a") / 200 - 1)
    return V.traj_events(t.events).select("traj", "t", d.alias("d"), action_token(d, 32000).alias("token"))


@query(f"WITH {EV} SELECT traj, t, round(-1 + (least(greatest(CAST(floor(a) AS INT) % 258 - 1, 0), 254) + 0.5) * (2.0::DOUBLE / 255), 6) AS centre FROM ev")
def token_decode(t):
    from kinetrail.functions.actions import token_centre

    return V.traj_events(t.events).select("traj", "t", F.round(token_centre(F.floor("a").cast("int") % 258), 6).alias("centre"))


_KEYS = "ky AS (SELECT traj, CAST(t AS DOUBLE) / 10 AS key, prim AS sub FROM ev WHERE t % 10 = 3)"


@query(f"""WITH {EV}, {_KEYS}, st AS (SELECT traj, t, CAST(t AS DOUBLE) / 10 AS time FROM ev),
m AS (SELECT st.traj, st.t, max(key) FILTER (WHERE key <= time) AS k, min(key) AS f FROM st JOIN ky USING (traj) GROUP BY st.traj, st.t)
SELECT m.traj, m.t, coalesce(m.k, m.f) AS key, ky.sub FROM m JOIN ky ON ky.traj = m.traj AND ky.key = coalesce(m.k, m.f)""")
def asof_reasoning(t):
    e = V.traj_events(t.events)
    keys = e.where("t % 10 = 3").select("traj", (F.col("t") / 10).alias("key"), F.col("prim").alias("sub"))
    steps = e.select("traj", "t", (F.col("t") / 10).alias("time"))
    return A.latest_key(steps, keys, "traj", "time", "key", "sub").where("key is not null").select("traj", "t", "key", "sub")


@query(f"""WITH {EV}, {_KEYS}, n AS (SELECT traj, count(*) AS len FROM ev GROUP BY traj), l AS (SELECT ky.traj, key, len, lead(key) OVER (PARTITION BY ky.traj ORDER BY key) AS nx FROM ky JOIN n ON n.traj = ky.traj)
SELECT traj, key, CAST(greatest(0, least(CASE WHEN nx IS NULL THEN len - 1 ELSE CAST(floor(nx * 10) AS BIGINT) - 1 END, len - 1)) AS BIGINT) AS goal FROM l""")
def goal_frame(t):
    e = V.traj_events(t.events).withColumn("len", F.count("*").over(Window.partitionBy("traj")))
    keys = e.where("t % 10 = 3").select("traj", (F.col("t") / 10).alias("key"), "len")
    return A.goal_frames(keys, "traj", "key", 10.0, "len").select("traj", "key", "goal")


_SEG = "sg AS (SELECT traj, event_id AS seg, t AS start, t + CAST(floor(g * 10) AS BIGINT) AS stop, prim AS label FROM ev WHERE t % 7 = 2)"


@query(f"""WITH {EV}, {_SEG}, j AS (SELECT ev.traj, ev.t, max_by(sg.label, sg.seg) AS hit FROM ev LEFT JOIN sg ON sg.traj = ev.traj AND ev.t BETWEEN sg.start AND sg.stop GROUP BY ev.traj, ev.t)
SELECT traj, t, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Perform task') AS label FROM j""")
def segment_range_join(t):
    e = V.traj_events(t.events)
    seg = e.where("t % 7 = 2").select("traj", F.col("event_id").alias("seg"), F.col("t").alias("start"), (F.col("t") + F.floor(F.col("g") * 10)).alias("stop"), F.col("prim").alias("label"))
    return A.label_frames(e.select("traj", "t"), seg, "traj", "Perform task").select("traj", "t", "label")


_VALID = "['click button', 'view', 'purchase item', 'search box', 'cart']"


@query(f"""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type WHEN 2 THEN 'the ' || event_type || ' now' ELSE 'nothing' END AS said, {_VALID} AS valid FROM events)
SELECT event_id, said, CASE WHEN list_contains(valid, said) THEN said ELSE list_filter(valid, lambda v: contains(lower(v), lower(trim(said))) OR contains(lower(trim(said)), lower(v)))[1] END AS match FROM s""")
def fuzzy_match(t):
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.upper("event_type")).when(k == 1, F.col("event_type")).when(k == 2, F.concat(F.lit("the "), "event_type", F.lit(" now"))).otherwise("nothing")
    df = t.events.select("event_id", said.alias("said"), F.array(*map(F.lit, ["click button", "view", "purchase item", "search box", "cart"])).alias("valid"))
    return df.select("event_id", "said", A.fuzzy_match("said", "valid").alias("match"))


@query(f"WITH {EV} SELECT traj, t, repeat('<image>', CAST(t % 3 + 1 AS INT)) || chr(10) || 'What action should the robot take to ' || lower(trim(prim)) || '?' AS prompt FROM ev")
def action_prompt(t):
    from kinetrail.functions import text as T

    return V.traj_events(t.events).select("traj", "t", T.action_prompt(F.col("prim"), (F.col("t") % 3 + 1).cast("int")).alias("prompt"))


@query(r"""SELECT doc_id, CASE WHEN x = '' THEN 'interact with any object' ELSE replace(x, chr(10), ' ') END AS instruction FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[!-/:-@\[-`{-~]+$', '')) AS x FROM documents)""")
def scene_prompt(t):
    from kinetrail.functions import text as T

    return t.documents.select("doc_id", T.scene_instruction(F.col("text")).alias("instruction"))


@query(f"""WITH {EV}, l AS (SELECT traj, t, list(CASE prim WHEN 'view' THEN '' ELSE trim(regexp_replace(lower('  ' || prim || '  Now'), '\\s+', ' ', 'g')) END) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM ev),
f AS (SELECT traj, t, list_filter(x, lambda v: v <> '') AS x FROM l)
SELECT traj, t, CASE WHEN len(x) = 0 THEN 'none' ELSE array_to_string(list_filter(x, lambda v, i: i = 1 OR v <> x[i - 1]), ', ') END AS thought FROM f""")
def thought_dedupe(t):
    e = V.traj_events(t.events).withColumn("said", F.when(F.col("prim") == "view", "").otherwise(A.cleaned(F.concat(F.lit("  "), "prim", F.lit("  Now")))))
    ahead = F.collect_list("said").over(V.steps().rowsBetween(0, 4))
    x = A.adjacent_distinct(F.col("x"))
    return e.select("traj", "t", ahead.alias("x")).select("traj", "t", F.when(F.size(x) == 0, "none").otherwise(F.array_join(x, ", ")).alias("thought"))


@query(r"""SELECT doc_id, trim(regexp_replace(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def canonical_text(t):
    return t.documents.where("text is not null").select("doc_id", A.canonical(F.col("text")).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def safe_json(t):
    k = F.col("event_id") % 5
    fence = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    single = F.concat(F.lit("answer "), F.replace("props", F.lit('"'), F.lit("'")))
    comma = F.concat(F.regexp_replace("props", r"\}$", ", /* last */ }"), F.lit(""))
    said = F.when(k == 0, F.col("props")).when(k == 1, fence).when(k == 2, single).when(k == 3, comma).otherwise("no answer")
    return t.events.select("event_id", A.parsed_json(said, "struct<k:bigint>")["k"].alias("k"))


@query("SELECT event_id, array_to_string(list_filter([event_type, ' Idle ', 'none', '', 'Unknown', 'pick'], lambda x: lower(trim(x)) NOT IN ('idle', 'none', 'unknown', '')), '|') AS kept FROM events")
def clean_subtasks(t):
    arr = F.array(F.col("event_type"), *map(F.lit, [" Idle ", "none", "", "Unknown", "pick"]))
    return t.events.select("event_id", F.array_join(A.clean_subtasks(arr), "|").alias("kept"))


@query(f"WITH {EV}, s AS (SELECT traj, list(prim ORDER BY t)[1:3] AS plan FROM ev GROUP BY traj) SELECT traj, unnest(['image', 'image', 'text', 'text', 'goal_image', 'action']) AS type, unnest([0, 0, 0, 1, 1, 1]) AS has_loss, unnest([0, 1, 2, 3, 4, 5]) AS pos, unnest([NULL, NULL, 'do ' || plan[1], array_to_string(plan, ', '), NULL, NULL]) AS text FROM s")
def episode_elements(t):
    from kinetrail.functions import text as T

    plan = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("t", "prim"))), lambda r: r["prim"]), 1, 3)
    s = V.traj_events(t.events).groupBy("traj").agg(plan.alias("plan"))
    return s.select("traj", F.posexplode(T.episode_elements(2, F.concat(F.lit("do "), F.col("plan")[0]), F.array_join("plan", ", "), True)).alias("pos", "e")).select("traj", "pos", "e.type", "e.has_loss", "e.text")


@query(f"WITH {EV}, m AS (SELECT traj, t, lower(prim) AS l, lag(a) OVER (PARTITION BY traj ORDER BY t) AS p FROM ev) SELECT traj, t, 0 AS part, 'human' AS role, 'step ' || t || ': ' || l AS value FROM m UNION ALL SELECT traj, t, 1, 'gpt', '<action' || CAST(t % 256 AS VARCHAR) || '>' FROM m")
def multi_turn_dialog(t):
    e = V.traj_events(t.events)
    turns = F.array(F.struct(F.lit(0).alias("part"), F.lit("human").alias("role"), F.concat(F.lit("step "), F.col("t"), F.lit(": "), F.lower("prim")).alias("value")), F.struct(F.lit(1).alias("part"), F.lit("gpt").alias("role"), F.concat(F.lit("<action"), F.col("t") % 256, F.lit(">")).alias("value")))
    return e.select("traj", "t", F.explode(turns).alias("x")).select("traj", "t", "x.part", "x.role", "x.value")


@query(f"WITH {EV}, u AS (SELECT traj, t, a, {lcg_sql('event_id', 21)} / 2147483648.0::DOUBLE AS tt, g FROM ev) SELECT traj, t, round(s, 6) AS s, round((1 - s) * a + s * g, 6) AS mixed, round(g - a, 6) AS target FROM (SELECT *, 3 * sg / (1 + 2 * sg) AS s FROM (SELECT *, 1 / (1 + exp(-(4 * tt - 2))) AS sg FROM u))")
def flow_mix(t):
    from kinetrail.functions.actions import flow

    e = V.traj_events(t.events).withColumn("raw", 4 * lcg("event_id", 21) / 2147483648.0 - 2)
    return e.select("traj", "t", *flow(F.col("raw"), F.col("a"), F.col("g"), 3.0))


@query(f"WITH {_PLAN} SELECT conv_id, item, {lcg_sql('conv_id * 131 + item', 2)} % 1000 < CASE type WHEN 'text' THEN 100 WHEN 'vit_image' THEN 400 ELSE 100 END AS dropped FROM pn WHERE enable_cfg = 1")
def cfg_dropout(t):
    p = _plan(t).where("enable_cfg = 1")
    rate = F.when(F.col("type") == "vit_image", 400).otherwise(100)
    return p.select("conv_id", "item", (F.pmod(lcg(F.col("conv_id") * 131 + F.col("item"), 2), F.lit(1000)) < rate).alias("dropped"))
