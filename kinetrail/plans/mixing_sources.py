"""Queries on sources, splits, shards, mixtures, sampling and standardisation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinetrail.operators import mixtures as X, standardize as Z, views as V
from kinetrail.operators.views import TRAJ_EVENTS, TRAJ_ORDER, lcg, lcg_sql
from kinetrail.plans.registry import query

EV, LO = TRAJ_EVENTS, TRAJ_ORDER


@query("SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= round(0.95 * count(*) OVER (PARTITION BY source)) THEN 'train' ELSE 'val' END AS split FROM documents")
def split_95_5(t):
    return X.split_boundary(t.documents, "source", "doc_id").select("doc_id", "source", "split")


_PATHS = "pt AS (SELECT doc_id, '/data/' || source || '/ep_' || doc_id || '.tar' AS path, '/data/' || source AS dir FROM documents)"


def _paths(t):
    d = F.concat(F.lit("/data/"), "source")
    return t.documents.select("doc_id", F.concat(d, F.lit("/ep_"), "doc_id", F.lit(".tar")).alias("path"), d.alias("dir"))


@query(f"WITH {_PATHS} SELECT dir, path FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS r FROM pt) WHERE r <= 5")
def topn_files(t):
    return X.first_n(_paths(t), ["dir"], "path", 5).select("dir", "path")


@query("SELECT host, url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url, page_id) AS r FROM (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS host FROM pages)) WHERE r <= 3")
def recursive_topn(t):
    df = t.pages.select("page_id", "url", F.regexp_extract("url", "://([^/]*)", 1).alias("host")).withColumn("o", F.struct("url", "page_id"))
    return X.first_n(df, ["host"], "o", 3).select("host", "url")


_RANK = "rk AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


def _ranked(t):
    w = Window.partitionBy("lang")
    return t.documents.select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("r"), F.count("*").over(w).alias("n"))


@query(f"WITH {_RANK}, p AS (SELECT *, n // 3 AS per, (n // 3) // 2 AS mine FROM rk), q AS (SELECT *, r - (r // per) * per AS inside FROM p) SELECT doc_id, CASE WHEN r < per * 3 AND inside < mine * 2 THEN CAST((r // per) * 2 + inside // mine AS BIGINT) END AS shard FROM q")
def shard_contiguous(t):
    return _ranked(t).select("doc_id", X.contiguous_shard(F.col("r"), F.col("n"), 3, 2).alias("shard"))


@query(f"WITH {_RANK} SELECT doc_id, r % 6 AS shard FROM rk")
def shard_stride(t):
    return _ranked(t).select("doc_id", (F.col("r") % 6).cast("long").alias("shard"))


_MIX = """mx AS (SELECT c_nationkey % 15 AS name, min(c_custkey) AS pos, count(*) AS size, CASE WHEN c_nationkey % 15 % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS raw FROM customer GROUP BY c_nationkey % 15),
nm AS (SELECT *, raw * size / sum(raw * size) OVER () AS norm FROM mx)"""


def _mixture(t):
    key = F.col("c_nationkey") % 15
    df = t.customer.groupBy(key.alias("name")).agg(F.min("c_custkey").alias("pos"), F.count("*").alias("size"))
    return X.mixture_weights(df.withColumn("raw", F.when(F.col("name") % 3 == 0, 1.0).otherwise(0.5)), "raw", "size")


@query(f"WITH {_MIX} SELECT name, size, raw, round(norm, 6) AS norm FROM nm")
def mixture_weights(t):
    return _mixture(t).select("name", "size", "raw", F.round("norm", 6).alias("norm"))


@query(f"WITH {_MIX} SELECT CAST(floor(max(CASE WHEN raw = 1.0 THEN size / norm END)) AS BIGINT) AS epoch FROM nm")
def epoch_length(t):
    return X.epoch_length(_mixture(t), "raw", "size", "norm")


@query("SELECT name, pos FROM (SELECT c_nationkey % 15 AS name, c_custkey AS pos, row_number() OVER (PARTITION BY c_nationkey % 15 ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def mixture_dedupe(t):
    return X.first_of_name(t.customer.select((F.col("c_nationkey") % 15).alias("name"), F.col("c_custkey").alias("pos")), "name", "pos")


@query(f"""WITH m AS (SELECT n_nationkey, n_nationkey % 4 + 1 AS w FROM nation), c AS (SELECT n_nationkey, sum(w) OVER (ORDER BY n_nationkey) AS hi, sum(w) OVER (ORDER BY n_nationkey) - w AS lo, sum(w) OVER () AS total FROM m),
d AS (SELECT o_orderkey, {lcg_sql('o_orderkey', 4)} / 2147483648.0::DOUBLE AS u FROM orders) SELECT o_orderkey, n_nationkey FROM d JOIN c ON u * total >= lo AND u * total < hi""")
def weighted_choice(t):
    m = t.nation.select("n_nationkey", (F.col("n_nationkey") % 4 + 1).cast("double").alias("w"))
    d = t.orders.select("o_orderkey", (lcg("o_orderkey", 4) / 2147483648.0).alias("u"))
    return X.choose(m, d, "n_nationkey", "w", "u").select("o_orderkey", "n_nationkey")


def _rows(expr: str) -> str:
    return f"SELECT n_nationkey, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS frame FROM (SELECT n_nationkey, {expr} AS x FROM nation)"


def _exploded(t, arr):
    return t.nation.select("n_nationkey", F.posexplode(arr).alias("i", "frame")).select("n_nationkey", F.col("i").cast("long").alias("i"), F.col("frame").cast("long").alias("frame"))


_N = "(n_nationkey * 13 % 40 + 1)"


@query(f"SELECT n_nationkey, i, CAST(frame AS BIGINT) AS frame FROM ({_rows(f'list_transform(range(8), lambda i: floor((floor(least(i, least(8, {_N}) - 1) * {_N}::DOUBLE / least(8, {_N})) + floor((least(i, least(8, {_N}) - 1) + 1) * {_N}::DOUBLE / least(8, {_N})) - 1) / 2))')})")
def frame_middle(t):
    return _exploded(t, X.middle(8, (F.col("n_nationkey") * 13 % 40 + 1).cast("int")))


@query(f"SELECT n_nationkey, i, CAST(frame AS BIGINT) AS frame FROM ({_rows(f'list_filter(list_transform(range(CAST(floor({_N} / 10.0 * 2) AS BIGINT) + 1), lambda k: round_even((k + 0.5) * 0.5 * 10, 0)), lambda f: f < {_N})')})")
def frame_fps(t):
    return _exploded(t, X.at_rate(2.0, (F.col("n_nationkey") * 13 % 40 + 1).cast("int"), F.lit(10.0)))


@query(f"SELECT n_nationkey, i, CAST(frame AS BIGINT) AS frame FROM ({_rows(f'list_transform(range(16), lambda i: floor(i * ({_N} - 1) / 15.0::DOUBLE))')})")
def frame_even(t):
    return _exploded(t, X.evenly(16, (F.col("n_nationkey") * 13 % 40 + 1).cast("int")))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE CAST(vec_id AS INT) END AS number FROM embeddings")
def frame_suffix_sort(t):
    path = F.when(F.col("vec_id") % 5 == 0, F.concat(F.lit("/f/img"), "vec_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("/f/img_"), "vec_id", F.lit(".jpg")))
    return t.embeddings.select("vec_id", X.frame_number(path).alias("number")).orderBy("number")


@query("SELECT event_id, CAST(event_id AS INT) AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events")
def frame_numeric_sort(t):
    w = Window.partitionBy("user_id").orderBy(F.col("f").cast("int"))
    return t.events.withColumn("f", F.col("event_id").cast("string")).select("event_id", F.col("f").cast("int").alias("frame"), F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT page_id, CASE WHEN url LIKE '%/' THEN 'folder' ELSE 'video' END AS reader FROM pages")
def sampler_dispatch(t):
    return t.pages.select("page_id", F.when(F.col("url").endswith("/"), "folder").otherwise("video").alias("reader"))


@query(f"WITH {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS r, count(*) OVER (PARTITION BY dir) AS n FROM pt) SELECT dir, path, CAST(k AS BIGINT) AS k FROM r, range(4) x(k) WHERE k * n + r <= 120")
def repeat_paths(t):
    w = Window.partitionBy("dir")
    df = _paths(t).withColumn("r", F.row_number().over(w.orderBy("path"))).withColumn("n", F.count("*").over(w)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    return df.where("k * n + r <= 120").select("dir", "path", "k")


@query("SELECT event_id, 'a ' || event_type AS first, 'a ' || event_type || ' ,or , the ' || event_type AS joined FROM events")
def instruction_pick(t):
    seen = F.array(F.concat(F.lit("a "), "event_type"), F.concat(F.lit("the "), "event_type"))
    return t.events.select("event_id", F.element_at(seen, 1).alias("first"), F.array_join(seen, " ,or , ").alias("joined"))


@query("SELECT source, count(*) AS len FROM documents GROUP BY source")
def episode_lengths(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("len"))


@query("SELECT doc_id, concat_ws('/', '/videos', doc_id::VARCHAR) || '.webm' AS video, lang AS label FROM documents ORDER BY doc_id LIMIT 50")
def label_video_paths(t):
    """The first n of a labelled list: the limit is the operator's own parameter."""
    return t.documents.orderBy("doc_id").limit(50).select("doc_id", F.concat(F.concat_ws("/", F.lit("/videos"), "doc_id"), F.lit(".webm")).alias("video"), F.col("lang").alias("label"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def head_n(t):
    """head-n of a stream: the limit is the operator's own parameter."""
    return t.events.orderBy("ts", "event_id").limit(100).select("event_id", "ts")


@query("SELECT * FROM (VALUES (0, 0, 4::BIGINT), (0, 1, 2), (0, 2, 1), (0, 3, 1), (1, 0, 2), (1, 1, 2), (1, 2, 1)) v(mix, pos, threads)")
def thread_allocation(t):
    rows = [(m, i, k) for m, (n, w) in enumerate([(8, [0.6, 0.3, 0.05, 0.05]), (5, [0.5, 0.3, 0.2])]) for i, k in enumerate(X.allocate(n, w))]
    return t.spark.createDataFrame(rows, "mix int, pos int, threads long")


@query("SELECT doc_id AS id, 'documents' AS source, text AS value FROM documents UNION ALL SELECT item_id, 'benchmark', text FROM benchmark")
def union_sources(t):
    a = t.documents.select(F.col("doc_id").alias("id"), F.lit("documents").alias("source"), F.col("text").alias("value"))
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), F.col("text").alias("value")), allowMissingColumns=True)


@query("SELECT n_nationkey, array_to_string(list_filter(['observation', 'action', 'language'], lambda x: NOT list_contains(CASE n_nationkey % 3 WHEN 0 THEN ['action'] WHEN 1 THEN ['action', 'observation'] ELSE ['action', 'language', 'observation'] END, x)), ',') AS missing FROM nation")
def missing_keys(t):
    k = F.col("n_nationkey") % 3
    have = F.when(k == 0, F.array(F.lit("action"))).when(k == 1, F.array(F.lit("action"), F.lit("observation"))).otherwise(F.array(F.lit("action"), F.lit("language"), F.lit("observation")))
    return t.nation.select("n_nationkey", F.array_join(F.array_except(F.array(F.lit("observation"), F.lit("action"), F.lit("language")), have), ",").alias("missing"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'image,language' ELSE 'language' END AS keys FROM nation")
def key_union(t):
    keys = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("image"))).otherwise(F.array(F.lit("language")))
    return t.nation.select("n_nationkey", F.array_join(F.array_union(keys, F.array(F.lit("language"))), ",").alias("keys"))


@query("SELECT n_nationkey, CAST(e AS BIGINT) AS epoch FROM nation, range(3) x(e)")
def repeat_epochs(t):
    return t.nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("epoch"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE length(d.text) > 0")
def sidecar_inner(t):
    """Episodes whose sidecar is there and not empty."""
    return t.documents.where(F.length("text") > 0).join(t.labels, "doc_id").select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_done_anti(t):
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, p.page_id FROM documents d JOIN pages p ON p.url IS NOT NULL AND CAST(regexp_extract(p.url, '/([0-9]+)', 1) AS BIGINT) = d.doc_id WHERE regexp_extract(p.url, '/([0-9]+)', 1) <> ''")
def basename_join(t):
    p = t.pages.select("page_id", F.regexp_extract("url", r"/([0-9]+)", 1).alias("stem")).where("stem <> ''").select("page_id", F.col("stem").cast("long").alias("doc_id"))
    return t.documents.select("doc_id").join(p, "doc_id")


@query("SELECT n_nationkey, n_name, CASE n_nationkey % 4 WHEN 0 THEN 'EEF_POS' WHEN 1 THEN 'EEF_R6' END AS encoding, n_nationkey % 4 > 1 AS skipped FROM nation")
def supported_encodings(t):
    k = F.col("n_nationkey") % 4
    enc = F.when(k == 0, "EEF_POS").when(k == 1, "EEF_R6").when(k == 2, "JOINT_POS").otherwise("JOINT_POS_BIMANUAL")
    ok = enc.isin("EEF_POS", "EEF_R6")
    return t.nation.select("n_nationkey", "n_name", F.when(ok, enc).alias("encoding"), (~ok).alias("skipped"))


@query("SELECT n_nationkey, generate_subscripts(m, 1) - 1 AS dim, unnest(m) AS absolute FROM (SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN [false, false, false, false, false, false, true] ELSE [false, false, false, false, false, false, false, false, false, true] END AS m FROM nation)")
def encoding_masks(t):
    mask = F.when(F.col("n_nationkey") % 2 == 0, F.array(*[F.lit(False)] * 6, F.lit(True))).otherwise(F.array(*[F.lit(False)] * 9, F.lit(True)))
    return t.nation.select("n_nationkey", F.posexplode(mask).alias("dim", "absolute")).withColumn("dim", F.col("dim").cast("long"))


@query("SELECT c_custkey, c_acctbal AS primary_state, c_nationkey AS wrist_state FROM customer")
def camera_select(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").alias("primary_state"), F.col("c_nationkey").alias("wrist_state"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 40 >= 16")
def min_frames(t):
    return t.embeddings.where(F.col("vec_id") % 40 >= 16).select("vec_id", "label")


@query("SELECT n_nationkey, generate_subscripts(x, 1) - 1 AS slot, unnest(x) AS value FROM (SELECT n_nationkey, list_transform(range(128), lambda i: CASE i WHEN 0 THEN n_nationkey::DOUBLE WHEN 10 THEN n_regionkey::DOUBLE ELSE 0.0 END) AS x FROM nation)")
def state_vector(t):
    """A 128-slot state from named readings; slots without a reading are 0."""
    values = F.create_map(F.lit(0), F.col("n_nationkey").cast("double"), F.lit(10), F.col("n_regionkey").cast("double"))
    x = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.element_at(values, i), F.lit(0.0)))
    return t.nation.select("n_nationkey", F.posexplode(x).alias("slot", "value")).withColumn("slot", F.col("slot").cast("long"))


def _std(t, name: str, source):
    df = Z.standardize(source, Z.SPECS[name])
    return df.select("traj", "t", F.posexplode("action").alias("dim", "v")).select("traj", "t", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


def _wide(t):
    """Seven-wide actions and states over the order view."""
    v = lambda *c: F.array(*(F.col(x) for x in c))
    return V.traj_order(t.lineitem).select("traj", "t", v("q", "d", "x", "d", "x", "q", "x").alias("action"), v("q", "d", "x", "d", "x", "q", "d").alias("state"), v("q", "d", "x").alias("world_vector"), v("x", "d", "q").alias("rotation_delta"), F.array(F.col("d") - 0.05).alias("gripper_closedness_action"), F.lit("pick").alias("natural_language_instruction"))


def _sql7(cells: list[str], source: str = "lo") -> str:
    return f"SELECT traj, t, generate_subscripts(x, 1) - 1 AS dim, round(unnest(x), 6) AS v FROM (SELECT traj, t, [{', '.join(cells)}] AS x FROM {source})"


_CI = "1 - greatest(0, least(1, x))"


@query(f"WITH {LO} {_sql7(['q', 'd', 'x', 'd', 'x', 'q', '1 - x'])}")
def std_concat_invert(t):
    return _std(t, "dlr_edan_shared_control", _wide(t))


@query(f"WITH {LO} {_sql7(['q', 'd', 'x', 'd', 'x', 'q', _CI])}")
def std_clip_invert(t):
    return _std(t, "austin_sailor", _wide(t))


@query(f"WITH {LO} {_sql7(['q', 'd', 'x', '0.0', '0.0', '0.0', 'x'])}")
def std_pad_zeros(t):
    return _std(t, "ucsd_pick_place", _wide(t))


@query(f"WITH {LO} {_sql7(['q', 'd', 'x', 'd', 'x', 'q'])}")
def std_slice_tail(t):
    return _std(t, "cmu_franka_exploration", _wide(t))


@query(f"""WITH {LO}, g AS (SELECT *, CASE WHEN x > 0.95 THEN 1.0 WHEN x < 0.05 THEN 0.0 END AS f FROM lo WHERE t > 0),
b AS (SELECT *, coalesce(first_value(f IGNORE NULLS) OVER w, last_value(x) OVER w) AS gr FROM g WINDOW w AS (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
n AS (SELECT traj, t - 1 AS t, gr, q, d, x, lead(q) OVER w AS nq, lead(d) OVER w AS nd, lead(x) OVER w AS nx FROM b WINDOW w AS (PARTITION BY traj ORDER BY t))
{_sql7(['nq - q', 'nd - d', 'nx - x', 'nd - d', 'nx - x', 'nq - q', 'gr'], '(SELECT * FROM n WHERE nq IS NOT NULL)')}""")
def std_drop_binarize_relabel(t):
    return _std(t, "bridge_orig", _wide(t))


@query(f"""WITH {LO}, m AS (SELECT *, CASE WHEN d - 0.05 < -0.1 THEN 1.0 WHEN d - 0.05 > 0.1 THEN -1.0 END AS mv FROM lo),
g AS (SELECT *, coalesce(last_value(mv IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -first_value(mv IGNORE NULLS) OVER (PARTITION BY traj ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) / 2 + 0.5 AS gr FROM m)
{_sql7(['q', 'd', 'x', 'x', 'd', 'q', 'gr'], 'g')}""")
def std_rel2abs_concat(t):
    return _std(t, "rt1", _wide(t))
