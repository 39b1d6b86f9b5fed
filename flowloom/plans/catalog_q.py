"""Queries for the operators of the engine itself, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.labels import CLASSES, LABEL_WORDS, MARKS, canonical_label, label_id
from flowloom.operators import features as ft
from flowloom.operators import graph, learning, metrics, reports, sampling, vector
from flowloom.operators.balanced import balanced_agg, balanced_last, balanced_running
from flowloom.session import checkpointed, table
from flowloom.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ev(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


def ev_seconds(s: SparkSession, d: str) -> DataFrame:
    return ev(s, d).withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))


def edges(s: SparkSession, d: str) -> DataFrame:
    """Distinct temporal edges with the largest weight of their repeats."""
    return table(s, d, "phase3a_temporal").where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def fused(s: SparkSession, d: str) -> DataFrame:
    sim = table(s, d, "phase3_final").where("edge_type_id = 1 and weight is not null")
    return graph.fuse(table(s, d, "phase3a_temporal").where("weight is not null"), sim)


def nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "phase2_sampled_500k").select("node_id", F.coalesce(F.col("label_multiclass"), F.lit(15)).alias("y"), F.coalesce(F.col("label_binary"), F.lit(0)).cast("double").alias("x"))


T = "CAST(floor(epoch(ts)) AS BIGINT)"
EDGES = "SELECT src, dst, max(weight) AS weight FROM phase3a_temporal WHERE src <> dst GROUP BY src, dst"
FUSED = """SELECT src, dst, edge_type, edge_type_id, max(weight) AS weight FROM (
  SELECT src, dst, weight, 'temporal' AS edge_type, 0 AS edge_type_id FROM phase3a_temporal WHERE weight IS NOT NULL
  UNION ALL SELECT src, dst, weight * 0.25, 'similarity', 1 FROM phase3_final WHERE edge_type_id = 1 AND weight IS NOT NULL) WHERE src <> dst GROUP BY ALL"""
NODES = "SELECT node_id, coalesce(label_multiclass, 15) AS y, CAST(coalesce(label_binary, 0) AS DOUBLE) AS x FROM phase2_sampled_500k"
MD5 = "md5(CAST({k} AS VARCHAR) || ':{s}')"

# --- time-bucketed edges -------------------------------------------------------------------------------------------

RANKED = f"SELECT event_id AS id, t, b, row_number() OVER (PARTITION BY b ORDER BY t, id) AS rn FROM (SELECT event_id, event_id AS id, {T} AS t, CAST(floor({T} / 3600.0) AS BIGINT) AS b FROM events)"


@query(f"""WITH r AS ({RANKED})
SELECT l.id AS src, q.id AS dst, round(1.0 / (1.0 + (q.t - l.t)), 6) AS weight FROM r l JOIN r q ON l.b = q.b AND q.rn > l.rn AND q.rn <= l.rn + 8
WHERE q.t - l.t <= 600""")
def q_temporal_edges(s, d):
    e = graph.temporal_edges(ev_seconds(s, d), "event_id", F.col("t"), 3600, 600, 8, 0.0)
    return e.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH r AS ({RANKED}), x AS (SELECT *, unnest([b - 1, b, b + 1]) AS bb FROM r)
SELECT l.id AS src, q.id AS dst, round(max(1.0 / (1.0 + abs(q.t - l.t))), 6) AS weight FROM r l JOIN x q ON l.b = q.bb AND q.rn > l.rn AND q.rn <= l.rn + 8
WHERE abs(q.t - l.t) <= 3600 AND l.id <> q.id GROUP BY ALL""")
def q_temporal_cross(s, d):
    e = graph.temporal_edges_across(ev_seconds(s, d), "event_id", F.col("t"), 3600, 3600, 8, 0.0)
    return e.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {T} AS t FROM events)
SELECT a.event_id, b.event_id AS event_id2, b.t - a.t AS dt FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 1800 WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def q_interval_join(s, d):
    e = ev_seconds(s, d).select("event_id", "user_id", "event_type", "t")
    a, b = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return graph.interval_join(a, b, ["user_id"], "t", 1800).select("event_id", "event_id2", (F.col("t2") - F.col("t")).alias("dt"))


@query(f"SELECT CAST(floor({T} / 3600.0) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_time_bucket(s, d):
    e = ev_seconds(s, d).withColumn("bucket", F.floor(F.col("t") / 3600).cast("long"))
    return e.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH e AS ({EDGES}), r AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY weight DESC NULLS LAST, src) AS rn FROM e),
l AS (SELECT dst, list(src ORDER BY rn) AS q FROM r WHERE rn <= 7 GROUP BY dst)
SELECT node_id, array_to_string(list_concat(coalesce(q, []), list_transform(range(8 - coalesce(len(q), 0)), lambda x: node_id)), ',') AS sequence FROM phase2_sampled_500k n LEFT JOIN l ON n.node_id = l.dst""")
def q_temporal_sequence(s, d):
    return graph.temporal_sequences(edges(s, d), nodes(s, d)).select("node_id", F.concat_ws(",", F.col("sequence").cast("array<string>")).alias("sequence"))


# --- fusion, re-indexing, set operations ---------------------------------------------------------------------------


@query(f"SELECT src, dst, edge_type, edge_type_id, round(weight, 6) AS weight FROM ({FUSED})")
def q_fuse(s, d):
    return fused(s, d).withColumn("weight", F.round("weight", 6))


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM ({EDGES})")
def q_edge_dedupe(s, d):
    return edges(s, d).withColumn("weight", F.round("weight", 6))


@query("SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS node_idx FROM (SELECT DISTINCT node_id FROM phase2_sampled_500k)")
def q_dense_nodes(s, d):
    return graph.dense_nodes(nodes(s, d))


@query(f"""WITH m AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM (SELECT DISTINCT node_id FROM phase2_sampled_500k))
SELECT a.i AS src_idx, b.i AS dst_idx, e.edge_type_id, round(e.weight, 6) AS weight FROM ({FUSED}) e JOIN m a ON e.src = a.node_id JOIN m b ON e.dst = b.node_id""")
def q_dense_edges(s, d):
    return graph.dense_edges(fused(s, d), graph.dense_nodes(nodes(s, d))).select("src_idx", "dst_idx", "edge_type_id", F.round("weight", 6).alias("weight"))


@query(f"SELECT src, dst, edge_type_id FROM ({FUSED}) e WHERE NOT EXISTS (SELECT 1 FROM phase2_sampled_500k n WHERE n.node_id = e.dst)")
def q_dangling_edges(s, d):
    return fused(s, d).join(nodes(s, d).select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst", "edge_type_id")


@query("SELECT node_id, attack_type FROM phase2_sampled_500k n WHERE EXISTS (SELECT 1 FROM phase3a_temporal e WHERE e.src = n.node_id)")
def q_semi(s, d):
    n = table(s, d, "phase2_sampled_500k").select("node_id", "attack_type")
    return n.join(table(s, d, "phase3a_temporal").select(F.col("src").alias("node_id")), "node_id", "left_semi")


@query("SELECT src, dst FROM phase3a_temporal INTERSECT SELECT src, dst FROM phase3_final WHERE edge_type_id = 0")
def q_edge_overlap(s, d):
    return table(s, d, "phase3a_temporal").select("src", "dst").intersect(table(s, d, "phase3_final").where("edge_type_id = 0").select("src", "dst"))


@query("SELECT src, dst, weight FROM phase3a_temporal EXCEPT ALL SELECT src, dst, weight FROM phase3_final WHERE edge_type_id = 0")
def q_edge_except(s, d):
    return table(s, d, "phase3a_temporal").select("src", "dst", "weight").exceptAll(table(s, d, "phase3_final").where("edge_type_id = 0").select("src", "dst", "weight"))


@query(f"SELECT src, dst, 0 AS edge_type_id, round(weight, 6) AS weight FROM ({FUSED}) WHERE edge_type_id = 1")
def q_relation_ablation(s, d):
    return fused(s, d).where("edge_type_id = 1").select("src", "dst", F.lit(0).alias("edge_type_id"), F.round("weight", 6).alias("weight"))


# --- structure -----------------------------------------------------------------------------------------------------

DEGREES = f"""SELECT n.node_id, n.y, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.c, 0) + coalesce(i.c, 0) AS BIGINT) AS degree
FROM ({NODES}) n LEFT JOIN (SELECT src, count(*) AS c FROM ({EDGES}) GROUP BY src) o ON n.node_id = o.src LEFT JOIN (SELECT dst, count(*) AS c FROM ({EDGES}) GROUP BY dst) i ON n.node_id = i.dst"""


@query(f"""SELECT count(*) AS nodes, round(avg(degree), 6) AS avg_degree, max(out_degree) AS max_out, max(in_degree) AS max_in, CAST(count(*) FILTER (degree = 0) AS BIGINT) AS isolated,
round((SELECT count(*) FROM ({EDGES})) / CAST(count(*) AS DOUBLE), 6) AS edges_per_node FROM ({DEGREES})""")
def q_degree_stats(s, d):
    g = graph.degrees(nodes(s, d), edges(s, d)).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), F.count_if(F.col("degree") == 0).alias("isolated"))
    return g.withColumn("edges_per_node", F.round(F.try_divide(edges(s, d).agg(F.count("*")).scalar(), F.col("nodes")), 6))


BINS = [0, 1, 2, 5, 10, 20, 50, 100]


@query(f"SELECT CASE {' '.join(f'WHEN degree >= {b} THEN {b}' for b in reversed(BINS))} END AS bin_from, count(*) AS n FROM ({DEGREES}) GROUP BY 1")
def q_degree_histogram(s, d):
    c = None
    for b in reversed(BINS):
        c = F.when(F.col("degree") >= b, b) if c is None else c.when(F.col("degree") >= b, b)
    return graph.degrees(nodes(s, d), edges(s, d)).groupBy(c.alias("bin_from")).agg(F.count("*").alias("n"))


@query(f"""SELECT edge_type_id, count(*) AS edges, round(avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END), 6) AS homophily
FROM ({FUSED}) e JOIN ({NODES}) a ON e.src = a.node_id JOIN ({NODES}) b ON e.dst = b.node_id GROUP BY ROLLUP (edge_type_id)""")
def q_homophily(s, d):
    return graph.homophily(fused(s, d), nodes(s, d).select("node_id", "y"))


@query(f"SELECT y, count(*) AS n, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, median(degree) AS median_degree FROM ({DEGREES}) GROUP BY y")
def q_class_degree(s, d):
    g = graph.degrees(nodes(s, d), edges(s, d)).join(nodes(s, d).select("node_id", "y"), "node_id")
    return g.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"))


@query(f"SELECT CAST(count(*) FILTER (edge_type_id = 0) AS BIGINT) AS temporal, CAST(count(*) FILTER (edge_type_id = 1) AS BIGINT) AS similarity FROM ({FUSED})")
def q_relation_counts(s, d):
    return fused(s, d).agg(F.count_if(F.col("edge_type_id") == 0).alias("temporal"), F.count_if(F.col("edge_type_id") == 1).alias("similarity"))


NORM = f"""WITH n AS ({NODES}), e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM ({FUSED}) WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)
UNION ALL SELECT node_id, node_id FROM n) GROUP BY ALL), g AS (SELECT src, 1.0 / sqrt(CAST(sum(n) AS DOUBLE)) AS r FROM e GROUP BY src),
a AS (SELECT e.src, e.dst, e.n * p.r * q.r AS w FROM e JOIN g p ON e.src = p.src JOIN g q ON e.dst = q.src)"""


@query(NORM + " SELECT src, dst, round(w, 6) AS w FROM a")
def q_sym_norm(s, d):
    return graph.symmetric_norm(nodes(s, d), fused(s, d)).withColumn("w", F.round("w", 6))


def _sign(s, d, hops):
    n = nodes(s, d).select("node_id", "x")
    out = graph.diffuse(graph.symmetric_norm(nodes(s, d), fused(s, d)), n, ["x"], hops)
    return out.select("node_id", *[F.round(c, 5).alias(c) for c in out.columns if c != "node_id"])


H1 = NORM + ", h1 AS (SELECT a.src AS node_id, sum(w * x) AS x FROM a JOIN n ON a.dst = n.node_id GROUP BY a.src)"


@query(H1 + " SELECT n.node_id, round(n.x, 5) AS x, round(h1.x, 5) AS x_1 FROM n LEFT JOIN h1 ON n.node_id = h1.node_id")
def q_sign_hop1(s, d):
    return _sign(s, d, 1)


def flow_vectors(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", vector.clean_vector(F.col("features")).alias("features"))


VECTORS = "SELECT node_id, list_transform(features, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE CAST(x AS DOUBLE) END) AS v FROM phase2_sampled_500k"


def _hop_sql(k: int) -> str:
    return f"h{k} AS (SELECT a.src AS node_id, pos, sum(w * v) AS v FROM a JOIN h{k - 1} x ON a.dst = x.node_id GROUP BY a.src, pos)"


@query(NORM + f""", h0 AS (SELECT node_id, unnest(v) AS v, unnest(range(len(v))) AS pos FROM ({VECTORS})), {_hop_sql(1)}, {_hop_sql(2)}, {_hop_sql(3)},
u AS (SELECT 0 AS hop, * FROM h0 UNION ALL SELECT 1, node_id, v, pos FROM h1 UNION ALL SELECT 2, node_id, v, pos FROM h2 UNION ALL SELECT 3, node_id, v, pos FROM h3)
SELECT node_id, hop, round(sum(v), 3) + 0.0 AS total, round(sum(v * pos), 2) + 0.0 AS moment FROM u GROUP BY ALL""")
def q_sign(s, d):
    """[X, AX, A2X, A3X] of the 78 flow features; of each hop its sum and its sum by position."""
    x = graph.sign_features(graph.symmetric_norm(nodes(s, d), fused(s, d)), flow_vectors(s, d), "features", 3)
    e = x.select("node_id", F.posexplode("features").alias("at", "v")).withColumn("hop", F.floor(F.col("at") / 78).cast("int"))
    return e.groupBy("node_id", "hop").agg((F.round(F.sum("v"), 3) + 0.0).alias("total"), (F.round(F.sum(F.col("v") * (F.col("at") % 78)), 2) + 0.0).alias("moment"))


@query(NORM + """, x AS (SELECT node_id, x FROM n), g1 AS (SELECT a.src AS node_id, sum(w * x) AS x FROM a JOIN x ON a.dst = x.node_id GROUP BY 1), g2 AS (SELECT a.src AS node_id, sum(w * x) AS x FROM a JOIN g1 ON a.dst = g1.node_id GROUP BY 1)
SELECT n.node_id, round(n.x, 5) AS x, round(g1.x, 5) AS x_1, round(g2.x, 5) AS x_2 FROM n LEFT JOIN g1 USING (node_id) LEFT JOIN g2 USING (node_id)""")
def q_sign_label(s, d):
    return _sign(s, d, 2)


@query(f"""WITH m AS (SELECT edge_type_id, dst AS node_id, pos, sum(weight * x) / greatest(any_value(t), 1.0) AS x FROM (SELECT *, sum(weight) OVER (PARTITION BY edge_type_id, dst) AS t FROM ({FUSED}) e WHERE src IN (SELECT node_id FROM phase2_sampled_500k)) e
JOIN (SELECT node_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({VECTORS})) v ON e.src = v.node_id GROUP BY ALL)
SELECT edge_type_id, node_id, round(sum(x), 3) + 0.0 AS total, round(sum(x * pos), 2) + 0.0 AS moment FROM m GROUP BY ALL""")
def q_message_vectors(s, d):
    m = graph.gathered_messages(fused(s, d), flow_vectors(s, d), "features")
    e = m.select("edge_type_id", "node_id", F.posexplode("message").alias("pos", "x"))
    return e.groupBy("edge_type_id", "node_id").agg((F.round(F.sum("x"), 3) + 0.0).alias("total"), (F.round(F.sum(F.col("x") * F.col("pos")), 2) + 0.0).alias("moment"))


@query(f"SELECT edge_type_id, dst AS node_id, round(sum(weight * x) / greatest(sum(weight), 1.0) + 0.0000001, 5) AS message FROM ({FUSED}) e JOIN ({NODES}) n ON e.src = n.node_id GROUP BY ALL")
def q_message_pass(s, d):
    return graph.message_pass(fused(s, d), nodes(s, d), "x").withColumn("message", F.round(F.col("message") + 0.0000001, 5))


def _hop(h: int, frontier: str, n: int) -> str:
    return f"(SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY md5(concat_ws(':', src, dst, '{42 + h}')), src) AS r FROM e WHERE dst IN ({frontier})) WHERE r <= {n})"


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM ({EDGES})), h0 AS {_hop(0, "SELECT node_id FROM phase2_sampled_500k WHERE split = 'test'", 20)}, h1 AS {_hop(1, "SELECT src FROM h0", 15)}
SELECT 0 AS hop, src, dst FROM h0 UNION ALL SELECT 1, src, dst FROM h1""")
def q_neighbor_sample(s, d):
    seeds = table(s, d, "phase2_sampled_500k").where("split = 'test'").select("node_id")
    return graph.neighbour_sample(edges(s, d), seeds, [20, 15])


# --- vectors -------------------------------------------------------------------------------------------------------

EMB = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


@query(f"""WITH e AS ({EMB}), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p) WHERE r <= 3 AND weight >= 0.3""")
def q_knn_cosine(s, d):
    return vector.exact_knn(table(s, d, "embeddings"), "vec_id", "embedding", 3, threshold=0.3)


@query(f"""WITH e AS ({EMB}), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.v, b.v), 6) AS weight FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS r FROM p) WHERE r <= 5""")
def q_knn_l2(s, d):
    return vector.exact_knn(table(s, d, "embeddings"), "vec_id", "embedding", 5, metric="l2")


@query()
def q_knn_ivf(s, d):
    return vector.knn_ivf(table(s, d, "embeddings"), "vec_id", "embedding", 3, cells=16, probes=11, threshold=0.3)


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l1_of_unit FROM ({EMB})")
def q_l2_norm(s, d):
    u = vector.l2_normalised(vector.clean_vector(F.col("embedding")))
    return table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("l1_of_unit"))


CLEAN = "list_transform(features, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE CAST(x AS DOUBLE) END)"


@query(f"SELECT node_id, round(list_sum({CLEAN}), 4) AS total FROM phase2_sampled_500k")
def q_vector_clean(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", F.round(F.aggregate(vector.clean_vector(F.col("features")), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""SELECT count(*) AS n_rows, CAST(count(*) FILTER (features IS NULL) AS BIGINT) AS null_vectors, CAST(min(len(features)) AS INTEGER) AS min_size, CAST(max(len(features)) AS INTEGER) AS max_size,
CAST(sum(len(list_filter(features, lambda x: x IS NULL))) AS BIGINT) AS null_entries, CAST(sum(len(list_filter(features, lambda x: isnan(x)))) AS BIGINT) AS nan_entries, CAST(sum(len(list_filter(features, lambda x: isinf(x)))) AS BIGINT) AS inf_entries FROM phase2_sampled_500k""")
def q_vector_validation(s, d):
    return vector.vector_validation(table(s, d, "phase2_sampled_500k"), "features")


@query(f"SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, round(1.0 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS p FROM ({EMB})")
def q_softmax_argmax(s, d):
    v = vector.clean_vector(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", vector.argmax(v).alias("best"), F.round(F.array_max(vector.softmax(v)), 6).alias("p"))


@query("""SELECT label, pos, strength FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY strength DESC, pos) AS r FROM (
SELECT label, pos, round(avg(abs(x)), 6) AS strength FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY label, pos)) WHERE r <= 10""")
def q_top_features(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    g = e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.abs(F.col("x").cast("double"))), 6).alias("strength"))
    w = Window.partitionBy("label").orderBy(F.desc("strength"), "pos")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@query("SELECT node_id, label_multiclass, round(-pow(1 - p, 2.0) * ln(p), 6) AS loss FROM (SELECT node_id, label_multiclass, 0.05 + 0.9 * (node_id % 97) / 97.0 AS p FROM phase2_sampled_500k)")
def q_focal_loss(s, d):
    p = F.lit(0.05) + F.lit(0.9) * (F.col("node_id") % 97) / F.lit(97.0)
    return table(s, d, "phase2_sampled_500k").select("node_id", "label_multiclass", F.round(metrics.focal_loss(p), 6).alias("loss"))


@query()
def q_noise(s, d):
    return table(s, d, "events").select("event_id", (F.col("value") + 0.5 * F.randn(7)).alias("noisy"))


# --- labels, times, text -------------------------------------------------------------------------------------------

FOLD = "regexp_replace(translate(regexp_replace(lower(trim(attack_type)), '[^\\x00-\\x7F]', '', 'g'), '- /', '___'), '_+', '_', 'g')"
CANON = "CASE WHEN attack_type IS NULL THEN 'unknown' " + " ".join(f"WHEN contains({FOLD}, '{m}') THEN '{c}'" for m, c in MARKS) + " ELSE 'unknown' END"
IDS = "CASE c " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"


@query(f"SELECT node_id, {CANON} AS class FROM phase2_features")
def q_canonical_label(s, d):
    return table(s, d, "phase2_features").select("node_id", canonical_label(F.col("attack_type")).alias("class"))


@query(f"SELECT node_id, {IDS} AS class_id FROM (SELECT node_id, lower(trim(attack_type)) AS c FROM phase2_sampled_500k)")
def q_label_map(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", label_id(F.lower(F.trim("attack_type"))).alias("class_id"))


@query(f"SELECT node_id, CASE WHEN {CANON} = 'benign' THEN 0 ELSE 1 END AS label_binary FROM phase2_sampled_500k")
def q_binary_label(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", F.when(canonical_label(F.col("attack_type")) == "benign", 0).otherwise(1).alias("label_binary"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def q_label_encode(s, d):
    e = ev(s, d).select("event_id", "event_type")
    # ranks over distinct values only, then joined back
    codes = e.select("event_type").distinct().withColumn("k", F.lit(0))
    codes = balanced_running(codes, ["k"], ["event_type"], out="code").select("event_type", (F.col("code") - 1).alias("code"))
    return e.join(codes, "event_type").select("event_id", "code")


@query("SELECT node_id, trim(attack_type) AS attack_type, trim(event_time) AS event_time FROM phase2_features")
def q_trim(s, d):
    return ft.trim_strings(table(s, d, "phase2_features").select("node_id", "attack_type", "event_time"))


@query("""SELECT node_id, CAST(epoch_us(coalesce(try_strptime(trim(event_time), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(event_time), '%m/%d/%Y %H:%M'), try_strptime(trim(event_time), '%d/%m/%Y %H:%M:%S'))) AS BIGINT) AS us FROM phase2_sampled_500k""")
def q_ts_parse(s, d):
    formats = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy H:mm:ss"]
    return table(s, d, "phase2_sampled_500k").select("node_id", F.unix_micros(ft.parsed_time(F.col("event_time"), formats, iso=False)).alias("us"))


@query("""SELECT event_id, CAST(epoch_us(CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END) AS BIGINT) AS us FROM events WHERE day(ts) > 12""")
def q_ts_formats(s, d):
    """Event times written in the five formats, days above 12 so that each text has one reading, and read back."""
    e = ev(s, d).where(F.day("ts") > 12)
    styles = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss"]
    text = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.date_format("ts", f)) for i, f in enumerate(styles)])
    return e.select("event_id", F.unix_micros(ft.parsed_time(text)).alias("us"))


@query("SELECT node_id, 1700000000 + node_id % 86400 AS t FROM phase2_sampled_500k")
def q_synth_time(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", F.unix_timestamp(F.timestamp_seconds(F.lit(1700000000) + F.col("node_id") % 86400)).alias("t"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_props(s, d):
    return ev(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# --- numeric features and quality ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL OR isnan(q) THEN 0.0 WHEN isinf(q) THEN sign(q) * 1e6 ELSE q END AS q FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS q FROM lineitem)")
def q_clean_numeric(s, d):
    q = F.when(F.col("l_discount") == 0, float("nan")).when(F.col("l_tax") == 0, float("inf")).otherwise(F.col("l_quantity"))
    return ft.clean_numbers(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q")), ["q"])


@query("SELECT l_orderkey, l_linenumber, round(list_sum([l_discount, l_extendedprice, l_quantity, l_tax]), 4) AS total, 4 AS n FROM lineitem")
def q_assemble(s, d):
    a = ft.assembled(table(s, d, "lineitem"), ["l_discount", "l_extendedprice", "l_quantity", "l_tax"])
    return a.select("l_orderkey", "l_linenumber", F.round(F.aggregate("features", F.lit(0.0), lambda x, v: x + v), 4).alias("total"), F.size("features").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def q_std_scale(s, d):
    z = ft.std_scaled(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return z.withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'F')")
def q_zscore(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    return ft.zscored(li, li.where("l_linestatus = 'F'"), ["l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"))


@query("SELECT count(*) AS n_rows, CAST(count(*) FILTER (event_time IS NULL) AS BIGINT) AS n_null, round(count(*) FILTER (event_time IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM phase2_features")
def q_null_rate(s, d):
    return ft.null_rate(table(s, d, "phase2_features"), "event_time")


@query("SELECT count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes, count(DISTINCT label_multiclass) AS n_classes, max(label_multiclass) + 1 AS id_space, min(received_at)::VARCHAR IS NOT NULL AS has_time FROM phase2_features")
def q_profile(s, d):
    return table(s, d, "phase2_features").agg(F.count("*").alias("n_rows"), F.countDistinct("node_id").alias("n_nodes"), F.countDistinct("label_multiclass").alias("n_classes"), (F.max("label_multiclass") + 1).alias("id_space"), F.min("received_at").isNotNull().alias("has_time"))


# --- classes and samples -------------------------------------------------------------------------------------------


@query("SELECT node_id, attack_type FROM phase2_sampled_500k WHERE attack_type IN ('benign', 'ddos', 'dos_hulk', 'portscan')")
def q_class_filter(s, d):
    return table(s, d, "phase2_sampled_500k").where(F.col("attack_type").isin("benign", "ddos", "dos_hulk", "portscan")).select("node_id", "attack_type")


@query("SELECT attack_type, label_multiclass, label_binary, count(*) AS n FROM phase2_sampled_500k GROUP BY ALL")
def q_class_distribution(s, d):
    return balanced_agg(table(s, d, "phase2_sampled_500k").select("attack_type", "label_multiclass", "label_binary", "node_id"), ["attack_type", "label_multiclass", "label_binary"], ["node_id"], {"n": ("count", None)})


@query("""WITH c AS (SELECT v.label_multiclass, count(n.node_id) AS n FROM label_vocab v LEFT JOIN phase2_sampled_500k n USING (label_multiclass) GROUP BY 1),
w AS (SELECT *, sqrt((SELECT sum(n) FROM c) / (greatest(n, 1) * CAST((SELECT count(*) FROM c) AS DOUBLE))) AS weight FROM c)
SELECT label_multiclass, n, round(weight / (SELECT avg(weight) FROM w), 6) AS weight FROM w""")
def q_class_weights(s, d):
    n = table(s, d, "phase2_sampled_500k").groupBy("label_multiclass").agg(F.count("*").alias("n"))
    c = table(s, d, "label_vocab").select("label_multiclass").join(n, "label_multiclass", "left").fillna(0, ["n"])
    return ft.class_weights(c, "n", 0.5).withColumn("weight", F.round("weight", 6))


@query("SELECT attack_type, count(*) AS support FROM phase2_sampled_500k GROUP BY 1 HAVING count(*) < 10")
def q_rare_classes(s, d):
    return table(s, d, "phase2_sampled_500k").groupBy("attack_type").agg(F.count("*").alias("support")).where("support < 10")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def q_cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT event_type, arg_max(event_id, (value, event_id)) AS best, arg_min(event_id, (value, event_id)) AS worst FROM events GROUP BY 1")
def q_argmax(s, d):
    k = F.struct("value", "event_id")
    return ev(s, d).groupBy("event_type").agg(F.max_by("event_id", k).alias("best"), F.min_by("event_id", k).alias("worst"))


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {MD5.format(k='event_id', s=42)}, event_id) AS rn FROM events) WHERE rn <= CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 500 ELSE 2147483647 END")
def q_cap(s, d):
    return sampling.capped(ev(s, d).select("event_id", "event_type"), "event_type", "event_id", {"view": 50, "click": 500})


@query(f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), q AS (SELECT event_type, greatest(1, least(n, CAST(round_even(1000.0 * n / (SELECT sum(n) FROM c), 0) AS BIGINT))) AS quota FROM c)
SELECT event_id, r.event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {MD5.format(k='event_id', s=42)}, event_id) AS rn FROM events) r JOIN q ON r.event_type = q.event_type WHERE rn <= quota""")
def q_stratified_quota(s, d):
    return sampling.proportional(ev(s, d).select("event_id", "event_type"), "event_type", "event_id", 1000)


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {MD5.format(k='event_id', s=42)}, event_id) AS rn FROM events) WHERE rn <= 200")
def q_stratified_equal(s, d):
    return sampling.equal_per_group(ev(s, d).select("event_id", "event_type"), "event_type", "event_id", 1000, 5)


@query(f"""SELECT event_id, event_type, CASE WHEN n < 10 OR rn / CAST(n AS DOUBLE) <= 0.8 THEN 'train' WHEN rn / CAST(n AS DOUBLE) <= 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {MD5.format(k='event_id', s=42)}, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def q_split(s, d):
    return sampling.split(ev(s, d).select("event_id", "event_type"), "event_type", "event_id").select("event_id", "event_type", "split")


@query(f"SELECT event_id, value FROM events ORDER BY {MD5.format(k='event_id', s=42)}, event_id LIMIT 500")
def q_random_batch(s, d):
    return sampling.random_batch(ev(s, d).select("event_id", "value"), "event_id", 500)


@query(f"""WITH c AS (SELECT event_type, count(*) AS n, pow(count(*), 0.5) AS w FROM events GROUP BY 1), b AS (SELECT event_type, n, sum(w) OVER (ORDER BY event_type) / (SELECT sum(w) FROM c) AS hi FROM c),
d AS (SELECT range AS draw, CAST('0x' || substr(md5(range || ':42a'), 1, 8) AS BIGINT) / 4294967296.0 AS u, CAST('0x' || substr(md5(range || ':42b'), 1, 8) AS BIGINT) / 4294967296.0 AS v FROM range(2000)),
p AS (SELECT draw, v, (SELECT min(hi) FROM b WHERE hi > u) AS hi FROM d), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {MD5.format(k='event_id', s=42)}, event_id) AS rn FROM events)
SELECT draw, event_id, r.event_type FROM p JOIN b ON p.hi = b.hi JOIN r ON r.event_type = b.event_type AND r.rn = CAST(floor(v * b.n) AS BIGINT) + 1""")
def q_weighted_resample(s, d):
    return sampling.weighted_resample(ev(s, d).select("event_id", "event_type"), "event_type", "event_id", 0.5, 2000)


@query()
def q_sampleby(s, d):
    n = {r["event_type"]: r["n"] for r in ev(s, d).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    return ev(s, d).sampleBy("event_type", {k: min(1.0, 500 / v) for k, v in n.items()}, 42).select("event_id", "event_type")


# --- metrics -------------------------------------------------------------------------------------------------------

PRED = f"SELECT label_multiclass AS a, {IDS.replace('CASE c', 'CASE ' + CANON)} AS p FROM phase2_sampled_500k WHERE label_multiclass IS NOT NULL"


def predictions(s, d):
    return table(s, d, "phase2_sampled_500k").where("label_multiclass is not null").select(F.col("label_multiclass").alias("a"), label_id(canonical_label(F.col("attack_type"))).alias("p"))


REPORT = f"""WITH r AS ({PRED}), s AS (SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(sup) AS BIGINT) AS support FROM (
SELECT a AS cls, CASE WHEN a = p THEN 1 ELSE 0 END AS tp, 0 AS pred, 1 AS sup FROM r UNION ALL SELECT p, 0, 1, 0 FROM r) GROUP BY cls),
c AS (SELECT cls, round(CASE WHEN pred = 0 THEN 0 ELSE tp / CAST(pred AS DOUBLE) END, 6) AS "precision", round(CASE WHEN support = 0 THEN 0 ELSE tp / CAST(support AS DOUBLE) END, 6) AS recall, round(2.0 * tp / (pred + support), 6) AS f1, support FROM s)"""


@query(f"SELECT a AS actual, p AS predicted, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY a) AS DOUBLE), 6) AS row_share FROM ({PRED}) GROUP BY a, p")
def q_confusion(s, d):
    return metrics.confusion(predictions(s, d), "a", "p")


@query(REPORT + " SELECT * FROM c")
def q_class_report(s, d):
    return metrics.class_report(predictions(s, d), "a", "p")


@query(REPORT + " SELECT round(avg(f1), 5) AS macro_f1, (SELECT round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) FROM r) AS accuracy FROM c")
def q_macro_f1(s, d):
    return metrics.macro_f1(predictions(s, d), "a", "p")


@query(f"""SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision", round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT count(*) FILTER (a > 0 AND p > 0) AS tp, count(*) FILTER (a = 0 AND p > 0) AS fp, count(*) FILTER (a > 0 AND p = 0) AS fn FROM ({PRED}))""")
def q_binary_prf(s, d):
    return metrics.binary_prf(predictions(s, d), F.col("a") > 0, F.col("p") > 0)


ROC = """SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp, p, n
FROM (SELECT value AS score, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type <> 'purchase') AS n FROM events GROUP BY value)"""


@query(f"SELECT score, tp, fp FROM ({ROC})")
def q_roc(s, d):
    return metrics.roc_points(ev(s, d), F.col("event_type") == "purchase", "value").select("score", "tp", "fp")


@query(f"SELECT round(sum(n * (tp - p / 2.0)) / CAST(sum(p) * sum(n) AS DOUBLE), 6) AS auc FROM ({ROC})")
def q_auc(s, d):
    return metrics.auc(ev(s, d), F.col("event_type") == "purchase", "value")


@query("SELECT event_type, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def q_latency_percentiles(s, d):
    q = lambda p: F.percentile("value", F.lit(p))
    return ev(s, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query("SELECT event_type, round(CASE WHEN sum(value) = 0 THEN 0 ELSE count(*) / sum(value) END, 6) AS throughput FROM events GROUP BY 1")
def q_throughput(s, d):
    return ev(s, d).groupBy("event_type").agg(F.round(F.coalesce(F.try_divide(F.count("*"), F.sum("value")), F.lit(0.0)), 6).alias("throughput"))


# --- windows -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, round((value - first_value(value) OVER w) / first_value(value) OVER w * 100, 1) + 0.0 AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_pct_vs_first(s, d):
    # the first row of each user by a partial aggregate, joined back: no window over a hot user
    e = ev(s, d).select("event_id", "user_id", "value")
    # a missing id is the last
    first = e.groupBy(F.col("user_id").alias("u")).agg(F.min_by("value", F.coalesce("event_id", F.lit(2**63 - 1))).alias("f"))
    v, f = F.col("value"), F.col("f")
    # 0 ** -1 is infinite with the sign of the zero, where a division would be an error
    pct = F.when(f == 0, (v - f) * F.pow(f, F.lit(-1.0))).otherwise((v - f) / f * 100)
    return e.join(first, F.col("user_id").eqNullSafe(F.col("u"))).select("event_id", "user_id", F.round(pct, 1).alias("pct"))


@query("SELECT event_id, round(least(value / (SELECT max(value) FROM events), 1.0), 6) AS share FROM events")
def q_max_norm(s, d):
    return ev(s, d).select("event_id", F.round(F.least(F.col("value") / ev(s, d).agg(F.max("value")).scalar(), F.lit(1.0)), 6).alias("share"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 30")
def q_last_n(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return ev(s, d).select("event_id", "user_id").withColumn("r", F.row_number().over(w)).where("r <= 30").drop("r")


@query("SELECT l_orderkey, l_linenumber, round(least(10.0, greatest(0.0, l_extendedprice / greatest(l_quantity * 100, 0.001))) + 0.00000001, 6) AS ratio FROM lineitem")
def q_ratio_clip(s, d):
    r = F.col("l_extendedprice") / F.greatest(F.col("l_quantity") * 100, F.lit(0.001))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), r)) + 0.00000001, 6).alias("ratio"))


@query("""SELECT o_orderkey, o_custkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER u AS quartile, lag(o_totalprice) OVER u AS prev, lead(o_totalprice) OVER u AS next,
round(percent_rank() OVER w, 6) AS pr, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), u AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def q_rank_suite(s, d):
    w, u = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(s, d, "orders").select(
        "o_orderkey", "o_custkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("drk"), F.ntile(4).over(u).cast("long").alias("quartile"),
        F.lag("o_totalprice").over(u).alias("prev"), F.lead("o_totalprice").over(u).alias("next"), F.round(F.percent_rank().over(w), 6).alias("pr"),
        F.round(F.sum("o_totalprice").over(u.rowsBetween(-2, 0)), 2).alias("moving"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_topk(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS last_view FROM events a WHERE a.event_type = 'purchase'""")
def q_asof(s, d):
    # a view at the same time counts, so views come first; a hot user is spread over range partitions
    e = ev(s, d).where(F.col("event_type").isin("purchase", "view")).select("user_id", "ts", "event_id", "event_type")
    e = e.withColumn("late", F.col("event_type") == "purchase").withColumn("view", F.when(F.col("event_type") == "view", F.col("event_id")))
    return balanced_last(e, ["user_id"], ["ts", "late", "event_id"], "view", "last_view").where("event_type = 'purchase'").select("event_id", "last_view")


@query("SELECT n_nationkey, n_name, range AS replica_id FROM nation, range(5)")
def q_replicate(s, d):
    return ft.replicated(table(s, d, "nation").select("n_nationkey", "n_name"), 5)


@query("""SELECT event_type, unnest(['n', 'mean', 'max']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(avg(value), 6), max(value)]) AS metric_value FROM events GROUP BY event_type""")
def q_report_flatten(s, d):
    m = F.create_map(F.lit("n"), F.count("*").cast("double"), F.lit("mean"), F.round(F.avg("value"), 6), F.lit("max"), F.max("value"))
    return ev(s, d).groupBy("event_type").agg(m.alias("m")).select("event_type", F.explode("m").alias("metric", "metric_value"))


# --- streaming-type windows (batch form; the streaming form runs in the tests) --------------------------------------


@query(f"""WITH m AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM (SELECT DISTINCT node_id FROM phase2_sampled_500k)), e AS (SELECT least(a.i, b.i) AS lo, greatest(a.i, b.i) AS hi FROM ({EDGES}) e JOIN m a ON e.src = a.node_id JOIN m b ON e.dst = b.node_id),
s AS (SELECT range AS s FROM range((SELECT count(*) // 200 FROM m)))
SELECT s.s, (s.s + 1) * 200 AS processed, least((s.s + 1) * 200, 1000) AS active_nodes, count(e.lo) AS active_edges FROM s LEFT JOIN e ON e.hi < (s.s + 1) * 200 AND e.lo >= (s.s + 1) * 200 - 1000 GROUP BY s.s""")
def q_stream_count_window(s, d):
    m = graph.dense_nodes(nodes(s, d))
    return graph.count_window(graph.dense_edges(edges(s, d), m), m.withColumnRenamed("node_idx", "idx"), 200, 1000)


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_window_tumbling(s, d):
    w = windows.windowed_counts(ev(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", keys=("event_type",))
    return w.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("""SELECT start_us, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest(range(3)) AS k, epoch_us(ts) // 7200000000 AS b FROM events), LATERAL (SELECT CAST((b - k) * 7200000000 AS BIGINT) AS start_us) GROUP BY ALL""")
def q_window_sliding(s, d):
    w = windows.windowed_counts(ev(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "2 hours", value="value")
    return w.select(F.unix_micros("window_start").alias("start_us"), "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM g GROUP BY user_id, k""")
def q_window_session(s, d):
    w = windows.sessions(ev(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ("user_id",))
    return w.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


@query("SELECT event_id // 2000 AS batch, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_class_counts(s, d):
    return ev(s, d).groupBy(F.floor(F.col("event_id") / 2000).cast("long").alias("batch"), "event_type").agg(F.count("*").alias("n"))


# --- model arithmetic ----------------------------------------------------------------------------------------------

GATES = {0: 0.3, 1: 1.1}


@query(f"""WITH m AS (SELECT edge_type_id, dst AS node_id, sum(weight * x) / greatest(sum(weight), 1.0) AS message FROM ({FUSED}) e JOIN ({NODES}) n ON e.src = n.node_id GROUP BY ALL)
SELECT node_id, round(sum(message * exp(CASE edge_type_id WHEN 0 THEN 0.3 ELSE 1.1 END)) / (exp(0.3) + exp(1.1)) + 0.0000001, 5) AS message FROM m GROUP BY node_id""")
def q_relation_gate(s, d):
    m = graph.gated_messages(graph.message_pass(fused(s, d), nodes(s, d), "x"), GATES)
    return m.withColumn("message", F.round(F.col("message") + 0.0000001, 5))


@query(f"SELECT n.node_id, n.x + coalesce(s, 0) AS total FROM ({NODES}) n LEFT JOIN (SELECT dst, sum(m.x) AS s FROM ({EDGES}) e JOIN ({NODES}) m ON e.src = m.node_id GROUP BY dst) ON n.node_id = dst")
def q_sum_aggregate(s, d):
    return graph.sum_with_self(edges(s, d), nodes(s, d), "x")


@query(f"SELECT vec_id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) - v[label + 1], 6) AS loss FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def q_cross_entropy(s, d):
    v = vector.clean_vector(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(metrics.cross_entropy(v, F.col("label")), 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, list_transform(v, lambda x: x / 2) AS t, list_transform(list_reverse(v), lambda x: x / 2) AS s FROM e),
n AS (SELECT *, ln(list_sum(list_transform(t, lambda x: exp(x)))) AS lt, ln(list_sum(list_transform(s, lambda x: exp(x)))) AS ls FROM p)
SELECT vec_id, round(4 * list_sum(list_transform(list_zip(t, s), lambda q: exp(q[1] - lt) * ((q[1] - lt) - (q[2] - ls)))), 6) AS loss FROM n""")
def q_distillation_loss(s, d):
    v = vector.clean_vector(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(metrics.distillation_loss(F.reverse(v), v), 6).alias("loss"))


@query("SELECT node_id, CASE attack_type WHEN 'benign' THEN 0 WHEN 'portscan' THEN 2 WHEN 'bot' THEN 3 ELSE 1 END AS family FROM phase2_sampled_500k")
def q_label_remap(s, d):
    m = F.create_map(*[F.lit(x) for kv in {"benign": 0, "portscan": 2, "bot": 3}.items() for x in kv])
    return table(s, d, "phase2_sampled_500k").select("node_id", F.coalesce(m[F.coalesce("attack_type", F.lit(""))], F.lit(1)).alias("family"))


# --- learning (rows only: fitted models are not SQL) ----------------------------------------------------------------


@query()
def q_ml_baseline(s, d):
    """A forest on the flow vectors, fitted on the train split and scored on the test split."""
    n = table(s, d, "phase2_sampled_500k").select("node_id", "split", F.coalesce(F.col("label_multiclass"), F.lit(15)).cast("double").alias("label"), vector.clean_vector(F.col("features")).alias("v"))
    x = learning.with_vector(n, "v")
    train, test = x.where("split = 'train'"), x.where("split = 'test'")
    return learning.fit_and_score(train, test, learning.baseline("forest", 78, 16))[1]


@query()
def q_ml_pipeline(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    m = learning.feature_pipeline(["l_quantity", "l_discount", "l_tax"], scale=True).fit(li)
    return m.transform(li).select("l_orderkey", "l_linenumber", learning.vector_to_array("features").alias("features"))


@query()
def q_pca_2d(s, d):
    return learning.projected_2d(table(s, d, "embeddings"), "embedding", "vec_id")


@query()
def q_noise_sweep(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return learning.noise_sweep(e, "embedding", [i / 2 for i in range(11)])


def _labelled(s, d):
    return table(s, d, "phase2_sampled_500k").select("node_id", "split", F.coalesce(F.col("label_multiclass"), F.lit(15)).cast("double").alias("label"), vector.clean_vector(F.col("features")).alias("features"))


@query()
def q_noise_scores(s, d):
    """Macro-F1 of a forest on the test split under the eleven noise levels."""
    n = _labelled(s, d)
    model = learning.baseline("forest", 78, 16).fit(learning.with_vector(n.where("split = 'train'"), "features"))
    return learning.noise_scores(model, n.where("split = 'test'"), "features", "label", [i / 2 for i in range(11)])


@query()
def q_ml_student(s, d):
    """A perceptron on [X, AX, A2X, A3X], trained on class-weighted draws from the train split, scored on the test split."""
    x = graph.sign_features(graph.symmetric_norm(nodes(s, d), fused(s, d)), flow_vectors(s, d), "features", 3)
    n = checkpointed(_labelled(s, d).drop("features").join(x, "node_id"))
    train = learning.balanced_training_rows(n.where("split = 'train'"), "label", "node_id")
    student = learning.baseline("mlp", 312, 16)
    return learning.fit_and_score(learning.with_vector(train, "features"), learning.with_vector(n.where("split = 'test'"), "features"), student)[1]


@query()
def q_component_ablation(s, d):
    """Eight rows: a student on diffused features, with relations, hops, bypass or class weights taken away."""
    return learning.component_ablation(_labelled(s, d), fused(s, d).select("src", "dst", "edge_type_id"), 78, 16)


# --- reports, curves, groupings ------------------------------------------------------------------------------------

OVR = """SELECT vec_id, label, unnest(range(12)) AS cls, unnest(CAST(embedding AS DOUBLE[])[1:12]) AS score FROM embeddings"""
OVR_POINTS = f"""SELECT cls, score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, p, n, row_number() OVER w AS r, count(*) OVER (PARTITION BY cls) AS points
FROM (SELECT cls, score, count(*) FILTER (label = cls) AS p, count(*) FILTER (label <> cls) AS n FROM ({OVR}) GROUP BY cls, score) WINDOW w AS (PARTITION BY cls ORDER BY score DESC)"""


def _ovr(s, d):
    return table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("scores"))


@query(f"SELECT CAST(cls AS INTEGER) AS cls, CAST(sum(p) AS BIGINT) AS support, round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (tp - p / 2.0)) / CAST(sum(p) * sum(n) AS DOUBLE) END, 6) AS auc FROM ({OVR_POINTS}) GROUP BY cls")
def q_ovr_auc(s, d):
    """Twelve classes of which ten occur: the two without positives have no AUC."""
    return metrics.one_vs_rest_auc(_ovr(s, d), "label", "scores", 12)


@query(f"SELECT CAST(cls AS INTEGER) AS cls, score, tp, fp FROM ({OVR_POINTS}) WHERE (r - 1) % greatest(1, points // 200) = 0")
def q_ovr_curves(s, d):
    p = metrics.one_vs_rest_points(_ovr(s, d), "label", "scores", 12)
    return metrics.thinned_curve(p.withColumn("neg", -F.col("score")), ["cls"], ["neg"]).select("cls", "score", "tp", "fp")


BS = "CASE event_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 64 ELSE 512 END"


@query(f"""SELECT event_type || '_baseline' AS system, upper(event_type || ' Baseline') AS display_name, {BS} AS batch_size, round(quantile_cont(value, 0.5), 6) AS end_to_end_p50_ms, round(quantile_cont(value, 0.95), 6) AS end_to_end_p95_ms, round(quantile_cont(value, 0.99), 6) AS end_to_end_p99_ms,
round(avg(value), 6) AS throughput_nodes_per_sec, count(*) AS n FROM events GROUP BY ALL""")
def q_report_nested(s, d):
    """A report system -> bs_N -> metrics, built from events and flattened to rows; keys of another form are left out."""
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    size = F.when(F.col("event_id") % 3 == 0, "bs_16").when(F.col("event_id") % 3 == 1, "bs_64").otherwise("bs_512")
    m = F.struct(F.struct(q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms")).alias("end_to_end_latency"), F.round(F.avg("value"), 6).alias("throughput_nodes_per_sec"), F.count("*").alias("n"))
    per = ev(s, d).groupBy(F.concat("event_type", F.lit("_baseline")).alias("system"), size.alias("key")).agg(m.alias("m"))
    sizes = per.groupBy("system").agg(F.map_from_entries(F.concat(F.collect_list(F.struct("key", "m")), F.array(F.struct(F.lit("notes").alias("key"), F.first("m").alias("m"))))).alias("sizes"))
    report = sizes.agg(F.map_from_entries(F.collect_list(F.struct("system", "sizes"))).alias("report"))
    return reports.flattened_latency(report, "report", ["throughput_nodes_per_sec", "n"], ["p50_ms", "p95_ms", "p99_ms"])


@query(f"SELECT CAST(label_multiclass AS INTEGER) AS cls, CASE label_multiclass {' '.join(f'WHEN {i} THEN {chr(39)}{c}{chr(39)}' for i, c in enumerate(CLASSES))} END AS class_name, count(*) AS support, count(DISTINCT source) AS sources FROM phase2_sampled_500k WHERE label_multiclass IS NOT NULL GROUP BY ALL")
def q_report_classes(s, d):
    per = table(s, d, "phase2_sampled_500k").where("label_multiclass is not null").groupBy(F.col("label_multiclass").cast("string").alias("k")).agg(F.struct(F.count("*").alias("support"), F.countDistinct("source").alias("sources")).alias("m"))
    report = per.agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("report"))
    return reports.flattened_classes(report, "report", dict(enumerate(CLASSES)))


@query("""SELECT unnest(['nan_total', 'pos_inf_total', 'neg_inf_total', 'total_rows', 'vector_length', 'total_feature_values']) AS metric, unnest([
CAST(sum(len(list_filter(features, lambda x: isnan(x)))) AS BIGINT), CAST(sum(len(list_filter(features, lambda x: isinf(x) AND x > 0))) AS BIGINT), CAST(sum(len(list_filter(features, lambda x: isinf(x) AND x < 0))) AS BIGINT),
count(*), CAST(max(len(features)) AS BIGINT), CAST(sum(len(features)) AS BIGINT)]) AS value FROM phase2_sampled_500k""")
def q_validation_report(s, d):
    return vector.validation_report(table(s, d, "phase2_sampled_500k"), "features")


@query("SELECT pos, round(avg(abs(x)), 6) AS strength FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY pos ORDER BY strength DESC, pos LIMIT 20")
def q_top_features_global(s, d):
    e = table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    g = e.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.abs(F.col("x").cast("double"))), 6).alias("strength"))
    return g.orderBy(F.desc("strength"), "pos").limit(20)


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def q_grouping_sets(s, d):
    li = table(s, d, "lineitem")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")], []]
    return li.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def q_pivot(s, d):
    p = table(s, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).fillna(0)
    return p.toDF("l_linestatus", "a", "n", "r")


@query("SELECT node_id, 'fit' AS split FROM phase2_sampled_500k WHERE split IN ('train', 'val')")
def q_train_val(s, d):
    n = table(s, d, "phase2_sampled_500k").select("node_id", "split")
    return sampling.joined_splits(n, "split", ["train", "val"], "fit")


@query("SELECT vec_id, round(list_sum(list_transform(list_concat(list_transform(CAST(embedding AS DOUBLE[])[1:16], lambda x: x * 2), CAST(embedding AS DOUBLE[])[17:]), lambda x: x)), 5) AS total, len(embedding) AS n FROM embeddings")
def q_prefix_overwrite(s, d):
    """The first 16 entries replaced, the rest as they were."""
    e = F.col("embedding").cast("array<double>")
    v = vector.prefix_overwritten(e, F.transform(F.slice(e, 1, 16), lambda x: x * 2))
    return table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(v).cast("long").alias("n"))


@query("SELECT node_id, round(0.6 * l1 + 0.4 * l2, 6) AS loss FROM (SELECT node_id, -ln(0.05 + 0.9 * (node_id % 97) / 97.0) AS l1, -ln(0.05 + 0.9 * (node_id % 89) / 89.0) AS l2 FROM phase2_sampled_500k)")
def q_multi_task_loss(s, d):
    p = lambda m: -F.log(F.lit(0.05) + F.lit(0.9) * (F.col("node_id") % m) / F.lit(float(m)))
    return table(s, d, "phase2_sampled_500k").select("node_id", F.round(metrics.multi_task_loss(p(97), p(89)), 6).alias("loss"))


CLASS = "SELECT n.node_id, n.split, coalesce(regexp_replace(lower(trim(n.attack_type)), '[ /\\-]+', '_', 'g'), v.attack_type) AS class FROM phase2_sampled_500k n LEFT JOIN label_vocab v USING (label_multiclass)"

SQL |= {
    "p3_found": f"""WITH e AS (SELECT time_bucket, count(*) AS n FROM (SELECT DISTINCT src, dst, weight, edge_type, time_bucket FROM phase3a_temporal) GROUP BY 1), c AS (SELECT class, count(*) AS n FROM ({CLASS}) GROUP BY 1)
SELECT 'phase3a_temporal' AS table_name, CAST(time_bucket AS VARCHAR) AS key_value FROM e WHERE time_bucket IS NOT NULL AND n * 20 >= (SELECT sum(n) FROM e)
UNION ALL SELECT 'phase2_sampled_500k', class FROM c WHERE class IS NOT NULL AND n * 20 >= (SELECT sum(n) FROM c)""",
    "p3_class_counts": f"SELECT class, count(*) AS n FROM ({CLASS}) GROUP BY 1",
    "p3_edge_rank": "SELECT *, row_number() OVER (PARTITION BY time_bucket ORDER BY src NULLS FIRST, dst NULLS FIRST, weight NULLS FIRST, edge_type NULLS FIRST) AS rank_in_bucket FROM (SELECT DISTINCT src, dst, weight, edge_type, time_bucket FROM phase3a_temporal)",
    "p3_bucket_counts": "SELECT time_bucket, count(*) AS n, round(sum(weight), 6) AS weight_sum FROM (SELECT DISTINCT src, dst, weight, edge_type, time_bucket FROM phase3a_temporal) GROUP BY 1",
}

MON = r"list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract(s, '^(?:[A-Za-z]{3}, )?\d{1,2}[ -]([A-Za-z]{3})', 1)))"
OFFSETS = "CASE z " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in [("Z", "+00:00"), ("UTC", "+00:00"), ("EST", "-05:00"), ("EDT", "-04:00"), ("CET", "+01:00"), ("CEST", "+02:00")]) + " ELSE z END"

SQL["p6_found"] = f"""WITH t AS (SELECT 'phase2_features' AS table_name, node_id, trim(event_time) AS s, source FROM phase2_features UNION ALL SELECT 'phase2_sampled_500k', node_id, trim(event_time), source FROM phase2_sampled_500k),
a AS (SELECT t.*, tz_name, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d[T ]') THEN substr(s, 1, 10) WHEN regexp_matches(s, '^\\d{{8}}T\\d{{6}}Z$') THEN substr(s, 1, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2)
  WHEN regexp_matches(s, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}} ') THEN regexp_extract(s, '/(\\d{{4}}) ', 1) || '-' || CASE date_order WHEN 'mdy' THEN regexp_extract(s, '^(\\d+)/(\\d+)', 1) || '-' || regexp_extract(s, '^(\\d+)/(\\d+)', 2) WHEN 'dmy' THEN regexp_extract(s, '^(\\d+)/(\\d+)', 2) || '-' || regexp_extract(s, '^(\\d+)/(\\d+)', 1) END
  WHEN {MON} IS NOT NULL THEN regexp_extract(s, '(\\d{{4}}),? ', 1) || '-' || {MON} || '-' || regexp_extract(s, '^(?:[A-Za-z]{{3}}, )?(\\d{{1,2}})', 1) END AS day,
  CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d\\d-\\d\\d[T ]') THEN substr(s, 12) WHEN regexp_matches(s, '^\\d{{8}}T\\d{{6}}Z$') THEN substr(s, 10, 2) || ':' || substr(s, 12, 2) || ':' || substr(s, 14) ELSE regexp_extract(s, '\\d{{4}},? (.*)$', 1) END AS rest FROM t LEFT JOIN sensors ON t.source = sensors.sensor),
b AS (SELECT *, regexp_extract(rest, '^(\\d{{1,2}}):\\d\\d', 1) AS h, regexp_extract(rest, '^\\d{{1,2}}:(\\d\\d)', 1) AS m, coalesce(nullif(regexp_extract(rest, '^\\d{{1,2}}:\\d\\d:(\\d\\d)', 1), ''), '00') AS sec,
  rpad(substr(regexp_extract(rest, '^\\d{{1,2}}:\\d\\d:\\d\\d\\.(\\d+)', 1), 1, 6), 6, '0') AS frac, regexp_extract(rest, ' (AM|PM)$', 1) AS half,
  regexp_replace(regexp_extract(rest, '^\\d{{1,2}}:\\d\\d(?::\\d\\d(?:\\.\\d+)?)? ?((?:[+-]|Z|[A-Za-z]{{3}})[^\\[]*)', 1), '^(AM|PM)$', '') AS z FROM a),
c AS (SELECT *, try_cast(day || ' ' || CASE half WHEN 'AM' THEN CAST(try_cast(h AS INT) % 12 AS VARCHAR) WHEN 'PM' THEN CAST(try_cast(h AS INT) % 12 + 12 AS VARCHAR) ELSE h END || ':' || m || ':' || sec AS TIMESTAMP) AS local, {OFFSETS} AS o FROM b WHERE h <> '' AND m <> ''),
e AS (SELECT table_name, node_id, frac, local, CASE WHEN regexp_matches(o, '^[+-]') THEN epoch_us(local) - (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (try_cast(substr(o, 2, 2) AS BIGINT) * 60 + coalesce(try_cast(right(o, 2) AS BIGINT) * CAST(length(o) > 3 AS BIGINT), 0)) * 60000000 END AS fixed,
  CASE WHEN o = '' THEN tz_name WHEN contains(o, '/') THEN o END AS zone FROM c WHERE local IS NOT NULL),
f AS (SELECT *, timezone(zone, local) AS x FROM e),
g AS (SELECT table_name, node_id, coalesce(fixed, epoch_us(CASE WHEN timezone(zone, x - INTERVAL 1 HOUR) = local THEN x - INTERVAL 1 HOUR ELSE x END)) + try_cast(frac AS BIGINT) AS us FROM f
  UNION ALL SELECT table_name, node_id, try_cast(s AS BIGINT) * CASE length(s) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END FROM t WHERE regexp_matches(s, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$'))
SELECT table_name, node_id, CAST(min(us) AS BIGINT) AS epoch_us FROM g WHERE us IS NOT NULL GROUP BY ALL"""

CELL = """'("(?:[^"]|"")*"|[^"' || p || ']*)'"""
CELLS = "CASE WHEN contains({t}, '\"') THEN regexp_extract_all(d || {t}, p || " + CELL + ", 1) ELSE string_split({t}, d) END"
KNOWN = "(" + CANON.replace("attack_type", "v") + f" <> 'unknown' OR {FOLD.replace('attack_type', 'v')} = 'unknown')"
SQL["p7_found"] = f"""WITH h AS (SELECT file_id, min(line_text) AS t FROM raw_flows WHERE line_no = 1 AND line_text IS NOT NULL GROUP BY 1),
n AS (SELECT *, length(t) - length(replace(t, ',', '')) AS a, length(t) - length(replace(t, ';', '')) AS b, length(t) - length(replace(t, chr(9), '')) AS c, length(t) - length(replace(t, '|', '')) AS e FROM h),
g AS (SELECT file_id, t, d, CASE d WHEN '|' THEN '\\|' ELSE d END AS p FROM (SELECT *, CASE WHEN a >= greatest(b, c, e) THEN ',' WHEN b >= greatest(c, e) THEN ';' WHEN c >= e THEN chr(9) ELSE '|' END AS d FROM n)),
k AS (SELECT file_id, d, p, list_transform({CELLS.format(t='t')}, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_')) AS names FROM g),
l AS (SELECT line_id, r.file_id, names, CASE WHEN contains(line_text, '"') AND NOT regexp_full_match(d || line_text, '(?:' || p || {CELL} || ')*') THEN 0 END AS broken, {CELLS.format(t='line_text')} AS cells
  FROM raw_flows r JOIN k ON r.file_id = k.file_id WHERE line_no > 1 AND line_text IS NOT NULL),
w AS (SELECT *, CASE WHEN broken = 0 THEN 0 WHEN len(cells) <> len(names) THEN 1 END AS whole FROM l),
x AS (SELECT line_id, file_id, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS pos, unnest(cells) AS cell FROM w WHERE whole IS NULL),
v AS (SELECT line_id, file_id, pos, name, trim(CASE WHEN starts_with(cell, '"') THEN replace(substr(cell, 2, length(cell) - 2), '""', '"') ELSE cell END) AS v FROM x),
y AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 1 WHEN regexp_full_match(v, '[+-]?(?:[0-9]+\\.[0-9]*|\\.[0-9]+|Infinity)|NaN') THEN 2 ELSE 3 END AS k FROM v WHERE v <> ''),
f AS (SELECT file_id, pos, min(name) AS name, count(*) AS n, count(*) FILTER (k = 1) AS i, count(*) FILTER (k = 2) AS dc, count(*) FILTER (k = 3 AND {CANON.replace('attack_type', 'v')} <> 'unknown') AS cl, count(*) FILTER (k = 1 AND length(v) <= 2) AS ids FROM y GROUP BY ALL),
z AS (SELECT file_id, pos, CASE WHEN i * 10 >= n * 9 THEN 1 WHEN (i + dc) * 10 >= n * 9 THEN 2 ELSE 3 END AS kind, cl * 2 >= n OR (regexp_matches(name, '{LABEL_WORDS}') AND (cl + ids) * 2 >= n) AS label FROM f),
bad AS (SELECT DISTINCT line_id FROM y JOIN z USING (file_id, pos) WHERE k > kind OR (label AND NOT ({KNOWN} OR (regexp_full_match(v, '\\+?[0-9]+') AND coalesce(try_cast(v AS BIGINT), 99) < 16)))),
u AS (SELECT node_id, CASE WHEN starts_with(s, '{{') THEN regexp_extract(s, '^\\{{\\s*"type"\\s*:\\s*\\d+\\s*,\\s*"values"\\s*:\\s*((?s:.*?))\\s*\\}}$', 1) ELSE s END AS s FROM (SELECT node_id, regexp_replace(features, '^\\s+|\\s+$', '', 'g') AS s FROM phase2_features WHERE features IS NOT NULL)),
q AS (SELECT node_id, CASE WHEN length(s) >= 2 AND s[1] = '[' AND s[-1] = ']' AND NOT regexp_matches(substr(s, 2, length(s) - 2), '[\\[\\]"'']') THEN string_split(substr(s, 2, length(s) - 2), ',') END AS e FROM u),
o AS (SELECT node_id, min(CASE WHEN e IS NULL THEN 0 WHEN len(e) <> 78 THEN 1 WHEN len(list_filter(e, lambda i: NOT regexp_full_match(trim(i), '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?Infinity|NaN|null'))) > 0 THEN 2 END) AS c FROM q GROUP BY 1)
SELECT 'raw_flows' AS table_name, line_id AS record_id, CASE whole WHEN 0 THEN 'quoting' ELSE 'column_count' END AS reason FROM w WHERE whole IS NOT NULL
UNION ALL SELECT 'raw_flows', line_id, 'bad_value' FROM bad
UNION ALL SELECT 'phase2_features', node_id, CASE c WHEN 0 THEN 'quoting' WHEN 1 THEN 'column_count' ELSE 'bad_value' END FROM o WHERE c IS NOT NULL"""

SQL["p7_clean_lines"] = f"WITH bad_lines AS ({SQL['p7_found']}) SELECT line_id, file_id, line_no, line_text FROM raw_flows r WHERE line_no > 1 AND line_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad_lines b WHERE b.table_name = 'raw_flows' AND b.record_id = r.line_id)"
