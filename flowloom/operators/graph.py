"""Graph operators over edge tables (src, dst, weight, edge_type_id) and node tables (node_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.balanced import balanced_running
from flowloom.session import checkpointed


def ranked_in_bucket(nodes: DataFrame, node: str, seconds: Column, bucket_seconds: int) -> DataFrame:
    """(id, t, bucket, rn): position by (t, id) within tumbling buckets; rows without a time are left out."""
    n = nodes.select(F.col(node).alias("id"), seconds.cast("long").alias("t")).where("t is not null")
    n = n.withColumn("bucket", F.floor(F.col("t") / bucket_seconds).cast("long"))
    return balanced_running(n, ["bucket"], ["t", "id"], out="rn")


def temporal_edges(nodes: DataFrame, node: str, seconds: Column, bucket_seconds: int = 2, window_seconds: int = 3, k: int = 8, min_weight: float = 0.2, chunk: int = 4096) -> DataFrame:
    """Edges from each node to the next k of its bucket, weight 1 / (1 + dt): one window, no self-join.

    A bucket is cut into chunks of bounded length; the first k rows of a chunk are also given to the chunk before,
    so a bucket with a third of all nodes is many window groups.
    """
    r = ranked_in_bucket(nodes, node, seconds, bucket_seconds).withColumn("pos", F.col("rn") - 1)
    own = F.floor(F.col("pos") / chunk)
    copies = F.when((F.col("pos") % chunk < k) & (F.col("pos") >= chunk), F.array(own, own - 1)).otherwise(F.array(own))
    r = r.withColumn("chunk", F.explode(copies)).withColumn("tail", F.col("chunk") != own)
    w = Window.partitionBy("bucket", "chunk").orderBy("rn").rowsBetween(1, k)
    e = r.select("id", "t", "tail", F.collect_list(F.struct("id", "t")).over(w).alias("next")).where("not tail").select("id", "t", F.explode("next").alias("n"))
    dt = F.col("n.t") - F.col("t")
    e = e.where((dt <= window_seconds) & (F.col("id") != F.col("n.id"))).select(F.col("id").alias("src"), F.col("n.id").alias("dst"), (1.0 / (1.0 + dt)).alias("weight"))
    return e.where(F.col("weight") >= min_weight).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def temporal_edges_across(nodes: DataFrame, node: str, seconds: Column, bucket_seconds: int, window_seconds: int, k: int, min_weight: float) -> DataFrame:
    """As temporal_edges, but also to adjacent buckets: rank offset 1..k, ranks counted per bucket.

    The theta join |b1 - b2| <= 1, l < r <= l + k becomes an equi-join on (bucket, chunk of 2k ranks): a row meets at most
    two chunks of each of three buckets (four and a half copies on average), and a chunk holds at most 2k rows.
    """
    chunk = 2 * k
    r = ranked_in_bucket(nodes, node, seconds, bucket_seconds).withColumn("chunk", F.floor(F.col("rn") / chunk))
    right = r.select(F.col("id").alias("dst"), F.col("t").alias("t2"), F.col("bucket").alias("b2"), F.col("rn").alias("r2"))
    right = right.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    # the ranks it can be reached from are r2 - k to r2 - 1
    near, far = F.floor((F.col("r2") - 1) / chunk), F.floor((F.col("r2") - k) / chunk)
    right = right.withColumn("chunk", F.explode(F.array_distinct(F.array(near, far)))).select("dst", "t2", "r2", (F.col("b2") + F.col("d")).alias("bucket"), "chunk")
    j = r.join(right, ["bucket", "chunk"]).where((F.col("r2") > F.col("rn")) & (F.col("r2") <= F.col("rn") + k))
    dt = F.abs(F.col("t2") - F.col("t"))
    e = j.where((dt <= window_seconds) & (F.col("id") != F.col("dst"))).select(F.col("id").alias("src"), "dst", (1.0 / (1.0 + dt)).alias("weight"))
    return e.where(F.col("weight") >= min_weight).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, within: int) -> DataFrame:
    """Pairs of equal keys with |t - t2| <= within, by time cells of that width: left to its cell, right to three.

    right's columns come with suffix 2.
    """
    a = left.withColumn("__cell", F.floor(F.col(t) / within))
    b = right.toDF(*[f"{c}2" for c in right.columns])
    b = b.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(f"{t}2") / within) - 1, F.floor(F.col(f"{t}2") / within) + 1)))
    cond = (a["__cell"] == b["__cell"]) & (F.abs(F.col(t) - F.col(f"{t}2")) <= within)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"{k}2"))
    return a.join(b, cond).drop("__cell")


def fuse(temporal: DataFrame, similarity: DataFrame, temporal_scale: float = 1.0, similarity_scale: float = 0.25) -> DataFrame:
    """Both relations tagged and scaled; no self loops; one edge per (src, dst, relation), the heaviest."""
    a = temporal.select("src", "dst", (F.col("weight") * temporal_scale).alias("weight"), F.lit("temporal").alias("edge_type"), F.lit(0).alias("edge_type_id"))
    b = similarity.select("src", "dst", (F.col("weight") * similarity_scale).alias("weight"), F.lit("similarity").alias("edge_type"), F.lit(1).alias("edge_type_id"))
    return a.unionByName(b).where("src <> dst").groupBy("src", "dst", "edge_type", "edge_type_id").agg(F.max("weight").alias("weight"))


def dense_nodes(nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """(node_id, node_idx): 0..N-1 by ascending id, by range partitions and their offsets."""
    d = nodes.select(F.col(node).alias("node_id")).where("node_id is not null").distinct().withColumn("__all", F.lit(0))
    r = balanced_running(d, ["__all"], ["node_id"], out="node_idx")
    return r.select("node_id", (F.col("node_idx") - 1).alias("node_idx"))


def dense_edges(edges: DataFrame, node_map: DataFrame) -> DataFrame:
    """Edges with dense endpoints; edges with an endpoint outside the map fall away."""
    s, t = node_map.toDF("src", "src_idx"), node_map.toDF("dst", "dst_idx")
    return edges.join(s, "src").join(t, "dst").drop("src", "dst")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree, degree) of every node, isolated ones with zeros."""
    d = endpoints(edges).groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    j = nodes.select("node_id").join(d, "node_id", "left").fillna(0)
    return j.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of edges between equal labels, per relation and (null relation) overall. labels: node_id, y."""
    j = edges.join(labels.toDF("src", "ys"), "src").join(labels.toDF("dst", "yd"), "dst")
    return j.rollup("edge_type_id").agg(F.count("*").alias("edges"), F.round(F.avg((F.col("ys") == F.col("yd")).cast("double")), 6).alias("homophily"))


def symmetric_norm(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) = d_src^-1/2 d_dst^-1/2 with self loops; the degree counts rows by src; repeated pairs add up."""
    ids = nodes.select("node_id").distinct()
    e = edges.select("src", "dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    e = e.unionByName(ids.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    # repeated pairs are reduced before the degree joins
    e = e.groupBy("src", "dst").agg(F.count("*").alias("n"))
    d = e.groupBy("src").agg((1.0 / F.sqrt(F.sum("n"))).alias("r"))
    return e.join(d.toDF("src", "rs"), "src").join(d.toDF("dst", "rd"), "dst").select("src", "dst", (F.col("n") * F.col("rs") * F.col("rd")).alias("w"))


def diffuse(adjacency: DataFrame, nodes: DataFrame, columns: list[str], hops: int, direction: str = "out") -> DataFrame:
    """node_id and columns, then each column after 1..hops multiplications with the adjacency (suffix _k).

    The adjacency and every hop are written once: a hop is read by the next and by the result.
    """
    at, frm = ("src", "dst") if direction == "out" else ("dst", "src")
    adjacency = checkpointed(adjacency)
    out, current = nodes.select("node_id", *columns), nodes.select("node_id", *columns)
    for k in range(1, hops + 1):
        moved = adjacency.join(current.withColumnRenamed("node_id", frm), frm)
        current = checkpointed(moved.groupBy(F.col(at).alias("node_id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns]))
        out = out.join(current.withColumnsRenamed({c: f"{c}_{k}" for c in columns}), "node_id", "left")
    return out


def sign_features(adjacency: DataFrame, nodes: DataFrame, vector: str, hops: int, direction: str = "out") -> DataFrame:
    """(node_id, vector): [X, AX, ..., A^hops X] as one array a node; a node without neighbours has zeros.

    nodes: node_id, vector array<double> of one length, without nulls. Entries are summed as columns, inside codegen.
    """
    size = nodes.agg(F.max(F.size(vector))).first()[0] or 0
    names = [f"x{i}" for i in range(size)]
    flat = nodes.select("node_id", *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)])
    d = diffuse(adjacency, flat, names, hops, direction)
    order = [f"{n}_{k}" if k else n for k in range(hops + 1) for n in names]
    return d.select("node_id", F.array(*[F.coalesce(c, F.lit(0.0)) for c in order]).alias(vector))


def gathered_messages(edges: DataFrame, nodes: DataFrame, vector: str) -> DataFrame:
    """message_pass for vectors: per relation and target the array sum(w x) / max(sum(w), 1)."""
    size = nodes.agg(F.max(F.size(vector))).first()[0] or 0
    j = edges.join(nodes.select(F.col("node_id").alias("src"), *[F.get(vector, F.lit(i)).alias(f"x{i}") for i in range(size)]), "src")
    g = j.groupBy("edge_type_id", F.col("dst").alias("node_id")).agg(F.greatest(F.sum("weight"), F.lit(1.0)).alias("s"), *[F.sum(F.col("weight") * F.col(f"x{i}")).alias(f"x{i}") for i in range(size)])
    return g.select("edge_type_id", "node_id", F.array(*[F.col(f"x{i}") / F.col("s") for i in range(size)]).alias("message"))


def message_pass(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Per relation and target: sum(w x) / max(sum(w), 1)."""
    j = edges.join(nodes.select(F.col("node_id").alias("src"), F.col(column).alias("x")), "src")
    s = F.sum("weight")
    return j.groupBy("edge_type_id", F.col("dst").alias("node_id")).agg((F.sum(F.col("weight") * F.col("x")) / F.greatest(s, F.lit(1.0))).alias("message"))


def neighbour_sample(edges: DataFrame, seeds: DataFrame, fanout: list[int], seed: int = 42) -> DataFrame:
    """(hop, src, dst): per hop at most fanout[h] incoming edges a node, chosen by hash; ranks are pruned before the shuffle."""
    out, frontier = None, seeds.select(F.col("node_id").alias("dst"))
    for h, n in enumerate(fanout):
        w = Window.partitionBy("dst").orderBy(F.md5(F.concat_ws(":", "src", "dst", F.lit(str(seed + h)))), "src")
        picked = edges.select("src", "dst").distinct().join(frontier, "dst", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
        # read by the result and by the next hop
        picked = checkpointed(picked.select(F.lit(h).alias("hop"), "src", "dst"))
        out = picked if out is None else out.unionByName(picked)
        frontier = picked.select(F.col("src").alias("dst")).distinct()
    return out


def temporal_sequences(edges: DataFrame, nodes: DataFrame, length: int = 8) -> DataFrame:
    """(node_id, sequence): the length - 1 heaviest incoming sources, then the node itself as padding."""
    w = Window.partitionBy("dst").orderBy(F.col("weight").desc(), F.col("src"))
    top = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= length - 1)
    lists = top.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "src"))), lambda s: s["src"]).alias("s"))
    j = nodes.select("node_id").join(lists.withColumnRenamed("dst", "node_id"), "node_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<bigint>")))
    return j.select("node_id", F.concat("s", F.expr(f"array_repeat(node_id, {length} - size(s))")).alias("sequence"))


def count_window(edges: DataFrame, nodes: DataFrame, step: int, cap: int) -> DataFrame:
    """Per step of a count-based sliding window over node positions: active nodes and edges with both ends inside.

    nodes: idx (0..N-1); edges: src_idx, dst_idx. An edge lives in the steps after its later end arrived and before
    its earlier end is dropped: it is exploded to those steps only. The last partial batch is not a step.
    """
    n = nodes.agg((F.floor(F.count("*") / step)).alias("steps"))
    # step s has seen (s + 1) * step nodes and keeps the last cap of them
    lo, hi = F.least("src_idx", "dst_idx"), F.greatest("src_idx", "dst_idx")
    first = F.floor(hi / step)
    last = F.floor((lo + cap) / step) - 1
    e = edges.withColumn("__first", first).withColumn("__last", F.least(last, n.scalar() - 1)).where("__last >= __first")
    per = e.select(F.explode(F.sequence("__first", "__last")).alias("s")).groupBy("s").agg(F.count("*").alias("active_edges"))
    steps = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("s"))
    j = steps.join(per, "s", "left")
    return j.select("s", ((F.col("s") + 1) * step).alias("processed"), F.least((F.col("s") + 1) * step, F.lit(cap)).alias("active_nodes"), F.coalesce("active_edges", F.lit(0)).alias("active_edges"))


def gated_messages(messages: DataFrame, gates: dict[int, float]) -> DataFrame:
    """Per node the softmax-weighted sum of its relations' messages; relations without a gate count as gate 0.

    messages: edge_type_id, node_id, message. The softmax runs over all given gates.
    """
    import math

    top = max(gates.values())
    total = sum(math.exp(g - top) for g in gates.values())
    share = F.create_map(*[x for r, g in gates.items() for x in (F.lit(r), F.lit(math.exp(g - top) / total))])
    return messages.groupBy("node_id").agg(F.sum(F.coalesce(share[F.col("edge_type_id")], F.lit(0.0)) * F.col("message")).alias("message"))


def sum_with_self(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Each node's own value plus the sum over its incoming neighbours (repeated edges add up)."""
    x = nodes.select("node_id", F.col(column).alias("x"))
    moved = edges.select("src", F.col("dst").alias("node_id")).join(x.withColumnRenamed("node_id", "src"), "src").groupBy("node_id").agg(F.sum("x").alias("s"))
    return x.join(moved, "node_id", "left").select("node_id", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("total"))
