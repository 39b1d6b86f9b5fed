"""The whole chain from raw CSV to dense graph tables, as functions and as a command line.

    python -m flowloom.plans.pipeline prepare --input data/ --output out/prepared
    python -m flowloom.plans.pipeline features|validate|sample|temporal|similarity|fuse|export|diffuse ...

Every phase reads and writes Parquet, checks its columns and least rows, and can leave a JSON document of counts.
Node ids are given once, when the prepared rows are written; every later phase reads them back.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import canonical_label, label_id
from flowloom.operators import features as ft
from flowloom.operators import graph, sampling, vector
from flowloom.session import build_session
from flowloom.sources.files import read_csv, write_metrics, write_parquet, write_single_csv

# Most rows kept of each class.
TARGET_COUNTS = {
    "benign": 150000, "dos_hulk": 100000, "ddos": 80000, "portscan": 80000, "dos_goldeneye": 30000, "ftp_patator": 25000,
    "ssh_patator": 25000, "dos_slowloris": 20000, "dos_slowhttptest": 20000, "bot": 9000, "web_bruteforce": 7000, "web_xss": 3000,
    "infiltration": 1000000, "web_sql_injection": 1000000, "heartbleed": 1000000,
}

META = {"node_id", "partition_id", "replica_id", "label_multiclass", "label_binary"}


def prepared(df: DataFrame, replication: int = 5) -> DataFrame:
    """Names normalised, strings trimmed, labels cleaned, event_time parsed or made from the id, rows replicated."""
    df = ft.trim_strings(ft.normalise_columns(df))
    label = ft.resolve_column(df, "label")
    if label is None:
        raise ValueError("no label column")
    time = ft.timestamp_column(df)
    df = df.withColumn("attack_type", canonical_label(F.col(f"`{label}`").cast("string"))).drop(label)
    df = df.withColumn("label_multiclass", label_id(F.col("attack_type"))).withColumn("label_binary", F.when(F.col("attack_type") == "benign", 0).otherwise(1))
    parsed = ft.parsed_time(F.col(f"`{time}`")) if time else F.lit(None).cast("timestamp")
    out = ft.replicated(df.withColumn("event_time", parsed), replication).withColumn("node_id", F.monotonically_increasing_id())
    return out.withColumn("event_time", F.coalesce("event_time", F.timestamp_seconds(F.lit(1700000000) + F.col("node_id") % 86400)))


def engineered(df: DataFrame, scale: bool = False) -> DataFrame:
    """All numeric columns, by name, cleaned and assembled to `features` array<double>; scale divides by the deviation."""
    ft.require_columns(df, ["node_id", "event_time", "attack_type", "label_multiclass", "label_binary"])
    cols = ft.numeric_columns(df, META)
    clean = ft.clean_numbers(df, cols)
    clean = ft.std_scaled(clean, cols) if scale else clean
    keep = ["node_id", "event_time", "attack_type", "label_multiclass", "label_binary", *(["replica_id"] if "replica_id" in df.columns else []), "features"]
    return ft.assembled(clean, cols).select(*keep)


def sampled(df: DataFrame, caps: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """Known classes only, one row a node, at most caps[class] random rows a class."""
    caps = caps or TARGET_COUNTS
    one = df.where(F.col("attack_type").isin(*caps)).dropDuplicates(["node_id"])
    return sampling.capped(one, "attack_type", "node_id", caps, seed)


def temporal(nodes: DataFrame, bucket: int = 2, window: int = 3, k: int = 8, least: float = 0.2, cross: bool = False, null_rate: float = 0.01) -> DataFrame:
    ft.require_null_rate(nodes, "event_time", null_rate)
    make = graph.temporal_edges_across if cross else graph.temporal_edges
    return make(nodes, "node_id", F.unix_timestamp("event_time"), bucket, window, k, least).withColumn("edge_type", F.lit("temporal"))


def similarity(nodes: DataFrame, k: int = 3, threshold: float = 0.8, cells: int = 256, probes: int = 16) -> DataFrame:
    n = nodes.count()
    cells = min(cells, max(1, n // 100))
    return vector.knn_ivf(nodes, "node_id", "features", k, cells, min(probes, cells), threshold=threshold).withColumn("edge_type", F.lit("similarity"))


def exported(nodes: DataFrame, edges: DataFrame, max_nodes: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node map, dense nodes, dense edges); max_nodes > 0 first draws a class-proportional sample."""
    kept = sampling.proportional(nodes, "attack_type", "node_id", max_nodes, seed) if max_nodes else nodes
    m = graph.dense_nodes(kept)
    return m, kept.join(m, "node_id").select("node_idx", "features", "label_multiclass"), graph.dense_edges(edges, m)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("phase", choices=["prepare", "features", "validate", "sample", "temporal", "similarity", "fuse", "export", "diffuse"])
    p.add_argument("--input", required=True)
    p.add_argument("--second", help="fuse: similarity edges; export, diffuse: edges")
    p.add_argument("--output", required=True)
    p.add_argument("--metrics-output")
    p.add_argument("--master")
    p.add_argument("--driver-memory")
    p.add_argument("--shuffle-partitions", type=int)
    p.add_argument("--min-rows", type=int, default=1)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--replication-factor", type=int, default=5)
    p.add_argument("--scale", action="store_true")
    p.add_argument("--temporal-window", type=int, default=3)
    p.add_argument("--bucket-seconds", type=int, default=2)
    p.add_argument("--max-neighbors", type=int, default=8)
    p.add_argument("--min-weight", type=float, default=0.2)
    p.add_argument("--cross-bucket", action="store_true")
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--temporal-scale", type=float, default=1.0)
    p.add_argument("--similarity-scale", type=float, default=0.25)
    p.add_argument("--max-nodes", type=int, default=0)
    p.add_argument("--hops", type=int, default=3)
    p.add_argument("--partitions", type=int, help="partitions of what is written")
    p.add_argument("--output-mode", choices=["overwrite", "append", "errorifexists", "ignore"], default="overwrite")
    p.add_argument("--max-null-time-rate", type=float, default=0.01)
    a = p.parse_args(argv)
    spark = spark or build_session(f"flowloom-{a.phase}", a.master, a.driver_memory, a.shuffle_partitions)
    read = spark.read.parquet
    out = a.output

    def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
        write_parquet(df.repartition(a.partitions) if a.partitions else df, path, a.output_mode, partition_by)

    if a.phase == "prepare":
        write(prepared(read_csv(spark, a.input), a.replication_factor), out)
    elif a.phase == "features":
        write(engineered(read(a.input), a.scale), out)
    elif a.phase == "validate":
        report = vector.validation_report(read(a.input), "features")
        write_single_csv(report, out)
        vector.require_finite(report)
        return
    elif a.phase == "diffuse":
        nodes, edges = read(a.input), read(a.second)
        n = nodes.select("node_id", vector.clean_vector(F.col("features")).alias("features"))
        write(graph.sign_features(graph.symmetric_norm(nodes, edges), n, "features", a.hops), out)
    elif a.phase == "sample":
        write(sampled(read(a.input), seed=a.seed), out)
    elif a.phase == "temporal":
        write(temporal(read(a.input), a.bucket_seconds, a.temporal_window, a.max_neighbors, a.min_weight, a.cross_bucket, a.max_null_time_rate), out)
    elif a.phase == "similarity":
        write(similarity(read(a.input), a.top_k, a.threshold), out)
    elif a.phase == "fuse":
        write(graph.fuse(read(a.input), read(a.second), a.temporal_scale, a.similarity_scale), out, partition_by=["edge_type_id"])
    else:
        m, nodes, edges = exported(read(a.input), read(a.second), a.max_nodes, a.seed)
        write(m, f"{out}/node_map")
        write(nodes, f"{out}/nodes")
        write(edges, f"{out}/edges")
    result = read(f"{out}/nodes" if a.phase == "export" else out)
    ft.require_rows(result, a.min_rows)
    if a.metrics_output:
        by = next((c for c in ("attack_type", "edge_type") if c in result.columns), None)
        counts = {str(r[0]): r[1] for r in result.groupBy(by).count().collect()} if by else {}
        write_metrics(a.metrics_output, {"phase": a.phase, "input": a.input, "output": out, "rows": result.count(), "counts": counts})


if __name__ == "__main__":
    main()
