"""The pN_ queries of the general problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import class_key
from flowloom.operators import badrows, balanced, drift, timestamps
from flowloom.session import checkpointed, table

EDGE = ["src", "dst", "weight", "edge_type"]


def sampled_with_class(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """phase2_sampled_500k with its class; label_vocab is a fixed table of 16 rows."""
    vocab = table(spark, d, "label_vocab").select(F.col("label_multiclass").alias("__id"), F.col("attack_type").alias("__name"))
    s = table(spark, d, "phase2_sampled_500k").select("attack_type", "label_multiclass", *cols)
    j = s.join(F.broadcast(vocab), F.col("label_multiclass") == F.col("__id"), "left")
    return j.withColumn("class", class_key(F.col("attack_type"), F.col("__name"))).drop("__id", "__name")


def p3_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges per time bucket with their weight sum, in one range shuffle."""
    edges = table(spark, d, "phase3a_temporal")
    counts = balanced.balanced_agg(edges, ["time_bucket"], EDGE, {"n": ("count", None), "weight_sum": ("sum", "weight")}, distinct=True)
    return counts.withColumn("weight_sum", F.round("weight_sum", 6))


def p3_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return balanced.balanced_agg(sampled_with_class(spark, d, "node_id"), ["class"], ["node_id"], {"n": ("count", None)})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    buckets = balanced.heavy_keys(p3_bucket_counts(spark, d), "time_bucket", "n", 20)
    classes = balanced.heavy_keys(p3_class_counts(spark, d), "class", "n", 20)
    a = buckets.select(F.lit("phase3a_temporal").alias("table_name"), F.col("time_bucket").cast("string").alias("key_value"))
    return a.unionByName(classes.select(F.lit("phase2_sampled_500k").alias("table_name"), F.col("class").alias("key_value")))


def p3_edge_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct edge with its rank inside its bucket, ordered by (src, dst, weight, edge_type)."""
    return balanced.balanced_running(table(spark, d, "phase3a_temporal"), ["time_bucket"], EDGE, out="rank_in_bucket", distinct=True)


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    """Both tables' rows with instant, status and reading."""
    cols = ["node_id", "event_time", "source"]
    a = table(spark, d, "phase2_features").select(F.lit("phase2_features").alias("table_name"), *cols)
    b = table(spark, d, "phase2_sampled_500k").select(F.lit("phase2_sampled_500k").alias("table_name"), *cols)
    return timestamps.normalise_timestamps(a.unionByName(b), "event_time", "source", table(spark, d, "sensors").select("sensor", "tz_name", "date_order"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ok = p6_instants(spark, d).where("instant_us is not null")
    return ok.groupBy("table_name", "node_id").agg(F.min("instant_us").alias("epoch_us"))


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The undamaged lines of raw_flows whose file has a time field, with instant, status and reading; the sensor is the file's."""
    cells = drift.time_cells(table(spark, d, "raw_flows")).join(table(spark, d, "capture_files").select("file_id", "sensor"), "file_id", "left")
    # read twice, for the evidence and for the instants: the fields are profiled once
    return timestamps.normalise_timestamps(checkpointed(cells), "time_text", "sensor", table(spark, d, "sensors").select("sensor", "tz_name", "date_order"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "raw_flows"), table(spark, d, "capture_files"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(table(spark, d, "raw_flows"), table(spark, d, "capture_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    lines = badrows.line_errors(table(spark, d, "raw_flows"))
    vectors = badrows.vector_errors(table(spark, d, "phase2_features"), "node_id", "features")
    a = lines.select(F.lit("raw_flows").alias("table_name"), F.col("line_id").alias("record_id"), "reason")
    return a.unionByName(vectors.select(F.lit("phase2_features").alias("table_name"), F.col("node_id").alias("record_id"), "reason"))


def p7_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_flows")
    return badrows.clean_lines(lines, badrows.line_errors(lines))


def p7_clean_vectors(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parsed_vectors(table(spark, d, "phase2_features").select("node_id", "features"), "node_id", "features").select("node_id", "vector")


QUERIES = {
    "p3_found": p3_found,
    "p3_bucket_counts": p3_bucket_counts,
    "p3_class_counts": p3_class_counts,
    "p3_edge_rank": p3_edge_rank,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p6_found": p6_found,
    "p6_instants": p6_instants,
    "p6_lines": p6_lines,
    "p7_found": p7_found,
    "p7_clean_lines": p7_clean_lines,
    "p7_clean_vectors": p7_clean_vectors,
}
