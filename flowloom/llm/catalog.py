"""The pN_ queries of the problems on training data, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.labels import class_key
from flowloom.llm import hnsw, mixing, overlap, packing, quota, truncation
from flowloom.llm.tokens import TOKENIZER, token_counter
from flowloom.session import checkpointed, table


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "phase2_sampled_500k")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = overlap.overlap_pairs(_sampled(spark, d), "node_id", "features", "split")
    return p.select(F.least("train_key", "other_key").alias("node_a"), F.greatest("train_key", "other_key").alias("node_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_sampled(spark, d), "node_id", "features", "split", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = hnsw.similar_pairs(_sampled(spark, d), "node_id", "features", k=5, min_cosine=0.97)
    return p.select(F.least("node_id", "neighbour").alias("node_a"), F.greatest("node_id", "neighbour").alias("node_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar of every record, whatever their cosine."""
    return hnsw.similar_pairs(_sampled(spark, d), "node_id", "features", k=5)


def _quota(spark: SparkSession, d: str):
    """class_targets and label_vocab are fixed tables of at most 16 rows."""
    vocab = table(spark, d, "label_vocab").select(F.col("label_multiclass").alias("__id"), F.col("attack_type").alias("__name"))
    s = _sampled(spark, d).select("node_id", "attack_type", "label_multiclass", "source", "split")
    s = s.join(F.broadcast(vocab), F.col("label_multiclass") == F.col("__id"), "left").withColumn("class", class_key(F.col("attack_type"), F.col("__name"))).drop("__id", "__name")
    targets = {r["attack_type"]: (r["target_share"], r["min_rows"]) for r in table(spark, d, "class_targets").collect()}
    return quota.quota_sample(s, "node_id", ["class"], [targets], fill=False)


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _quota(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_report(spark, d).where("not met").select(F.col("category").alias("attack_type"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "parent_id", "text")
    return packing.packed(packing.measured(docs), docs.count())


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("pieces > 1 and piece = 0").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def _mixture(spark: SparkSession, d: str, tokenizer: str = TOKENIZER):
    items = table(spark, d, "documents").select("doc_id", "source", token_counter(tokenizer)("text").alias("tokens"))
    # tokenised once, read for the totals and for the streams
    return mixing.mixture(checkpointed(items), table(spark, d, "source_targets"))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(*_mixture(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("not met").select("source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged_texts(table(spark, d, "documents")).where("cut is not null").select(F.col("id").alias("doc_id"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.judged_texts(table(spark, d, "documents")))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_sample": p5_sample,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_schedule": p9_schedule,
    "p10_found": p10_found,
    "p10_report": p10_report,
}

CLASS = "SELECT coalesce(regexp_replace(lower(trim(n.attack_type)), '[ /\\-]+', '_', 'g'), v.attack_type) AS class FROM phase2_sampled_500k n LEFT JOIN label_vocab v USING (label_multiclass)"
VEC = "SELECT node_id, split, list_transform(features, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE CAST(x AS DOUBLE) END) AS v FROM phase2_sampled_500k"
UNIT = "SELECT node_id, list_transform(v, lambda x: coalesce(x, 0.0)) AS v FROM (" + VEC + ")"

SQL = {
    "p1_found": f"""WITH r AS ({VEC}) SELECT least(a.node_id, b.node_id) AS node_a, greatest(a.node_id, b.node_id) AS node_b FROM r a JOIN r b ON a.split = 'train' AND b.split IN ('val', 'test')
WHERE len(list_filter(list_zip(a.v, b.v), lambda p: coalesce(abs(p[1] - p[2]) <= 0.075001, false))) >= 74""",
    "p1_report": f"""WITH r AS ({VEC}), p AS (SELECT b.node_id, min(78 - len(list_filter(list_zip(a.v, b.v), lambda p: coalesce(abs(p[1] - p[2]) <= 0.075001, false)))) AS best FROM r a JOIN r b ON a.split = 'train' AND b.split IN ('val', 'test') GROUP BY 1)
SELECT split, source, count(*) AS records, count(*) FILTER (best <= 4) AS overlapping, count(*) FILTER (best = 0) AS within_tolerance FROM phase2_sampled_500k n LEFT JOIN p USING (node_id) WHERE split IN ('val', 'test') GROUP BY ALL""",
    "p2_found": f"""WITH r AS ({UNIT}), p AS (SELECT a.node_id AS q, b.node_id AS n, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM r a JOIN r b ON a.node_id <> b.node_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS k FROM p WHERE c >= 0.97) WHERE k <= 5) SELECT DISTINCT least(q, n) AS node_a, greatest(q, n) AS node_b FROM t""",
    "p5_found": f"""WITH c AS (SELECT class, count(*) AS n FROM ({CLASS}) GROUP BY 1), s AS (SELECT count(*) // 4 AS s FROM phase2_sampled_500k)
SELECT t.attack_type FROM class_targets t LEFT JOIN c ON t.attack_type = c.class, s WHERE coalesce(c.n, 0) < greatest(t.min_rows, CAST(floor(CAST(t.target_share AS DECIMAL(12, 6)) * s.s + 0.5) AS BIGINT))""",
}

WANTED = f"""c AS (SELECT class, count(*) AS n FROM ({CLASS}) GROUP BY 1), s AS (SELECT count(*) // 4 AS s FROM phase2_sampled_500k),
w AS (SELECT t.attack_type, coalesce(c.n, 0) AS available, greatest(t.min_rows, CAST(floor(CAST(t.target_share AS DECIMAL(12, 6)) * s.s + 0.5) AS BIGINT)) AS wanted FROM class_targets t LEFT JOIN c ON t.attack_type = c.class, s)"""
SQL["p5_report"] = f"WITH {WANTED} SELECT 'class' AS column_name, attack_type AS category, available, wanted, least(available, wanted) AS drawn, available >= wanted AS met FROM w"
SQL["p5_sample"] = f"""WITH {WANTED}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(CAST(node_id AS VARCHAR) || ':5'), node_id) AS rn FROM (SELECT n.node_id, n.attack_type, n.label_multiclass, n.source, n.split, coalesce(regexp_replace(lower(trim(n.attack_type)), '[ /\\-]+', '_', 'g'), v.attack_type) AS class FROM phase2_sampled_500k n LEFT JOIN label_vocab v USING (label_multiclass)))
SELECT r.* EXCLUDE (rn) FROM r JOIN w ON r.class = w.attack_type WHERE rn <= wanted"""
