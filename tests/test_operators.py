import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowloom.functions.labels import canonical_label, class_key
from flowloom.operators import features, graph, learning, metrics, sampling, vector
from flowloom.sources import files


def one(spark, expr_df, c):
    return [r[c] for r in expr_df.collect()]


def test_labels(spark):
    cases = {None: "unknown", "": "unknown", " BENIGN ": "benign", "DoS  Hulk": "dos_hulk", "DoS/GoldenEye": "dos_goldeneye", "Web Attack – Brute Force": "web_bruteforce", "Web Attack â€“ XSS": "web_xss", "ddos bot": "ddos", "SQL injection": "web_sql_injection", "x" * 100_000: "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert one(spark, df.select(canonical_label(F.col("t")).alias("c")), "c") == list(cases.values())
    k = spark.createDataFrame([(" Dos - Hulk ", "v"), (None, "v"), (None, None)], "t string, v string").select(class_key(F.col("t"), F.col("v")).alias("k"))
    assert one(spark, k, "k") == ["dos_hulk", "v", None]


def test_names():
    assert features.normalise_names([" Fwd Header Length", "Fwd Header-Length", "Flow Bytes/s (avg)", "a.b"]) == ["Fwd_Header_Length", "Fwd_Header_Length_1", "Flow_Bytes_s_avg", "a.b"]


def test_cleaning_and_gates(spark):
    df = spark.createDataFrame([(1, None, " x "), (2, float("nan"), None), (3, float("inf"), ""), (4, float("-inf"), "y"), (5, 2.5, "y")], "k int, `a.b` double, s string")
    assert one(spark, features.clean_numbers(df.withColumnRenamed("a.b", "v"), ["v"]), "v") == [0.0, 0.0, 1e6, -1e6, 2.5]
    assert one(spark, features.trim_strings(df), "s") == ["x", None, "", "y", "y"]
    assert features.null_rate(df.limit(0), "s").first()["null_rate"] == 0.0
    assert features.resolve_column(df, "K") == "k" and features.timestamp_column(df) is None and features.numeric_columns(df, {"k"}) == ["a.b"]
    with pytest.raises(ValueError, match="zz"):
        features.require_columns(df, ["k", "zz"])
    with pytest.raises(ValueError):
        features.require_rows(df, 6)
    with pytest.raises(ValueError):
        features.require_null_rate(df, "s", 0.01)
    features.require_rows(df, 5)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    z = features.zscored(df, df, ["a", "b"]).collect()
    assert [round(r["a"], 4) for r in z] == [-0.7071, 0.7071] and [r["b"] for r in z] == [0.0, 0.0]
    assert [r["b"] for r in features.std_scaled(df, ["b"]).collect()] == [0.0, 0.0]


def test_temporal_edges_chunks_equal_one_chunk(spark):
    n = spark.range(300).select(F.col("id").alias("node"), (F.col("id") / 40).cast("int").alias("t"))
    n = n.unionByName(spark.createDataFrame([(999, None)], "node long, t int"))
    a = rows(graph.temporal_edges(n, "node", F.col("t"), 4, 2, 5, 0.2, chunk=16))
    assert a == rows(graph.temporal_edges(n, "node", F.col("t"), 4, 2, 5, 0.2, chunk=4096)) and len(a) > 1000
    assert graph.temporal_edges(n.limit(0), "node", F.col("t"), 4).count() == 0


def test_graph_edge_cases(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5), (2, 2, 1.0), (1, 9, 1.0)], "src long, dst long, weight double")
    n = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    f = graph.fuse(e, e.limit(1))
    assert rows(f, "src", "dst", "edge_type_id", "weight") == [(1, 2, 0, 0.5), (1, 2, 1, 0.125), (1, 9, 0, 1.0)]
    m = graph.dense_nodes(n)
    assert rows(m) == [(1, 0), (2, 1), (3, 2)] and rows(graph.dense_edges(e.dropDuplicates(), m), "src_idx", "dst_idx") == [(0, 1), (1, 1)]
    assert rows(graph.degrees(n, f), "node_id", "degree") == [(1, 3), (2, 2), (3, 0)]
    a = graph.symmetric_norm(n, e)
    assert {(r["src"], r["dst"]): round(r["w"], 4) for r in a.collect()} == {(1, 1): 0.3333, (1, 2): round(2 / math.sqrt(6), 4), (2, 2): 1.0, (3, 3): 1.0}
    s = {r["node_id"]: r["sequence"] for r in graph.temporal_sequences(e, n, 3).collect()}
    assert s == {1: [1, 1, 1], 2: [2, 1, 2], 3: [3, 3, 3]}


def test_count_window(spark):
    n = spark.range(10).select(F.col("id").alias("idx"))
    e = spark.createDataFrame([(0, 1), (0, 5), (4, 9), (3, 4)], "src_idx long, dst_idx long")
    got = rows(graph.count_window(e, n, 3, 6), "s", "processed", "active_nodes", "active_edges")

    def brute(s):
        hi, lo = (s + 1) * 3, max(0, (s + 1) * 3 - 6)
        return sum(lo <= a < hi and lo <= b < hi for a, b in [(0, 1), (0, 5), (4, 9), (3, 4)])

    assert got == [(s, (s + 1) * 3, min(6, (s + 1) * 3), brute(s)) for s in range(3)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, None]), (4, [6.0, 8.0]), (5, None)], "id long, v array<double>")
    u = df.where("v is not null").select("id", vector.l2_normalised(vector.clean_vector(F.col("v"))).alias("u"))
    assert rows(u) == [(1, [0.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0]), (4, [0.6, 0.8])]
    k = vector.exact_knn(df.where("v is not null"), "id", "v", 1, blocks=3)
    assert rows(k) == [(1, 2, 0.0), (2, 4, 1.0), (3, 2, 0.6), (4, 2, 1.0)]
    assert vector.exact_knn(df.limit(0), "id", "v", 1).count() == 0
    r = vector.vector_validation(df, "v").first()
    assert (r["n_rows"], r["null_vectors"], r["null_entries"]) == (5, 1, 1)
    s = df.where("id = 2").select(vector.softmax(F.col("v")).alias("s"), vector.argmax(F.col("v")).alias("a")).first()
    assert abs(sum(s["s"]) - 1) < 1e-12 and s["a"] == 1


def test_ivf_with_all_probes_is_exact(spark):
    df = spark.range(120).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * (i + 1.7))).alias("v"))
    a, b = vector.knn_ivf(df, "id", "v", 3, cells=5, probes=5), vector.exact_knn(df, "id", "v", 3)
    assert rows(a, "src", "dst") == rows(b, "src", "dst")


def test_ivf_collapses_copies(spark):
    # 200 copies of one vector and 40 others: with all probes as exact, and the copies never meet pair by pair
    one = F.when(F.col("id") % 6 > 0, F.lit(0.0)).otherwise(F.col("id"))
    df = spark.range(240).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(one * (i + 1.7) + 0.3 * (i + 1))).alias("v"))
    a, b = vector.knn_ivf(df, "id", "v", 3, cells=5, probes=5), vector.exact_knn(df, "id", "v", 3)
    assert rows(a, "src", "dst") == rows(b, "src", "dst")
    assert df.select("v").distinct().count() == 40
    # the classes are written before the cells are searched, so the aggregate is no longer part of the result's plan
    assert vector.distinct_vectors(df.withColumnRenamed("v", "x")).count() == 40


def test_ivf_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    q = entry.queries()
    found, true = ({tuple(r) for r in q[n](spark, d).select("src", "dst").collect()} for n in ("q_knn_ivf", "q_knn_cosine"))
    assert len(found & true) >= 0.9 * len(true)


def test_sampling(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, "x").when(F.col("id") % 7 > 0, "y").alias("g"))
    c = {r["g"]: r["count"] for r in sampling.capped(df, "g", "id", {"x": 10}).groupBy("g").count().collect()}
    n = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert c == n | {"x": 10}
    p = sampling.proportional(df, "g", "id", 50)
    assert abs(p.count() - 50) <= 3 and p.columns == df.columns
    s = sampling.split(df, "g", "id")
    assert s.count() == 500 and s.where("split = 'train'").count() in range(395, 410)
    assert rows(sampling.random_batch(df, "id", 5)) == rows(sampling.random_batch(df.repartition(7), "id", 5))
    assert sampling.weighted_resample(df.where("g is not null"), "g", "id", 1.0, 200).count() == 200


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "a int, p int")
    rep = {r["cls"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.class_report(df, "a", "p").collect()}
    assert rep == {0: (1.0, 0.5, 0.666667, 2), 1: (0.333333, 1.0, 0.5, 1), 2: (0.0, 0.0, 0.0, 1)}
    sc = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert metrics.auc(sc, F.col("y") == 1, "s").first()["auc"] == 0.625
    assert metrics.auc(sc.where("y = 0"), F.col("y") == 1, "s").first()["auc"] is None
    assert metrics.auc(sc.limit(0), F.col("y") == 1, "s").first()["auc"] is None


def test_learning(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    x = learning.feature_pipeline(["a", "b"], scale=True).fit(df).transform(df)
    _, score = learning.fit_and_score(x, x, learning.baseline("logistic", 2, 2))
    assert score.first()["accuracy"] > 0.9
    with pytest.raises(ValueError):
        learning.baseline("oracle", 2, 2)


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.resolve_inputs(str(tmp_path / "*.csv"))
    (tmp_path / "a.csv").write_text("x,y\n1,b\n2,\n")
    (tmp_path / "b.csv").write_text("x,y\n3,c\n")
    df = files.read_csv(spark, str(tmp_path))
    assert df.count() == 3 and dict(df.dtypes)["x"] == "int"
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "x long, y string").count() == 2
    assert files.read_json(spark, str(tmp_path / "none.json")) is None
    files.write_metrics(str(tmp_path / "m" / "m.json"), {"f1": 0.5})
    assert files.read_json(spark, str(tmp_path / "m" / "m.json")).first()["f1"] == 0.5
    files.write_parquet(df, str(tmp_path / "p"), partition_by=["x"])
    assert spark.read.parquet(str(tmp_path / "p")).where("x = 3").count() == 1
    files.write_single_csv(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    assert features.replicated(df, 3).count() == 9 and features.replicated(df, 1).columns == df.columns
