import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowloom.operators import features, graph, metrics, reports, vector
from flowloom.operators.balanced import balanced_last


def test_names_with_dots_are_scaled(spark):
    df = spark.createDataFrame([(1.0, "2"), (3.0, "x"), (5.0, None)], "`Fwd_Header_Length.1` double, `a b/c` string")
    df = features.clean_numbers(df, df.columns)
    assert rows(df.select("`a b/c`")) == [(0.0,), (0.0,), (2.0,)]
    s = [r[0] for r in features.std_scaled(df, df.columns).collect()]
    assert s == [0.5, 1.5, 2.5]
    z = features.zscored(df, df, df.columns).collect()
    assert [r[0] for r in z] == [-1.0, 0.0, 1.0]


def test_parsed_time(spark):
    texts = ["2025-03-05T06:07:08Z", "3/5/2025 6:07", "3/5/2025 6:07:08", "25/03/2025 06:07", "25/03/2025 06:07:08", " 2025-03-05 06:07:08 ", "soon", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", features.parsed_time(F.col("t")).cast("string").alias("p"))
    assert [r["p"] for r in d.orderBy("i").collect()] == ["2025-03-05 06:07:08", "2025-03-05 06:07:00", "2025-03-05 06:07:08", "2025-03-25 06:07:00", "2025-03-25 06:07:08", "2025-03-05 06:07:08", None, None, None]


def test_last_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 97 == 0, F.col("id")).alias("v"))
    df.createOrReplaceTempView("w")
    want = rows(spark.sql("select k, o, last(v, true) over (partition by k order by o rows unbounded preceding) as x from w"))
    assert rows(balanced_last(df, ["k"], ["o"], "v", "x", parts=9), "k", "o", "x") == want
    assert balanced_last(df.limit(0), ["k"], ["o"], "v", "x").count() == 0


def test_knn_of_many_blocks(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(8, 12))[r.integers(8, size=300)] + r.normal(scale=0.3, size=(300, 12))).round(3)
    x[40:60] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    c = np.round((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 6)
    np.fill_diagonal(c, -9)
    want = {(i, int(j)) for i in range(300) for j in sorted(range(300), key=lambda j: (-c[i, j], j))[:4]}
    got = {(a["src"], a["dst"]) for a in vector.exact_knn(df, "id", "v", 4, block_rows=70).collect()}
    assert got == want
    every = {(a["src"], a["dst"]) for a in vector.knn_ivf(df, "id", "v", 4, cells=5, probes=5, block_rows=60).collect()}
    assert len(every & want) / len(want) >= 0.999
    assert vector.knn_ivf(df.limit(0), "id", "v", 4).count() == 0


def test_ivf_recall_on_the_embeddings(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("no test data")
    import __spark_entry__ as entry

    e = spark.read.parquet(path)
    want = {(r["src"], r["dst"]) for r in vector.exact_knn(e, "vec_id", "embedding", 3, threshold=0.3).collect()}
    got = {(r["src"], r["dst"]) for r in entry.queries()["q_knn_ivf"](spark, "/root/testdata/sf0.1").collect()}
    assert len(got & want) / len(want) >= 0.9


def test_sign_features(spark):
    nodes = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "node_id long, f array<double>")
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (2, 3, 1.0)], "src long, dst long, w double")
    got = {r["node_id"]: r["f"] for r in graph.sign_features(edges, nodes, "f", 2).collect()}
    a = np.array([[0, 0.5, 0], [0.25, 0, 1.0], [0, 0, 0]])
    x = np.array([[1.0, 2], [3, 4], [5, 6]])
    want = np.concatenate([x, a @ x, a @ a @ x], axis=1)
    assert all(np.allclose(got[i + 1], want[i]) for i in range(3))


def test_one_vs_rest(spark):
    r = np.random.default_rng(1)
    data = [(int(y), [float(round(v, 2)) for v in r.normal(size=3)]) for y in r.integers(2, size=400)]
    df = spark.createDataFrame(data, "y int, s array<double>")
    got = {x["cls"]: (x["support"], x["auc"]) for x in metrics.one_vs_rest_auc(df, "y", "s", 3).collect()}
    for c in (0, 1):
        pos, neg = [s[c] for y, s in data if y == c], [s[c] for y, s in data if y != c]
        want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        assert got[c][0] == len(pos) and abs(got[c][1] - want) < 1e-6
    assert got[2] == (0, None)
    p = metrics.one_vs_rest_points(df, "y", "s", 3).withColumn("neg", -F.col("score"))
    n = {x["cls"]: x["count"] for x in p.groupBy("cls").count().collect()}
    thin = {x["cls"]: x["count"] for x in metrics.thinned_curve(p, ["cls"], ["neg"], 50).groupBy("cls").count().collect()}
    assert all(thin[c] == -(-n[c] // max(1, n[c] // 50)) for c in n)


def test_reports_and_validation(spark):
    keys = spark.createDataFrame([("bs_512",), ("bs_x",), ("notes",), (None,)], "k string").select(reports.batch_size(F.col("k"))).collect()
    assert [k[0] for k in keys] == [512, None, None, None]
    assert spark.range(1).select(reports.display_name(F.lit("mlp_baseline"))).first()[0] == "MLP BASELINE"
    good = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],)], "f array<double>")
    rep = {r["metric"]: r["value"] for r in vector.validation_report(good, "f").collect()}
    assert rep["total_rows"] == 2 and rep["vector_length"] == 2 and rep["total_feature_values"] == 4
    vector.require_finite(vector.validation_report(good, "f"))
    bad = spark.createDataFrame([([float("nan"), float("-inf")],)], "f array<double>")
    with pytest.raises(ValueError, match="neg_inf_total"):
        vector.require_finite(vector.validation_report(bad, "f"))
    assert vector.validation_report(bad.limit(0), "f").where("metric = 'total_rows'").first()["value"] == 0
