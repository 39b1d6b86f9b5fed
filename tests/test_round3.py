import math
import random

import duckdb

import __spark_entry__ as entry
from flowloom.operators import learning


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_pct_vs_first_of_zero_and_of_no_user(spark, tmp_path):
    """First values of 0 and -0 (infinite or NaN, not an error), users and events without an id: as the SQL has them."""
    first = {1: 0.0, 2: -0.0, 3: 4.0, None: 2.0}
    rows = [(10 * i + j, u, v) for i, (u, f) in enumerate(first.items()) for j, v in enumerate([f, 5.0, -5.0, 0.0, None, float("nan")])]
    rows += [(None, 3, 7.0), (70, 4, None), (71, 4, 1.0), (None, 5, 3.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["event_id"], r["user_id"]): r["pct"] for r in entry.queries()["q_pct_vs_first"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(e, u): p for e, u, p in con.sql(entry.oracle_sql()["q_pct_vs_first"]).fetchall()}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all(same(got[k], want[k]) for k in want), [(k, got[k], want[k]) for k in want if not same(got[k], want[k])]
    assert got[(1, 1)] == math.inf and got[(11, 2)] == -math.inf


def test_ablation_sends_the_features_once_not_once_a_configuration(spark):
    """Three more configurations of the same relations shuffle less than the features of one (2,000 nodes of 80 doubles)."""
    r = random.Random(3)
    rows = [(i, "test" if i % 4 == 0 else "train", float(i % 2), [r.gauss(i % 2, 1) for _ in range(20)]) for i in range(2000)]
    nodes = spark.createDataFrame(rows, "node_id long, split string, label double, features array<double>")
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 2000, 0) for i in range(2000)], "src long, dst long, edge_type_id int")
    all_ = {"a": ((0,), 3, True, True), "b": ((0,), 2, True, True), "c": ((0,), 3, False, True), "d": ((0,), 3, True, False)}
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = []
        for some in ({"a": all_["a"]}, all_):
            before = total()
            got = {x["configuration"]: x["accuracy"] for x in learning.component_ablation(nodes, edges, 20, 2, components=some).collect()}
            assert list(got) == list(some) and got["a"] > 0.8
            sent.append(total() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sent[1] - sent[0] < 2000 * 80 * 8
