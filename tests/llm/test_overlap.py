import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import overlap

SCHEMA = "node_id long, split string, features array<float>, h1 string, dot string"


def brute(rows, size, tol=0.075, most=4):
    import math

    def differs(a, b):
        return a is None or b is None or math.isnan(a) or math.isnan(b) or math.isinf(a) or math.isinf(b) or abs(a - b) > tol

    out = set()
    for i, s, x, *_ in rows:
        for j, t, y, *_ in rows:
            if s == "train" and t in ("val", "test") and x is not None and y is not None and len(x) == len(y) == size and sum(map(differs, x, y)) <= most:
                out.add((i, j))
    return out


def make(n=480, size=78, seed=1):
    r = random.Random(seed)
    base = [[r.choice([0.0, round(r.gauss(0, 1), 2)]) if p % 7 == 0 else round(r.gauss(0, 1), 2) for p in range(size)] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        x = list(base[r.randrange(len(base))])
        for p in r.sample(range(size), r.choice([0, 0, 0, 1, 2, 3, 4, 5])):
            x[p] = r.choice([None, float("nan"), float("inf"), x[p] + 0.5, -x[p] - 1])
        x = [v if v is None else v + r.choice([0, 0.05, -0.02]) for v in x]
        rows.append((i, r.choice(["train", "val", "test", None]), x, "clash", "clash"))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = make()
    rows += [(1000 + i, s, rows[0][2], "copy", None) for i, s in enumerate(["train", "train", "val", "test"])]
    rows += [(2000, "train", None, None, None), (2001, "val", [1.0, 2.0], None, None), (2002, "test", [None] * 78, None, None), (2003, "train", [None] * 78, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["train_key"], r["other_key"]) for r in overlap.overlap_pairs(df, "node_id", "features", "split").collect()}
    want = brute(rows, 78)
    assert len(want) > 100 and got == want


def test_empty_and_report(spark):
    df = spark.createDataFrame(make(60), SCHEMA).withColumn("source", F.lit("s"))
    assert overlap.overlap_pairs(df.limit(0), "node_id", "features", "split").count() == 0
    rep = overlap.overlap_report(df, "node_id", "features", "split", "source").collect()
    assert sum(r["records"] for r in rep) == df.where("split in ('val', 'test')").count()
    assert sum(r["overlapping"] for r in rep) == len({j for _, j in brute(make(60), 78)})


def test_nulls_among_equal_values(spark):
    """Vectors whose nulls stand at different places among equal values are different vectors, in either id order."""
    t = [0.5] * 78
    v1, v2 = list(t), list(t)
    for p in (0, 1, 2, 3):
        v1[p] = None
    for p in (0, 1, 2, 3, 4):
        v2[p] = None
    v2[5], v1[5] = 0.5, 0.5
    v3 = [0.5] * 74 + [None] * 4
    for ids in ((1, 2, 3, 4), (9, 4, 3, 2), (1, 3, 2, 4)):
        rows = [(ids[0], "train", t, "", ""), (ids[1], "val", v1, "", ""), (ids[2], "test", v2, "", ""), (ids[3], "test", v3, "", "")]
        got = {(r["train_key"], r["other_key"]) for r in overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA), "node_id", "features", "split").collect()}
        assert got == brute(rows, 78) == {(ids[0], ids[1]), (ids[0], ids[3])}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["train", "val"]), st.lists(st.sampled_from([None, float("nan"), 0.0, 0.3, 0.37]), min_size=8, max_size=8)), min_size=2, max_size=24))
def test_small_vectors_equal_brute_force(spark, data):
    rows = [(i, s, x, "", "") for i, (s, x) in enumerate(data)]
    got = [(r["train_key"], r["other_key"]) for r in overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA), "node_id", "features", "split", size=8, max_diff=2, blocks=4, extra=1).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 8, most=2)


def test_cosine_is_of_unit_vectors(spark):
    rows = [(1, "train", [float(i) for i in range(78)], "", ""), (2, "val", [float(i) for i in range(78)], "", ""), (3, "val", [float(i) if i else 99.0 for i in range(78)], "", "")]
    got = {r["other_key"]: r["cosine"] for r in overlap.overlap_pairs(spark.createDataFrame(rows, SCHEMA), "node_id", "features", "split").collect()}
    # twelve terms of equal weight, one of them missed
    assert abs(got[2] - 1) < 1e-9 and abs(got[3] - (11 / 12) ** 0.5) < 1e-9


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_little_is_shuffled_beside_the_vectors(spark, tmp_path):
    """Less than half the bytes of the vectors, which are not sent themselves: 6,000 of 312 bytes."""
    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 78)).round(2).astype(np.float32)
    x[5900:] = x[:100] + np.float32(0.03)
    rows = [(i, "train" if i < 4000 else "test", v.tolist()) for i, v in enumerate(x)]
    path = str(tmp_path / "v")
    spark.createDataFrame(rows, "node_id long, split string, features array<float>").repartition(4).write.parquet(path)
    before = shuffled(spark)
    got = {(r["train_key"], r["other_key"]) for r in overlap.overlap_pairs(spark.read.parquet(path), "node_id", "features", "split").collect()}
    assert got == {(i, 5900 + i) for i in range(100)}
    assert shuffled(spark) - before < 6000 * 312 // 2


def test_huge_values_and_sketches_lose_nothing(spark):
    r = random.Random(4)
    base = [[r.choice([1e30, -3e38, 1e17, r.gauss(0, 1)]) for _ in range(78)] for _ in range(20)]
    rows = []
    for i in range(200):
        x = list(r.choice(base))
        for p in r.sample(range(78), r.choice([0, 2, 4, 5])):
            x[p] = r.choice([float("nan"), 5.0, -1e30])
        rows.append((i, r.choice(["train", "val"]), [v + r.choice([0, 0.07]) for v in x], "", ""))
    df = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))
    got = {(r["train_key"], r["other_key"]) for r in overlap.overlap_pairs(df, "node_id", "features", "split").collect()}
    want = brute(rows, 78, 0.075001)
    assert len(want) > 100 and got == want
