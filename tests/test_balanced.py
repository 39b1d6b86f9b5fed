import json

from conftest import rows
from pyspark.sql import functions as F

from flowloom.operators.balanced import RangeSplit, balanced_agg, balanced_lag, balanced_running, heavy_keys


def skewed(spark, n=2000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 11).cast("int").alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))


def test_running_equals_window(spark):
    df = skewed(spark)
    got = rows(balanced_running(df, ["k"], ["o"], F.col("v"), parts=7), "k", "o", "running")
    df.createOrReplaceTempView("w")
    want = rows(spark.sql("select k, o, sum(v) over (partition by k order by o) as running from w"))
    assert got == want


def test_running_count_exclusive_and_null_values(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 3), (1, 3, 4)], "k int, o int, v int")
    assert rows(balanced_running(df, ["k"], ["o"], F.col("v"), exclusive=True), "o", "running") == [(1, 0), (2, 0), (3, 3)]


def test_lag_equals_window(spark):
    df = skewed(spark)
    df.createOrReplaceTempView("w")
    got = rows(balanced_lag(df, ["k"], ["o"], "o", "prev", parts=6), "k", "o", "prev")
    assert got == rows(spark.sql("select k, o, lag(o) over (partition by k order by o) as prev from w"))


def test_agg_distinct(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, 5, None), (2, 5, None), (None, 5, 1.0)], "k int, o int, w double")
    out = balanced_agg(df, ["k"], ["o", "w"], {"n": ("count", None)}, distinct=True)
    assert rows(out) == sorted([(1, 1), (2, 1), (None, 1)], key=str)
    assert balanced_agg(df.limit(0), ["k"], ["o", "w"], {"n": ("count", None)}).count() == 0


def test_agg_equals_group_by(spark):
    df = skewed(spark).withColumn("w", F.when(F.col("o") % 4 > 0, F.col("v").cast("double")))
    aggs = {"n": ("count", None), "n_w": ("count", "w"), "s": ("sum", "w"), "lo": ("min", "o"), "hi": ("max", "o")}
    got = balanced_agg(df, ["k"], ["o"], aggs, parts=9)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.count("w").alias("n_w"), F.sum("w").alias("s"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    assert rows(got) == rows(want)


def test_agg_and_ranks_move_rows_once(spark):
    """The rows cross one exchange; duplicates, states and windows find them where they are. Only boundary keys are stitched."""
    df = skewed(spark)
    rs = RangeSplit(df, ["k"], ["o"], 7)
    assert 4 <= len(rs.bounds) <= 6 and {json.loads(b)["c0"] for b in rs.bounds} <= {None, *range(11)}
    states = rs.split(df, distinct=True).groupBy("__pid", "k").agg(F.count("*"))
    assert states._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    spread = rs.split(df).where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 2
    keys_of_two = df.withColumn("p", rs.pid).groupBy("k").agg(F.countDistinct("p").alias("n"), F.max(rs.on_edge).alias("e")).where("n > 1").collect()
    assert keys_of_two and all(r["e"] for r in keys_of_two)


def test_bounds_of_many_types(spark):
    df = spark.range(300).selectExpr("if(id % 5 = 0, null, cast(id % 7 as string)) k", "timestamp_seconds(id * 7919) t", "if(id % 11 = 0, double('NaN'), id / 3) x", "cast(id as decimal(12,2)) d", "id")
    got = rows(balanced_running(df, ["k"], ["t", "x", "d"], parts=6), "id", "running")
    df.createOrReplaceTempView("w")
    assert got == rows(spark.sql("select id, row_number() over (partition by k order by t, x, d) as running from w"))


def test_running_distinct(spark):
    df = spark.range(400).selectExpr("id % 3 as k", "id % 50 as o")
    df.createOrReplaceTempView("w")
    assert rows(balanced_running(df, ["k"], ["o"], distinct=True, parts=5)) == rows(spark.sql("select k, o, row_number() over (partition by k order by o) as running from (select distinct k, o from w)"))


def test_heavy_keys(spark):
    c = spark.createDataFrame([("a", 50), ("b", 3), (None, 47)], "k string, n long")
    assert rows(heavy_keys(c, "k", "n", 20), "k") == [("a",)]
    assert heavy_keys(c.limit(0), "k", "n", 20).count() == 0


def test_empty(spark):
    e = skewed(spark).limit(0)
    assert balanced_running(e, ["k"], ["o"]).count() == 0
    assert balanced_lag(e, ["k"], ["o"], "o", "p").count() == 0
