import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from flowloom.streaming import windows

T0 = dt.datetime(2024, 1, 1)


def events(spark, path, n=300):
    data = [(i, T0 + dt.timedelta(minutes=7 * i), i % 5, ["a", "b", "c"][i % 3], float(i)) for i in range(n)]
    df = spark.createDataFrame(data, "id long, ts timestamp, user int, kind string, value double")
    # one file after the other, so that the stream reads them in the order of time
    for lo in range(0, n, n // 4):
        df.where(f"id >= {lo} and id < {lo + n // 4}").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def collect(spark, stream, tmp_path, mode="append"):
    got = []
    windows.run_available(stream, lambda b, _: got.extend(map(tuple, b.collect())), str(tmp_path / "cp"), mode)
    return got


def test_sliding_window_stream_equals_batch(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"))
    stream = windows.file_stream(spark, str(tmp_path / "in"), batch.schema)
    got = collect(spark, windows.windowed_counts(stream, "ts", "6 hours", "2 hours", ("kind",), "1 hour", "value"), tmp_path)
    want = {tuple(r) for r in windows.windowed_counts(batch, "ts", "6 hours", "2 hours", ("kind",), value="value").collect()}
    # append mode keeps back the windows that the watermark has not passed
    assert len(got) == len(set(got)) and set(got) <= want and len(got) > 0.7 * len(want)


def test_sessions(spark, tmp_path):
    data = [(1, T0), (1, T0 + dt.timedelta(minutes=60)), (1, T0 + dt.timedelta(minutes=121)), (2, T0)]
    df = spark.createDataFrame(data, "user int, ts timestamp")
    assert rows(windows.sessions(df, "ts", "1 hour", ("user",)), "user", "n") == [(1, 1), (1, 2), (2, 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    p = str(tmp_path / "in")
    first = [(i, T0 + dt.timedelta(hours=i)) for i in range(48)]
    spark.createDataFrame(first, "id long, ts timestamp").coalesce(1).write.parquet(p)
    stream = windows.file_stream(spark, p, spark.read.parquet(p).schema)
    q = windows.windowed_counts(stream, "ts", "1 hour", watermark="2 hours")
    got = collect(spark, q, tmp_path)
    spark.createDataFrame([(99, T0)], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(p)
    late = collect(spark, windows.windowed_counts(windows.file_stream(spark, p, spark.read.parquet(p).schema), "ts", "1 hour", watermark="2 hours"), tmp_path)
    assert len(got) > 40 and T0 not in {r[0] for r in late}


def test_dedupe_and_counts_sink(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.createDataFrame([(1, T0, "a"), (1, T0, "a"), (2, T0, "b")], "id long, ts timestamp, kind string").coalesce(1).write.parquet(p)
    schema = spark.read.parquet(p).schema
    got = collect(spark, windows.deduplicated(windows.file_stream(spark, p, schema), ["id"], "ts", "1 hour"), tmp_path)
    assert sorted(r[0] for r in got) == [1, 2]
    out = str(tmp_path / "out")
    windows.run_available(windows.file_stream(spark, p, schema), windows.class_counts_sink(out, "kind"), str(tmp_path / "cp2"))
    assert rows(spark.read.parquet(out), "kind", "n") == [("a", 2), ("b", 1)]


def test_stream_join(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, T0), (2, T0)], "k int, t1 timestamp").write.parquet(a)
    spark.createDataFrame([(1, T0 + dt.timedelta(minutes=5)), (2, T0 + dt.timedelta(hours=5))], "k int, t2 timestamp").write.parquet(b)
    s = windows.stream_interval_join(windows.file_stream(spark, a, spark.read.parquet(a).schema, 9), windows.file_stream(spark, b, spark.read.parquet(b).schema, 9), "k", "t1", "t2", "1 hour", "2 hours")
    assert [r[0] for r in collect(spark, s.select(F.col("a.k")), tmp_path)] == [1]


def test_last_n_per_key(spark, tmp_path):
    batch = events(spark, str(tmp_path / "in"), 40)
    stream = windows.file_stream(spark, str(tmp_path / "in"), batch.schema)
    got = collect(spark, windows.last_n_per_key(stream, "kind", "id", "value", 5), tmp_path, "update")
    final = {k: (seen, held, mean) for k, seen, held, mean in sorted(got, key=lambda r: r[1])}
    for i, k in enumerate("abc"):
        v = list(range(i, 40, 3))
        assert final[k] == (len(v), 5, sum(v[-5:]) / 5)
