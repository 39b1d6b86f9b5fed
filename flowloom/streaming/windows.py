"""Structured Streaming forms of the window operators. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def windowed_counts(df: DataFrame, ts: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), watermark: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and the sum of value) per tumbling or sliding window and keys; the same code for batch and stream."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    aggs = [F.count("*").alias("n")] + ([F.round(F.sum(value), 4).alias("total")] if value else [])
    return df.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a for a in ("n", "total") if a == "n" or value])


def sessions(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...], watermark: str | None = None) -> DataFrame:
    if watermark:
        df = df.withWatermark(ts, watermark)
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(df: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """First row of each key within the watermark; state older than it is let go."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, ts_left: str, ts_right: str, within: str, watermark: str) -> DataFrame:
    """Inner join of two streams on key with right in [left, left + within]; both sides need the watermark to bound state."""
    a = left.withWatermark(ts_left, watermark).alias("a")
    b = right.withWatermark(ts_right, watermark).alias("b")
    cond = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{ts_right}") >= F.col(f"a.{ts_left}")) & (F.col(f"b.{ts_right}") <= F.col(f"a.{ts_left}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, cond)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all input there is, batch by batch, and returns."""
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def class_counts_sink(table_path: str, column: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: class counts of each micro-batch, one folder a batch, so a retried batch is not doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(column).agg(F.count("*").alias("n")).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return write


def last_n_per_key(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Count-based sliding window on a stream: after each micro-batch, per key that got rows, how many rows were seen,
    how many of the last n are held, and their mean. State per key is the last n values, so it does not grow.

    Rows of one micro-batch are taken in `order`; the order across batches is that of arrival.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k, batches, state):
        seen, recent = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        recent = [*recent, *rows[value].dropna().tolist()][-n:]
        seen += len(rows)
        state.update((seen, recent))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "held": [len(recent)], "mean": [sum(recent) / len(recent) if recent else None]})

    kind = dict(df.dtypes)[key]
    out = f"`{key}` {kind}, seen long, held long, mean double"
    slim = df.select(key, order, df[value].cast("double").alias(value))
    return slim.groupBy(key).applyInPandasWithState(update, out, "seen long, recent array<double>", "update", GroupStateTimeout.NoTimeout)
