"""Nested reports to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_size(key: Column, prefix: str = "bs_") -> Column:
    """The number in a key like bs_512; null for keys of another form."""
    return F.when(key.startswith(prefix), F.substring_index(key, prefix, -1).try_cast("int"))


def display_name(name: Column) -> Column:
    """mlp_baseline -> MLP BASELINE"""
    return F.upper(F.replace(name, F.lit("_baseline"), F.lit(" Baseline")))


def flattened_latency(df: DataFrame, report: str, metrics: list[str], percentiles: list[str]) -> DataFrame:
    """One row per system and batch size of a report system -> bs_N -> struct of metrics.

    report: map<string, map<string, struct<..., end_to_end_latency: struct<percentiles>>>>. Keys other than bs_N are left out.
    """
    d = df.select(F.explode(report).alias("system", "sizes")).select("system", F.explode("sizes").alias("key", "m")).withColumn("batch_size", batch_size(F.col("key"))).where("batch_size is not null")
    return d.select("system", display_name(F.col("system")).alias("display_name"), "batch_size", *[F.col(f"m.end_to_end_latency.{p}").alias(f"end_to_end_{p}") for p in percentiles], *[F.col(f"m.{x}").alias(x) for x in metrics])


def flattened_classes(df: DataFrame, report: str, names: dict[int, str]) -> DataFrame:
    """One row per class of a report class id -> struct, with the class's name."""
    lookup = F.create_map(*[x for i, n in names.items() for x in (F.lit(i), F.lit(n))])
    d = df.select(F.explode(report).alias("cls", "m")).withColumn("cls", F.col("cls").try_cast("int"))
    return d.select("cls", F.coalesce(lookup[F.col("cls")], F.concat(F.lit("class "), F.col("cls").cast("string"))).alias("class_name"), "m.*")
