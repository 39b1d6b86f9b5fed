"""File sources and sinks with explicit not-found errors."""

from __future__ import annotations

import glob
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def resolve_inputs(path: str, suffix: str = ".csv") -> list[str]:
    """A glob, a directory or one file on a mounted file system, sorted; other schemes are left to Spark."""
    if "://" in path:
        return [path]
    found = sorted(glob.glob(path)) if any(c in path for c in "*?[") else sorted(glob.glob(os.path.join(path, f"*{suffix}"))) if os.path.isdir(path) else [path] if os.path.exists(path) else []
    if not found:
        raise FileNotFoundError(f"no input files at {path}")
    return found


def read_csv(spark: SparkSession, path: str, schema=None, delimiter: str = ",") -> DataFrame:
    """Header CSV, permissive. With a schema there is no inference pass over the data."""
    r = spark.read.options(header=True, mode="PERMISSIVE", sep=delimiter, enforceSchema=schema is not None)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(resolve_inputs(path))


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A (multi-line) JSON document; None if the file does not exist."""
    try:
        files = resolve_inputs(path, ".json")
    except FileNotFoundError:
        return None
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(files)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV part with header, for reports of a bounded size."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(path: str, payload: dict) -> None:
    """A driver-side JSON document with a UTC stamp."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload | {"ts_utc": datetime.now(UTC).isoformat()}, f, indent=2, sort_keys=True, default=str)


class RunLog:
    """Parameters once and metrics line by line in a folder."""

    def __init__(self, folder: str, params: dict):
        self.folder = folder
        write_metrics(os.path.join(folder, "params.json"), params)

    def log(self, step: int, metrics: dict) -> None:
        with open(os.path.join(self.folder, "metrics.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps({"step": step, "ts_utc": datetime.now(UTC).isoformat()} | metrics, sort_keys=True, default=str) + "\n")
