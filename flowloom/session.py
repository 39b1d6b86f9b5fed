"""Session factory and the few session-level helpers the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "flowloom",
    master: str | None = None,
    driver_memory: str | None = None,
    shuffle_partitions: int | None = None,
    adaptive: bool = True,
    compression: str = "zstd",
    default_parallelism: int | None = None,
    dynamic_allocation: tuple[int, int] | None = None,
    checkpoint_dir: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session in UTC with AQE, Arrow and compressed Parquet; unset values keep the cluster's own.

    dynamic_allocation: least and most executors.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if default_parallelism:
        b = b.config("spark.default.parallelism", str(default_parallelism))
    if dynamic_allocation:
        least, most = dynamic_allocation
        b = b.config("spark.dynamicAllocation.enabled", "true").config("spark.dynamicAllocation.minExecutors", str(least)).config("spark.dynamicAllocation.maxExecutors", str(most))
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", str(adaptive).lower())
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", compression)
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session (tests, a laptop), where driver and executors are one process, gets a folder of its own, which
    goes with the process. Elsewhere an unset folder is an error: no machine-local folder can serve several hosts.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
    folder = tempfile.mkdtemp(prefix="flowloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint. Its files go once nothing refers to it (cleanCheckpoints, see build_session)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
