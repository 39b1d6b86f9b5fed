"""Deterministic samples: ranks by md5(id:seed), the same on every engine and in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.balanced import balanced_running


def md5_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_rank(df: DataFrame, keys: list[str], key: str, seed: int = 42, out: str = "rn") -> DataFrame:
    """Random but repeatable rank of each row within its group; a hot group is spread over range partitions."""
    return balanced_running(df.withColumn("__m", md5_key(key, seed)), keys, ["__m", key], out=out).drop("__m")


def capped(df: DataFrame, group: str, key: str, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """At most caps[group] random rows of a group; groups without a cap are kept whole."""
    m = F.create_map(*[x for g, n in caps.items() for x in (F.lit(g), F.lit(n))])
    r = hash_rank(df, [group], key, seed)
    return r.where(F.col("rn") <= F.coalesce(m[F.col(group)], F.lit(2147483647))).drop("rn")


def proportional(df: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """Per group max(1, min(n, round_half_even(total n / N))) random rows."""
    counts = df.groupBy(group).agg(F.count("*").alias("__n"))
    quota = F.greatest(F.lit(1), F.least(F.col("__n"), F.bround(F.lit(float(total)) * F.col("__n") / counts.agg(F.sum("__n")).scalar()).cast("long")))
    q = counts.select(F.col(group).alias("__g"), quota.alias("__q"))
    r = hash_rank(df, [group], key, seed)
    return r.join(q, F.col(group).eqNullSafe(F.col("__g"))).where("rn <= __q").drop("rn", "__g", "__q")


def equal_per_group(df: DataFrame, group: str, key: str, total: int, n_groups: int, seed: int = 42) -> DataFrame:
    """max(1, total // n_groups) random rows a group; a constant rank bound is pruned before the shuffle."""
    w = Window.partitionBy(group).orderBy(md5_key(key, seed), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, total // max(1, n_groups))).drop("rn")


def split(df: DataFrame, group: str, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42, least: int = 10) -> DataFrame:
    """Stratified split: rank / n within the group decides; groups below `least` rows are all train."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    r = hash_rank(df, [group], key, seed).join(n, F.col(group).eqNullSafe(F.col("__g")))
    q = F.col("rn") / F.col("__n")
    out = F.when((F.col("__n") < least) | (q <= train), "train").when(q <= train + val, "val").otherwise("test")
    return r.withColumn("split", out).drop("rn", "__g", "__n")


def joined_splits(df: DataFrame, split: str, of: list[str], name: str) -> DataFrame:
    """The rows of several splits as one split, in one pass."""
    return df.where(F.col(split).isin(*of)).withColumn(split, F.lit(name))


def random_batch(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows: a top-n by hash, taken per partition first."""
    return df.orderBy(md5_key(key, seed), key).limit(n)


def weighted_resample(df: DataFrame, group: str, key: str, alpha: float, draws: int, seed: int = 42) -> DataFrame:
    """`draws` draws with replacement, a row's chance ~ its group's size^-alpha.

    Each draw is a hashed uniform; groups are chosen by cumulative group weight (one row a group) and rows by rank
    within the group, so no cumulative sum over rows and no range join is needed.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__w", F.pow(F.col("__n"), F.lit(1.0 - alpha)))
    w = Window.orderBy(group)
    # one row a group: the window is over categories, not rows
    cum = counts.withColumn("__hi", F.sum("__w").over(w)).withColumn("__all", F.sum("__w").over(Window.partitionBy()))
    bins = cum.agg(F.sort_array(F.collect_list(F.struct((F.col("__hi") / F.col("__all")).alias("hi"), F.col(group).alias("g"), F.col("__n").alias("n")))).alias("bins"))
    u = lambda tag: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}{tag}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    d = df.sparkSession.range(draws).withColumn("__bins", bins.scalar()).withColumn("__u", u("a"))
    pick = F.coalesce(F.filter("__bins", lambda b: b["hi"] > F.col("__u"))[0], F.element_at("__bins", -1))
    d = d.withColumn("__b", pick).select(F.col("id").alias("draw"), F.col("__b.g").alias("__g"), (F.floor(u("b") * F.col("__b.n")) + 1).alias("__r"))
    r = hash_rank(df, [group], key, seed)
    return d.join(r, (F.col("__g") == F.col(group)) & (F.col("__r") == F.col("rn"))).drop("__g", "__r", "rn")
