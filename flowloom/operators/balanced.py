"""Per-key results without key skew.

Rows are range-partitioned on the composite (key, secondary order) with sampled quantiles, so a heavy key spreads over
as many partitions as its share asks for. The quantiles come from a sample of bounded size and are literals of the plan:
a row's partition is a pure function of its own columns, so no two reads can disagree and nothing has to be written to
keep them in step. Every partition finishes its keys by itself. Only a key that stands in a quantile can lie in two
partitions; the partial states of those keys (at most two a partition: the proven bound under which they are
broadcast) are all that is stitched.

Costs: a count, a sample and one shuffle of the rows; states of boundary keys besides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import checkpointed, shuffle_partitions

PID = "__pid"
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


class RangeSplit:
    """Sampled quantiles of (keys, order): which partition a row belongs to and which keys may lie in several.

    Rows that agree in all these columns share a partition. Null keys form a group of their own.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, per_part: int = 60, least_rows: int = 1000, seed: int = 11):
        """parts: as many as shuffles have, but none for fewer than least_rows rows, unless given."""
        self.keys, self.cols = list(keys), list(dict.fromkeys([*keys, *order]))
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        self.kinds = [kinds[c] for c in self.cols]
        d = df.select(*_cols(self.cols))
        n = d.count()
        self.parts = parts or max(1, min(shuffle_partitions(df.sparkSession), n // least_rows))
        self.bounds = self._quantiles(d, n, per_part * self.parts, seed) if self.parts > 1 else []

    def _row(self, n: int) -> Column:
        return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(_cols(self.cols[:n]))])

    def _quantiles(self, d: DataFrame, n: int, size: int, seed: int) -> list[str]:
        """At most parts - 1 rows as JSON, in order. One task sorts the sample, as structs are compared: nulls first."""
        if n > size:
            d = d.sample(min(1.0, 1.1 * size / n), seed)
        r = d.agg(F.sort_array(F.collect_list(self._row(len(self.cols)))).alias("r"))
        pick = F.transform(F.sequence(F.lit(1), F.lit(self.parts - 1)), lambda i: F.get("r", F.floor(F.size("r") * i / self.parts).cast("int")))
        rows = r.select(F.transform(pick, lambda x: F.to_json(x, {"ignoreNullFields": "false"}))).first()[0]
        return list(dict.fromkeys(x for x in rows or [] if x is not None))

    def _literal(self, n: int) -> Column:
        """The first n columns of the quantiles, as an array of structs that the optimizer folds to a literal."""
        kind = ", ".join(f"c{i}: {k}" for i, k in enumerate(self.kinds[:n]))
        return F.from_json(F.lit(f"[{','.join(self.bounds)}]"), f"array<struct<{kind}>>")

    @cached_property
    def pid(self) -> Column:
        """The number of quantiles that are not above the row, by binary search."""
        last = len(self.bounds)
        if not last:
            return F.lit(0)
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(last.bit_length()))])
        b = self._literal(len(self.cols))

        def search(row: Column) -> Column:
            return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= last) & (F.get(b, p + s - 1) <= row), p + s).otherwise(p))

        # the array of one makes the row a variable
        return F.transform(F.array(self._row(len(self.cols))), search)[0]

    @cached_property
    def on_edge(self) -> Column:
        """Whether the row's key stands in a quantile, so that it may lie in several partitions."""
        if not self.bounds:
            return F.lit(False)
        n = len(self.keys)
        return F.array_contains(F.array_distinct(self._literal(n)), self._row(n))

    def split(self, df: DataFrame, distinct: bool = False) -> DataFrame:
        """The rows in their partitions; distinct keeps one row of those equal in keys and order, without an exchange."""
        d = df.withColumn(PID, self.pid).repartitionById(self.parts, F.col(PID))
        return d.dropDuplicates([PID, *self.cols]) if distinct else d


def balanced_agg(df: DataFrame, keys: Sequence[str], order: Sequence[str], aggs: dict[str, tuple[str, str | None]], distinct: bool = False, parts: int | None = None) -> DataFrame:
    """groupBy(keys) with aggs {name: (count | sum | min | max, column or None for rows)}, over a range split.

    distinct=True first reduces rows equal in keys and order to one; such rows share a partition. Each partition aggregates
    its keys to the end; of the states (written once: one a key, and at most one more a partition) only those of
    boundary keys are merged. An empty input gives no rows; null keys give a row with a null key.
    """
    rs = RangeSplit(df, keys, order, parts)
    narrow = df.select(*_cols(dict.fromkeys([*rs.cols, *[c for _, c in aggs.values() if c]])))
    first = [getattr(F, f)(F.col(f"`{c}`") if c else F.lit(1)).alias(name) for name, (f, c) in aggs.items()]
    states = rs.split(narrow, distinct).groupBy(PID, *_cols(keys)).agg(*first)
    states = checkpointed(states.withColumn("__edge", rs.on_edge).drop(PID))
    merged = states.where("__edge").groupBy(*_cols(keys)).agg(*[MERGE[f](F.col(f"`{name}`")).alias(name) for name, (f, _) in aggs.items()])
    return states.where("not __edge").drop("__edge").unionByName(merged)


def balanced_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column | dict[str, Column] | None = None,
    out: str = "running",
    exclusive: bool = False,
    distinct: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Running sum (default: running count, i.e. the rank) of value per key in the given order, without a task per key.

    A dict of values gives several sums by name. order must be a total order within a key for a defined result.
    exclusive=True leaves the row itself out; distinct=True first reduces rows equal in keys and order to one. Null values
    count as zero. Empty input gives an empty result with the same schema. df is read four times (count, sample, boundary
    states, result), so it should be cheap to read.
    """
    rs = RangeSplit(df, keys, order, parts)
    values = value if isinstance(value, dict) else {out: F.lit(1).cast("long") if value is None else value}
    d = df.withColumns({f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(values.values())})
    vs = [f"__v{i}" for i in range(len(values))]
    key = F.struct(*_cols(keys))
    local = Window.partitionBy(PID, *_cols(keys)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rs.split(d, distinct).withColumns({o: F.sum(v).over(local) - (F.col(v) if exclusive else F.lit(0)) for o, v in zip(values, vs, strict=True)})
    if not rs.bounds:
        return ranked.drop(PID, *vs)
    states = rs.split(d.where(rs.on_edge).select(*_cols(rs.cols), *vs), distinct).groupBy(PID, key.alias("__k2")).agg(*[F.sum(v).alias(v) for v in vs])
    # one row per boundary key and partition: a heavy key has at most as many rows here as there are partitions
    before = Window.partitionBy("__k2").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select(F.col(PID).alias("__p2"), "__k2", F.struct(*[F.sum(v).over(before).alias(v) for v in vs]).alias("__carry"))
    ranked = ranked.join(F.broadcast(carried), (F.col(PID) == F.col("__p2")) & key.eqNullSafe(F.col("__k2")), "left")
    ranked = ranked.withColumns({o: F.col(f"`{o}`") + F.coalesce(f"__carry.{v}", F.lit(0)) for o, v in zip(values, vs, strict=True)})
    return ranked.drop(PID, *vs, "__p2", "__k2", "__carry")


def balanced_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str, parts: int | None = None) -> DataFrame:
    """lag(column) per key in the given order; the first row of a partition takes it from the last row before."""
    rs = RangeSplit(df, keys, order, parts)
    key, x = F.struct(*_cols(keys)), F.struct(F.col(f"`{column}`").alias("x"))
    ends = df.where(rs.on_edge).withColumn(PID, rs.pid).groupBy(PID, key.alias("__k2")).agg(F.max_by(x, F.struct(*_cols(order))).alias("__last"))
    prev = ends.withColumn("__prev", F.lag("__last").over(Window.partitionBy("__k2").orderBy(PID))).where("__prev is not null")
    prev = prev.select(F.col(PID).alias("__p2"), "__k2", "__prev")
    local = Window.partitionBy(PID, *_cols(keys)).orderBy(*_cols(order))
    ranked = rs.split(df).withColumn("__n", F.row_number().over(local)).withColumn("__lag", F.lag(x).over(local))
    ranked = ranked.join(F.broadcast(prev), (F.col(PID) == F.col("__p2")) & key.eqNullSafe(F.col("__k2")), "left")
    return ranked.withColumn(out, F.when(F.col("__n") == 1, F.col("__prev.x")).otherwise(F.col("__lag.x"))).drop(PID, "__n", "__lag", "__p2", "__k2", "__prev")


def balanced_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str, parts: int | None = None) -> DataFrame:
    """The last value of column that is not null, per key in the given order up to the row itself: an as-of lookup."""
    rs = RangeSplit(df, keys, order, parts)
    key, x = F.struct(*_cols(keys)), F.col(f"`{column}`")
    seen = df.where(rs.on_edge & x.isNotNull()).withColumn(PID, rs.pid).groupBy(PID, key.alias("__k2")).agg(F.max_by(x, F.struct(*_cols(order))).alias("__last"))
    # every partition of a boundary key, also those without a value of their own
    every = df.where(rs.on_edge).select(rs.pid.alias(PID), key.alias("__k2")).distinct()
    before = Window.partitionBy("__k2").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    prev = every.join(seen.select(F.col(PID).alias("__p3"), F.col("__k2").alias("__k3"), "__last"), (F.col(PID) == F.col("__p3")) & F.col("__k2").eqNullSafe(F.col("__k3")), "left")
    prev = prev.select(F.col(PID).alias("__p2"), "__k2", F.last("__last", ignorenulls=True).over(before).alias("__prev"))
    local = Window.partitionBy(PID, *_cols(keys)).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rs.split(df).withColumn(out, F.last(x, ignorenulls=True).over(local))
    ranked = ranked.join(F.broadcast(prev), (F.col(PID) == F.col("__p2")) & key.eqNullSafe(F.col("__k2")), "left")
    return ranked.withColumn(out, F.coalesce(F.col(f"`{out}`"), F.col("__prev"))).drop(PID, "__p2", "__k2", "__prev")


def heavy_keys(counts: DataFrame, key: str, n: str, one_in: int) -> DataFrame:
    """Keys of a (key, n) count table that hold at least one in `one_in` of all counted rows; null is no key."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(key).isNotNull() & (F.col(n) * F.lit(one_in) >= total))
