"""Column discovery, cleaning, assembling, scaling, and the quality gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)


def normalise_names(names: list[str]) -> list[str]:
    """Trimmed; blank, slash and hyphen as underscore, no parentheses, single underscores; repeats get _1, _2 ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        m = re.sub("_+", "_", re.sub(r"[()]", "", re.sub(r"[ /\-]", "_", n.strip())))
        k = seen.get(m, -1) + 1
        seen[m] = k
        out.append(f"{m}_{k}" if k else m)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_names(df.columns))


def trim_strings(df: DataFrame) -> DataFrame:
    """Every string column trimmed, the rest untouched."""
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def resolve_column(df: DataFrame, name: str) -> str | None:
    """The column's own spelling, whatever the case; of several the last."""
    return {c.lower(): c for c in df.columns}.get(name.lower())


def timestamp_column(df: DataFrame) -> str | None:
    """The first column whose name tells of a time."""
    return next((c for c in df.columns if any(w in c.lower() for w in ("timestamp", "time", "date"))), None)


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude)


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def clean_number(c: Column, big: float = 1e6) -> Column:
    """Double with null, NaN and what is no number as 0 and the infinities as +-big."""
    d = c.try_cast("double")
    inf = float("inf")
    return F.when(d.isNull() | F.isnan(d), 0.0).when(d == inf, big).when(d == -inf, -big).otherwise(d)


def clean_numbers(df: DataFrame, cols: list[str], big: float = 1e6) -> DataFrame:
    """All columns in one projection."""
    return df.withColumns({c: clean_number(F.col(f"`{c}`"), big) for c in cols})


def assembled(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").try_cast("double") for c in cols]))


def std_scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column by its sample deviation (a constant column becomes 0); the one stats row is a scalar subquery."""
    return _with_stats(df, df, cols, lambda x, mean, std: F.when(std > 0, x / std).otherwise(0.0))


def zscored(df: DataFrame, fit_on: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / std with statistics of fit_on only; a zero deviation counts as 1."""
    return _with_stats(df, fit_on, cols, lambda x, mean, std: (x - mean) / F.when(std == 0, 1.0).otherwise(std))


def _with_stats(df: DataFrame, fit_on: DataFrame, cols: list[str], f) -> DataFrame:
    """f(value, mean, deviation) of each column. Statistics go by position: a name may hold dots, blanks or slashes."""
    x = lambda c: F.col(f"`{c}`")
    stats = fit_on.agg(F.struct(*[F.struct(F.avg(x(c)).alias("m"), F.stddev_samp(x(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(cols)]).alias("st")).scalar()
    j = df.withColumn("__st", stats)
    return j.withColumns({c: f(x(c), F.col(f"__st.c{i}.m"), F.col(f"__st.c{i}.s")) for i, c in enumerate(cols)}).drop("__st")


# Formats tried in this order after ISO, so a day up to 12 reads month first.
TIME_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss"]


def parsed_time(text: Column, formats: list[str] | None = None, iso: bool = True) -> Column:
    """The timestamp of the first format that fits, ISO first; null if none does."""
    t = F.trim(text.cast("string"))
    return F.coalesce(*([t.try_cast("timestamp")] if iso else []), *[F.try_to_timestamp(t, F.lit(f)) for f in (TIME_FORMATS if formats is None else formats)])


def null_rate(df: DataFrame, c: str) -> DataFrame:
    """One row: rows, nulls, rate (0 for no rows), in one pass."""
    s = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"))
    return s.withColumn("null_rate", F.when(F.col("n_rows") == 0, 0.0).otherwise(F.round(F.col("n_null") / F.col("n_rows"), 6)))


def require_null_rate(df: DataFrame, c: str, most: float) -> None:
    rate = null_rate(df, c).first()["null_rate"]
    if rate > most:
        raise ValueError(f"{c}: null rate {rate:.4f} is above {most}")


def require_rows(df: DataFrame, least: int) -> None:
    """Stops at `least` rows; the rest are not counted."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are needed")


def class_weights(counts: DataFrame, n: str, power: float = 1.0, normalise: bool = True) -> DataFrame:
    """counts (one row a class) with weight (sum n / (n C))^power, divided by the mean weight if normalise."""
    stats = counts.agg(F.struct(F.sum(n).alias("t"), F.count("*").alias("c"))).scalar()
    w = counts.withColumn("__s", stats).withColumn("weight", F.pow(F.col("__s.t") / (F.greatest(F.col(n), F.lit(1)) * F.col("__s.c")), F.lit(power))).drop("__s")
    return w.withColumn("weight", F.col("weight") / w.agg(F.avg("weight")).scalar()) if normalise else w


def replicated(df: DataFrame, k: int, out: str = "replica_id") -> DataFrame:
    """k copies of every row numbered 0..k-1 by exploding a literal sequence; k <= 1 leaves the frame as it is."""
    return df if k <= 1 else df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
