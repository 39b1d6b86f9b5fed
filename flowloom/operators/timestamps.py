"""Mixed timestamp spellings to one UTC instant.

Every text is matched against a table of shapes; a shape gives one or more *readings* (numeric dates with slashes: month
first and day first; integers: seconds, milliseconds and microseconds since 1970), valid if they name an existing date or
a plausible time. Per source, expectation-maximisation estimates how the source mixes its readings: each distinct evidence
pattern (the set of readings valid for a text) contributes its likelihood under every valid reading, next to a small
chance that the text is none of them. The posterior of each reading picks the interpretation of a text, marks it
ambiguous, or gives it up. A catalogue entry for the source (its date order) is a finite prior: `catalogue_weight` texts
seen in that order. Only pattern counts reach the EM step, one row a source, so it is independent of the number of rows.

Defined results: null, empty or unknown text gives a null instant with status 'none', and so does a text that is valid
only under a reading its source all but never uses; local time without a known zone gives 'no_zone'; several readings
with no evidence either way give 'ambiguous' (and a null instant). Doubled local times are the earlier instant; skipped
ones are read with the offset valid before the jump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import checkpointed

# Offsets of zone abbreviations.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "NST": "-03:30", "NDT": "-02:30", "BRT": "-03:00",
    "BST": "+01:00", "WET": "+00:00", "WEST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "IST": "+05:30", "JST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00",
}

ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+)?(?:\[[^\]]*\])?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:([AaPp][Mm])(?![A-Za-z]))?"
ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[Tt]|\s+)" + CLOCK + ZONE + "$"
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + CLOCK + ZONE + "$"
NAMED = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}),?\s+" + CLOCK + ZONE + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})()()" + ZONE + "$"
EPOCH = r"^[+-]?\d{1,18}$"
UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}
EVIDENCE = r"^\s*(?:\d{1,2}/\d{1,2}/\d{4}|[+-]?\d{1,18}\s*$)"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _part(text: Column, shape: Column, i: int) -> Column:
    """Group i of the text under its own shape."""
    out = None
    for name, pattern in (("iso", ISO), ("slash", SLASH), ("named", NAMED), ("compact", COMPACT)):
        e = F.regexp_extract(text, pattern, i)
        out = F.when(shape == name, e) if out is None else out.when(shape == name, e)
    return out


def parsed(df: DataFrame, text: str, zones: set[str], plausible: tuple[str, str]) -> DataFrame:
    """Adds struct __p: shape, zone or offset, and the micros of every reading: local time of both date orders (null if
    there is no such date), UTC of the three epoch units (null if not in the plausible span)."""
    t = F.trim(F.regexp_replace(F.col(f"`{text}`"), r"\s+", " "))
    df = df.withColumn("__t", t)
    t = F.col("__t")
    shape = F.when(t.rlike(ISO), "iso").when(t.rlike(SLASH), "slash").when(t.rlike(NAMED), "named").when(t.rlike(COMPACT), "compact").when(t.rlike(EPOCH), "epoch")
    df = df.withColumn("__shape", shape)
    s = F.col("__shape")
    df = df.withColumn("__g", F.when(s.isNotNull() & (s != "epoch"), F.struct(*[_part(t, s, i).alias(f"g{i}") for i in range(1, 10)])))
    g = lambda i: F.col(f"__g.g{i}")
    month_no = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(g(2))).cast("string"), 2, "0")
    two = lambda c: F.lpad(c, 2, "0")
    hour = g(4).cast("int")
    ampm = F.upper(F.when(s != "compact", g(8)).otherwise(F.lit("")))
    hour = (
        F.when(ampm == "", hour)
        .when((hour < 1) | (hour > 12), F.lit(None))
        .when(ampm == "PM", hour % 12 + 12)
        .otherwise(hour % 12)
    )
    fraction = F.when(s == "compact", F.lit("000000")).otherwise(F.rpad(F.substring(F.coalesce(g(7), F.lit("")), 1, 6), 6, "0"))
    sec = F.when(g(6) == "", F.lit("00")).otherwise(g(6))
    clock = F.concat(two(hour.cast("string")), F.lit(":"), g(5), F.lit(":"), sec)

    def micros(y: Column, m: Column, d: Column) -> Column:
        # the fraction is added apart: a text's digits beyond microseconds are dropped, never rounded
        ts = F.try_to_timestamp(F.concat(y, F.lit("-"), two(m), F.lit("-"), two(d), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss"))
        return F.unix_micros(ts) + fraction.cast("long")

    first = (
        F.when(s.isin("iso", "compact"), micros(g(1), g(2), g(3)))
        .when(s == "named", micros(g(3), month_no, g(1)))
        .when(s == "slash", micros(g(3), g(1), g(2)))
    )
    second = F.when(s == "slash", micros(g(3), g(2), g(1)))
    count = F.when(s == "epoch", t.try_cast("long"))
    low, high = (F.unix_micros(F.lit(x).cast("timestamp")) for x in plausible)
    # compared in units, so that nothing overflows
    epoch = {u: F.when((count >= F.ceil(low / k)) & (count < F.floor(high / k)), count * F.lit(k)) for u, k in UNITS.items()}
    z = F.when(s.isin("iso", "slash", "named"), g(9)).when(s == "compact", g(9)).otherwise(F.lit(""))
    abbr = F.create_map(*[x for k, w in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(w))])
    zone = (
        F.when(z == "", F.lit(None).cast("string"))
        .when(z.rlike(r"^[+-]\d{2}$"), F.concat(z, F.lit(":00")))
        .when(z.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2)))
        .when(z.rlike(r"^[+-]"), z)
        .when(z.contains("/"), F.when(F.array_contains(F.split(F.lit(",".join(sorted(zones))), ","), z), z).otherwise(F.lit("?")))
        .otherwise(F.coalesce(abbr[F.upper(z)], F.lit("?")))
    )
    return df.withColumn("__p", F.struct(s.alias("shape"), first.alias("mdy"), second.alias("dmy"), *[e.alias(u) for u, e in epoch.items()], zone.alias("zone"))).drop("__t", "__shape", "__g")


def _mask(group: list[str]) -> Column:
    """Which readings of the group are valid, as bits; two that give the same micros are one."""
    out = F.lit(0)
    for i, r in enumerate(group):
        same = [F.col(f"__p.{r}").eqNullSafe(F.col(f"__p.{q}")) for q in group[:i]]
        valid = F.col(f"__p.{r}").isNotNull()
        for x in same:
            valid = valid & ~x
        out = out + F.when(valid, 1 << i).otherwise(0)
    return out


GROUPS = {"order": ["mdy", "dmy"], "unit": list(UNITS)}


def em_shares(counts: str, prior: str, size: int, noise: float, iterations: int = 30) -> Column:
    """EM for one group of readings as column arithmetic: the source's share of each reading.

    counts: an array with the number of texts per mask of valid readings (0 to 2^size - 1); prior: an array of prior
    counts. A text is one of its valid readings, by their shares, or with weight `noise` none of them.
    """
    masks = ", ".join(f"array({', '.join(str(float(m >> k & 1)) for k in range(size))})" for m in range(1 << size))
    dot = f"(noise + aggregate(sequence(0, {size - 1}), 0D, (s, j) -> s + m[p][j] * t[j]))"
    mass = f"aggregate(sequence(1, {(1 << size) - 1}), 0D, (a, p) -> a + {counts}[p] * m[p][k] * t[k] / {dot})".replace("noise", f"{noise!r}D")
    total = "aggregate(w, 0D, (s, x) -> s + x)"
    step = f"transform(transform(sequence(0, {size - 1}), k -> {prior}[k] + {mass}), x -> x)"
    normal = f"transform(array({step}), w -> transform(w, x -> x / {total}))[0]"
    start = f"transform(array({prior}), w -> transform(w, x -> x / {total}))[0]"
    return F.expr(f"transform(array(array({masks})), m -> aggregate(sequence(1, {iterations}), {start}, (t, i) -> {normal}))[0]")


def normalise_timestamps(
    df: DataFrame,
    text: str,
    source: str,
    catalogue: DataFrame,
    out: str = "instant",
    decided: float = 0.95,
    catalogue_weight: float = 10_000.0,
    noise: float = 0.01,
    plausible: tuple[str, str] = ("1980-01-01", "2100-01-01"),
    max_broadcast_sources: int = 100_000,
) -> DataFrame:
    """Adds out (timestamp, UTC), `out`_us (bigint micros), `out`_status, `out`_reading and `out`_posterior.

    catalogue: source, tz_name, date_order ('mdy', 'dmy' or null), one row a source. A reading is taken if its posterior
    is at least `decided`; it is given up if no reading reaches 1 - decided (a slash date is none of its readings with weight
    `noise`); else the value is marked 'ambiguous' and left
    null. The shares (one row a source) are broadcast only if they are counted to be at most `max_broadcast_sources`.
    """
    spark: SparkSession = df.sparkSession
    zones = {str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()}
    cat = catalogue.select(F.col(catalogue.columns[0]).alias("__s"), F.col("tz_name").alias("__tz"), F.col("date_order").alias("__order"))
    numeric = parsed(df.where(F.col(f"`{text}`").rlike(EVIDENCE)).select(text, source), text, zones, plausible)
    numeric = numeric.select(F.col(f"`{source}`").alias("__e"), *[_mask(g).alias(n) for n, g in GROUPS.items()])
    # a number that falls into the plausible span by chance is not reckoned with
    junk = {"order": noise, "unit": 0.0}
    per_mask = {n: F.array(*[F.count_if(F.col(n) == m).cast("double") for m in range(1 << len(g))]).alias(f"n_{n}") for n, g in GROUPS.items()}
    evidence = numeric.groupBy("__e").agg(*per_mask.values())
    joined = evidence.join(cat, F.col("__e").eqNullSafe(F.col("__s")), "full").select(
        F.coalesce("__s", "__e").alias("__s2"), "__tz",
        *[F.coalesce(F.col(f"n_{n}"), F.array_repeat(F.lit(0.0), 1 << len(g))).alias(f"n_{n}") for n, g in GROUPS.items()],
        F.array(*[F.when(F.col("__order") == r, catalogue_weight).otherwise(0.0) + 1.0 for r in GROUPS["order"]]).alias("a_order"),
        F.array_repeat(F.lit(1.0), len(UNITS)).alias("a_unit"),
    )
    shares = joined.select("__s2", "__tz", *[em_shares(f"n_{n}", f"a_{n}", len(g), junk[n]).alias(f"__{n}") for n, g in GROUPS.items()])
    mix = checkpointed(shares)
    if mix.count() <= max_broadcast_sources:
        mix = F.broadcast(mix)
    j = parsed(df, text, zones, plausible).join(mix, F.col(f"`{source}`").eqNullSafe(F.col("__s2")), "left")

    def best_of(n: str, group: list[str]) -> Column:
        """(posterior, reading) of the most likely valid reading of the group."""
        share = lambda i: F.coalesce(F.get(f"__{n}", F.lit(i)), F.lit(1.0 / len(group)))
        w = [F.when(F.col(f"__p.{r}").isNotNull(), share(i)) for i, r in enumerate(group)]
        if n == "order":
            # two readings that agree are one
            agree = F.col("__p.mdy") == F.col("__p.dmy")
            w = [F.when(agree, share(0) + share(1)).otherwise(w[0]), F.when(~F.coalesce(agree, F.lit(False)), w[1])]
        total = F.lit(junk[n])
        for x in w:
            total = total + F.coalesce(x, F.lit(0.0))
        return F.greatest(*[F.when(x.isNotNull(), F.struct((x / total).alias("p"), F.lit(r).alias("r"))) for x, r in zip(w, group, strict=True)])

    only = F.struct(F.lit(1.0 / (1.0 + noise)).alias("p"), F.col("__p.shape").alias("r"))
    shape = F.col("__p.shape")
    best = F.when(shape == "slash", best_of("order", GROUPS["order"])).when(shape == "epoch", best_of("unit", GROUPS["unit"])).when(F.col("__p.mdy").isNotNull(), only)
    j = j.withColumn("__b", best)
    taken = F.col("__b.p") >= decided
    j = j.withColumn("__r", F.when(taken, F.col("__b.r")))
    r = F.col("__r")
    local = F.when(r == "dmy", F.col("__p.dmy")).when(r.isNotNull() & ~r.isin(*UNITS), F.col("__p.mdy"))
    epoch = F.coalesce(*[F.when(r == u, F.col(f"__p.{u}")) for u in UNITS])
    j = j.withColumn("__local", local).withColumn("__epoch", epoch).withColumn("__zone", F.coalesce(F.col("__p.zone"), F.col("__tz")))
    usable = F.col("__local").isNotNull() & F.col("__zone").isNotNull() & (F.col("__zone") != "?")
    instant = F.coalesce(F.timestamp_micros("__epoch"), F.when(usable, F.to_utc_timestamp(F.timestamp_micros("__local"), F.when(usable, F.col("__zone")).otherwise(F.lit("UTC")))))
    status = (
        F.when(F.col("__epoch").isNotNull() | usable, F.lit("ok"))
        .when(F.col("__b.p").isNotNull() & ~taken & (F.col("__b.p") > 1 - decided), F.lit("ambiguous"))
        .when(F.col("__local").isNotNull(), F.lit("no_zone"))
        .otherwise(F.lit("none"))
    )
    return (
        j.withColumn(out, instant)
        .withColumn(f"{out}_us", F.unix_micros(out))
        .withColumn(f"{out}_status", status)
        .withColumn(f"{out}_reading", r)
        .withColumn(f"{out}_posterior", F.col("__b.p"))
        .drop("__p", "__b", "__r", "__local", "__epoch", "__zone", "__s2", "__tz", *[f"__{n}" for n in GROUPS])
    )
