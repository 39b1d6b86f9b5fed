"""A sample matching target category proportions, by swap repair.

Start: every category draws its floor at random, and the rest of the sample is drawn at random from all other rows, so
the start satisfies the floors wherever there are rows for them. Rows of one signature (the values of all target columns
together) are interchangeable, so the start is known by its signature counts, and only counts are exchanged: one
signature gives, another takes, as many rows as keep lowering the total deviation from the targets, until no exchange
improves (without `fill` also with the rows that are not drawn). A floor that is met is never given up. The counts are then materialised at random, by md5 rank within each
signature; ranks come from the range-partitioned running count, so a signature with a third of all rows is spread over
many tasks.

The exchange never compares signatures with each other. What a row brings is a sum over its columns of its category's
marginal gain, so the best giver and the best taker are the two extremes; only an exchange that keeps one column's value
needs more, and there the signatures that share the value are looked through. With c categories a column and s signatures
a step costs s, and each step moves as many rows as stay improving.

Defined results: rows with a null or untargeted value have a target of 0; a category is unmet (met = false) if fewer rows
than its target or floor are in the drawn sample; all of its rows are then taken if no other target forbids it. Ties in
the hash are broken by key. Empty input gives no rows, and every category that wants a row is unmet.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.sampling import hash_rank

Target = dict[str | None, tuple[float, int]]


def wanted(share: float, size: int, floor: int) -> int:
    """max(floor, share x size rounded half up)."""
    return max(floor, int((Decimal(repr(float(share))) * size).to_integral_value(ROUND_HALF_UP)))


def _order(s: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in s)


def random_start(have: np.ndarray, code: np.ndarray, floors: list[np.ndarray], size: int, seed: int) -> np.ndarray:
    """Signature counts of a random sample without replacement that satisfies the floors as far as there are rows.

    Per column and category the rows that its floor still lacks are drawn first, then the rest from all rows left.
    """
    r = np.random.default_rng(seed)
    take = np.zeros_like(have)

    def draw(among: np.ndarray, n: int) -> None:
        left = (have - take)[among]
        n = int(min(n, left.sum(), size - take.sum()))
        if n > 0:
            # below 10^9 rows the exact multivariate hypergeometric draw; above, its multinomial limit with the rest by size
            if left.sum() < 10**9:
                got = r.multivariate_hypergeometric(left, n, method="marginals")
            else:
                got = np.minimum(r.multinomial(n, left / left.sum()), left)
                for i in np.argsort(got - left)[: len(left)]:
                    lack = n - int(got.sum())
                    got[i] += min(lack, left[i] - got[i])
            take[among] += got

    for i, floor in enumerate(floors):
        for c in np.flatnonzero(floor):
            among = np.flatnonzero(code[:, i] == c)
            draw(among, int(floor[c] - take[among].sum()))
    draw(np.arange(len(have)), size - int(take.sum()))
    return take


def swap_repair(have: dict[tuple, int], targets: list[Target], size: int, seed: int = 5, fill: bool = True) -> dict[tuple, int]:
    """Counts per signature that sum to min(size, rows) and have no improving exchange left.

    Without fill, rows may also be put back or drawn without an exchange where that lowers the deviation: categories short
    of rows leave the sample smaller instead of others larger, floors above the shares make it larger.
    """
    rows = sum(have.values())
    size = min(size, rows)
    signatures = sorted(have, key=_order)
    if not signatures or not targets:
        return dict.fromkeys(have, 0)
    n = np.array([have[s] for s in signatures], dtype=np.int64)
    values = [sorted({s[i] for s in signatures} | set(t), key=lambda v: (v is not None, str(v))) for i, t in enumerate(targets)]
    place = [{v: k for k, v in enumerate(vs)} for vs in values]
    code = np.array([[place[i][v] for i, v in enumerate(s)] for s in signatures], dtype=np.int64)
    goal = [np.array([wanted(*_args(t, v, size)) if v in t else 0 for v in vs], dtype=np.int64) for t, vs in zip(targets, values, strict=True)]
    floor = [np.array([t[v][1] if v in t else 0 for v in vs], dtype=np.int64) for t, vs in zip(targets, values, strict=True)]
    take = random_start(n, code, floor, size, seed)
    now = [np.bincount(code[:, i], weights=take, minlength=len(vs)).astype(np.int64) for i, vs in enumerate(values)]
    # floors weigh more than any deviation, so that they are met first and never given up
    heavy = 4 * size + 4

    def step_gain(i: int, by: int) -> np.ndarray:
        """What one row more (by = 1) or less (by = -1) of each category of column i gains."""
        c, t, f = now[i], goal[i], floor[i]
        return np.abs(c - t) - np.abs(c + by - t) + heavy * (np.maximum(0, f - c) - np.maximum(0, f - c - by))

    columns = range(len(targets))
    never = np.iinfo(np.int64).min // 4
    while True:
        less, more = [step_gain(i, -1) for i in columns], [step_gain(i, 1) for i in columns]
        out = np.where(take > 0, sum(less[i][code[:, i]] for i in columns), never)
        into = np.where(n > take, sum(more[i][code[:, i]] for i in columns), never)
        a, b = int(out.argmax()), int(into.argmax())
        options = [(_pair_gain(code, less, more, a, b), a, b)] if take[a] > 0 and n[b] > take[b] else []
        if not fill:
            options += [(int(out[a]), a, -1), (int(into[b]), -1, b)]
        # exchanges that keep one column's value do not pay for it: best giver and taker of each shared value
        for i in columns if len(targets) > 1 else ():
            giver, taker = (_best_of_value(code[:, i], np.where(x > never, x - y[i][code[:, i]], never)) for x, y in ((out, less), (into, more)))
            options += [(_pair_gain(code, less, more, g, t), g, t) for g, t in zip(giver, taker, strict=True) if take[g] > 0 and n[t] > take[t]]
        gain, a, b = max(options, key=lambda x: x[0], default=(0, -1, -1))
        if gain <= 0:
            break
        # every column's gain stays the same until its count reaches the target or the floor
        most = int(min(take[a] if a >= 0 else size + rows, n[b] - take[b] if b >= 0 else size + rows))
        for i in columns:
            x, y = (code[a, i] if a >= 0 else -1), (code[b, i] if b >= 0 else -1)
            if x != y:
                steps = [now[i][x] - goal[i][x], now[i][x] - floor[i][x]] if x >= 0 else []
                steps += [goal[i][y] - now[i][y], floor[i][y] - now[i][y]] if y >= 0 else []
                most = min([most, *(int(d) for d in steps if d > 0)])
        for at, by in ((a, -most), (b, most)):
            if at >= 0:
                take[at] += by
                for i in columns:
                    now[i][code[at, i]] += by
    return {s: int(k) for s, k in zip(signatures, take, strict=True)}


def _best_of_value(code: np.ndarray, gain: np.ndarray) -> list[int]:
    """Per value that occurs, in order, the signature with the largest gain."""
    order = np.lexsort((-gain, code))
    return order[np.unique(code[order], return_index=True)[1]].tolist()


def _args(t: Target, v, size: int) -> tuple[float, int, int]:
    share, floor = t[v]
    return share, size, floor


def _pair_gain(code: np.ndarray, less: list[np.ndarray], more: list[np.ndarray], a: int, b: int) -> int:
    return int(sum(less[i][code[a, i]] + more[i][code[b, i]] for i in range(len(less)) if code[a, i] != code[b, i]))


def quota_sample(df: DataFrame, key: str, columns: list[str], targets: list[Target], size: int | None = None, fraction: int = 4, seed: int = 5, fill: bool = True) -> tuple[DataFrame, DataFrame]:
    """The sample and the report of it (see quota_report).

    size defaults to one in `fraction` of all rows. The driver holds one count a signature: combinations of category
    values, not rows.
    """
    spark = df.sparkSession
    counted = df.groupBy(*columns).agg(F.count("*").alias("n")).collect()
    have = {tuple(r[c] for c in columns): r["n"] for r in counted}
    n_rows = sum(have.values())
    size = n_rows // fraction if size is None else size
    take = swap_repair(have, targets, size, seed, fill)
    goals = []
    for i, (c, t) in enumerate(zip(columns, targets, strict=True)):
        available: dict = {}
        for s, k in have.items():
            available[s[i]] = available.get(s[i], 0) + k
        goals += [(c, v, available.get(v, 0), wanted(share, size, floor)) for v, (share, floor) in t.items()]
    schema = ", ".join(f"`__{c}` {t}" for c, t in df.select(*columns).dtypes) + ", __take long"
    plan = spark.createDataFrame([(*s, n) for s, n in take.items() if n], schema)
    ranked = hash_rank(df, columns, key, seed, out="__rank")
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # a plan of a few thousand signatures is broadcast, a longer one is joined by its columns
    drawn = ranked.join(F.broadcast(plan) if len(take) <= 10_000 else plan, cond).where(F.col("__rank") <= F.col("__take"))
    drawn = drawn.drop("__rank", "__take", *[f"__{c}" for c in columns])
    return drawn, quota_report(drawn, spark.createDataFrame(goals, "column_name string, category string, available long, wanted long"), columns)


def quota_report(sample: DataFrame, goals: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and category: rows available, wanted and drawn, and whether the drawn rows reach what is wanted."""
    parts = None
    for c in columns:
        p = sample.groupBy(F.col(c).cast("string").alias("category")).agg(F.count("*").alias("drawn")).withColumn("column_name", F.lit(c))
        parts = p if parts is None else parts.unionByName(p)
    j = goals.join(parts, ["column_name", "category"], "left").fillna(0, ["drawn"])
    return j.withColumn("met", F.col("drawn") >= F.col("wanted"))
