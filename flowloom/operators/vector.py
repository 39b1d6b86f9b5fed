"""Vector operators on array columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import checkpointed


def _bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def clean_vector(c: Column) -> Column:
    """null, NaN and infinite entries as 0, as doubles."""
    return F.transform(c, lambda v: F.when(_bad(v), F.lit(0.0)).otherwise(v.cast("double")))


def l2_normalised(c: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(F.array(norm), lambda n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0))))[0]


def vector_validation(df: DataFrame, c: str) -> DataFrame:
    """One row of totals over all rows: vectors, null vectors, lengths, NaN, infinite and null entries."""
    v = F.col(c)
    n = lambda f: F.coalesce(F.sum(F.size(F.filter(v, f))), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("null_vectors"), F.min(F.size(v)).alias("min_size"), F.max(F.size(v)).alias("max_size"),
        n(lambda x: x.isNull()).alias("null_entries"), n(lambda x: F.isnan(x)).alias("nan_entries"), n(lambda x: F.abs(x) == float("inf")).alias("inf_entries"),
    )


def validation_report(df: DataFrame, c: str) -> DataFrame:
    """(metric, value): totals of NaN and infinite entries, rows, vector length (-1 if vectors differ) and entries."""
    v = F.col(c)
    n = lambda f: F.coalesce(F.sum(F.size(F.filter(v, f))), F.lit(0)).cast("long")
    inf = float("inf")
    row = df.agg(
        n(lambda x: F.isnan(x)).alias("nan_total"), n(lambda x: x == inf).alias("pos_inf_total"), n(lambda x: x == -inf).alias("neg_inf_total"), F.count("*").alias("total_rows"),
        F.when(F.min(F.size(v)) == F.max(F.size(v)), F.max(F.size(v))).otherwise(-1).cast("long").alias("vector_length"), F.coalesce(F.sum(F.size(v)), F.lit(0)).cast("long").alias("total_feature_values"),
    )
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in row.columns])).alias("r")).select("r.*")


def require_finite(report: DataFrame) -> None:
    bad = {r["metric"]: r["value"] for r in report.where("metric in ('nan_total', 'pos_inf_total', 'neg_inf_total') and value > 0").collect()}
    if bad:
        raise ValueError(f"entries that are not finite: {bad}")


def prefix_overwritten(c: Column, first: Column) -> Column:
    """The array with its first entries replaced by those of `first` (as a perturbed hop 0 in front of clean hops)."""
    return F.concat(first, F.slice(c, F.size(first) + 1, F.greatest(F.size(c) - F.size(first), F.lit(0))))


def softmax(c: Column) -> Column:
    top = F.transform(F.array(F.struct(c.alias("c"), F.array_max(c).alias("m"))), lambda v: F.transform(v["c"], lambda x: F.exp(x - v["m"])))[0]
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(top), lambda e: F.transform(F.array(total(e)), lambda n: F.transform(e, lambda x: x / n))[0])[0]


def argmax(c: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def _best(near: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best rows a src; all but the k best of a partition are dropped before the shuffle."""
    w = Window.partitionBy("src").orderBy(F.desc("weight") if largest else F.col("weight"), "dst")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _top_of_block(q: pd.DataFrame, p: pd.DataFrame, k: int, metric: str, digits: int, least: float | None = None, slice_rows: int = 512) -> pd.DataFrame:
    """(src, dst, weight): for each row of q its k best of p, other than itself; products in slices of bounded size."""
    a, b = np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy())
    qa, pb = q["id"].to_numpy(), p["id"].to_numpy()
    # ordered by id, so ties keep the smaller id
    by_id = np.argsort(pb, kind="stable")
    b, pb = b[by_id], pb[by_id]
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        a, b = a / np.where(na > 0, na, 1)[:, None], b / np.where(nb > 0, nb, 1)[:, None]
    out = []
    for lo in range(0, len(a), slice_rows):
        x, ids = a[lo : lo + slice_rows], qa[lo : lo + slice_rows]
        s = x @ b.T if metric == "cosine" else -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * x @ b.T, 0))
        s = np.round(s, digits)
        s[ids[:, None] == pb[None, :]] = -np.inf
        if least is not None:
            s[s < least] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, 1)
        rows, cols = np.nonzero(np.isfinite(top))
        w = top[rows, cols]
        out.append(pd.DataFrame({"src": ids[rows], "dst": pb[order[rows, cols]], "weight": w if metric == "cosine" else -w}))
    return pd.concat(out) if out else _nothing()


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "weight": pd.Series(dtype="float64")})


def exact_knn(df: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", threshold: float | None = None, blocks: int | None = None, block_rows: int = 4096, digits: int = 6) -> DataFrame:
    """(src, dst, weight): the k nearest others of every vector, exactly, by blocks of matrix products.

    metric cosine (larger is nearer) or l2 (smaller is nearer). Scores are rounded, ties go to the smaller id. Unless
    their number is given, blocks hold about block_rows vectors however many there are. Work is quadratic: for collections too large for that use knn_ivf, or
    the graph index of the training-data package.
    """
    v = df.select(F.col(key).alias("id"), clean_vector(F.col(vector)).alias("x"))
    blocks = blocks or max(1, math.ceil(v.count() / block_rows))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries, base = v.withColumnRenamed("b", "qb").withColumn("b", each), v.withColumn("qb", each)

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return _top_of_block(q, p, k, metric, digits) if len(q) and len(p) else _nothing()

    near = queries.groupBy("qb", "b").cogroup(base.groupBy("qb", "b")).applyInPandas(run, "src long, dst long, weight double")
    out = _best(near, k, metric == "cosine")
    if threshold is not None:
        out = out.where(F.col("weight") >= threshold if metric == "cosine" else F.col("weight") <= threshold)
    return out


def distinct_vectors(v: DataFrame) -> DataFrame:
    """(id, x): every distinct vector once, with the smallest id of its copies."""
    return v.groupBy("x").agg(F.min("id").alias("id")).select("id", "x")


def knn_ivf(df: DataFrame, key: str, vector: str, k: int, cells: int = 16, probes: int = 4, sample: int = 20_000, threshold: float | None = None, block_rows: int = 8192) -> DataFrame:
    """(src, dst, weight): approximate k nearest by cosine. Cells come from KMeans on about `sample` vectors at most; every
    vector is indexed in its nearest cell and looked up in its `probes` nearest ones; all probes = exact.

    Exact copies are one class, only classes meet in the cells. A class needs the k + 1 nearest classes (itself included)
    and of each the k + 1 smallest ids: no other row can be among the k nearest of one of its rows. A cell is searched by
    matrix products between blocks of at most about block_rows members and queries, each of which gives only its own best.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(F.col(key).alias("id"), l2_normalised(clean_vector(F.col(vector))).alias("x"))
    classes = checkpointed(distinct_vectors(v)).toDF("id", "x")
    n = classes.count()
    if not n:
        return df.sparkSession.createDataFrame([], "src long, dst long, weight double")
    train = (classes if n <= sample else classes.sample(sample / n, 1)).select(array_to_vector("x").alias("features"))
    centres = np.array(KMeans(k=cells, seed=1, maxIter=10).fit(train).clusterCenters())
    n_probe = min(probes, len(centres))

    def assign(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, centres.shape[1]))
            d = x @ centres.T * 2 - (centres * centres).sum(1)
            pdf["c"] = list(np.argsort(-d, axis=1)[:, :n_probe].astype("int32"))
            yield pdf

    assigned = classes.mapInPandas(assign, "id long, x array<double>, c array<int>")
    # one row a cell: how many blocks its members and its queries fill
    sizes = assigned.select(F.col("c")[0].alias("own"), F.explode("c").alias("cell")).groupBy("cell").agg(F.count_if(F.col("own") == F.col("cell")).alias("m"), F.count("*").alias("q"))
    sizes = sizes.select("cell", *[F.greatest(F.lit(1), F.ceil(F.col(c) / block_rows)).cast("int").alias(c) for c in ("m", "q")])
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = assigned.select("id", "x", F.explode("c").alias("cell")).join(F.broadcast(sizes), "cell").withColumn("qb", dealt("q")).withColumn("mb", every("m"))
    right = assigned.select("id", "x", F.col("c")[0].alias("cell")).join(F.broadcast(sizes), "cell").withColumn("mb", dealt("m")).withColumn("qb", every("q"))
    keys = ["cell", "qb", "mb"]

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return _nothing()
        others = _top_of_block(q, p, k, "cosine", 6, threshold)
        # the class itself: its copies are as near as can be
        both = q[["id", "x"]].merge(p[["id"]], on="id")
        own = pd.DataFrame({"src": both["id"], "dst": both["id"], "weight": np.round([float(np.dot(x, x)) for x in both["x"]], 6)})
        return pd.concat([others, own if threshold is None else own[own["weight"] >= threshold]])

    # both sides come from one frame: new names keep their columns apart
    left, right = (d.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", *keys)]).toDF("id", "x", *keys) for s, d in (("q", left), ("m", right)))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "src long, dst long, weight double")
    member = v.join(classes.select(F.col("id").alias("class"), F.col("x").alias("y")), F.col("x") == F.col("y")).select("id", "class")
    first = member.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("r") <= k + 1).select("class", "id")
    links = _best(near, k + 1, True).withColumnsRenamed({"src": "of", "dst": "class"}).join(first, "class")
    links = _best(links.select(F.col("of").alias("src"), F.col("id").alias("dst"), "weight"), k + 1, True)
    lists = links.groupBy(F.col("src").alias("class")).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("d"), "dst", "weight"))).alias("b"))
    out = member.join(lists, "class").select(F.col("id").alias("src"), F.expr(f"slice(filter(b, e -> e.dst <> id), 1, {k})").alias("b"))
    return out.select("src", F.explode("b").alias("e")).select("src", "e.dst", "e.weight")
