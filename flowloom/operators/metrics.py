"""Evaluation metrics as aggregates over (actual, predicted) or (label, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.balanced import balanced_running
from flowloom.session import checkpointed


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, row_share)."""
    c = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    # one row a class pair
    return c.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("actual")), 6))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(cls, precision, recall, f1, support); every row gives at most two partial counts, no join."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("a").alias("cls"), hit.alias("tp"), F.lit(0).cast("long").alias("pred"), F.col("n").alias("sup")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("sup")))
    s = pairs.select(F.explode(sides).alias("s")).groupBy("s.cls").agg(F.sum("s.tp").alias("tp"), F.sum("s.pred").alias("pred"), F.sum("s.sup").alias("support"))
    p, r = ratio0(F.col("tp"), F.col("pred")), ratio0(F.col("tp"), F.col("support"))
    return s.select("cls", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio0(2.0 * F.col("tp"), F.col("pred") + F.col("support")), 6).alias("f1"), "support")


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro-F1 (classes seen on either side, 0 where undefined)."""
    acc = df.agg(F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), 6)).scalar()
    return class_report(df, actual, predicted).agg(F.round(F.avg("f1"), 5).alias("macro_f1")).withColumn("accuracy", acc)


def binary_prf(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of the positive class, 0 where undefined."""
    s = df.agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", F.round(ratio0(tp, tp + fp), 6).alias("precision"), F.round(ratio0(tp, tp + fn), 6).alias("recall"), F.round(ratio0(2.0 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def roc_points(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """(score, tp, fp): cumulative counts at every distinct score, best first; ties are one point.

    The running sums go over range partitions of the score, so the curve of any number of scores needs no single task.
    """
    g = df.groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    g = g.withColumn("k", F.lit(0)).withColumn("neg", -F.col("score"))
    r = balanced_running(g, ["k"], ["neg"], {"tp": F.col("p"), "fp": F.col("n")})
    return r.select("score", "p", "n", "tp", "fp")


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row: area under the curve by trapezoids; null without positives or negatives."""
    r = roc_points(df, positive, score)
    a = r.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def macro_f1_by(df: DataFrame, by: str, actual: str, predicted: str) -> DataFrame:
    """(by, accuracy, macro_f1): macro_f1 for every value of a column, in one pass."""
    pairs = df.groupBy(by, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct(F.col("a").alias("cls"), hit.alias("tp"), zero.alias("pred"), F.col("n").alias("sup")), F.struct(F.col("p").alias("cls"), zero.alias("tp"), F.col("n").alias("pred"), zero.alias("sup")))
    s = pairs.select(by, F.explode(sides).alias("s")).groupBy(by, "s.cls").agg(F.sum("s.tp").alias("tp"), F.sum("s.pred").alias("pred"), F.sum("s.sup").alias("sup"))
    return s.groupBy(by).agg(F.round(F.sum("tp") / F.sum("sup"), 6).alias("accuracy"), F.round(F.avg(ratio0(2.0 * F.col("tp"), F.col("pred") + F.col("sup"))), 5).alias("macro_f1"))


def one_vs_rest_points(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """(cls, score, p, n, tp, fp) of the ROC curve of every class against the rest; scores: one per class, by position.

    Each row is exploded to its classes and reduced to counts per (class, score); the running sums go over range
    partitions of (class, score), so neither many rows nor a hot class need a single task.
    """
    each = df.select(F.col(label).alias("__y"), F.posexplode(F.slice(scores, 1, classes)).alias("cls", "score"))
    g = each.groupBy("cls", "score").agg(F.count_if(F.col("__y") == F.col("cls")).alias("p"), F.count_if(F.coalesce(F.col("__y") != F.col("cls"), F.lit(True))).alias("n"))
    g = checkpointed(g.withColumn("neg", -F.col("score")))
    return balanced_running(g, ["cls"], ["neg"], {"tp": F.col("p"), "fp": F.col("n")}).drop("neg")


def one_vs_rest_auc(df: DataFrame, label: str, scores: str, classes: int) -> DataFrame:
    """(cls, support, auc) of every class; null without positives or negatives."""
    a = one_vs_rest_points(df, label, scores, classes).groupBy("cls").agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("a"), F.sum("p").alias("support"), F.sum("n").alias("n"))
    return a.select("cls", "support", F.round(F.when((F.col("support") > 0) & (F.col("n") > 0), F.col("a") / (F.col("support") * F.col("n"))), 6).alias("auc"))


def thinned_curve(points: DataFrame, keys: list[str], order: list[str], most: int = 200) -> DataFrame:
    """Every stride-th point of each curve in order, from the first, stride = max(1, points // most)."""
    n = points.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    r = balanced_running(points, keys, order, out="__r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    j = r.join(n, cond).where((F.col("__r") - 1) % F.greatest(F.lit(1), F.floor(F.col("__n") / most)) == 0)
    return j.drop("__r", "__n", *[f"__{k}" for k in keys])


def focal_loss(p_true: Column, gamma: float = 2.0) -> Column:
    return -F.pow(1.0 - p_true, F.lit(gamma)) * F.log(p_true)


def _log_norm(c: Column) -> Column:
    """log sum exp, with the largest entry found once."""
    f = lambda v: v["m"] + F.log(F.aggregate(v["c"], F.lit(0.0), lambda s, x: s + F.exp(x - v["m"])))
    return F.transform(F.array(F.struct(c.alias("c"), F.array_max(c).alias("m"))), f)[0]


def log_softmax_at(logits: Column, i: Column) -> Column:
    """log softmax(logits)[i], zero-based."""
    return F.get(logits, i) - _log_norm(logits)


def cross_entropy(logits: Column, label: Column) -> Column:
    return -log_softmax_at(logits, label)


def multi_task_loss(first: Column, second: Column, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    return weights[0] * first + weights[1] * second


def distillation_loss(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """T^2 KL(softmax(teacher / T) || softmax(student / T))."""
    t = temperature

    def log_p(c: Column) -> Column:
        scaled = F.transform(c, lambda v: v / t)
        return F.transform(F.array(F.struct(scaled.alias("c"), _log_norm(scaled).alias("n"))), lambda v: F.transform(v["c"], lambda x: x - v["n"]))[0]

    return t * t * F.aggregate(F.zip_with(log_p(teacher), log_p(student), lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, v: s + v)
