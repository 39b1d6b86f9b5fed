"""Model-side operators on pyspark.ml: pipelines, baselines, tuning, a 2-D projection, noise sweeps, ablations."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.features import class_weights
from flowloom.operators.metrics import macro_f1, macro_f1_by
from flowloom.operators.sampling import weighted_resample
from flowloom.session import checkpointed


def feature_pipeline(columns: list[str], scale: bool = False, out: str = "features") -> Pipeline:
    """Assembler (NaN kept) and, if asked for, a scaler to unit sample deviation without centring."""
    stages: list = [VectorAssembler(inputCols=columns, outputCol="__raw" if scale else out, handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol=out, withMean=False, withStd=True))
    return Pipeline(stages=stages)


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


def label_encoder(column: str, out: str) -> StringIndexer:
    """Codes 0.. in alphabetical order; unseen values get the code after the last."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")


def baseline(name: str, features: int, classes: int, seed: int = 42, weight: str | None = None) -> Estimator:
    """mlp (2h, h, h/2, h/4 as in a student of diffused features), forest, boosted (trees, one against the rest) or logistic."""
    if name == "mlp":
        h = max(8, min(128, features))
        return MultilayerPerceptronClassifier(layers=[features, 2 * h, h, h // 2, max(2, h // 4), classes], maxIter=60, seed=seed)
    if name == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **({"weightCol": weight} if weight else {}))
    if name == "logistic":
        return LogisticRegression(maxIter=50, regParam=1e-4, **({"weightCol": weight} if weight else {}))
    if name == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, seed=seed), parallelism=2, **({"weightCol": weight} if weight else {}))
    raise ValueError(f"unknown baseline {name}")


def fit_and_score(train: DataFrame, test: DataFrame, model: Estimator) -> tuple[PipelineModel, DataFrame]:
    """The fitted model and one row of accuracy and macro-F1 on test."""
    fitted = model.fit(train)
    return fitted, macro_f1(fitted.transform(test).select(F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").alias("p")), "a", "p")


def grid_search(model: Estimator, grid: list, train: DataFrame, folds: int = 3, parallelism: int = 2):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, parallelism=parallelism, seed=42)
    return cv.fit(train)


def projected_2d(df: DataFrame, array: str, key: str) -> DataFrame:
    """(key, u, v): the two leading principal components; signs are as the decomposition gives them."""
    v = with_vector(df.select(key, array), array, "__v")
    p = PCA(k=2, inputCol="__v", outputCol="__p").fit(v).transform(v).select(key, vector_to_array("__p").alias("p"))
    return p.select(key, F.col("p")[0].alias("u"), F.col("p")[1].alias("v"))


def noise_sweep(df: DataFrame, array: str, sigmas: Iterable[float], seed: int = 7) -> DataFrame:
    """Every row once per noise level with Gaussian noise of that deviation on its vector."""
    levels = F.array(*[F.lit(float(s)) for s in sigmas])
    d = df.withColumn("sigma", F.explode(levels)).withColumn("__seed", F.randn(seed))
    # one uniform hash a position and row, turned into a normal deviate by Box-Muller
    u = lambda i, tag: (F.pmod(F.xxhash64(F.col("__seed"), i, F.lit(tag)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    noisy = F.transform(F.col(array), lambda x, i: x + F.col("sigma") * F.sqrt(-2.0 * F.log(u(i, 1))) * F.cos(6.283185307179586 * u(i, 2)))
    return d.withColumn(array, noisy).drop("__seed")


def noise_scores(model: PipelineModel, df: DataFrame, array: str, label: str, sigmas: Iterable[float], seed: int = 7) -> DataFrame:
    """(sigma, accuracy, macro_f1) of a fitted model on noisy copies of df, one pass over all levels."""
    noisy = with_vector(noise_sweep(df, array, sigmas, seed), array, "features")
    p = model.transform(noisy).select("sigma", F.col(label).cast("int").alias("a"), F.col("prediction").cast("int").alias("p"))
    return macro_f1_by(p, "sigma", "a", "p")


def balanced_training_rows(df: DataFrame, label: str, key: str, alpha: float = 0.5, draws: int | None = None, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement by class size^-alpha: class weights for learners that take none."""
    return weighted_resample(df, label, key, alpha, draws or df.count(), seed).drop("draw")


# The eight configurations of the component ablation: relations, hops, bypass of the hops (X0), class weights.
COMPONENTS = {
    "full": ((0, 1), 3, True, True), "no bypass": ((0, 1), 3, False, True), "no graph": ((0, 1), 0, True, True), "similarity only": ((1,), 3, True, True),
    "temporal only": ((0,), 3, True, True), "uniform loss": ((0, 1), 3, True, False), "one hop": ((0, 1), 1, True, True), "two hops": ((0, 1), 2, True, True),
}


def component_ablation(nodes: DataFrame, edges: DataFrame, size: int, classes: int, learner: str = "logistic", components: dict = COMPONENTS) -> DataFrame:
    """(configuration, accuracy, macro_f1) of a student on diffused features with components taken away.

    nodes: node_id, split, label (double), features array<double> of length size; edges: src, dst, edge_type_id. Each set of
    relations is diffused once, to the most hops; configurations take slices of it.
    """
    from flowloom.operators import graph

    most = {}
    for relations, hops, _, _ in components.values():
        most[relations] = max(hops, most.get(relations, 0))
    n = checkpointed(nodes.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n")))
    weights = class_weights(n, "n", 0.5).select("label", "weight")
    scores = {}
    # one set of relations after the other, scored at once: its features are written once, with all that a configuration
    # needs besides, so that configurations are slices of the rows where they lie, and go before the next set's are written
    for relations, h in most.items():
        x = graph.sign_features(graph.symmetric_norm(nodes, edges.where(F.col("edge_type_id").isin(*relations))), nodes.select("node_id", "features"), "features", h)
        d = nodes.select("node_id", "split", "label").join(x, "node_id")
        d = checkpointed(d.join(F.broadcast(weights), "label", "left").fillna(1.0, ["weight"]).where("split in ('train', 'test')").select("split", "label", "weight", "features"))
        for name, (own, hops, bypass, weighted) in components.items():
            if own != relations:
                continue
            first = 1 if bypass or not hops else size + 1
            width = size * (hops + 1) - first + 1
            c = with_vector(d.withColumn("features", F.slice("features", first, width)), "features")
            model = baseline(learner, width, classes, weight="weight" if weighted else None)
            scores[name] = checkpointed(fit_and_score(c.where("split = 'train'"), c.where("split = 'test'"), model)[1].withColumn("configuration", F.lit(name)))
        # written files go with the objects that refer to them
        del x, d, c, model
        gc.collect()
        nodes.sparkSession.sparkContext._jvm.System.gc()
    out = None
    for name in components:
        out = scores[name] if out is None else out.unionByName(scores[name])
    return out


def ablations(configurations: dict[str, Callable[[DataFrame], DataFrame]], data: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of every configuration of the data, one row each with its name."""
    out = None
    for name, change in configurations.items():
        row = score(change(data)).withColumn("configuration", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
