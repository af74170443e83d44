"""Training, scoring and evaluation of the attack classifiers with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import bands
from vigilframe.operators import boosting, evaluation, exact
from vigilframe.session import written

SEED = 42
ROWS_A_TASK = 500_000

# Hyper-parameters of the published models. Spark's boosted trees have no L2
# penalty, and sample columns per node instead of per tree; boosting.train has both.
FULL = {"maxIter": 11, "maxDepth": 3, "stepSize": 0.08, "subsamplingRate": 0.55, "featureSubsetStrategy": "0.55"}
EDGE = {"maxIter": 1, "maxDepth": 3, "stepSize": 0.3}
BASELINE = {"maxDepth": 2}


def _pipeline(estimator, features: Sequence[str]) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, estimator])


def tasks_for(rows: DataFrame, most: int = ROWS_A_TASK) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def spread(rows: DataFrame, columns: Sequence[str], most: int = ROWS_A_TASK) -> DataFrame:
    """The columns in even partitions of about ``most`` rows.

    A fit holds each partition as objects some six times the size of its file, and reads it in every pass.
    """
    tasks = tasks_for(rows, most)
    return rows.select(*columns).repartition(tasks, F.rand(SEED))


def _fitted(estimator, train: DataFrame, features: Sequence[str]) -> PipelineModel:
    return _pipeline(estimator, features).fit(spread(train, [*features, "label"]))


def train_full_model(train: DataFrame, features: Sequence[str], **override) -> PipelineModel:
    """Spark's boosted trees, grown on blocks of binned rows.

    Spark's own fit keeps all rows as objects, with their errors and draws of each tree beside them, which
    doesn't fit in memory and is then written and read in each pass.
    """
    pipeline = _pipeline(GBTClassifier(labelCol="label", seed=SEED, **{**FULL, **override}), features)
    assembler, estimator = pipeline.getStages()
    share = estimator.getFeatureSubsetStrategy()
    settings = boosting.Settings(
        trees=estimator.getMaxIter(), depth=estimator.getMaxDepth(), rate=estimator.getStepSize(), rows=estimator.getSubsamplingRate(),
        columns=1.0 if share in ("all", "auto") else float(share), l2=0.0, least_weight=estimator.getMinInstancesPerNode(), seed=SEED, squared=True)
    edges = boosting.middle_edges(train, features, estimator.getMaxBins())
    refuse = lambda why, kind: F.raise_error(F.lit(why)).cast(kind)
    number = lambda c: F.when(F.abs(c) < float("inf"), c).otherwise(refuse("features must be finite numbers", "double"))
    known = train.select(
        *[number(F.col(f"`{c}`").cast("double")).alias(c) for c in features],
        F.when(F.col("label").isin(0, 1), F.col("label").cast("int")).otherwise(refuse("labels must be 0 or 1", "int")).alias("label"))
    cores = train.sparkSession.sparkContext.defaultParallelism
    data = boosting.binned(known, features, edges, "label", [], F.lit(0), files=-(-tasks_for(train) // cores) * cores)
    booster = boosting.grown(data, features, edges, settings, [-1])[0]
    return PipelineModel([assembler, as_spark_model(booster, estimator, settings)])


def as_spark_model(booster: boosting.Booster, estimator: GBTClassifier, settings: boosting.Settings) -> GBTClassificationModel:
    """The grown trees as Spark's model, so that it is scored, saved and read like any other."""
    new, jvm = JavaWrapper._new_java_obj, SparkContext._active_spark_context._jvm
    array, double = JavaWrapper._new_java_array, jvm.double
    tree_of = "org.apache.spark.ml.tree."

    def node_of(tree: boosting.Tree, at: int):
        """Spark's node and, where it is a leaf, its prediction."""
        rest, count, squares = (float(x) for x in tree.sums[at])
        mean = -rest / count if count else 0.0
        impurity = max(0.0, squares / count - mean * mean) if count else 0.0
        stats = new("org.apache.spark.mllib.tree.impurity.VarianceCalculator", array([count, -rest, squares], double), int(count))
        if at < len(tree.feature) and tree.feature[at] >= 0:
            (left, low), (right, high) = node_of(tree, 2 * at + 1), node_of(tree, 2 * at + 2)
            if low is None or low != high:
                sides = [tree.sums[2 * at + 1 + side] for side in (0, 1)]
                gain = (sum(x[0] ** 2 / x[1] for x in sides) - rest * rest / count) / count
                index = int(tree.feature[at])
                split = new(f"{tree_of}ContinuousSplit", index, float(booster.edges[index][tree.cut[at]]))
                return new(f"{tree_of}InternalNode", mean, impurity, float(gain), left, right, split, stats), None
        return new(f"{tree_of}LeafNode", mean, impurity, stats), mean

    count = len(booster.features)
    made = [new("org.apache.spark.ml.regression.DecisionTreeRegressionModel", node_of(tree, 0)[0], count) for tree in booster.trees]
    weights = [settings.weight(n) for n in range(len(made))]
    of = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    model = GBTClassificationModel(new("org.apache.spark.ml.classification.GBTClassificationModel", estimator.uid, array(made, of), array(weights, double), count, 2))
    return estimator._copyValues(model)


def train_edge_model(train: DataFrame, features: Sequence[str], **override) -> PipelineModel:
    return _fitted(GBTClassifier(labelCol="label", seed=SEED, **{**EDGE, **override}), train, features)


def train_baseline(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    return _fitted(DecisionTreeClassifier(labelCol="label", seed=SEED, **BASELINE), train, features)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds prediction (0/1) and score, the probability of an attack."""
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn(
        "prediction", F.col("prediction").cast("int")
    ).drop("features", "rawPrediction", "probability")


def predict_batch(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Label, probability with four decimals, and severity."""
    return score(model, rows).select(
        *keep, "prediction", F.round("score", 4).alias("probability"), bands.probability_severity(F.col("score")).alias("severity")
    )


def heuristic_score(features: Sequence[Column]) -> Column:
    """tanh of the mean feature value, used when no model is loaded."""
    total = features[0]
    for more in features[1:]:
        total = total + more
    return F.tanh(total / (len(features) + 1e-6))


def score_label(score_column: Column) -> Column:
    return bands.anomaly_label(score_column)


def evaluate_holdout(scored: DataFrame) -> DataFrame:
    """Accuracy and AUC of scored rows in one row."""
    return evaluation.accuracy(scored).withColumn("auc_roc", evaluation.auc_roc(scored).scalar())


def cross_validate(rows: DataFrame, features: Sequence[str], key: Sequence[str], k: int = 5) -> DataFrame:
    """Accuracy and AUC of each of ``k`` stratified folds; the folds' models grow in the same passes."""
    # Written once: bin edges and bins each read all rows.
    folded = written(exact.stratified_folds(rows.select(*dict.fromkeys([*key, *features, "label"])), "label", key, k), "folds")
    scored = written(boosting.cross_scored(folded, features, "fold", k, key), "cross")
    area = evaluation.auc_roc(scored, by=["fold"]).withColumnRenamed("auc", "auc_roc")
    return evaluation.accuracy(scored, by=["fold"]).join(area, "fold")


def feature_importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(features, values))
    return spark.createDataFrame(rows, "name string, score double").orderBy(F.col("score").desc(), "name")


def timed(train):
    """Result and seconds of a training call."""
    start = time.perf_counter()
    model = train()
    return model, round(time.perf_counter() - start, 2)


def model_status(metrics: DataFrame) -> DataFrame:
    """Display record of a metrics document; missing quality figures are 0."""
    have = set(metrics.columns)
    number = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
    return metrics.select(
        F.lit(True).alias("model_loaded"), F.col("model_name"), F.col("features"), F.size("features").alias("feature_count"),
        number("precision"), number("recall"), number("f1_score"), F.lit(False).alias("gpu_mode"),
    )
