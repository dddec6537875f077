"""Boosted-tree forecast of the cost rate and of budget overrun."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from girder.functions.exprs import clip_scale, hash_bucket, safe_div, score_level
from girder.models.blocks import BlockClassifier, BlockRegressor
from girder.models.features import encoder, feature_names
from girder.operators.summaries import histogram, top_k
from girder.session import ensure_checkpoint_dir, packed, settle

ITERATIONS, STEP, DEPTH = 100, 0.1, 5
TARGET, LABEL = "actual_cost_rate", "is_over_budget"


def regressor(iterations: int = ITERATIONS, step: float = STEP, depth: int = DEPTH, seed: int = 42) -> GBTRegressor:
    return BlockRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="predicted_cost_rate",
        maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed,
    )


def classifier(iterations: int = ITERATIONS, step: float = STEP, depth: int = DEPTH, seed: int = 42) -> GBTClassifier:
    trees = BlockClassifier(
        featuresCol="features", labelCol=LABEL, predictionCol="predicted_over_budget",
        maxIter=iterations, stepSize=step, maxDepth=depth, seed=seed,
    )
    return trees.setRawPredictionCol("over_budget_raw").setProbabilityCol("over_budget_vector")


def fit(train: DataFrame, estimator: GBTRegressor | GBTClassifier) -> PipelineModel:
    """Encoder and boosted trees fitted on the training rows.

    A tree level is a job, so the encoded rows lie in as few partitions as their
    number needs: a level of a few thousand rows in 200 partitions spends its time
    on starting tasks. They are settled, so that a level's tasks carry the fit
    alone and not the plan that made its rows.
    A boosted fit iterates for a long time; its growing lineage is cut in the
    shared checkpoint folder.
    """
    return fit_all(train, estimator)[0]


def fit_all(train: DataFrame, *estimators: GBTRegressor | GBTClassifier) -> list[PipelineModel]:
    """Models fitted side by side on the same training rows, with one encoder; each as by ``fit``.

    The levels of one fit follow each other and leave most of a cluster idle.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    train = packed(settle(train))
    encode = encoder().fit(train)
    labels = dict.fromkeys(e.getLabelCol() for e in estimators)
    rows = settle(encode.transform(train).select("features", *labels))

    @inheritable_thread_target(spark)
    def grown(estimator: GBTRegressor | GBTClassifier):
        return estimator.fit(rows)

    with ThreadPool(len(estimators)) as pool:
        return [PipelineModel(stages=[*encode.stages, trees]) for trees in pool.map(grown, estimators)]


def cross_validate(train: DataFrame, estimator: GBTRegressor, folds: int = 5, key: str = "project_id", seed: int = 42, parallel: int = 5) -> DataFrame:
    """Root mean squared error of each held-out fold, with their mean and deviation."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    train = packed(settle(train))
    encoded = encoder().fit(train).transform(train)
    rows = settle(encoded.select("features", TARGET, hash_bucket(key, folds, seed).alias("fold")))

    @inheritable_thread_target(spark)
    def rmse(fold: int) -> tuple[int, float | None]:
        model = estimator.copy().fit(rows.filter(F.col("fold") != fold))
        held_out = model.transform(rows.filter(F.col("fold") == fold))
        return fold, regression_metrics(held_out).first()["rmse"]

    with ThreadPool(min(parallel, folds)) as pool:
        scores = pool.map(rmse, range(folds))
    frame = spark.createDataFrame(scores, "fold int, rmse double")
    mean, std = frame.agg(F.avg("rmse")).scalar(), frame.agg(F.stddev_pop("rmse")).scalar()
    return frame.withColumns({"mean_rmse": mean, "std_rmse": std})


def regression_metrics(df: DataFrame, actual: str = TARGET, predicted: str = "predicted_cost_rate") -> DataFrame:
    """RMSE, MAE and MAPE; a zero actual counts as 1 in the percentage."""
    error = F.col(actual) - F.col(predicted)
    base = F.when(F.col(actual) != 0, F.col(actual)).otherwise(F.lit(1.0))
    return df.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(error / base)) * 100).alias("mape"),
        F.count("*").alias("row_count"),
    )


def confusion_matrix(df: DataFrame, actual: str = LABEL, predicted: str = "predicted_over_budget") -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return df.agg(
        F.count_if(~a & ~p).alias("true_negative"),
        F.count_if(~a & p).alias("false_positive"),
        F.count_if(a & ~p).alias("false_negative"),
        F.count_if(a & p).alias("true_positive"),
    )


def classification_metrics(df: DataFrame, actual: str = LABEL, predicted: str = "predicted_over_budget") -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where the denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))

    def ratio(a, b):
        return F.coalesce(safe_div(a, b), F.lit(0.0))

    return confusion_matrix(df, actual, predicted).select(
        "*",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Importance of each feature, the largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(feature_names(model), weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def probability_histogram(df: DataFrame, bins: int = 15) -> DataFrame:
    """Over-budget probabilities binned per actual class."""
    return histogram(df, "over_budget_prob", bins, [LABEL])


def score(features: DataFrame, reg: PipelineModel, clf: PipelineModel, rmse: float) -> DataFrame:
    """Predicted rate with its 95 % interval, over-budget probability, risk score and level.

    Rows are encoded once, so both models have to know the same categories.
    """
    labels = [[list(x) for x in m.stages[0].labelsArray] for m in (reg, clf)]
    if labels[0] != labels[1]:
        raise ValueError(f"the models were fitted on different categories: {labels[0]} and {labels[1]}")
    encoded = clf.transform(features).drop(*[c for s in reg.stages[:-2] for c in s.getOutputCols()])
    predicted = reg.stages[-1].transform(encoded)
    margin = F.lit(1.96 * rmse)
    return risk_scores(
        predicted.withColumn("over_budget_prob", vector_to_array("over_budget_vector")[1])
        .withColumn("prediction_interval_lower", F.col("predicted_cost_rate") - margin)
        .withColumn("prediction_interval_upper", F.col("predicted_cost_rate") + margin)
    )


def risk_scores(predicted: DataFrame) -> DataFrame:
    """Score of 0-100: 70 % over-budget probability, 30 % predicted excess over target."""
    excess = safe_div(F.col("predicted_cost_rate") - F.col("target_cost_rate"), "target_cost_rate")
    scaled = F.coalesce(clip_scale(excess, 0.0, 0.2, 5), F.lit(0.0))
    return predicted.withColumn(
        "risk_score", (F.col("over_budget_prob") * 0.7 + scaled * 0.3) * 100
    ).withColumn("risk_level", score_level("risk_score"))


RESULT_COLUMNS: Sequence[str] = (
    "project_id",
    "project_name",
    "target_cost_rate",
    "actual_cost_rate",
    "predicted_cost_rate",
    "prediction_interval_lower",
    "prediction_interval_upper",
    "risk_score",
    "risk_level",
)


def result_table(scored: DataFrame, rows: int | None = None) -> DataFrame:
    """Ranked result; ``rows`` limits it to the riskiest projects."""
    if rows is not None:
        return top_k(scored.select(*RESULT_COLUMNS), "risk_score", rows, ["project_id"])
    return scored.select(*RESULT_COLUMNS).orderBy(F.desc("risk_score"), "project_id")
