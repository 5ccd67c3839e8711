"""Phase C on Spark: feature table -> prepared matrix -> hash split -> boosting
-> metrics -> artifacts. No row data leaves the cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.config import BOOST, MODEL_FEATURES, TARGET, BoostParams
from surgelane.operators.boost import BoostedTrees, train_boosted, train_warm_start
from surgelane.operators.evaluate import evaluate_predictions, top_k
from surgelane.operators.prep import prepare_features, train_val_split
from surgelane.session import materialise


@dataclass
class TrainingResult:
    model: BoostedTrees
    metrics: DataFrame
    importance: DataFrame

    def top_features(self, k: int = 20) -> DataFrame:
        """Top-k features by average gain (rounded to 4 places, ties by name)."""
        return top_k(self.importance, k, "importance_gain", "feature", digits=4)


def evaluate_model(model: BoostedTrees, validation: DataFrame, label: str = TARGET) -> TrainingResult:
    scored = model.predict(validation)
    metrics = evaluate_predictions(scored, label, "prediction").withColumns(
        {"n_trees": F.lit(model.n_trees), "n_features": F.lit(len(model.features))}
    )
    importance = model.importance(validation.sparkSession)
    top = top_k(importance, 20, "importance_gain", "feature", digits=4)
    listed = top.agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance_gain"))).alias("feature_importance_top20"))
    metrics = metrics.crossJoin(F.broadcast(listed))  # one row each
    return TrainingResult(model, metrics, importance)


def train_surge_model(
    features_df: DataFrame,
    key: str | None = None,
    params: BoostParams = BOOST,
    exclude=(),
    incremental: bool = False,
    n_batches: int = 10,
    init_model: BoostedTrees | None = None,
    folder: str | None = None,
) -> TrainingResult:
    """Prepare, split, train and evaluate; ``init_model`` is boosted further, ``folder`` makes the run resumable."""
    keep = [key] if key else []
    prepared, names = prepare_features(features_df, MODEL_FEATURES, TARGET, exclude=exclude, keep=keep)
    split = train_val_split(prepared, key=key, fraction=params.validation_fraction, seed=params.seed)
    # Written: a filter on the hash of all columns would make the optimizer derive constraints for each of them.
    split = materialise(split, "split")
    if incremental:
        model = train_warm_start(split, names, TARGET, "is_validation", params, n_batches, init_model, key, folder)
    else:
        model = train_boosted(split, names, TARGET, "is_validation", params, init_model=init_model, folder=folder)
    return evaluate_model(model, split.filter("is_validation"))


def save_artifacts(spark: SparkSession, result: TrainingResult, path: str) -> str:
    """Model, metrics JSON, ordered feature names, importance CSV (gain desc)."""
    result.model.save(spark, f"{path}/model")
    result.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    names = [(i, f) for i, f in enumerate(result.model.features)]
    spark.createDataFrame(names, "ordinal int, feature string").coalesce(1).write.mode("overwrite").json(
        f"{path}/feature_names"
    )
    (
        result.importance.orderBy(F.col("importance_gain").desc(), F.col("feature"))
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", "true")
        .csv(f"{path}/feature_importance")
    )
    return path


def load_importance(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    imp = spark.read.option("header", "true").schema("feature string, importance_gain double").csv(
        f"{path}/feature_importance"
    )
    return top_k(imp, k, "importance_gain", "feature")


def load_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """Ordered feature names saved with the model (ordinal, feature)."""
    return spark.read.schema("ordinal int, feature string").json(f"{path}/feature_names").orderBy("ordinal")
