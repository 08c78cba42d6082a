"""Heading classifiers on feature tables: random forests with class weights, their predictions and importances."""

from __future__ import annotations

import json
from collections.abc import Mapping
from copy import deepcopy
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest as forests


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 100
    depth: int = 15
    leaf: int = 4
    share: float = 0.7
    positive_weight: float = 75.0
    seed: int = 42


def train_forest(df: DataFrame, columns: list[str], label: str = "is_heading", settings: ForestSettings = ForestSettings(), texts: list[str] = ()) -> PipelineModel:
    """A forest over numeric ``columns`` and, indexed once and for all, ``texts``. Rows without a feature are left out.

    Without ``texts`` the forest grows on distinct rows and their counts, if ``forest.DISTINCT`` of them hold the table.
    """
    weighted = df.dropna(subset=[*columns, label]).withColumn("__weight", F.when(F.col(label) > 0, settings.positive_weight).otherwise(1.0))
    index = [StringIndexer(inputCol=c, outputCol=f"__{c}", stringOrderType="alphabetAsc", handleInvalid="keep") for c in texts]
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="__features", weightCol="__weight", numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.leaf, subsamplingRate=settings.share,
        featureSubsetStrategy="sqrt", seed=settings.seed,
    )
    vectors = VectorAssembler(inputCols=[*columns, *(f"__{c}" for c in texts)], outputCol="__features", handleInvalid="keep")
    if not texts and (model := forests.fit(weighted, columns, label, settings, forest)):
        return PipelineModel([vectors, model])
    return Pipeline(stages=[*index, vectors, forest]).fit(weighted)


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``df`` with heading_confidence and is_heading_pred."""
    out = model.transform(df).withColumn("heading_confidence", vector_to_array("probability")[1])
    return out.withColumn("is_heading_pred", (F.col("heading_confidence") >= threshold).cast("int")).drop("rawPrediction", "probability", "prediction", *(c for c in out.columns if c.startswith("__")))


def predict_class(model: PipelineModel, df: DataFrame, name: str = "predicted_level") -> DataFrame:
    """``df`` with the class that a forest of several classes finds likeliest, and the probability of each as an array."""
    out = model.transform(df).withColumn(name, F.col("prediction").cast("int")).withColumn("class_probabilities", vector_to_array("probability"))
    return out.drop("rawPrediction", "probability", "prediction", *(c for c in out.columns if c.startswith("__")))


@dataclass(frozen=True)
class Bundle:
    """What prediction needs: a model, the threshold chosen for it, and its columns in order."""

    model: PipelineModel
    columns: list[str]
    threshold: float = 0.5
    version: str = ""


def save_bundle(bundle: Bundle, path: str) -> None:
    """A model's own files and, beside them, its settings as a line of JSON."""
    from pyspark.sql import SparkSession

    bundle.model.write().overwrite().save(f"{path}/model")
    line = json.dumps({"columns": bundle.columns, "threshold": bundle.threshold, "version": bundle.version})
    SparkSession.getActiveSession().createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_bundle(path: str) -> Bundle:
    from pyspark.sql import SparkSession

    found = json.loads(SparkSession.getActiveSession().read.text(f"{path}/settings").first().value)
    return Bundle(PipelineModel.load(f"{path}/model"), found["columns"], found["threshold"], found["version"])


def selected(df: DataFrame, columns: list[str], label: str = "is_heading", most: int = 100, keep: int = 50) -> list[str]:
    """The columns as they are, or of more than ``most`` the ``keep`` most important of a small forest, in their order."""
    if len(columns) <= most:
        return columns
    best = {c for c, _ in importances(train_forest(df, columns, label, ForestSettings(trees=20, depth=8)), columns, keep)}
    return [c for c in columns if c in best]


def importances(model: PipelineModel, columns: list[str], n: int = 15) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, values.tolist()), key=lambda x: (-x[1], x[0]))[:n]


def training_seconds(trees: int, rows: int, features: int) -> float:
    """A rough estimate to show to users."""
    return trees * 0.5 * min(2.0, rows / 10000) * min(1.5, features / 100)


def adjusted(settings: dict, reduction_rate: float, exclusions: Mapping[str, int] | None = None) -> dict:
    """Training settings after feedback: stricter over 60 percent filtered, looser under 20. The settings given stay as they are.

    ``settings``: pipeline_settings (confidence_threshold), model_params (class_weight by class), precision_filters
    (min_font_size_percentile, max_word_count). ``exclusions``: how often each reason excluded a text.
    """
    out = deepcopy(settings)
    pipeline, model, limits = (out.setdefault(k, {}) for k in ("pipeline_settings", "model_params", "precision_filters"))
    threshold = pipeline.get("confidence_threshold", 0.5)
    if reduction_rate > 60:
        pipeline["confidence_threshold"] = min(0.95, threshold + 0.05)
        weights = model.setdefault("class_weight", {})
        weights["1"] = min(100, weights.get("1", 75) + 10)
        limits["min_font_size_percentile"] = min(80, limits.get("min_font_size_percentile", 75) + 5)
    elif reduction_rate < 20:
        pipeline["confidence_threshold"] = max(0.75, threshold - 0.02)
    if (exclusions or {}).get("excluded_long_sentences", 0) > 30:
        limits["max_word_count"] = min(15, limits.get("max_word_count", 15) - 2)
    return out
