"""Classifiers on Spark ML: random forest, kernel SVM by landmarks,
soft-voting ensemble, searches, importances, PCA, persistence and evaluation."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.ml import prep
from aircadence.ml.forests import CutForest
from aircadence.ml.kernels import Machines, fit_landmarks, fit_machines
from aircadence.ml.metrics import argmax, binary_detection, overall_metrics, weighted_vote
from aircadence.ml.wide_forests import WideForest


def assembled(rows: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(rows)


def random_forest(trees: int = 100, depth: int = 20, leaf: int = 1, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed, labelCol="label_index", featuresCol="features", weightCol="weight")


def kernel_width(rows: DataFrame, dims: int, gamma: float | str | None) -> float:
    """The kernel's gamma: a number, "auto" (1 / columns) or "scale" (that over the variance of all entries)."""
    if gamma in (None, "auto"):
        return 1.0 / dims
    if gamma != "scale":
        return float(gamma)
    values = F.explode(vector_to_array("features"))
    return 1.0 / (dims * (rows.select(values.alias("x")).agg(F.var_pop("x")).first()[0] or 1.0))


@dataclass
class KernelSvm:
    """Kernel machines, one for each class against the rest, with Platt scaling."""

    machines: Machines
    calibration: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        out = self.machines.transform(rows, "__margins").withColumn("svm_margin", array_to_vector("__margins"))
        return self.calibration.transform(out).drop("__margins", "svm_margin", "platt_raw")

    def save(self, path: str) -> None:
        self.machines.save(SparkSession.getActiveSession(), f"{path}/machines")
        self.calibration.write().overwrite().save(f"{path}/calibration")

    @classmethod
    def load(cls, path: str) -> KernelSvm:
        return cls(Machines.load(SparkSession.getActiveSession(), f"{path}/machines"), PipelineModel.load(f"{path}/calibration"))


@dataclass
class Vote:
    """Soft vote of fitted models, by weighted means of class probabilities."""

    members: dict[str, object]
    weights: tuple[float, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        names = [f"__{n}" for n in self.members]
        for name, model in zip(names, self.members.values(), strict=True):
            rows = predictions(model, rows, name)
        voted = rows.withColumn("__p", weighted_vote(names, self.weights))
        return voted.withColumn("prediction", argmax(F.col("__p")).cast("double")).withColumn("probability", array_to_vector("__p")).drop("__p", *names)


def fit_kernel_svm(rows: DataFrame, dims: int, landmarks: int = 256, reg: float = 0.01, gamma: float | str | None = None, kernel: str = "rbf", c: float | None = None) -> KernelSvm:
    """Fit the machines; ``c``, if given, sets the penalty to 1 / (c * rows).

    With as many landmarks as distinct rows these are exact kernel machines; else
    ``machines.error`` tells how far the kernel is off.
    """
    if c is not None:
        reg = 1.0 / (c * max(1, rows.count()))
    classes = int(rows.agg(F.max("label_index")).first()[0]) + 1
    machines = fit_machines(rows, fit_landmarks(rows, landmarks, kernel_width(rows, dims, gamma), kernel), classes, reg)
    margins = machines.transform(rows, "__margins").withColumn("svm_margin", array_to_vector("__margins"))
    platt = LogisticRegression(featuresCol="svm_margin", labelCol="label_index", weightCol="weight", rawPredictionCol="platt_raw", probabilityCol="probability", predictionCol="prediction")
    return KernelSvm(machines, Pipeline(stages=[platt]).fit(margins))


def fit_forest(rows: DataFrame, trees: int = 100, depth: int = 20, leaf: int = 1, seed: int = 42) -> PipelineModel:
    return PipelineModel(stages=[random_forest(trees, depth, leaf, seed).fit(rows)])


def _told(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(F.col("label_index").alias("y_true"), F.col("prediction").alias("y_pred"))


def score_of(told: DataFrame, metric: str) -> float:
    """A metric of predictions; "f1" is that of class 1."""
    return (binary_detection(told).first().f1 if metric == "f1" else overall_metrics(told).first()[metric]) or 0.0


def search(rows: DataFrame, fit: Callable[..., object], grid: dict[str, Sequence], folds: int = 5, fold_col: str = "fold", metric: str = "f1_weighted") -> tuple[object, dict, list[tuple[dict, float]]]:
    """The model of the best parameters, fitted on all rows, the parameters, and the mean score of each.

    ``fit(rows, **parameters)`` gives a model; of equal scores the first in
    grid order wins.  The driver loops over fits, each of which is distributed.
    """
    tried = []
    for values in itertools.product(*grid.values()):
        chosen = dict(zip(grid, values, strict=True))
        scores = []
        for k in range(folds):
            model = fit(rows.where(F.col(fold_col) != k), **chosen)
            scores.append(score_of(_told(model, rows.where(F.col(fold_col) == k)), metric))
        tried.append((chosen, sum(scores) / folds))
    best = max(tried, key=lambda t: t[1])[0]
    return fit(rows, **best), best, tried


def cross_scores(rows: DataFrame, fit: Callable[[DataFrame], object], folds: int = 5, fold_col: str = "fold") -> DataFrame:
    """Accuracy and macro and weighted F1 on the test and the training side of each fold."""
    out = None
    for k in range(folds):
        inside, outside = rows.where(F.col(fold_col) != k), rows.where(F.col(fold_col) == k)
        model = fit(inside)
        for side, part in (("test", outside), ("train", inside)):
            one = overall_metrics(_told(model, part)).select(F.lit(k).alias("fold"), F.lit(side).alias("side"), "accuracy", "f1_macro", "f1_weighted")
            out = one if out is None else out.unionByName(one)
    return out


def predictions(model, rows: DataFrame, name: str) -> DataFrame:
    """Add ``name``, an array of class probabilities."""
    out = model.transform(rows).withColumn(name, vector_to_array("probability"))
    return out.drop("probability", "rawPrediction", "prediction")


def with_vote(rows: DataFrame, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Add the soft vote's ``y_pred`` and ``confidence``."""
    voted = rows.withColumn("__p", weighted_vote(names, weights))
    return voted.withColumn("confidence", F.array_max("__p")).withColumn("y_pred", argmax(F.col("__p")).cast("int")).drop("__p")


def grid_search(rows: DataFrame, estimator, grid: dict, folds: int = 5, parallelism: int = 4, fold_col: str | None = "fold") -> CrossValidatorModel:
    """Cross-validated search by weighted F1; the best is fitted on all rows."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    judge = MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1")
    extra = {"foldCol": fold_col} if fold_col else {}
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, **extra).fit(rows)


#: The grids searched for many and for two classes.
FOREST_GRID = {"trees": (100, 200, 300), "depth": (10, 20, 30), "split": (2, 5, 10), "leaf": (1, 2, 4)}
FOREST_GRID_BINARY = {"trees": (150, 250, 350), "depth": (15, 25, 30), "split": (2, 5), "leaf": (1, 2)}
SVM_GRID = {"c": (0.1, 1, 10, 100), "gamma": ("scale", "auto", 0.01, 0.1), "kernel": ("rbf", "poly")}
SVM_GRID_BINARY = {"c": (0.5, 1, 5, 10, 50), "gamma": ("scale", "auto", 0.05, 0.1)}


def importances(model, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    values = model.importances().tolist() if isinstance(model, WideForest) else model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(columns, values, strict=True)), "feature string, importance double")


def pca(rows: DataFrame, columns: Sequence[str], k: int = 2, standardise: bool = True) -> tuple[DataFrame, list[float]]:
    """Components ``pc1..pck`` of centred columns and their variance shares."""
    fitted = prep.scaling(rows, columns)
    if not standardise:
        fitted = {c: (m, 1.0) for c, (m, _) in fitted.items()}
    vectors = assembled(prep.scale(rows, fitted), columns)
    model = PCA(k=k, inputCol="features", outputCol="__pc").fit(vectors)
    out = model.transform(vectors).withColumn("__pc", vector_to_array("__pc"))
    return out.select(*rows.columns, *(F.col("__pc")[i].alias(f"pc{i + 1}") for i in range(k))), model.explainedVariance.toArray().tolist()


def camera_class(names: Sequence[str]) -> int:
    """Place of the first name with "camera" in it, else 0."""
    return next((i for i, n in enumerate(names) if "camera" in n.lower()), 0)


def alerts(rows: DataFrame, positive: str, least: float = 0.5) -> DataFrame:
    """Predictions of exactly the positive label with enough confidence."""
    return rows.where((F.col("predicted_type") == positive) & (F.col("confidence") >= least))


def choose_model(f1: dict[str, float]) -> str:
    """The ensemble, unless the SVM or the forest has a higher score; the forest must beat both."""
    best = "svm" if f1["ensemble"] < f1["svm"] else "ensemble"
    return "rf" if f1["rf"] > max(f1["svm"], f1["ensemble"]) else best


def best_model(f1: dict[str, float]) -> str:
    """The name with the highest F1; of equals the one named first."""
    return max(f1, key=f1.get)


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """Overall metrics of several prediction relations, one row each."""
    tables = [overall_metrics(r).withColumn("model", F.lit(n)) for n, r in results.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy(F.desc("f1_weighted"), "model")


def save_bundle(model, path: str, feature_names: Sequence[str], label_names: Sequence[str], kind: str) -> None:
    """Save a fitted forest, kernel SVM or vote, and its names as a small table beside it."""
    meta = {"feature_names": list(feature_names), "label_names": list(label_names), "model_type": kind}
    parts = model.members if isinstance(model, Vote) else {"": model}
    if isinstance(model, Vote):
        meta |= {"members": {n: type(m).__name__ for n, m in parts.items()}, "weights": list(model.weights)}
    else:
        meta["class"] = type(model).__name__
    for name, part in parts.items():
        where = f"{path}/model/{name}".rstrip("/")
        part.save(where) if isinstance(part, (KernelSvm, CutForest)) else part.write().overwrite().save(where)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[object, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    kinds = {"KernelSvm": KernelSvm, "PipelineModel": PipelineModel, "CutForest": CutForest}
    if "members" in meta:
        return Vote({n: kinds[k].load(f"{path}/model/{n}") for n, k in meta["members"].items()}, tuple(meta["weights"])), meta
    return kinds[meta.get("class", "PipelineModel")].load(f"{path}/model"), meta
