"""Models on synthetic features of three kinds of device."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from aircadence import cli
from aircadence.ml import metrics, models, prep

COLUMNS = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    data = [(k, f"class_{k % 3}", *(float(x) for x in rng.normal(k % 3, 1.0, len(COLUMNS)))) for k in range(150)]
    flat = spark.createDataFrame(data, "key long, device_type string, " + ", ".join(f"{c} double" for c in COLUMNS))
    scaled = prep.scale(flat, prep.scaling(flat, COLUMNS))
    ready = prep.class_weights(prep.encode_labels(prep.stratified_split(scaled, "device_type", "key"), "device_type"), "device_type")
    return models.assembled(ready.withColumn("label_index", F.col("label_index").cast("double")), COLUMNS).repartition(1).cache()


def accuracy(told):
    return told.agg(F.avg((F.col("y_pred") == F.col("label_index")).cast("double"))).first()[0]


def test_forest_svm_ensemble(spark, rows, tmp_path):
    train, test = rows.where("not is_test"), rows.where("is_test")
    assert test.count() == 45
    forest = models.random_forest(trees=20, depth=5).fit(train)
    svm = models.fit_kernel_svm(train, len(COLUMNS), landmarks=64)
    both = models.predictions(svm, models.predictions(forest, test, "rf"), "svm")
    for names in (["rf"], ["svm"], ["svm", "rf"]):
        told = models.with_vote(both, names, [1.0] * len(names))
        assert accuracy(told) > 0.6
        assert told.where("confidence < 0 or confidence > 1").count() == 0
    assert models.importances(forest, COLUMNS, spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    models.save_bundle(PipelineModel(stages=[forest]), str(tmp_path / "m"), COLUMNS, ["a"], "rf")
    again, meta = models.load_bundle(spark, str(tmp_path / "m"))
    assert meta["feature_names"] == COLUMNS
    assert again.transform(test).select("prediction").collect() == forest.transform(test).select("prediction").collect()


def test_grid_search(rows):
    folded = prep.stratified_folds(rows.where("not is_test"), "device_type", "key", 2)
    found = models.grid_search(folded, models.random_forest(trees=3), {"maxDepth": (2, 4)}, folds=2)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.5


def test_impute_scale_align(spark):
    t = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (float("inf"), 2.0)], "a double, b double")
    assert prep.medians(t, ["a", "b"]) == {"a": 3.0, "b": 2.0}
    assert sorted(r.a for r in prep.impute(t, ["a"]).collect()) == [0.0, 1.0, 3.0, 3.0]
    constant = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert [r.a for r in prep.scale(constant, prep.scaling(constant, ["a"])).collect()] == [0.0, 0.0]
    assert prep.align(t, ["z", "a"]).columns == ["b", "z", "a"]


def test_pca_and_names(rows):
    out, shares = models.pca(rows.select("key", *COLUMNS), COLUMNS)
    assert out.columns[-2:] == ["pc1", "pc2"] and shares[0] > shares[1]
    assert models.camera_class(["phone", "Wireless_Camera"]) == 1 and models.camera_class(["phone"]) == 0
    assert models.best_model({"svm": 0.5, "rf": 0.5}) == "svm"


def test_kernels_separate_a_ring(spark):
    """Classes that no line parts: both kernels find them, and a saved machine tells the same."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), float(c), 1.0) for (a, b), c in zip(x, y)], "a double, b double, label_index double, weight double")
    rows = models.assembled(rows, ["a", "b"]).cache()
    got = {k: metrics.overall_metrics(models._told(models.fit_kernel_svm(rows, 2, landmarks=200, gamma=0.7, kernel=k, c=10), rows)).first().accuracy for k in ("rbf", "poly")}
    assert got["rbf"] > 0.9 and got["poly"] > 0.5
    assert models.kernel_width(rows, 2, "auto") == 0.5 and models.kernel_width(rows, 2, 0.3) == 0.3
    assert models.kernel_width(rows, 2, "scale") == pytest.approx(1 / (2 * x.var()), rel=1e-6)


def test_search_and_cross_scores(rows):
    folded = prep.stratified_folds(rows.withColumn("key", F.monotonically_increasing_id()), "device_type", "key", 2).cache()
    model, best, tried = models.search(folded, models.fit_forest, {"trees": (3,), "depth": (1, 4)}, folds=2)
    assert best == max(tried, key=lambda t: t[1])[0] and len(tried) == 2 and model.transform(rows).count() == rows.count()
    scores = models.cross_scores(folded, lambda r: models.fit_forest(r, trees=3, depth=3), 2).collect()
    assert [(r.fold, r.side) for r in scores] == [(0, "test"), (0, "train"), (1, "test"), (1, "train")] and all(0 <= r.f1_macro <= 1 for r in scores)


def test_choice_of_models():
    assert models.choose_model({"svm": 0.5, "rf": 0.5, "ensemble": 0.5}) == "ensemble"
    assert models.choose_model({"svm": 0.6, "rf": 0.5, "ensemble": 0.5}) == "svm"
    assert models.choose_model({"svm": 0.6, "rf": 0.7, "ensemble": 0.65}) == "rf"
    assert models.choose_model({"svm": 0.6, "rf": 0.7, "ensemble": 0.7}) == "ensemble"


def test_curves_by_class(spark):
    """A class that all rows have, or none, has no curve."""
    rows = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.3, 0.6, 0.1]), (1, [0.6, 0.3, 0.1]), (0, [0.5, 0.4, 0.1])], "y int, p array<double>")
    each = metrics.one_vs_rest(rows, "y", "p", ["a", "b", "c"])
    auc = {r.label: r.auc for r in metrics.roc_auc(each, ["label"]).collect()}
    assert auc == {"a": 0.75, "b": 0.75, "c": None}
    assert {r.label for r in metrics.roc_curve(each, ["label"]).collect()} == {"a", "b"}


def test_best_weights(spark):
    none = spark.createDataFrame([(1, [0.9, 0.1], [0.9, 0.1])], "y int, a array<double>, b array<double>")
    assert metrics.best_weights(metrics.weight_search(none, "y", "a", "b", metric="f1_weighted")) == ((1, 1), 0.0)


@pytest.mark.parametrize("binary", [[], ["--binary", "class_1"]])
def test_command_line(spark, rows, tmp_path, binary):
    rows.select("device_type", *COLUMNS, F.lit("s").alias("sa"), F.lit("d").alias("da")).write.parquet(str(tmp_path / "in"))
    for argv in (["train", *binary, "--weigh"], ["detect", "--model", "M", "--alert", "class_1"], ["evaluate", "--model", "M", "--folds", "2"]):
        argv = [str(tmp_path / "model") if x == "M" else x for x in argv]
        out = str(tmp_path / ("model" if argv[0] == "train" else argv[0]))
        args = cli.parser().parse_args([*argv, "--input", str(tmp_path / "in"), "--output", out])
        if argv[0] == "evaluate":
            (tmp_path / "evaluate").mkdir()
        args.run(spark, args)
    told = spark.read.parquet(str(tmp_path / "detect"))
    assert told.count() == 150 and ("prob_non_class_1" if binary else "prob_class_2") in told.columns
    assert {p.name for p in (tmp_path / "evaluate").iterdir()} >= {"overall.json", "confusion.json", "auc.json", "roc.json", "pr.json", "folds.json"}
    for name in ("svm", "rf", "ensemble"):
        assert cli.predict(spark, spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "model" / "all" / name)).count() == 150


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, 1, 0.5)], "y_true int, y_pred int, score double")
    assert metrics.roc_auc(one).first()[0] is None and metrics.roc_curve(one).count() == 0
    none = one.limit(0)
    assert metrics.binary_detection(none).first().detection_rate == 0.0
    assert metrics.confusion_matrix(none, [0, 1]).count() == 4


def test_score_steps_are_spread(spark):
    """Distinct scores are summed in several tasks, with the results of one loop."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    data = [(rng.random(), int(rng.random() < 0.3)) for _ in range(400)]
    data += data[:40]
    rows = spark.createDataFrame(data, "score double, y_true int")
    want = sorted((s, sum(y for x, y in data if x >= s), sum(1 - y for x, y in data if x >= s)) for s in {x for x, _ in data})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = metrics.score_steps(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.score, r.tp, r.fp) for r in got) == want
    assert len({r.task for r in got}) > 1
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(rows).first()[0] - auc) < 1e-12
