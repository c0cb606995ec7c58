"""Kernel machines against an exact solver, cut forests against Spark's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from aircadence.ml import forests, metrics, models, prep
from aircadence.ml.kernels import Machines, fit_landmarks, kernel


def exact_machine(k, y, c, weights):
    """Decision values of the C-SVM on its own rows: pairs that violate the conditions most are solved in turn."""
    n = len(y)
    alpha, bound = np.zeros(n), c * weights
    gradient = -np.ones(n)
    for _ in range(100_000):
        up = ((y > 0) & (alpha < bound - 1e-12)) | ((y < 0) & (alpha > 1e-12))
        down = ((y < 0) & (alpha < bound - 1e-12)) | ((y > 0) & (alpha > 1e-12))
        v = -y * gradient
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(down)[v[down].argmin()]
        if v[i] - v[j] < 1e-5:
            break
        step = (v[i] - v[j]) / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j])
        step = min(step, bound[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else bound[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        gradient += step * y * (k[:, i] - k[:, j])
    return k @ (alpha * y) + (v[i] + v[j]) / 2


def table(spark, name):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(320, 3))
    if name == "ring":
        y = (x**2).sum(axis=1) > 2.2
    elif name == "cubic":
        y = x[:, 0] * x[:, 1] * x[:, 2] + 0.3 * x[:, 0] ** 3 > 0
    else:
        y = np.sin(2 * x[:, 0]) + x[:, 1] > 0.2
    y = np.where(rng.random(320) < 0.04, ~y, y).astype(float)
    weights = np.where(y > 0, 160 / y.sum(), 160 / (1 - y).sum())
    rows = spark.createDataFrame([(k, *map(float, v), float(c), float(w)) for k, (v, c, w) in enumerate(zip(x, y, weights))], "key long, a double, b double, c double, label_index double, weight double")
    return x, y, weights, models.assembled(rows, ["a", "b", "c"]).coalesce(1).cache()


@pytest.mark.parametrize("name,kind,gamma,c", [("ring", "rbf", 0.5, 1.0), ("wave", "rbf", 1.0, 10.0), ("cubic", "poly", 0.5, 1.0), ("wave", "poly", 0.3, 10.0)])
def test_decisions_agree_with_the_exact_machine(spark, name, kind, gamma, c):
    x, y, weights, rows = table(spark, name)
    exact = exact_machine(kernel(x, x, gamma, kind), np.where(y > 0, 1.0, -1.0), c, weights) > 0
    fitted = models.fit_kernel_svm(rows, 3, landmarks=320, gamma=gamma, kernel=kind, c=c)
    margins = fitted.machines.margins(x)
    assert np.mean((margins[:, 1] > 0) == exact) >= 0.98 and np.allclose(margins[:, 0], -margins[:, 1])
    told = np.array([r[0] for r in fitted.machines.transform(rows).orderBy("key").select("margins").collect()])
    assert np.allclose(told, margins)
    # A quarter of the rows as landmarks comes close.
    assert np.mean((models.fit_kernel_svm(rows, 3, landmarks=80, gamma=gamma, kernel=kind, c=c).machines.margins(x)[:, 1] > 0) == exact) >= 0.97


def test_error_falls_with_landmarks(spark):
    x, _, _, rows = table(spark, "ring")
    for kind in ("rbf", "poly"):
        fitted = [fit_landmarks(rows, m, 0.5, kind) for m in (5, 20, 80, 240)]
        errors = [f.error for f in fitted]
        assert errors[0] > 0.05 and errors[-1] < 0.05 and all(a >= b - 1e-7 for a, b in zip(errors, errors[1:])), errors
        # A kernel of degree 3 on 3 columns has 10 dimensions, so 20 landmarks are all of it.
        assert kind == "rbf" or errors[1] < 1e-6
    whole = fit_landmarks(rows, 320, 0.5, "rbf")
    f = whole.features(x)
    assert np.abs(f @ f.T - kernel(x, x, 0.5, "rbf")).max() < 1e-6


def test_landmarks_are_distinct_and_saved(spark, tmp_path):
    _, _, _, rows = table(spark, "ring")
    many = rows.unionByName(rows.where("key < 3").crossJoin(spark.range(500).select()))
    fitted = fit_landmarks(many, 64, 0.7, "rbf")
    assert len(np.unique(fitted.landmarks, axis=0)) == 64
    saved = Machines(fitted.landmarks, fitted.whiten[:, :3], np.arange(3.0), 0.7, "rbf", fitted.error)
    saved.save(spark, str(tmp_path / "k"))
    again = Machines.load(spark, str(tmp_path / "k"))
    assert all(np.array_equal(getattr(again, c), getattr(saved, c)) for c in ("landmarks", "coefficients", "intercepts")) and (again.gamma, again.kind, again.error) == (0.7, "rbf", fitted.error)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(3)
    data = [(k, f"c{k % 3}", *(float(v) for v in rng.normal(k % 3, 1.6, 5))) for k in range(240)]
    flat = spark.createDataFrame(data, "key long, label string, " + ", ".join(f"f{i} double" for i in range(5)))
    ready = prep.class_weights(prep.encode_labels(prep.stratified_folds(flat, "label", "key", 3), "label"), "label")
    return models.assembled(ready.withColumn("label_index", F.col("label_index").cast("double")), [f"f{i}" for i in range(5)]).coalesce(1).cache()


def test_uncut_forest_tells_what_spark_tells(classes):
    grown = forests.grow(classes, 12, 8)
    own = grown.transform(classes).orderBy("key").select("prediction", vector_to_array("probability")).collect()
    spark_own = grown.forest.transform(classes).orderBy("key").select("prediction", vector_to_array("probability")).collect()
    assert np.allclose([r[1] for r in own], [r[1] for r in spark_own])
    assert np.mean([a[0] == b[0] for a, b in zip(own, spark_own)]) > 0.99  # equal shares may fall either way


def plain_shares(nodes, x, trees, depth, split):
    out = np.zeros(nodes.shares.shape[1])
    for root in nodes.roots[:trees]:
        at, level = root, 0
        while nodes.left[at] >= 0 and level < depth and nodes.rows[at] >= split:
            at = nodes.left[at] if x[nodes.feature[at]] <= nodes.threshold[at] else nodes.right[at]
            level += 1
        out += nodes.shares[at]
    return out / min(trees, len(nodes.roots))


def test_all_settings_from_one_walk(classes):
    grown = forests.grow(classes, 9, 10)
    x = np.array([r[0] for r in classes.select(vector_to_array("features")).limit(40).collect()])
    trees, depths, splits = (2, 5, 9), (1, 4, 10), (2, 20, 100)
    got = grown.nodes.shares_of(x, trees, depths, splits)
    for i, t in enumerate(trees):
        for j, d in enumerate(depths):
            for k, s in enumerate(splits):
                assert np.allclose(got[i, j, k], [plain_shares(grown.nodes, row, t, d, s) for row in x])


def test_search_scores_equal_those_of_each_setting(spark, classes, tmp_path):
    grid = {"trees": (3, 8), "depth": (2, 6), "split": (2, 40), "leaf": (1, 4)}
    fits = []
    real = forests.grow
    forests.grow = lambda *a, **k: fits.append(a[1:]) or real(*a, **k)
    try:
        model, best, tried = forests.forest_search(classes, grid, 3)
    finally:
        forests.grow = real
    # Sixteen settings by six fits, and the best once more.
    assert len(tried) == 16 and len(fits) == 3 * 2 + 1 and fits[-1][:3] == (best["trees"], best["depth"], best["leaf"])
    for chosen, score in tried[::5]:
        each = []
        for k in range(3):
            own = real(classes.where(F.col("fold") != k), 8, 6, chosen["leaf"])
            own.trees, own.depth, own.split = chosen["trees"], chosen["depth"], chosen["split"]
            each.append(models.score_of(models._told(own, classes.where(F.col("fold") == k)), "f1_weighted"))
        assert score == pytest.approx(np.mean(each))
    assert best == max(tried, key=lambda t: t[1])[0]
    models.save_bundle(model, str(tmp_path / "m"), ["a"], ["b"], "rf")
    again, meta = models.load_bundle(spark, str(tmp_path / "m"))
    assert meta["class"] == "CutForest" and again.transform(classes).select("prediction").collect() == model.transform(classes).select("prediction").collect()


def test_binary_searches_look_at_the_positive_class(spark, classes):
    two = classes.withColumn("label_index", F.when(F.col("label_index") == 1, 1.0).otherwise(0.0))
    _, _, tried = forests.forest_search(two, {"trees": (4,), "depth": (3,), "split": (2,), "leaf": (1,)}, 3, metric="f1")
    each = []
    for k in range(3):
        told = models._told(forests.grow(two.where(F.col("fold") != k), 4, 3), two.where(F.col("fold") == k))
        each.append(metrics.binary_detection(told).first().f1)
    assert tried[0][1] == pytest.approx(np.mean(each))
    assert models.score_of(told, "f1") == each[-1] != models.score_of(told, "f1_weighted")
    assert (len(models.FOREST_GRID["split"]) * 27, 3 * 3 * 2 * 2) == (81, 36)
