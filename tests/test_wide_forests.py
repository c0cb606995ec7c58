"""Forests as tables: against Spark's own, for any partitions, and without nodes in the driver."""

from __future__ import annotations

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from aircadence.ml import models, wide_forests
from aircadence.ml.wide_forests import Top, WideForest, fit_wide_forest, grow_tree

COLUMNS = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    y = (x[:, 0] + x[:, 1] > 0) * 1 + (x[:, 2] > 0.8) * 1
    noisy = np.where(rng.random(900) < 0.05, rng.integers(0, 3, 900), y)
    made = spark.createDataFrame([(k, k + 7, *map(float, v), float(c), 1.0 + float(c)) for k, (v, c) in enumerate(zip(x, noisy))], "key long, row long, " + ", ".join(f"{c} double" for c in COLUMNS) + ", label_index double, weight double")
    return models.assembled(made, COLUMNS).cache()


def told(model, rows):
    return {r.key: (r.prediction, tuple(r.probability.toArray())) for r in model.transform(rows).select("key", "prediction", "probability").collect()}


@pytest.mark.parametrize("most", [100_000, 100])
def test_like_sparks_forest(rows, most):
    train, test = rows.where("key % 3 > 0"), rows.where("key % 3 = 0")
    forest = fit_wide_forest(train, "key", "row", trees=10, depth=8, most=most)
    assert (max(len(t.feature) for t in forest.tops) > 8) == (most == 100)
    plain = models.random_forest(trees=10, depth=8).fit(train)
    truth = {r.key: r.label_index for r in test.collect()}
    right = [np.mean([p == truth[k] for k, (p, _) in told(m, test).items()]) for m in (forest, plain)]
    assert right[0] > max(0.8, right[1] - 0.04)
    ours, theirs = forest.importances(), plain.featureImportances.toArray()
    assert ours.sum() == pytest.approx(1.0) and np.abs(ours - theirs).max() < 0.08
    got = told(forest, test)
    assert len(got) == test.count() and all(sum(p) == pytest.approx(1.0) for _, p in got.values())


def test_partitions_and_blocks_do_not_matter(rows):
    want = None
    for count, most in ((1, 100), (5, 100)):
        forest = fit_wide_forest(rows.repartition(count), "key", "row", trees=5, depth=6, most=most)
        got = told(forest, rows)
        assert want in (None, got)
        want = got
    # More rows than a block holds, and rows that repeat a key.
    forest.most = 50
    assert told(forest, rows) == want
    twice = rows.unionByName(rows.withColumn("row", F.col("row") + 5000))
    assert forest.transform(twice).count() == 2 * rows.count()


def test_driver_holds_no_trees(rows):
    grown = rows.withColumn("label_index", (F.col("key") * 7919 % 3).cast("double"))
    forest = fit_wide_forest(grown, "key", "row", trees=10)
    nodes = forest.parts.agg(F.sum(F.length("feature") / 2)).first()[0]
    assert nodes > 10 * 250 and all(t.feature == [-1] for t in forest.tops)
    held = {k: v for k, v in vars(forest).items() if k != "parts"}
    assert len(pickle.dumps(held)) < nodes
    from aircadence.plans import models as plans

    assert isinstance(plans._forest(grown.withColumnRenamed("key", "vec_id").withColumn("is_test", F.lit(False))), WideForest)


def test_depth_leaf_size_and_pure_nodes():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 32, (200, 4)).astype(np.uint8), rng.integers(0, 2, 200)
    one = np.ones(200)
    full = grow_tree(x, y, one, one, 2, 30, 1, 4, rng)
    # Rows that differ in their bins are told apart.
    assert (full.leaves(x).argmax(axis=1) == y).all() and (full.gains >= 0).all()
    assert len(grow_tree(x, y, one, one, 2, 1, 1, 4, rng).feature) <= 3
    assert len(grow_tree(x, y * 0, one, one, 2, 30, 1, 4, rng).feature) == 1
    large = grow_tree(x, y, one, one, 2, 30, 40, 4, rng)
    held = np.unique([tuple(s) for s in large.leaves(x)], axis=0, return_counts=True)[1]
    assert held.min() >= 40 and len(held) > 1
    # The best split by plain trial.
    gini = lambda v: 1 - (np.bincount(v, minlength=2) / len(v)) @ (np.bincount(v, minlength=2) / len(v))
    tries = {(f, b): gini(y) - (below := x[:, f] <= b).mean() * gini(y[below]) - (~below).mean() * gini(y[~below]) for f in range(4) for b in range(31) if 0 < (x[:, f] <= b).sum() < 200}
    assert tries[int(full.feature[0]), int(full.cut[0])] == pytest.approx(max(tries.values()))
    assert (Top([0, -1, -1], [10, 0, 0], [1, 0, 0], [0, 1, 1], [0.0]).parts(x) == np.where(x[:, 0] <= 10, 1, 2)).all()


def test_parts_are_copied_for_their_own_rows_alone(rows):
    """Blocks grow with the parts and with the rows, not with the product of both."""
    forest = fit_wide_forest(rows, "key", "row", trees=5, depth=6, most=100)
    want = told(forest, rows)
    parts, whole = forest.parts.count(), rows.count()
    binned = wide_forests._binned(rows.select("key", "features"), forest.thresholds, "key")
    blocks = forest.blocks(binned)
    assert all((own > 0).tolist() == [f < 0 for f in top.feature] for own, top in zip(blocks, forest.tops))
    # Before, each of the parts was copied for each of the nine blocks.
    assert parts > 30 and sum(own.sum() for own in blocks) <= parts + 5 * whole / forest.most < parts * 9 / 2
    # All rows in one part of a tree that is not split.
    plain = fit_wide_forest(rows, "key", "row", trees=2, depth=6, most=5000)
    plain.most = 100
    assert [own.tolist() for own in plain.blocks(binned)] == [[9], [9]]
    assert told(forest, rows) == want and len(told(plain, rows)) == whole
    assert forest.transform(rows.where("false")).count() == 0
