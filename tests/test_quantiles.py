"""Exact quantiles and seeded orders against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aircadence.functions import frames as X
from aircadence.ml import prep
from aircadence.operators import flows
from aircadence.operators.quantiles import quantiles

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def columns(n=30_000):
    rng = np.random.default_rng(4)
    return {
        "offset": 1.7e9 + np.arange(n) % 7919, "equal": np.full(n, 3.5), "two": rng.integers(0, 2, n).astype(float), "mixed": rng.standard_normal(n) * 10.0 ** rng.integers(-9, 9, n),
        "outlier": np.r_[np.full(n - 1, 1e-3) + rng.uniform(0, 1e-9, n - 1), 1e300], "skewed": np.exp(rng.standard_normal(n) * 20), "infinite": np.r_[rng.standard_normal(n - n // 4), np.full(n // 4, np.inf)],
    }


@pytest.mark.parametrize("whole", [10_000, 10])
def test_quantiles_are_exact_for_any_distribution(spark, whole):
    data = columns()
    names = list(data)
    n = len(data["equal"])
    rows = spark.createDataFrame(list(zip(*([None if i % 3 == 0 else "g" for i in range(n)], *(c.tolist() for c in data.values())))), "g string, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {r.g: r for r in quantiles(rows, ["g"], {c: F.col(c) for c in names}, SHARES, whole).collect()}
    part = np.arange(n) % 3 == 0
    for g, mask in ((None, part), ("g", ~part)):
        for c in names:
            with np.errstate(invalid="ignore"):
                x = np.sort(data[c][mask])
                at = (len(x) - 1) * np.array(SHARES)
                low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
                want = [x[i] if i == j else (j - a) * x[i] + (a - i) * x[j] for a, i, j in zip(at, low, high)]
            assert [got[g][f"{c}_{k}"] for k in range(len(SHARES))] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, c)


def test_quantiles_of_nothing_and_nan(spark):
    rows = spark.createDataFrame([(1, None), (1, float("nan")), (1, 2.0), (1, float("inf")), (2, None)], "g int, x double")
    assert [(r.g, r.x_0, r.x_1) for r in quantiles(rows, ["g"], {"x": F.col("x")}, (0.0, 0.5)).collect()] == [(1, 2.0, float("inf"))]
    assert quantiles(rows.limit(0), [], {"x": F.col("x")}, (0.5,)).first().x_0 is None


def test_only_values_near_a_rank_are_put_in_order(spark):
    """Of 200,000 distinct values about one in a thousand and one cell for all below reach the window."""
    rows = spark.range(200_000).select((1.7e9 + F.col("id") * 0.25).alias("x"))
    made = quantiles(rows, [], {"x": F.col("x")}, (0.5,))
    assert made.first().x_0 == 1.7e9 + 199_999 * 0.25 / 2
    plan = made._sc._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    cells = made._jdf.queryExecution().executedPlan()
    counted = []

    def walk(node):
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else node
        if node.nodeName() == "Window":
            below = node.children().head()
            while not below.metrics().contains("numOutputRows") and not below.metrics().contains("recordsRead"):
                below = below.plan() if "QueryStage" in below.nodeName() else below.children().head()
            counted.append(below.metrics().apply("numOutputRows" if below.metrics().contains("numOutputRows") else "recordsRead").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(cells)
    assert "Window" in plan
    assert counted == [] or max(counted) < 2000, counted


def plain_order(keys, seed=42):
    return sorted(keys, key=lambda k: ((k + seed) * 2654435761 % 2**32, k))


def test_splits_take_any_key(spark):
    keys = [0, 1, 5, 4_000_000_000, 2**63 - 1, 2**63 - 2, -1, -5, -(2**63), 2**32, 2**32 - 42, 2**40 + 7, *range(100, 130)]
    rows = spark.createDataFrame([(k, "a") for k in keys], "key bigint, label string")
    order = plain_order(keys)
    tested = {r.key for r in prep.stratified_split(rows, "label", "key").where("is_test").collect()}
    assert tested == set(order[: round(len(keys) * 0.3)])
    folds = {r.key: r.fold for r in prep.stratified_folds(rows, "label", "key").collect()}
    assert folds == {k: i % 5 for i, k in enumerate(order)}


def test_median_gap_of_large_flows(spark):
    """Flows beyond what an aggregate holds give the same medians by selection."""
    rng = np.random.default_rng(2)
    from tests.test_frames import frames

    rows = []
    for pair in range(3):
        t = np.cumsum(rng.exponential(0.01, 60 + 40 * pair))
        rows += [{"sa": f"aa:bb:cc:00:00:0{pair}", "da": None if pair == 2 else "d", "timestamp": float(x)} for x in t]
    sessions = flows.sessionise(X.frame_features(frames(spark, *rows)), 5.0, 1.0)
    want = {(r.sa, r.da): r.median_iat for r in flows.flow_features(sessions).collect()}
    for held in (10, 80, 120):
        got = {(r.sa, r.da): r.median_iat for r in flows.flow_features(sessions, most_held=held).collect()}
        assert got == pytest.approx(want)
