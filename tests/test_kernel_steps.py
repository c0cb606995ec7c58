"""Steps of kernel machines are solved in tasks: the driver gets steps, not sums of all tasks."""

from __future__ import annotations

import numpy as np
import pytest

from aircadence.ml import kernels


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_sums_meet_in_tasks(spark, partitions):
    rows = spark.range(400).selectExpr("array(id / 100D, 1D) AS f", "CAST(id % 3 AS DOUBLE) AS label_index", "1D AS weight").repartition(partitions)
    seen = kernels._stepped(rows, lambda f, y, w: ((k, np.r_[(f[:, 0] * (y == k)).sum(), np.ones(5000) * len(f)]) for k in (0, 2)), lambda k, sums: np.array([k, sums[0], sums[-1], len(sums)]))
    want = {k: sum(i / 100 for i in range(400) if i % 3 == k) for k in (0, 2)}
    assert set(seen) == {0, 2}
    for k, step in seen.items():
        assert step == pytest.approx([k, want[k], 400, 5001])


def test_no_step_grows_with_the_tasks(spark, monkeypatch):
    """What reaches the driver in a fit has the size of a step or of its losses."""
    rows = spark.range(300).selectExpr("id", "array(sin(id), cos(id * 7)) AS x", "CAST(id % 2 AS DOUBLE) AS label_index", "1D AS weight")
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("x").alias("features"), "label_index", "weight").repartition(4).cache()
    sizes = []
    passed = kernels._passed
    monkeypatch.setattr(kernels, "_passed", lambda mapped, f: sizes.append(len(out := passed(mapped, f))) or out)
    kernels.fit_machines(rows, kernels.fit_landmarks(rows, 32, 0.5, "rbf"), 2, 0.01)
    assert sizes and max(sizes) <= 2 * 8
