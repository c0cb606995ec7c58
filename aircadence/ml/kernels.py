"""Kernel maps by landmarks: a kernel machine as a linear one.

With landmarks z and K the kernel's values between them, the features

    f(x) = K^(-1/2) (k(x, z_1), ..., k(x, z_m))

have inner products that equal the kernel wherever one side is in the span of the
landmarks, so with all distinct rows as landmarks the linear machine is the kernel
machine itself, and with fewer it comes close to it.  The error that is left is measured
when the map is fitted.

Machines are fitted by Newton steps on a smoothed hinge, which is sharpened from round to
round.  A step is one pass over the mapped rows: a task sends the gradient and the second
derivatives of its rows, of the size of the landmarks alone, and those of a machine meet in
one task, which solves for the step, so the driver gets no more with more rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.workspace import Workspace

#: Rows on which the error is measured.
MEASURED = 256
#: Widths of the smoothed corner of the hinge, one round each, and most steps of a round.
CORNERS, STEPS = (2.0, 0.5, 0.1, 0.02, 0.005), 25
#: Parts of a step that are tried in one pass.
_PARTS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def kernel(x: np.ndarray, y: np.ndarray, gamma: float, kind: str) -> np.ndarray:
    """Values between the rows of two matrices: "rbf", or "poly" of degree 3."""
    dots = x @ y.T
    if kind == "rbf":
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * dots
        return np.exp(-gamma * np.maximum(square, 0.0))
    if kind == "poly":
        return (gamma * dots) ** 3
    raise ValueError(f"kernel {kind}")


@dataclass
class KernelMap:
    """Features by landmarks."""

    landmarks: np.ndarray
    whiten: np.ndarray  #: landmarks by features
    gamma: float
    kind: str
    #: Root mean square difference of the kernel and the features' inner products on other rows, over that of the kernel.
    error: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.gamma, self.kind) @ self.whiten


@dataclass
class Machines:
    """A machine for each class, its margin a sum over landmarks."""

    landmarks: np.ndarray
    coefficients: np.ndarray  #: landmarks by classes
    intercepts: np.ndarray
    gamma: float
    kind: str
    error: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.gamma, self.kind) @ self.coefficients + self.intercepts

    def transform(self, rows: DataFrame, out: str = "margins") -> DataFrame:
        """Add the classes' margins of ``features``, an array."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(shared.value.margins(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return rows.withColumn(out, told(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, x, w) for k, (x, w) in enumerate(zip(self.landmarks.tolist(), self.coefficients.tolist(), strict=True))]
        spark.createDataFrame(rows, "place int, landmark array<double>, coefficients array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/landmarks")
        meta = json.dumps({"gamma": self.gamma, "kind": self.kind, "error": self.error, "intercepts": self.intercepts.tolist()})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/kernel")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Machines:
        meta = json.loads(spark.read.text(f"{path}/kernel").first()[0])
        rows = spark.read.parquet(f"{path}/landmarks").orderBy("place").collect()
        return cls(np.array([r.landmark for r in rows]), np.array([r.coefficients for r in rows]), np.array(meta["intercepts"]), meta["gamma"], meta["kind"], meta["error"])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _hinge(z: np.ndarray, corner: float) -> np.ndarray:
    """0 up to 0, then a parabola up to ``corner``, then a line."""
    return np.where(z <= 0, 0.0, np.where(z < corner, z * z / (2 * corner), z - corner / 2))


def _passed(mapped: DataFrame, f) -> np.ndarray:
    """Sum of ``f(features, labels, weights)``, a flat array, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = f(_matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy())
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], ["task", "sums"])

    def met(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"sums": [sums.tobytes()]})

    tasks = mapped.rdd.getNumPartitions()
    parts = mapped.mapInArrow(run, "task int, sums binary")
    if tasks > 32:
        # As many sums as the root of the tasks reach the driver.
        parts = parts.groupBy((F.col("task") % math.isqrt(tasks)).alias("group")).applyInArrow(met, "sums binary")
    return sum(np.frombuffer(bytes(r.sums)) for r in parts.select("sums").collect())


def _stepped(mapped: DataFrame, f, step) -> dict[int, np.ndarray]:
    """``step(machine, sums)``, a flat array, of the sums of ``f(features, labels, weights)`` over all rows.

    ``f`` gives an array for each machine.  The sums of a machine meet in a task, which
    takes the step, so only steps reach the driver, however many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for k, own in f(_matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()):
                    totals[k] = totals[k] + own if k in totals else own
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([total.tobytes()])], ["task", "machine", "sums"])

    def whole(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(x.as_buffer()) for x in table.sort_by("task").column("sums"))

    def met(table: pa.Table) -> pa.Table:
        return pa.table({"task": pa.array([min(table.column("task").to_pylist())], pa.int32()), "machine": table.column("machine")[:1], "sums": [whole(table).tobytes()]})

    def last(table: pa.Table) -> pa.Table:
        k = table.column("machine")[0].as_py()
        return pa.table({"machine": pa.array([k], pa.int32()), "step": [step(k, whole(table)).tobytes()]})

    tasks = mapped.rdd.getNumPartitions()
    parts = mapped.mapInArrow(run, "task int, machine int, sums binary")
    if tasks > 32:
        parts = parts.groupBy("machine", (F.col("task") % math.isqrt(tasks)).alias("group")).applyInArrow(met, "task int, machine int, sums binary")
    return {r.machine: np.frombuffer(bytes(r.step)) for r in parts.groupBy("machine").applyInArrow(last, "machine int, step binary").collect()}


def fit_machines(rows: DataFrame, fitted: KernelMap, classes: int, penalty: float) -> Machines:
    """One machine against the rest for each class: the least of penalty / 2 |w|^2 and the weighted mean hinge.

    ``rows`` needs ``features``, ``label_index`` and ``weight``.
    """
    work = Workspace(rows.sparkSession, "machines")
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            f = shared.value.features(np.stack(x.to_numpy())) if len(x) else np.zeros((0, 1))
            yield pd.Series(list(np.hstack([f, np.ones((len(f), 1))])))

    # The map is costly next to a step, so it runs once.
    mapped = work.stage(rows.select(features(vector_to_array("features")).alias("f"), "label_index", F.col("weight").cast("double").alias("weight")), "mapped")
    size = fitted.whiten.shape[1] + 1
    machines = classes if classes > 2 else 1  # of two classes one machine is the other's mirror
    total = mapped.agg(F.sum("weight")).first()[0] or 1.0
    w = np.zeros((machines, size))
    ridge = np.r_[np.full(size - 1, penalty), 0.0]
    sign = lambda y, k: np.where(y == (k if machines > 1 else 1), 1.0, -1.0)

    for corner in CORNERS:
        open_ones = list(range(machines))
        for _ in range(STEPS):
            def slopes(f, y, weight, w=w, open_ones=tuple(open_ones), corner=corner):
                for k in open_ones:
                    s = sign(y, k)
                    z = 1 - s * (f @ w[k])
                    curved = (z > 0) & (z < corner)
                    g = -(f.T @ (weight * s * np.clip(z / corner, 0, 1)))
                    yield k, np.r_[g, ((f[curved] * weight[curved, None]).T @ f[curved] / corner).ravel()]

            def step(k, sums, w=w):
                own = sums / total
                g, h = own[:size] + ridge * w[k], own[size:].reshape(size, size) + np.diag(ridge)
                # A little of the identity where no row is in the corner.
                return -np.linalg.solve(h + np.eye(size) * (1e-9 * max(1.0, np.trace(h) / size) + 1e-10), g)

            found = _stepped(mapped, slopes, step)
            steps = {k: found[k] for k in open_ones}

            def losses(f, y, weight, w=w, steps=steps, corner=corner):
                return np.concatenate([[(weight * _hinge(1 - sign(y, k) * (f @ (w[k] + t * d)), corner)).sum() for t in (0.0, *_PARTS)] for k, d in steps.items()])

            tried = _passed(mapped, losses).reshape(len(steps), -1) / total
            still = []
            for (k, d), loss in zip(steps.items(), tried, strict=True):
                value = [x + 0.5 * float(ridge @ (w[k] + t * d) ** 2) for x, t in zip(loss, (0.0, *_PARTS), strict=True)]
                best = int(np.argmin(value))
                if best:
                    w = w.copy()
                    w[k] = w[k] + _PARTS[best - 1] * d
                    if value[0] - value[best] > 1e-7 * max(1e-12, value[0]):
                        still.append(k)
            open_ones = still
            if not open_ones:
                break
    work.drop(mapped)
    if machines == 1:
        w = np.vstack([-w, w])[:classes] if classes == 2 else w
    return Machines(fitted.landmarks, fitted.whiten @ w[:, :-1].T, w[:, -1], fitted.gamma, fitted.kind, fitted.error)


def fit_landmarks(rows: DataFrame, count: int, gamma: float, kind: str) -> KernelMap:
    """A map by up to ``count`` distinct rows of ``features``, the first in the order of a hash."""
    x = rows.select(vector_to_array("features").alias("x")).distinct()
    picked = np.array([r.x for r in x.orderBy(F.xxhash64("x"), "x").limit(count + MEASURED).collect()], np.float64)
    marks, others = picked[:count], picked[count:]
    values, vectors = np.linalg.eigh(kernel(marks, marks, gamma, kind))
    kept = values > values.max() * 1e-10
    fitted = KernelMap(marks, vectors[:, kept] / np.sqrt(values[kept]), gamma, kind)
    if len(others):
        true, near = kernel(others, others, gamma, kind), fitted.features(others)
        fitted.error = float(np.sqrt(((true - near @ near.T) ** 2).mean() / (true**2).mean()))
    return fitted
