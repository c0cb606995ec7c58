"""Searches over forests from few fits.

The first trees of a forest are a forest, a tree cut at a level is the tree of that
depth, and one whose small nodes are leaves is the tree of that least split size: trees
grow from the root on, and nothing above a node depends on what is below it.  So one
forest of the most and deepest trees stands for all settings of these three, and only the
least leaf size, on which splits depend, takes a fit of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.workspace import Workspace


@dataclass
class Nodes:
    """Nodes of all trees in arrays; children by place in them, -1 for none."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray  #: training rows of a node
    shares: np.ndarray  #: of each class

    @classmethod
    def of(cls, data: DataFrame) -> Nodes:
        """From a saved forest's table of nodes."""
        n = data.select("treeID", "nodeData.*").select("treeID", "id", "impurityStats", "rawCount", "leftChild", "rightChild", "split.featureIndex", F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("at"))
        t = n.toPandas().sort_values(["treeID", "id"], ignore_index=True)
        roots = np.flatnonzero(t["id"].to_numpy() == 0)
        # Numbers inside a tree run from 0 without gaps.
        base = np.repeat(roots, np.diff([*roots, len(t)]))
        stats = np.stack(t["impurityStats"].to_numpy())
        child = lambda c: np.where(t[c] >= 0, t[c] + base, -1)
        return cls(roots, t["featureIndex"].to_numpy(), t["at"].fillna(0.0).to_numpy(), child("leftChild"), child("rightChild"), t["rawCount"].to_numpy(), stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300))

    def shares_of(self, x: np.ndarray, trees: Sequence[int], depths: Sequence[int], splits: Sequence[int]) -> np.ndarray:
        """Class shares of rows: trees, depths, splits, rows, classes."""
        out = np.zeros((len(trees), len(depths), len(splits), len(x), self.shares.shape[1]))
        every = np.arange(len(x))
        for k, split in enumerate(splits):
            inner = (self.left >= 0) & (self.rows >= split)
            running = np.zeros(out.shape[1:2] + out.shape[3:])
            for number, root in enumerate(self.roots[: max(trees)], 1):
                at = np.full(len(x), root)
                for level in range(max(depths) + 1):
                    for j, depth in enumerate(depths):
                        if depth == level:
                            running[j] += self.shares[at]
                    go = every[inner[at]]
                    if not len(go):
                        for j, depth in enumerate(depths):
                            if depth > level:
                                running[j] += self.shares[at]
                        break
                    node = at[go]
                    at[go] = np.where(x[go, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                for i, most in enumerate(trees):
                    if most == number or most > len(self.roots) == number:
                        out[i, :, k] = running / number
        return out


@dataclass
class CutForest:
    """The first ``trees`` trees of a forest, cut at a depth, without splits of fewer than ``split`` rows."""

    forest: RandomForestClassificationModel
    nodes: Nodes
    trees: int
    depth: int
    split: int = 2

    @property
    def featureImportances(self):
        return self.forest.featureImportances

    def transform(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.nodes, self.trees, self.depth, self.split))

        @F.pandas_udf("array<double>")
        def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            nodes, trees, depth, split = shared.value
            for x in batches:
                yield pd.Series(list(nodes.shares_of(np.stack(x.to_numpy()), [trees], [depth], [split])[0, 0, 0])) if len(x) else pd.Series([], dtype=object)

        out = rows.withColumn("__shares", told(vector_to_array("features")))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return out.withColumn("probability", array_to_vector("__shares")).withColumn("prediction", best.cast("double")).drop("__shares")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/forest")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.trees, self.depth, self.split)], "trees int, depth int, split int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cut")

    @classmethod
    def load(cls, path: str) -> CutForest:
        spark = SparkSession.getActiveSession()
        cut = spark.read.parquet(f"{path}/cut").first()
        return cls(RandomForestClassificationModel.load(f"{path}/forest"), Nodes.of(spark.read.parquet(f"{path}/forest/data")), cut.trees, cut.depth, cut.split)


def grow(rows: DataFrame, trees: int, depth: int, leaf: int = 1, seed: int = 42) -> CutForest:
    """A forest that smaller ones are cut from."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed, labelCol="label_index", featuresCol="features", weightCol="weight").fit(rows)
    work = Workspace(rows.sparkSession, "forest")
    where = work.path("grown")
    forest.write().save(where)
    saved = rows.sparkSession.read.parquet(f"{where}/data")
    nodes = Nodes.of(saved)
    work.drop(saved)
    return CutForest(forest, nodes, trees, depth)


def f1_of(confusion: dict[tuple[int, int], int], metric: str) -> float:
    """ "f1_weighted", or "f1" of class 1, from counts of (truth, prediction)."""
    classes = sorted({c for pair in confusion for c in pair})
    total, out = sum(confusion.values()), 0.0
    for c in [1] if metric == "f1" else classes:
        hit = confusion.get((c, c), 0)
        told = sum(n for (_, p), n in confusion.items() if p == c)
        true = sum(n for (t, _), n in confusion.items() if t == c)
        out += (2 * hit / (told + true) if hit else 0.0) * (1.0 if metric == "f1" else true / max(1, total))
    return out


def scored(grown: CutForest, rows: DataFrame, trees: Sequence[int], depths: Sequence[int], splits: Sequence[int], metric: str) -> dict[tuple[int, int, int], float]:
    """The score of every setting on some rows, in one pass over them."""
    shared = rows.sparkSession.sparkContext.broadcast(grown.nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                told = shared.value.shares_of(np.stack(batch.x.to_numpy()), trees, depths, splits).argmax(axis=-1)
                setting = np.repeat(np.arange(told[..., 0].size), len(batch))
                each = pd.DataFrame({"setting": setting, "truth": np.tile(batch.y.to_numpy().astype(np.int64), told[..., 0].size), "told": told.reshape(-1)})
                yield each.groupby(["setting", "truth", "told"]).size().reset_index(name="n")

    needed = rows.select(F.col("label_index").alias("y"), vector_to_array("features").alias("x"))
    # One row for each setting and pair of classes.
    counts = needed.mapInPandas(run, "setting bigint, truth bigint, told bigint, n bigint").groupBy("setting", "truth", "told").agg(F.sum("n").alias("n")).collect()
    out = {}
    for k, setting in enumerate(itertools.product(trees, depths, splits)):
        out[setting] = f1_of({(r.truth, r.told): r.n for r in counts if r.setting == k}, metric)
    return out


def forest_search(rows: DataFrame, grid: dict[str, Sequence], folds: int = 5, fold_col: str = "fold", metric: str = "f1_weighted", seed: int = 42, side_by_side: int = 4) -> tuple[CutForest, dict, list[tuple[dict, float]]]:
    """As :func:`aircadence.ml.models.search`, for ``trees``, ``depth``, ``split`` and ``leaf``.

    A fit for each fold and leaf size, ``side_by_side`` at a time, scores all settings.
    """
    trees, depths = sorted(grid["trees"]), sorted(min(d, 30) for d in grid["depth"])
    splits, leaves = sorted(grid.get("split", (2,))), grid.get("leaf", (1,))

    def one(job: tuple[int, int]) -> dict:
        leaf, k = job
        grown = grow(rows.where(F.col(fold_col) != k), trees[-1], depths[-1], leaf, seed)
        return scored(grown, rows.where(F.col(fold_col) == k), trees, depths, splits, metric)

    jobs = list(itertools.product(leaves, range(folds)))
    with ThreadPoolExecutor(side_by_side) as pool:
        found = dict(zip(jobs, pool.map(one, jobs), strict=True))
    tried = []
    for values in itertools.product(*grid.values()):
        chosen = dict(zip(grid, values, strict=True))
        setting = chosen["trees"], min(chosen["depth"], 30), chosen.get("split", 2)
        tried.append((chosen, sum(found[chosen.get("leaf", 1), k][setting] for k in range(folds)) / folds))
    best = max(tried, key=lambda t: t[1])[0]
    grown = grow(rows, best["trees"], min(best["depth"], 30), best.get("leaf", 1), seed)
    grown.split = best.get("split", 2)
    return grown, best, tried
