"""Random forests whose nodes are a table, for forests that grow with their rows.

Fully grown trees have about as many nodes as rows, so a forest of a hundred is larger
than its input and must not be held in one place.  Here the driver knows only the first
few levels of each tree.  A node of more than ``most`` rows is split by sums over all
tasks; a smaller one is a part, whose rows meet in one task, which grows all that is
below it.  The parts stay in a staged table, and rows that are predicted are dealt to
the parts that they reach.

Trees follow Spark ML's forests: Poisson bags, thresholds from ``SAMPLE`` rows, Gini gain on
weighted rows, the root of the columns (rounded up) tried in a node, and sibling leaves of one class are
one leaf.  Bags and tried columns come from hashes of the rows' keys and the nodes'
places, so that neither the partitions nor their order matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from aircadence.workspace import Workspace

#: Ranges of values of a column, and rows that the thresholds are taken from (both as in Spark ML).
BINS, SAMPLE = 32, 10_000
#: Rows from which a node is split by the sums of its bins, not by its rows.
LARGE = 128
#: A share of 1 as an integer, so that sums do not depend on their order.
_ONE = 1 << 40
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_PARTS = "tree int, part int, feature binary, cut binary, child binary, shares binary, gains array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree takes each row."""
    own = _mixed(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return np.searchsorted(_POISSON, _mixed(own + np.uint64((tree + 1) * 0xD1B54A32D192ED03 % (1 << 64))) / 2.0**64, side="right")


def _tried(rng: np.random.Generator, nodes: int, columns: int, count: int) -> np.ndarray:
    """Columns that each node tries."""
    if count >= columns:
        return np.tile(np.arange(columns), (nodes, 1))
    return np.argpartition(rng.random((nodes, columns)), count - 1, axis=1)[:, :count]


def _by_cells(x, rows, at, y, w, c, stats, tried, leaf):
    """``_best`` for large nodes: sums of the classes in every bin."""
    nodes, classes = stats.shape
    every, y, w = np.arange(nodes), y[rows], w[rows]
    total, gains = stats.sum(axis=1), np.zeros(nodes)
    pure = (stats * stats).sum(axis=1) / (total * total)
    column, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    for j in range(tried.shape[1]):
        cell = at * BINS + x[rows, tried[at, j]]
        left = np.bincount(cell * classes + y, weights=w, minlength=nodes * BINS * classes).reshape(nodes, BINS, classes).cumsum(axis=1)[:, :-1]
        right = np.maximum(stats[:, None] - left, 0.0)
        squares = [np.einsum("nbk,nbk->nb", v, v) / np.maximum(v.sum(axis=2), 1e-300) for v in (left, right)]
        score = (squares[0] + squares[1]) / total[:, None] - pure[:, None]
        # A split lies after a bin with rows if rows of the node have a higher bin.
        seen = np.bincount(cell, minlength=nodes * BINS).reshape(nodes, BINS)
        fits = (seen[:, :-1] > 0) & (seen[:, ::-1].cumsum(axis=1)[:, -2::-1] > 0)
        if leaf > 1:
            taken = np.bincount(cell, weights=c[rows], minlength=nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
            fits &= (taken[:, :-1] >= leaf) & (taken[:, -1:] - taken[:, :-1] >= leaf)
        score = np.where(fits, score, 0.0)
        b = score.argmax(axis=1)
        top = score[every, b]
        better = top > np.maximum(gains, 1e-10)
        gains[better], column[better], cut[better] = top[better], tried[better, j], b[better]
    return gains, column, cut


def _by_rows(x, rows, at, y, w, c, stats, tried, leaf):
    """``_best`` for small nodes: rows in the order of their bins, one number for each row and not one for each class.

    A row adds to the squared sum of its class what that grows by.  Weights are
    whole numbers of up to 2**30 in a node, so sums that run over all nodes are
    exact: they may pass 64 bits, but their differences within a node do not.
    """
    nodes, classes = stats.shape
    bits, place = int(len(rows)).bit_length(), np.arange(len(rows))
    order = np.argsort(at * classes + y[rows], kind="stable")
    rows, at = rows[order], at[order]
    kind = at * classes + y[rows]
    total, gains = stats.sum(axis=1), np.zeros(nodes)
    column, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    weight = np.rint(w[rows] / c[rows] * np.exp2(30 - np.ceil(np.log2(total)))[at]).astype(np.int64) * c[rows].astype(np.int64)
    # Rows of a node and class stand together, from ``starts``; those of a node from ``first``.
    new = np.r_[True, kind[1:] != kind[:-1]]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    own = np.add.reduceat(weight, starts)
    before = (np.r_[0, np.cumsum(weight)][starts])[group]
    first, heads = np.searchsorted(at, np.arange(nodes)), np.searchsorted(at[starts], np.arange(nodes))
    whole, squares = np.add.reduceat(own, heads), np.add.reduceat(own * own, heads)
    pure, own = squares / whole.astype(float) ** 2, own[group]
    for j in range(tried.shape[1]):
        b = x[rows, tried[at, j]].astype(np.int64)
        by_class = np.sort((group * BINS + b << bits) | place) & ((1 << bits) - 1)
        v = weight[by_class]
        grows = v * (2 * (np.cumsum(v) - before) - v)
        met = np.sort((at * BINS + b[by_class] << bits) | place)
        cell, by_bin = met >> bits, met & ((1 << bits) - 1)
        # A split lies after a row whose successor in the node has a higher bin.
        ends = np.flatnonzero((cell[1:] != cell[:-1]) & (at[1:] == at[:-1]))
        if leaf > 1:
            taken = np.r_[0, np.cumsum(c[rows][by_class][by_bin])]
            below = taken[ends + 1] - taken[first[at[ends]]]
            all_taken = np.bincount(at, weights=c[rows], minlength=nodes)[at[ends]]
            ends = ends[(below >= leaf) & (all_taken - below >= leaf)]
        if not len(ends):
            continue
        k = at[ends]

        def upto(values):
            sums = np.cumsum(values[by_bin])
            return sums[ends] - (sums - values[by_bin])[first][k]

        left, square, cross = upto(v), upto(grows), upto(v * own)
        right = whole[k] - left
        score = (square / np.maximum(left, 1) + (squares[k] - 2 * cross + square) / np.maximum(right, 1)) / whole[k] - pure[k]
        lead = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        top = np.maximum.reduceat(score, lead)
        hits = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[lead, len(k)])))
        hits = hits[np.r_[True, k[hits[1:]] != k[hits[:-1]]]]
        better = top > np.maximum(gains[k[lead]], 1e-10)
        node = k[lead][better]
        gains[node], column[node], cut[node] = top[better], tried[node, j], b[by_class[by_bin[ends[hits[better]]]]]
    return gains, column, cut


def _best(x, rows, at, y, w, c, stats, tried, leaf):
    """Gain, column and bin of each node's best split; ``at`` is the node of each of ``rows``, the gain 0 without a split."""
    large = np.bincount(at, minlength=len(stats)) >= LARGE
    out = np.zeros(len(stats)), np.full(len(stats), -1), np.zeros(len(stats), np.int64)
    for chosen, best in ((large, _by_cells), (~large, _by_rows)):
        if chosen.any():
            inside = chosen[at]
            found = best(x, rows[inside], (np.cumsum(chosen) - 1)[at[inside]], y, w, c, stats[chosen], tried[chosen], leaf)
            for all_nodes, own in zip(out, found, strict=True):
                all_nodes[chosen] = own
    return out


@dataclass
class Tree:
    """Nodes in arrays; the second child stands after the first, ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray  #: the highest bin that goes to the first child
    child: np.ndarray
    shares: np.ndarray  #: of each class, leaf by leaf
    gains: np.ndarray  #: weighted gain of each column

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The shares of the leaf of each row of bins."""
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(go := every[self.feature[at[every]] >= 0]):
            node = at[go]
            at[go] = self.child[node] + (x[go, self.feature[node]] > self.cut[node])
            every = go
        return self.shares[(np.cumsum(self.feature < 0) - 1)[at]]


def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, classes: int, depth: int, leaf: int, count: int, rng: np.random.Generator) -> Tree:
    """Grow all levels below a node from its rows of bins, classes, weights and how often each is taken."""
    rows, at, nodes, first = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0
    levels = []
    for level in range(depth + 1):
        stats = np.bincount(at * classes + y[rows], weights=w[rows], minlength=nodes * classes).reshape(nodes, classes)
        feature, cut, gain, child = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes, np.int64)
        levels.append((feature, cut, gain, child, stats))
        several = np.flatnonzero((stats > 0).sum(axis=1) > 1)
        if level == depth or not len(several):
            break
        number = np.full(nodes, -1)
        number[several] = np.arange(len(several))
        inside = number[at] >= 0
        rows, own = rows[inside], number[at[inside]]
        gain[several], feature[several], cut[several] = _best(x, rows, own, y, w, c, stats[several], _tried(rng, len(several), x.shape[1], count), leaf)
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        first += nodes
        child[split] = first + 2 * np.arange(len(split))
        node = several[own]
        going = feature[node] >= 0
        rows, node = rows[going], node[going]
        at = child[node] - first + (x[rows, feature[node]] > cut[node])
        nodes = 2 * len(split)
    feature, cut, gain, child, stats = (np.concatenate(a) for a in zip(*levels, strict=True))
    # From the bottom up, sibling leaves of one class become one leaf.
    best = stats.argmax(axis=1)
    place = len(feature)
    for level in reversed(levels):
        place -= len(level[0])
        inner = place + np.flatnonzero(feature[place : place + len(level[0])] >= 0)
        one = child[inner]
        feature[inner[(feature[one] < 0) & (feature[one + 1] < 0) & (best[one] == best[one + 1])]] = -1
    used = np.zeros(len(feature), bool)
    used[0] = True
    place = 0
    for level in levels:
        inner = place + np.flatnonzero(used[place : place + len(level[0])] & (feature[place : place + len(level[0])] >= 0))
        used[child[inner]] = used[child[inner] + 1] = True
        place += len(level[0])
    child = np.where(feature >= 0, np.cumsum(used)[child] - 1, 0)[used]
    feature, cut, gain, stats = feature[used], cut[used], gain[used], stats[used]
    inner, ends = feature >= 0, stats[feature < 0]
    gains = np.bincount(feature[inner], weights=(gain * stats.sum(axis=1))[inner], minlength=x.shape[1]).astype(np.float64)
    shares = np.rint(ends / np.maximum(ends.sum(axis=1, keepdims=True), 1e-300) * _ONE).astype(np.int64)
    return Tree(feature.astype(np.int16), cut.astype(np.uint8), child.astype(np.int32), shares, gains)


@dataclass
class Top:
    """First levels of a tree; nodes that are not split here are its parts."""

    feature: list[int]
    cut: list[int]
    child: list[int]
    depth: list[int]
    gains: list[float]

    def parts(self, x: np.ndarray) -> np.ndarray:
        at, feature, cut, child = np.zeros(len(x), np.int64), np.array(self.feature), np.array(self.cut), np.array(self.child)
        while len(go := np.flatnonzero(feature[at] >= 0)):
            node = at[go]
            at[go] = child[node] + (x[go, feature[node]] > cut[node])
        return at


def _bins_of(column: pa.Array | pa.ChunkedArray, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, columns)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of bins as binary values."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _binned(rows: DataFrame, thresholds: list[np.ndarray], *others: str) -> DataFrame:
    """``others`` and the bins of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                x = np.stack([np.searchsorted(t, values[:, k]) for k, t in enumerate(thresholds)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], _packed(x)], [*others, "x"])

    kinds = dict(rows.dtypes)
    return rows.select(vector_to_array("features").alias("__features"), *others).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", x binary")


def _thresholds(rows: DataFrame, key: str) -> list[np.ndarray]:
    """Up to BINS - 1 thresholds of each column, between values of the first rows in the order of a hash."""
    picked = rows.select(vector_to_array("features").alias("x"), key).orderBy(F.xxhash64(key), key, "x").limit(SAMPLE).toPandas()
    out = []
    for values in np.stack(picked["x"].to_numpy()).T:
        distinct = np.unique(values)
        if len(distinct) > BINS:
            distinct = np.unique(np.quantile(values, np.arange(BINS) / BINS, method="inverted_cdf"))
            distinct = np.r_[distinct, values.max()] if distinct[-1] < values.max() else distinct
        out.append((distinct[1:] + distinct[:-1])[: BINS - 1] / 2)
    return out


@dataclass
class WideForest:
    """A grown forest: the first levels of its trees and a staged table of the parts below."""

    parts: DataFrame
    tops: list[Top]
    thresholds: list[np.ndarray]
    classes: int
    row: str
    most: int

    def blocks(self, binned: DataFrame) -> list[np.ndarray]:
        """Of each tree, the blocks of up to about ``most`` rows for each node that is a part, by the rows of bins ``x`` that reach it; else 0.

        A part is copied for its own blocks alone, so copies grow with the parts and with
        the rows, not with the product of both.
        """
        leaves = [np.array(top.feature) < 0 for top in self.tops]
        if binned.count() <= self.most:
            return [own.astype(np.int64) for own in leaves]
        columns, shared = len(self.thresholds), binned.sparkSession.sparkContext.broadcast(self.tops)

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = shared.value
            seen = [np.zeros(len(top.feature), np.int64) for top in tops]
            for batch in batches:
                x = _bins_of(batch.column(0), columns)
                for own, top in zip(seen, tops, strict=True):
                    own += np.bincount(top.parts(x), minlength=len(own))
            tree, node = (np.concatenate(a).astype(np.int32) for a in zip(*((np.full(len(own), t), np.arange(len(own))) for t, own in enumerate(seen)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(node), pa.array(np.concatenate(seen))], ["tree", "part", "seen"])

        out = [own.astype(np.int64) for own in leaves]
        for r in binned.select("x").mapInArrow(reached, "tree int, part int, seen bigint").where("seen > 0").groupBy("tree", "part").agg(F.sum("seen").alias("seen")).collect():
            out[r.tree][r.part] = -(-r.seen // self.most)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction``; ``rows`` needs ``features`` and the whole number ``row``, which no two rows share."""
        columns, classes, key = len(self.thresholds), self.classes, self.row
        binned = _binned(rows.select(F.col(key).cast("bigint").alias("key"), "features").withColumn("hash", F.xxhash64("key")), self.thresholds, "key", "hash")
        blocks = self.blocks(binned)
        shared = rows.sparkSession.sparkContext.broadcast((self.tops, blocks))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x, mixed = _bins_of(batch.column(2), columns), batch.column(1).to_numpy()
                for tree, (top, own) in enumerate(zip(*shared.value, strict=True)):
                    part = top.parts(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(part.astype(np.int32)), pa.array((mixed % own[part]).astype(np.int32)), batch.column(0), batch.column(2)], ["tree", "part", "block", "key", "x"])

        def told(part: pa.Table, dealt: pa.Table) -> pa.Table:
            if not len(dealt) or not len(part):
                return pa.table({"key": pa.array([], pa.int64()), "class": pa.array([], pa.int32()), "share": pa.array([], pa.int64())})
            one = {c: part.column(c)[0].as_py() for c in ("feature", "cut", "child", "shares")}
            tree = Tree(np.frombuffer(one["feature"], np.int16), np.frombuffer(one["cut"], np.uint8), np.frombuffer(one["child"], np.int32), np.frombuffer(one["shares"], np.int64).reshape(-1, classes), np.zeros(0))
            shares = tree.leaves(_bins_of(dealt.column("x"), columns))
            row, of = np.nonzero(shares)
            return pa.table({"key": dealt.column("key").to_numpy()[row], "class": of.astype(np.int32), "share": shares[row, of]})

        at = ["tree", "part", "block"]
        dealt = binned.mapInArrow(deal, "tree int, part int, block int, key bigint, x binary")
        counts = [(t, int(p), int(own[p])) for t, own in enumerate(blocks) for p in np.flatnonzero(own)]
        copied = F.broadcast(rows.sparkSession.createDataFrame(counts, "tree int, part int, blocks int"))
        copies = self.parts.join(copied, ["tree", "part"]).select("tree", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "feature", "cut", "child", "shares")
        tasks = max(1, sum(n for _, _, n in counts))
        found = copies.repartition(tasks, *at).groupBy(*at).cogroup(dealt.repartition(tasks, *at).groupBy(*at)).applyInArrow(told, "key bigint, class int, share bigint")
        each = [F.sum(F.when(F.col("class") == k, F.col("share")).otherwise(0)) / float(_ONE * len(self.tops)) for k in range(classes)]
        votes = found.groupBy("key").agg(F.array(*each).alias("__shares")).withColumnRenamed("key", "__key")
        out = rows.join(votes, F.col(key).cast("bigint") == F.col("__key")).drop("__key")
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return out.withColumn("probability", array_to_vector("__shares")).withColumn("prediction", best.cast("double")).drop("__shares")

    def importances(self) -> np.ndarray:
        """Gains of columns, each tree's and the forest's adding to 1; the driver gets one number for each tree and column."""
        gains = np.array([top.gains for top in self.tops])
        for r in self.parts.select("tree", F.posexplode("gains").alias("at", "gain")).groupBy("tree", "at").agg(F.sort_array(F.collect_list("gain")).alias("gains")).collect():
            gains[r.tree, r.at] += sum(r.gains)
        each = gains.sum(axis=1, keepdims=True)
        whole = (gains / np.where(each > 0, each, 1.0)).sum(axis=0)
        return whole / (whole.sum() or 1.0)


def _open_sums(binned: DataFrame, tops: list[Top], open_ones: dict[int, dict[int, np.ndarray]], classes: int, columns: int, seed: int, leaf: int) -> list:
    """Best splits of nodes of the first levels, from sums of all tasks; a few numbers for each node."""
    shared = binned.sparkSession.sparkContext.broadcast((tops, open_ones))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, open_ones = shared.value
        met: dict = {}
        for batch in batches:
            key, y, w, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), _bins_of(batch.column(3), columns)
            for tree, nodes in open_ones.items():
                c = bag(key, tree, seed)
                taken_rows = np.flatnonzero(c)
                at = tops[tree].parts(x[taken_rows])
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.r_[0 : len(tops[tree].feature) + 1])
                for node, tried in nodes.items():
                    r = taken_rows[order[ends[node] : ends[node + 1]]]
                    own = []
                    for f in tried:
                        cell = x[r, f].astype(np.int64)
                        cells = np.bincount(cell * classes + y[r], weights=w[r] * c[r], minlength=BINS * classes).reshape(BINS, classes)
                        taken, seen = (np.bincount(cell, weights=v, minlength=BINS)[:, None] for v in (c[r], None))
                        own.append(np.hstack([cells, taken, seen]))
                    met[tree, node] = met.get((tree, node), 0) + np.array(own)
        if met:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in met], pa.int32()), pa.array([n for _, n in met], pa.int32()), pa.array([task] * len(met), pa.int32()), pa.array([v.tobytes() for v in met.values()])], ["tree", "node", "task", "sums"])

    def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        tried = shared.value[1][tree][node]
        ordered = table.sort_by("task").column("sums")
        cells = sum(np.frombuffer(s.as_buffer()) for s in ordered).reshape(len(tried), BINS, classes + 2).cumsum(axis=1)
        stats = cells[0, -1, :classes]
        total = stats.sum()
        left, right = cells[:, :-1, :classes], np.maximum(stats - cells[:, :-1, :classes], 0.0)
        squares = lambda v: (v * v).sum(axis=2) / np.maximum(v.sum(axis=2), 1e-300)
        gain = (squares(left) + squares(right)) / total - (stats * stats).sum() / (total * total)
        fits = (cells[:, :-1, classes] >= leaf) & (cells[:, -1:, classes] - cells[:, :-1, classes] >= leaf)
        gain = np.where(fits, gain, 0.0)
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        seen = cells[j, b, -1], cells[j, -1, -1] - cells[j, b, -1]
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([int(tried[j]) if gain[j, b] > 1e-10 else -1], pa.int32()), "cut": pa.array([int(b)], pa.int32()), "gain": [float(gain[j, b] * total)], "first": [float(seen[0])], "second": [float(seen[1])]})

    return binned.mapInArrow(sums, "tree int, node int, task int, sums binary").groupBy("tree", "node").applyInArrow(best, "tree int, node int, feature int, cut int, gain double, first double, second double").collect()


def fit_wide_forest(rows: DataFrame, key: str, row: str, trees: int = 100, depth: int = 20, leaf: int = 1, seed: int = 42, most: int = 100_000) -> WideForest:
    """A forest of ``features``, ``label_index`` and ``weight``; bags follow from ``key``, a whole number (null: 0)."""
    work = Workspace(rows.sparkSession, "wide-forest")
    thresholds = _thresholds(rows, key)
    columns, depth = len(thresholds), min(depth, 30)
    count = math.ceil(math.sqrt(columns))
    plain = rows.select(F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"), F.col("label_index").cast("int").alias("y"), F.col("weight").cast("double").alias("w"), "features")
    binned = work.stage(_binned(plain, thresholds, "key", "y", "w"), "binned")
    whole, classes = binned.agg(F.count("*"), F.max("y") + 1).first()

    tops = [Top([-1], [0], [0], [0], [0.0] * columns) for _ in range(trees)]
    # Rows of a bag, without their repetitions.
    large = {t: [0] for t in range(trees)} if whole * (1 - math.exp(-1)) > most and depth > 0 else {}
    while large:
        open_ones = {t: {n: _tried(np.random.default_rng([seed, t, n, 1]), 1, columns, count)[0] for n in nodes} for t, nodes in large.items()}
        large = {}
        for r in sorted(_open_sums(binned, tops, open_ones, classes, columns, seed, leaf), key=lambda r: (r.tree, r.node)):
            if r.feature < 0:
                continue
            top = tops[r.tree]
            first = len(top.feature)
            top.feature[r.node], top.cut[r.node], top.child[r.node] = r.feature, r.cut, first
            top.gains[r.feature] += r.gain
            for place, seen in ((first, r.first), (first + 1, r.second)):
                top.feature.append(-1)
                top.cut.append(0)
                top.child.append(0)
                top.depth.append(top.depth[r.node] + 1)
                if seen > most and top.depth[place] < depth:
                    large.setdefault(r.tree, []).append(place)

    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, x = batch.column(0).to_numpy(), _bins_of(batch.column(3), columns)
            for tree, top in enumerate(shared.value if len(batch) else ()):
                c = bag(key, tree, seed)
                r = np.flatnonzero(c)
                own = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), tree, np.int32)), pa.array(top.parts(x[r]).astype(np.int32)), pa.array(c[r].astype(np.int32)), *own.columns], ["tree", "part", "c", "key", "y", "w", "x"])

    def grown(at: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, part = (k.as_py() for k in at)
        # In one order, whatever came first.
        table = table.sort_by([("key", "ascending"), ("y", "ascending"), ("x", "ascending")])
        c = table.column("c").to_numpy().astype(np.int64)
        rng = np.random.default_rng([seed, tree, part, 0])
        one = grow_tree(_bins_of(table.column("x"), columns), table.column("y").to_numpy().astype(np.int64), table.column("w").to_numpy() * c, c, classes, depth - shared.value[tree].depth[part], leaf, count, rng)
        return pa.table({"tree": pa.array([tree], pa.int32()), "part": pa.array([part], pa.int32()), "feature": [one.feature.tobytes()], "cut": [one.cut.tobytes()], "child": [one.child.tobytes()], "shares": [one.shares.tobytes()], "gains": [one.gains.tolist()]})

    tasks = sum(f < 0 for top in tops for f in top.feature)
    dealt = binned.mapInArrow(deal, "tree int, part int, c int, key bigint, y int, w double, x binary")
    parts = work.stage(dealt.repartition(tasks, "tree", "part").groupBy("tree", "part").applyInArrow(grown, _PARTS), "parts")
    work.drop(binned)
    return WideForest(parts, tops, thresholds, classes, row, most)
