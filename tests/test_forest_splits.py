"""Splits of a tree's nodes: the best of all, in time and memory that do not grow with the classes of each row."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from aircadence.ml import wide_forests
from aircadence.ml.wide_forests import BINS, grow_tree


def plain(x, y, w, c, tried, leaf):
    """Gains of all splits of one node, by trial."""
    gini = lambda r: 1 - ((np.bincount(y[r], weights=w[r]) / w[r].sum()) ** 2).sum()
    out, whole = {}, np.ones(len(y), bool)
    for f in tried:
        for b in range(BINS - 1):
            low = x[:, f] <= b
            if low.any() and not low.all() and min(c[low].sum(), c[~low].sum()) >= leaf:
                out[f, b] = gini(whole) - (w[low].sum() * gini(low) + w[~low].sum() * gini(~low)) / w.sum()
    return out


@pytest.mark.parametrize("leaf", [1, 3])
@pytest.mark.parametrize("uneven", [False, True])
def test_best_split_of_small_and_large_nodes(leaf, uneven):
    rng = np.random.default_rng(leaf + 10 * uneven)
    # Forty-odd small nodes, whose sums together pass 64 bits, and two large ones.
    at = np.r_[np.repeat(np.arange(48), rng.integers(4, 60, 48)), np.repeat([48, 49], [130, 400])]
    at = rng.permutation(at)
    rows = np.sort(rng.choice(3 * len(at), len(at), replace=False))
    x, y, c = rng.integers(0, BINS, (3 * len(at), 6)).astype(np.uint8), rng.integers(0, 5, 3 * len(at)), 1 + rng.poisson(0.5, 3 * len(at))
    w = (np.array([1e-3, 1, 7, 50, 0.3]) if uneven else np.ones(5))[y] * c
    stats = np.bincount(at * 5 + y[rows], weights=w[rows], minlength=250).reshape(50, 5)
    tried = np.array([rng.choice(6, 3, replace=False) for _ in range(50)])
    gains, column, cut = wide_forests._best(x, rows, at, y, w, c, stats, tried, leaf)
    for k in range(50):
        r = rows[at == k]
        tries = plain(x[r], y[r], w[r], c[r], tried[k], leaf)
        best = max(tries.values(), default=0.0)
        # Weights are rounded to 2**-30 of a node.
        assert gains[k] == pytest.approx(best, abs=1e-7)
        assert (column[k] == -1) if best < 1e-10 else tries[column[k], cut[k]] == pytest.approx(best, abs=1e-7)
    # Neither the order of the rows nor the other nodes matter.
    mixed = rng.permutation(len(at))
    again = wide_forests._best(x, rows[mixed], at[mixed], y, w, c, stats, tried, leaf)
    assert np.allclose(again[0], gains, atol=1e-12)
    own = at < 20
    assert all((a == b[:20]).all() for a, b in zip(wide_forests._best(x, rows[own], at[own], y, w, c, stats[:20], tried[:20], leaf), (gains, column, cut)))


def test_no_table_of_rows_and_classes():
    """Each tried column made tables of all rows by all classes before, which was most of the time of a forest."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, BINS, (20_000, 8)).astype(np.uint8), rng.integers(0, 100, 20_000)
    one = np.ones(len(y))
    tracemalloc.start()
    tree = grow_tree(x, y, one, one, 100, 3, 1, 3, np.random.default_rng(0))
    wide = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    # Many small nodes: 40 rows in each.
    at = np.sort(rng.integers(0, 500, len(y)))
    stats = np.bincount(at * 100 + y, minlength=50_000).reshape(500, 100).astype(float)
    held = tracemalloc.get_traced_memory()[0]
    wide_forests._best(x, np.arange(len(y)), at, y, one, one, stats, np.tile([0, 1, 2], (500, 1)), 1)
    small = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert len(tree.feature) == 15
    # A table of rows and classes has 16 MB.
    assert wide < 16e6 and small < 16e6
