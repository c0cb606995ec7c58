"""Quality rules: rule statistics judged by an isolation forest.

Base statistics of each whole text are counted once, in Arrow batches.  Two
fixed rules reject a document outright.  The rest is judged by an isolation
forest: random splits isolate odd rows after few steps, so a short mean path
is a high score.  The trees are grown on a bounded sample of labelled good
rows; their splits fall anywhere in the box that all sampled labelled rows
span, so places that good rows leave empty have short paths.  The threshold is
calibrated on all labelled rows by a distributed histogram of scores.

Defined cases: a null text has no words and fails the base rules, as an empty
one does; labels that are null, or whose id no document has, are ignored, and
an id with several labels counts as good if one says so; without labelled good
rows nothing is rejected beyond the base rules; rows that repeat an id are
judged one by one, and so are rows with a null id, of which none is labelled;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from aircadence.llm import textkernel as tk
from aircadence.workspace import Workspace

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further statistics that only the forest sees.
EXTRA = ("n_lines", "n_upper", "n_digits", "n_distinct", "n_bars", "n_ends")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[ord("|")] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_SPACES = " \t\n\v\f\r"


def _per_doc(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(marks), bounds))


def _repeat_words(windows: np.ndarray) -> int:
    """Words covered by windows of three words that occur twice or more."""
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    if not len(at):
        return 0
    covered = np.zeros(len(windows) + 2, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def _dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> list[pa.Array]:
    """The statistics of whole texts, in the order of ``BASE`` and ``EXTRA``."""
    columns: dict[str, list] = {c: [] for c in BASE + EXTRA}
    for first, stop, data, bounds in tk.chunks(texts):
        words = tk.scan(data, bounds, tk.NON_SPACE)
        hashes = tk.hashes(data, words, lower=False)
        inside = np.zeros(len(data), dtype=bool) if not len(data) else tk.NON_SPACE[data]
        columns["n_words"].append(np.diff(words.first))
        columns["word_chars"].append(_per_doc(inside & ((data & 0xC0) != 0x80), bounds))
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_bars", _BAR), ("n_ends", _END)):
            columns[name].append(_per_doc(table[data], bounds))
        columns["n_lines"].append(_per_doc(data == 10, bounds) + 1)
        three = np.zeros(0, np.uint64)
        if len(hashes) > 2:
            step = tk.constants(3, 29)
            three = tk.mix(hashes[:-2] * step[0] + hashes[1:-1] * step[1] + hashes[2:] * step[2])
        raw = data.tobytes()
        repeat, dup, distinct = [], [], []
        for i in range(stop - first):
            a, b = words.first[i], words.first[i + 1]
            repeat.append(_repeat_words(three[a: max(a, b - 2)]))
            dup.append(_dup_lines(raw[bounds[i]: bounds[i + 1]]))
            distinct.append(len(np.unique(hashes[a:b])))
        columns["n_repeat_words"].append(np.array(repeat))
        columns["n_dup_lines"].append(np.array(dup))
        columns["n_distinct"].append(np.array(distinct))
    return [pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in columns.values()]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *measure(batch.column(1))], ["id", *BASE, *EXTRA])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule statistics ``(id, ...)`` of every row's whole text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tk.trimmed(_statistics), "id bigint, " + ", ".join(f"{c} bigint" for c in BASE + EXTRA))


def features(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rates that do not depend on a text's length, one row for each document."""
    col = {c: table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in BASE + EXTRA}
    words, chars = np.maximum(col["n_words"], 1), np.maximum(col["word_chars"], 1)
    rates = np.stack([
        col["word_chars"] / words,
        col["n_symbols"] / words,
        col["n_dup_lines"] / col["n_lines"],
        col["n_repeat_words"] / words,
        col["n_upper"] / chars,
        col["n_digits"] / chars,
        col["n_bars"] / words,
        col["n_ends"] / words,
        # A text's vocabulary grows with about this power of its length.
        col["n_distinct"] / words ** 0.85,
    ], axis=1)
    return np.log1p(20 * rates)


class Forest:
    """Isolation trees as flat arrays: feature (-1 at a leaf), cut, left child."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], norm: float):
        self.trees, self.norm = trees, norm

    @staticmethod
    def expected(n: float) -> float:
        """Mean path length of an unsuccessful search among ``n`` rows."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    @classmethod
    def grow(cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        """Grow trees on ``rows``, splitting at random inside the box ``low`` to ``high``.

        The box may be wider than the rows; its empty parts become leaves
        after few splits, so what falls there has short paths.
        """
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        depth = int(np.ceil(np.log2(max(sample, 2)))) + 2
        wide = np.flatnonzero(high > low)
        grown = []
        for _ in range(trees):
            feature, cut, left, length = [], [], [], []
            todo = [(rows[rng.choice(len(rows), sample, replace=False)], low, high, 0)]
            at = 0
            while at < len(todo):
                part, lo, hi, level = todo[at]
                at += 1
                if level >= depth or len(part) <= 1 or not len(wide):
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(0)
                    length.append(level + cls.expected(len(part)))
                    continue
                f = int(rng.choice(wide))
                c = float(rng.uniform(lo[f], hi[f]))
                feature.append(f)
                cut.append(c)
                left.append(len(todo))
                length.append(0.0)
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = c
                todo += [(part[part[:, f] < c], lo, below, level + 1), (part[part[:, f] >= c], above, hi, level + 1)]
            grown.append((np.array(feature), np.array(cut), np.array(left), np.array(length)))
        return cls(grown, cls.expected(sample) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]; short paths score high."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                inner = f >= 0
                step = left[node] + (rows[every, np.maximum(f, 0)] >= cut[node])
                node = np.where(inner, step, node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / self.norm) if self.trees else np.zeros(len(rows))


def _judge(forest: Forest, table: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Base failures, and anomaly scores to six places."""
    base = pc.or_(pc.less(table.column("n_words"), 50), pc.greater(pc.multiply(table.column("n_repeat_words"), 100), pc.multiply(table.column("n_words"), 50)))
    return base, np.round(forest.score(features(table)), 6)


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, score = _judge(forest, batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", *BASE)), base, pa.array(score)], ["id", *BASE, "base_failed", "score"])

    return run


def _good_rows(forest: Forest, threshold: float, text_at: int):
    """Keep the rows whose own text is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, score = _judge(forest, pa.RecordBatch.from_arrays(measure(batch.column(text_at)), [*BASE, *EXTRA]))
            yield batch.filter(pc.and_(pc.invert(base), pa.array(score <= threshold)))

    return run


def calibrate(histogram: list[tuple[int, int, int]], caution: float) -> int:
    """The highest step at which bad rows kept and good rows lost cost least.

    ``histogram`` holds (step, good rows, bad rows); rows at or below the
    returned step are kept.  A share of good rows lost weighs ``caution``
    times a share of bad rows kept.  Without bad rows everything is kept.
    """
    good, bad = (max(1, sum(r[k] for r in histogram)) for k in (1, 2))
    top = max((r[0] for r in histogram), default=0)
    best, least, lost, kept = top, sum(r[2] for r in histogram) / bad, 0, sum(r[2] for r in histogram)
    for step, n_good, n_bad in sorted(histogram, reverse=True):
        lost, kept = lost + n_good, kept - n_bad
        cost = kept / bad + caution * lost / good
        if cost < least:
            best, least = step - 1, cost
    return best


def _fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality",
    caution: float = 5.0, trees: int = 100, sample: int = 1024, fit_rows: int = 20_000, seed: int = 7,
) -> tuple[Forest, float, DataFrame]:
    """The forest, its threshold, and all rows of ``docs`` with their scores."""
    work = Workspace(docs.sparkSession, "quality")
    stats = work.stage(statistics(docs, id_col, text_col), "statistics")
    marks = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("good")).where("id is not null and good is not null").groupBy("id").agg((F.max("good") == 1).alias("good"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # The least hashes of ids are a sample that reruns repeat.
    fit = stats.where(~base).join(marks, "id").orderBy(F.xxhash64("id"), *BASE).limit(fit_rows).toArrow()
    seen, good = features(fit), np.array(fit.column("good").to_pylist(), dtype=bool)
    forest = Forest.grow(seen[good], seen.min(axis=0), seen.max(axis=0), trees, sample, seed) if good.any() else Forest([], 1.0)
    scored = work.stage(stats.mapInArrow(tk.trimmed(_scored(forest)), "id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, score double"), "scored")
    # The histogram has at most 1001 rows, whatever the input.
    steps = scored.where("not base_failed").join(marks, "id").groupBy(F.ceil(F.col("score") * 1000).alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    return forest, calibrate([tuple(r) for r in steps], caution) / 1000 if forest.trees else 1.0, scored


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Judge every row of ``docs``.

    Returns ``(id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept)``.  ``labels`` holds ``id_col``
    and ``label_col`` (1: good, 0: bad).  Options are ``label_col``,
    ``caution``, ``trees``, ``sample``, ``seed`` and ``fit_rows``, which bounds
    the labelled rows that the trees see; the threshold uses every labelled row.
    """
    _, threshold, scored = _fit(docs, labels, id_col, text_col, **options)
    return scored.select(F.col("id").alias(id_col), *BASE, "base_failed", "score", (~F.col("base_failed") & (F.col("score") <= threshold)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were.

    A row is judged by its own text where it lies, so texts are not shuffled,
    and null or repeated ids change nothing.
    """
    forest, threshold, _ = _fit(docs, labels, id_col, text_col, **options)
    return docs.mapInArrow(tk.trimmed(_good_rows(forest, threshold, docs.columns.index(text_col))), docs.schema)
