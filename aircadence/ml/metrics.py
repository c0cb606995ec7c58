"""Metrics of predictions as relations ``(y_true, y_pred[, score])``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence.workspace import Workspace


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(rows: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """Counts and row shares of all (true, predicted) pairs of classes."""
    counts = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    if classes is None:
        names = counts.select(F.col("y_true").alias("y")).union(counts.select("y_pred")).distinct()
    else:
        names = counts.sparkSession.createDataFrame([(c,) for c in classes], f"y {dict(rows.dtypes)['y_true']}")
    # The spine pairs classes, not rows.
    spine = names.select(F.col("y").alias("y_true")).crossJoin(names.select(F.col("y").alias("y_pred")))
    full = spine.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])
    return full.withColumn("share", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true"))))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    counts = rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said")),
    )).alias("s")).select("s.*")
    out = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("true").alias("support"), F.sum("said").alias("said"))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("said"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return out.select("label", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def overall_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, and macro and weighted precision, recall and F1, in one row."""
    per = class_metrics(rows)
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{c}_weighted")
    # Weighted recall is accuracy.
    return per.agg(w("recall").alias("accuracy"), *(F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")), *(w(c) for c in ("precision", "recall", "f1")))


def binary_detection(rows: DataFrame) -> DataFrame:
    """Counts and rates of 0/1 detection; empty denominators count as 1."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    out = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    c, one = F.col, F.lit(1)
    out = out.withColumn("detection_rate", c("tp") / F.greatest(c("tp") + c("fn"), one)).withColumn("false_alarm_rate", c("fp") / F.greatest(c("fp") + c("tn"), one))
    out = out.withColumn("precision", c("tp") / F.greatest(c("tp") + c("fp"), one))
    return out.withColumn("f1", 2 * c("tp") / F.greatest(2 * c("tp") + c("fp") + c("fn"), one))


def _steps(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each distinct score's own positives and negatives, the sums down to it and the totals.

    Scores are dealt to tasks by range.  Running sums stay inside a range; only
    one row for each range goes through a single task.  ``by`` keeps groups apart.
    """
    spark = rows.sparkSession
    steps = rows.groupBy(*by, "score").agg(F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") != 1).alias("q"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = Workspace(spark, "score-steps").stage(steps.repartitionByRange(parts, *by, F.desc("score")).withColumn("part", F.spark_partition_id()), "steps")
    before, every = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    ranges = steps.groupBy(*by, "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    none = F.lit(0)
    ranges = ranges.select(
        *by, "part", F.coalesce(F.sum("p").over(before), none).alias("p0"), F.coalesce(F.sum("q").over(before), none).alias("q0"),
        F.sum("p").over(every).alias("positives"), F.sum("q").over(every).alias("negatives"),
    )
    down = Window.partitionBy(*by, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select(*by, "part", "score", "p", "q", F.sum("p").over(down).alias("p1"), F.sum("q").over(down).alias("q1"))
    return summed.join(F.broadcast(ranges), [*by, "part"]).select(*by, "score", "p", "q", (F.col("p0") + F.col("p1")).alias("tp"), (F.col("q0") + F.col("q1")).alias("fp"), "positives", "negatives")


def score_steps(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each distinct score: true and false positives from the highest down to it."""
    return _steps(rows, by).drop("p", "q")


def roc_curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates at each distinct score; groups with one class only have no curve."""
    return score_steps(rows, by).where("positives > 0 and negatives > 0").select(*by, "score", (F.col("fp") / F.col("negatives")).alias("fpr"), (F.col("tp") / F.col("positives")).alias("tpr"))


def pr_curve(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return score_steps(rows, by).where("positives > 0").select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def roc_auc(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by trapezes (null with one class only)."""
    s = _steps(rows, by).withColumn("y2", 2 * F.col("tp") - F.col("p"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("q") * F.col("y2")) / 2.0, (F.max("positives") * F.max("negatives")).cast("double")).alias("auc"))


def one_vs_rest(rows: DataFrame, label: str, probabilities: str, names: Sequence[str]) -> DataFrame:
    """A row ``(label, y_true, score)`` for each row and class, for curves with ``by=["label"]``."""
    each = rows.select(F.col(label).alias("__y"), F.posexplode(probabilities).alias("__k", "score"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("__k") + 1)
    return each.select(name.alias("label"), (F.col("__y") == F.col("__k")).cast("int").alias("y_true"), "score")


def weighted_vote(probabilities: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted mean of arrays of class probabilities."""
    total = float(sum(weights))

    def scaled(name: str, w: float) -> Column:
        return F.transform(F.col(name), lambda x: x * (w / total))

    terms = [scaled(p, w) for p, w in zip(probabilities, weights, strict=True)]
    return reduce(lambda one, two: F.zip_with(one, two, lambda a, b: a + b), terms)


def argmax(probabilities: Column) -> Column:
    """0-based place of the greatest element, the first of equals."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def weight_search(rows: DataFrame, label: str, first: str, second: str, most: int = 5, metric: str = "accuracy") -> DataFrame:
    """Score of the soft vote for all pairs of weights 1..most, best first.

    Every row meets a fixed grid of weights, in one aggregation.  ``metric`` is
    "accuracy" or "f1_weighted".
    """
    grid = F.array(*(F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2")) for a in range(1, most + 1) for b in range(1, most + 1)))
    tried = rows.select(label, first, second, F.explode(grid).alias("g")).select(label, "g.w1", "g.w2", F.zip_with(first, second, lambda a, b: a * F.col("g.w1") + b * F.col("g.w2")).alias("p"))
    if metric == "accuracy":
        scored = tried.groupBy("w1", "w2").agg(F.avg((argmax(F.col("p")) == F.col(label)).cast("double")).alias("accuracy"))
    else:
        # Weighted F1 from the counts of (weights, true, predicted).
        counts = tried.groupBy("w1", "w2", F.col(label).cast("int").alias("t"), argmax(F.col("p")).cast("int").alias("s")).count()
        side = lambda c, true, said: F.struct(F.col(c).alias("k"), F.when(F.col("t") == F.col("s"), F.col("count")).otherwise(0).alias("tp") if true else F.lit(0).cast("bigint").alias("tp"), (F.col("count") if true else F.lit(0).cast("bigint")).alias("true"), (F.col("count") if said else F.lit(0).cast("bigint")).alias("said"))
        sides = counts.select("w1", "w2", F.explode(F.array(side("t", True, False), side("s", False, True))).alias("x")).select("w1", "w2", "x.*")
        each = sides.groupBy("w1", "w2", "k").agg(F.sum("tp").alias("tp"), F.sum("true").alias("true"), F.sum("said").alias("said"))
        f1 = _ratio(2 * F.col("tp"), F.col("true") + F.col("said"))
        scored = each.groupBy("w1", "w2").agg((F.sum(f1 * F.col("true")) / F.sum("true")).alias(metric))
    return scored.orderBy(F.desc(metric), "w1", "w2")


def best_weights(searched: DataFrame) -> tuple[tuple[int, int], float]:
    """The first weights with the best score; equal ones if all scores are 0."""
    top = searched.first()
    return ((1, 1), 0.0) if top is None or not top[2] else ((top.w1, top.w2), top[2])


def rank_features(importances: DataFrame) -> DataFrame:
    """Add rank by importance (ties by name) and the cumulative sum."""
    w = Window.orderBy(F.desc("importance"), "feature")
    return importances.select("feature", "importance", F.row_number().over(w).alias("rank"), F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def top_features(importances: DataFrame, k: int | None = None, threshold: float = 0.01) -> DataFrame:
    """The k most important features, or all that reach the threshold."""
    ranked = rank_features(importances)
    return ranked.where(F.col("rank") <= k) if k is not None else ranked.where(F.col("importance") >= threshold)
