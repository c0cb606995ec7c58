"""The data behind the plots: counts, histograms, box statistics, fits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from aircadence.operators.quantiles import join_keys, quantiles


def type_counts(frames: DataFrame) -> DataFrame:
    return frames.where("frame_type in (0, 1, 2)").groupBy("frame_type").agg(F.count("*").alias("frames"))


def channel_usage(frames: DataFrame) -> DataFrame:
    return frames.where("channel_freq > 0").groupBy("channel_freq").agg(F.count("*").alias("frames"))


def histogram(rows: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from least to greatest value, the last one closed.

    ``by`` makes a histogram of each group.  Returns the bin, its lower edge,
    the count, and the density.
    """
    x = F.col(column).cast("double")
    rows = rows.where(x.isNotNull()).select(*by, x.alias("x"))
    # An integer key keeps the range join an equi-join without groups too.
    keys = [*by, "__all"]
    rows = rows.withColumn("__all", F.lit(0))
    span = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    # A single value gets a range of one around it.
    span = span.withColumn("width", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins).withColumn("lo", F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = rows.join(F.broadcast(span) if not by else span, keys).groupBy(*keys, at.alias("bin"), "lo", "width", "n").agg(F.count("*").alias("frames"))
    return counts.select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"), "frames", (F.col("frames") / F.col("n") / F.col("width")).alias("density"))


def mean_rate(frames: DataFrame) -> DataFrame:
    return frames.agg(F.avg(F.when(F.col("data_rate") > 0, F.col("data_rate"))).alias("mean_data_rate"))


def box_statistics(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outlier counts."""
    x = rows.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("x"))
    q = quantiles(x, [by], {"q": F.col("x")}, (0.25, 0.5, 0.75)).toDF(by, "q1", "median", "q3")
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= lo) & (F.col("x") <= hi)
    return join_keys(x, q, [by]).groupBy(by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.count_if(~inside).alias("fliers"), F.count("*").alias("n"))


def line_fit(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least-squares line of signal over the index of valid values (over 1)."""
    x = F.col("rssi_pos").cast("double")
    out = sessions.where("rssi is not null").groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("rssi", x).alias("slope"), F.avg("rssi").alias("__y"), F.avg(x).alias("__x"), F.min(x).alias("__x0")).where("n > 1")
    return out.select(*by, "n", "slope", (F.col("__y") - F.col("slope") * (F.col("__x") - F.col("__x0"))).alias("intercept"))


def correlation_pairs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = rows.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("p")).select("p.*")


def feature_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population and sample deviation of each column, long form."""
    one = rows.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("var", F.var_samp))))
    long = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), F.col(f"var_{c}").alias("variance")) for c in columns))
    return one.select(F.explode(long).alias("s")).select("s.*")


def top_by_variance(rows: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    return feature_stats(rows, columns).select("feature", "variance").orderBy(F.desc("variance"), "feature").limit(n)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
