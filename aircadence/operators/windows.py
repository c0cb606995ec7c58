"""Tumbling windows of a capture and fixed-rate series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from aircadence.functions.frames import _flag
from aircadence.operators.flows import _or_zero, _share

WINDOW = ["source_file", "window_idx"]


def assign_windows(features: DataFrame, window_sec: float = 10.0) -> DataFrame:
    """Add ``window_idx`` and ``time_start``; time 0 is a file's first frame."""
    first = features.groupBy("source_file").agg(F.min_by("timestamp", "frame_no").alias("t0"))
    index = ((F.col("timestamp") - F.col("t0")) / window_sec).cast("int")
    return features.join(first, "source_file").withColumn("window_idx", index).withColumn("time_start", F.col("t0") + F.col("window_idx") * window_sec)


def source_counts(windowed: DataFrame) -> DataFrame:
    return windowed.groupBy(*WINDOW, "sa").agg(F.count("*").alias("cnt"), F.min("frame_no").alias("first_no"))


def dominant_source(windowed: DataFrame) -> DataFrame:
    """Most frequent source of each window (ties: seen first) and the entropy."""
    counts = source_counts(windowed)
    totals = counts.groupBy(*WINDOW).agg(
        F.sum("cnt").alias("__n"), F.max_by("sa", F.struct("cnt", -F.col("first_no"))).alias("dominant_sa"), F.max("cnt").alias("__top"),
        F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))).alias("__clog"), F.count("*").alias("unique_sources"),
    )
    n = F.col("__n")
    # -sum(p log p) = log n - sum(c log c) / n
    entropy = F.greatest(F.log2(n.cast("double")) - F.col("__clog") / n, F.lit(0.0))
    return totals.select(*WINDOW, "unique_sources", (F.col("__top") / n).alias("dominant_source_ratio"), "dominant_sa", entropy.alias("source_entropy"))


def window_features(features: DataFrame, window_sec: float = 10.0) -> DataFrame:
    """The 16 window columns for each non-empty window of each file."""
    windowed = assign_windows(features, window_sec)
    c = F.col
    base = windowed.groupBy(*WINDOW).agg(
        F.min("time_start").alias("time_start"), F.sum(c("frame_len").cast("bigint")).alias("total_traffic_volume"), F.count("*").alias("packet_count"),
        _share(c("is_data") == 1).alias("data_frame_ratio"), _share(c("is_mgmt") == 1).alias("mgmt_frame_ratio"), _share(c("is_ctrl") == 1).alias("ctrl_frame_ratio"),
        _or_zero(F.avg("rssi")).alias("mean_global_rssi"), _or_zero(F.max("rssi")).alias("max_global_rssi"), _share(c("is_uplink") == 1).alias("uplink_ratio"), _share(c("is_qos_data") == 1).alias("qos_ratio"),
    )
    # Distinct pairs first, so that no task holds all destinations of a window.
    dests = windowed.select(*WINDOW, "da").distinct().groupBy(*WINDOW).agg(F.count("*").alias("unique_destinations"))
    return base.join(dests, WINDOW).join(dominant_source(windowed), WINDOW)


def throughput_series(frames: DataFrame, window_sec: float = 1.0) -> DataFrame:
    """Rates in equal bins from each file's first time; empty bins are 0.

    Files of fewer than two frames have no series.
    """
    span = frames.groupBy("source_file").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.count("*").alias("n")).where("n >= 2")
    last = ((F.col("t1") - F.col("t0")) / window_sec).cast("int")
    spine = span.select("source_file", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    filled = frames.join(span, "source_file").groupBy("source_file", F.floor((F.col("timestamp") - F.col("t0")) / window_sec).cast("int").alias("bin")).agg(F.sum(F.col("frame_len").cast("bigint")).alias("bytes"), F.count("*").alias("frames"))
    out = spine.join(filled, ["source_file", "bin"], "left").fillna(0, ["bytes", "frames"])
    return out.select("source_file", "bin", (F.col("bin") * window_sec + window_sec / 2).alias("centre"), (F.col("bytes") * 8 / F.lit(window_sec) / 1e6).alias("mbps"), (F.col("frames") / F.lit(window_sec)).alias("pps"))


def source_ranking(frames: DataFrame, n: int = 10) -> DataFrame:
    """The addresses that send most data frames (ties: seen first)."""
    rows = frames.where((F.col("frame_type") == 2) & F.col("sa").isNotNull() & (F.col("sa") != ""))
    return rows.groupBy(F.lower("sa").alias("mac")).agg(F.count("*").alias("frames"), F.min("frame_no").alias("first_no")).orderBy(F.desc("frames"), "first_no").limit(n)


def device_profile(features: DataFrame) -> DataFrame:
    """One row for each source address, ranked by how camera-like its frames are."""
    c = F.col
    out = features.groupBy("sa").agg(
        F.count("*").alias("frames"), F.sum(c("frame_len").cast("bigint")).alias("total_bytes"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.avg(c("frame_len").cast("double")).alias("mean_frame_size"), _share(c("is_uplink") == 1).alias("uplink_ratio"), _share(c("is_qos_data") == 1).alias("qos_ratio"),
        _or_zero(F.avg("rssi")).alias("mean_rssi"), F.max("is_known_camera_oui").alias("known_oui"),
    )
    suspicion = _flag(c("mean_frame_size") > 500) + _flag(c("uplink_ratio") > 0.7) + _flag(c("qos_ratio") > 0.5) + 2 * c("known_oui")
    return out.withColumn("suspicion", suspicion)


def candidate_truth(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit, false alarm and miss counts of candidate against true addresses."""
    a = candidates.select(F.lower("mac").alias("mac")).distinct().withColumn("said", F.lit(1))
    b = truth.select(F.lower("mac").alias("mac")).distinct().withColumn("true", F.lit(1))
    both = a.join(b, "mac", "full").fillna(0)
    return both.agg(F.sum(F.col("said") * F.col("true")).alias("hits"), F.sum(F.col("said") * (1 - F.col("true"))).alias("false_alarms"), F.sum((1 - F.col("said")) * F.col("true")).alias("misses"))


def proximity_trend(frames: DataFrame, window_sec: float = 10.0) -> DataFrame:
    """Mean signal of each source by window, and its change to the one before."""
    means = frames.where("rssi is not null and sa is not null").groupBy("source_file", "sa", F.floor(F.col("timestamp") / window_sec).cast("int").alias("bin")).agg(F.avg("rssi").alias("mean_rssi"))
    return means.withColumn("change", F.col("mean_rssi") - F.lag("mean_rssi").over(Window.partitionBy("source_file", "sa").orderBy("bin")))
