"""Cameras among other devices: several at once, and whether one comes nearer.

Devices are looked at window by window, each by its own figures, so that many can
be told side by side, and all sums run over windows, not frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence.functions.frames import _flag, estimated_distance
from aircadence.operators.flows import _share

DEVICE = ["source_file", "sa"]


def device_windows(features: DataFrame, window_sec: float = 10.0) -> DataFrame:
    """One row for each device and window, with ``score`` from 0 to 9: the signs of an uploading camera."""
    c = F.col
    size, rate = c("frame_len").cast("double"), F.when(c("data_rate") > 0, c("data_rate"))
    out = features.groupBy(*DEVICE, F.floor(c("timestamp") / window_sec).alias("window_id")).agg(
        F.count("*").alias("packets"), F.sum(c("frame_len").cast("bigint")).alias("bytes"), F.avg(size).alias("__size"), _share(c("frame_len") > 1000).alias("__large"), _share(c("is_uplink") == 1).alias("__up"),
        _share(c("is_qos_data") == 1).alias("__qos"), _share(c("protected_flag") == 1).alias("__protected"), F.avg(rate).alias("__rate"), F.avg("rssi").alias("mean_rssi"), F.max("channel_freq").alias("channel_freq"),
    )
    score = 2 * _flag(c("__size") > 1000) + 2 * _flag(c("__large") > 0.5) + 2 * _flag(c("__up") > 0.7) + _flag(c("__qos") > 0.5) + _flag(c("__protected") > 0.5) + _flag(c("__rate") > 50)
    return out.select(*DEVICE, "window_id", "packets", "bytes", "mean_rssi", "channel_freq", score.alias("score"))


def joint_cameras(windows: DataFrame, least_score: int = 5, min_windows: int = 2, min_stability: float = 0.5, most_lag: int = 3) -> DataFrame:
    """Devices of :func:`device_windows` with what tells several cameras apart.

    ``stability`` is the share of a device's windows that look like a camera's,
    ``overlap_windows`` counts those in which another device does too, and
    ``mean_share`` is the device's part of the bytes around it.  ``alignment`` is the
    greatest correlation of its bytes with those of the file's leading device, over
    shifts of up to ``most_lag`` windows, and ``lag`` the shift: a relayed stream
    follows its source, a second camera does not.  Both are null for the leader, and
    where no shift has three windows in common that vary.
    """
    c = F.col
    like = _flag(c("score") >= least_score)
    of_window = Window.partitionBy("source_file", "window_id")
    rows = windows.withColumn("__like", like).withColumn("__alike", F.sum("__like").over(of_window)).withColumn("__all", F.sum("bytes").over(of_window))
    devices = rows.groupBy(*DEVICE).agg(
        F.count("*").alias("windows"), F.sum("__like").alias("camera_windows"), F.sum(_flag((c("__like") == 1) & (c("__alike") > 1))).alias("overlap_windows"),
        F.avg(c("bytes") / c("__all")).alias("mean_share"), F.sum("bytes").alias("__bytes"),
    )
    first = Window.partitionBy("source_file").orderBy(F.desc("camera_windows"), F.desc("__bytes"), "sa")
    leaders = devices.withColumn("__k", F.row_number().over(first)).where("__k = 1").select(c("source_file").alias("__file"), c("sa").alias("leader"))
    series = windows.select(c("source_file").alias("__of"), c("sa").alias("__sa"), c("window_id").alias("__window"), c("bytes").alias("__led"))
    leading = series.join(leaders, (c("__of") == c("__file")) & (c("__sa") == c("leader"))).select("__file", "leader", "__window", "__led")
    shifted = windows.select(*DEVICE, "window_id", "bytes", F.explode(F.sequence(F.lit(-most_lag), F.lit(most_lag))).alias("lag"))
    met = shifted.join(leading, (c("source_file") == c("__file")) & (c("window_id") - c("lag") == c("__window"))).where("sa <> leader")
    pairs = met.groupBy(*DEVICE, "lag").agg(F.count("*").alias("__n"), F.corr(c("bytes").cast("double"), c("__led").cast("double")).alias("__r"), F.var_pop("bytes").alias("__v"), F.var_pop("__led").alias("__w"))
    pairs = pairs.where("__n >= 3 and __v > 0 and __w > 0").withColumn("__r", F.round("__r", 6))
    best = pairs.groupBy(*DEVICE).agg(F.min(F.struct((-c("__r")).alias("r"), F.abs("lag").alias("d"), "lag")).alias("__best"))
    best = best.select(*DEVICE, (F.lit(0.0) - c("__best.r")).alias("alignment"), c("__best.lag").alias("lag"))
    stability = c("camera_windows") / c("windows")
    out = devices.join(best, DEVICE, "left").withColumn("stability", stability)
    return out.withColumn("is_camera", (c("camera_windows") >= min_windows) & (c("stability") >= min_stability)).select(
        *DEVICE, "windows", "camera_windows", "stability", "overlap_windows", "mean_share", "alignment", "lag", "is_camera",
    )


def approaches(windows: DataFrame, drift: float = 1.0, threshold: float = 8.0) -> DataFrame:
    """Changes of a device's signal, by cumulative sums (CUSUM) of :func:`device_windows`.

    The sum of (signal - mean - drift) since its last low is ``rise``, that of
    (mean - drift - signal) is ``fall``; over ``threshold`` the device is
    "approaching" or "receding", since ``since_window``.  A sum that is held at 0 from
    below is the running total less its own least value so far, so the recursion is
    a window.  Windows without a signal are left out; ``distance_m`` is estimated.
    """
    c = F.col
    order = Window.partitionBy(*DEVICE).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    heard = windows.where("mean_rssi is not null").withColumn("__off", c("mean_rssi") - F.avg("mean_rssi").over(Window.partitionBy(*DEVICE)))

    def held(name: str, step: Column, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(f"__{name}", F.round(F.sum(step).over(order), 6))
        low = F.least(F.lit(0.0), F.min(f"__{name}").over(order))
        rows = rows.withColumn(name, F.round(c(f"__{name}") - low, 6))
        # The window after the last low.
        return rows.withColumn(f"__{name}_low", F.max(F.when(c(name) == 0, c("window_id"))).over(order))

    rows = held("fall", -c("__off") - drift, held("rise", c("__off") - drift, heard))
    up, down = c("rise") > threshold, c("fall") > threshold
    trend = F.when(up & (~down | (c("rise") >= c("fall"))), "approaching").when(down, "receding").otherwise("steady")
    since = F.when(trend == "approaching", c("__rise_low") + 1).when(trend == "receding", c("__fall_low") + 1)
    return rows.select(*DEVICE, "window_id", "mean_rssi", "rise", "fall", trend.alias("trend"), since.alias("since_window"), estimated_distance("mean_rssi").alias("distance_m"))
