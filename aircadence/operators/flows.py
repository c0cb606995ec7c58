"""Flows, bursts, and their features.

A flow is the frames of one (file, source, destination) without a gap of more
than the timeout; a burst is a run within a flow without a gap of more than
the threshold.  Both are gaps and islands over the same order.

The order is built in two levels so that one busy pair does not land in one
task: windows run within time buckets of a pair, and a small table of one row
for each bucket carries the last time and the counts over to the next bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence import schema as S
from aircadence.functions.frames import _flag, oui
from aircadence.operators.quantiles import join_keys, quantiles
from aircadence.workspace import Workspace

PAIR = ["source_file", "sa", "da"]
FLOW = [*PAIR, "flow_id"]
BUCKET_SECONDS = 3600.0


def _earlier(order: str) -> Window:
    return Window.partitionBy(*PAIR).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def sessionise(features: DataFrame, timeout_sec: float = 5.0, burst_ms: float = 1.0, bucket_sec: float = BUCKET_SECONDS) -> DataFrame:
    """Add ``iat, pos, rssi_pos, flow_id, burst_id`` to frame features.

    ``pos`` counts a pair's frames from 0 in time order; a flow's id is the
    ``pos`` of its first frame, and so is a burst's.  ``iat`` is the gap in
    seconds to the frame before in the same flow.
    """
    bucket = [*PAIR, "__bucket"]
    local = Window.partitionBy(*bucket).orderBy("timestamp", "frame_no")
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    c = F.col

    def opens_flow(gap: Column) -> Column:
        return gap > timeout_sec

    def opens_burst(gap: Column) -> Column:
        return opens_flow(gap) | (gap * 1000 > burst_ms)

    rows = features.withColumn("__bucket", F.floor(c("timestamp") / bucket_sec))
    rows = rows.withColumn("__gap", c("timestamp") - F.lag("timestamp").over(local)).withColumn("__at", F.row_number().over(local) - 1).withColumn("__rs", F.count("rssi").over(running))
    # Starts inside a bucket, by place in the bucket; its first frame is judged below.
    rows = rows.withColumn("__flow", F.when(opens_flow(c("__gap")), c("__at"))).withColumn("__burst", F.when(opens_burst(c("__gap")), c("__at")))

    # One row for each bucket, on the partitioning that the windows have.
    ends = rows.groupBy(*bucket).agg(F.min("timestamp").alias("__t0"), F.max("timestamp").alias("__t1"), F.count("*").alias("__n"), F.count("rssi").alias("__r"), F.max("__flow").alias("__f"), F.max("__burst").alias("__b"))
    earlier = _earlier("__bucket")
    ends = ends.select(
        *bucket, "__f", "__b", (c("__t0") - F.max("__t1").over(earlier)).alias("__gap0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__r").over(earlier), F.lit(0)).alias("__r0"),
    )
    first_opens = {k: c("__gap0").isNull() | f(c("__gap0")) for k, f in (("f", opens_flow), ("b", opens_burst))}
    ends = ends.select(
        *bucket, "__gap0", "__n0", "__r0",
        # The start that holds before the bucket's own ones: its first frame's, or the last one of earlier buckets.
        *(F.when(first_opens[k], c("__n0")).otherwise(F.max(F.coalesce(c("__n0") + c(f"__{k}"), F.when(first_opens[k], c("__n0")))).over(earlier)).alias(f"__{k}0") for k in ("f", "b")),
        first_opens["f"].alias("__new"),
    )
    rows = rows.withColumn("__fl", F.max("__flow").over(running)).withColumn("__bl", F.max("__burst").over(running)).join(ends, bucket)
    gap = F.when(c("__at") == 0, F.when(~c("__new"), c("__gap0"))).when(c("__flow").isNull(), c("__gap"))
    return rows.select(
        *features.columns, gap.alias("iat"), (c("__at") + c("__n0")).alias("pos"), F.when(c("rssi").isNotNull(), c("__rs") + c("__r0") - 1).alias("rssi_pos"),
        F.coalesce(c("__n0") + c("__fl"), c("__f0")).alias("flow_id"), F.coalesce(c("__n0") + c("__bl"), c("__b0")).alias("burst_id"),
    )


def camera_score() -> Column:
    """Heuristic score from 0 to 10 on flow features."""
    c = F.col
    return (
        2 * _flag(c("mean_frame_size") > 1000) + 2 * _flag(c("large_frame_ratio") > 0.5) + 2 * _flag(c("uplink_ratio") > 0.7)
        + _flag(c("qos_data_ratio") > 0.5) + _flag(c("protected_ratio") > 0.5) + _flag((c("cv_iat") < 0.5) & (c("mean_iat") > 0)) + _flag(c("mean_data_rate") > 50)
    )


def _share(condition: Column) -> Column:
    return F.avg(_flag(condition).cast("double"))


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


#: Gaps of a flow that one aggregate may hold for their median.
MOST_HELD = 100_000


def flow_features(sessions: DataFrame, median_gap: bool = True, most_held: int = MOST_HELD) -> DataFrame:
    """One row of 35 features for each flow of :func:`sessionise`'s output.

    The aggregate holds up to ``most_held`` gaps of a flow for their median.  The
    rows are staged, and only if some flow is larger do the sessions of such flows
    take a second pass.  Without ``median_gap`` the column ``median_iat`` is left out
    and nothing is staged.
    """
    c, ms = F.col, F.col("iat") * 1000
    size, rate = F.col("frame_len").cast("double"), F.when(F.col("data_rate") > 0, F.col("data_rate"))
    out = sessions.groupBy(*FLOW).agg(
        (F.max("timestamp") - F.min("timestamp")).alias("duration_sec"), F.count("*").alias("packet_count"), F.sum(c("frame_len").cast("bigint")).alias("total_bytes"),
        F.avg(size).alias("mean_frame_size"), F.stddev_pop(size).alias("std_frame_size"), F.min("frame_len").alias("min_frame_size"), F.max("frame_len").alias("max_frame_size"), F.median(size).alias("median_frame_size"),
        _share(c("frame_len") > 1000).alias("large_frame_ratio"), _share(c("frame_len") < 100).alias("small_frame_ratio"),
        _or_zero(F.avg(ms)).alias("mean_iat"), _or_zero(F.stddev_pop(ms)).alias("std_iat"), _or_zero(F.min(ms)).alias("min_iat"), _or_zero(F.max(ms)).alias("max_iat"),
        _share(c("is_uplink") == 1).alias("uplink_ratio"),
        _or_zero(F.avg("rssi")).alias("mean_rssi"), _or_zero(F.stddev_pop("rssi")).alias("std_rssi"), _or_zero(F.min("rssi")).alias("min_rssi"), _or_zero(F.max("rssi")).alias("max_rssi"),
        F.when(F.count("rssi") > 2, F.regr_slope("rssi", c("rssi_pos").cast("double"))).otherwise(0.0).alias("rssi_trend"),
        _share(c("is_data") == 1).alias("data_frame_ratio"), _share(c("is_mgmt") == 1).alias("mgmt_frame_ratio"), _share(c("is_ctrl") == 1).alias("ctrl_frame_ratio"),
        _share(c("is_qos_data") == 1).alias("qos_data_ratio"), _share(c("retry_flag") == 1).alias("retry_ratio"), _share(c("protected_flag") == 1).alias("protected_ratio"),
        _or_zero(F.avg(rate)).alias("mean_data_rate"), _or_zero(F.max(rate)).alias("max_data_rate"), F.max("is_5ghz").alias("is_5ghz"),
        # Frame lengths have few values, so an aggregate can count them all; gaps can all differ.
        *([_or_zero(F.median(F.when(c("pos") - c("flow_id") < most_held, ms))).alias("median_iat")] if median_gap else []),
    )
    if median_gap:
        out = Workspace(sessions.sparkSession, "flows").stage(out, "features")
        large = out.where(c("packet_count") > most_held).select(*FLOW)
        if not large.isEmpty():
            named = large.select(*(c(k).alias(f"__{k}") for k in FLOW))
            those = sessions.join(named, reduce(lambda a, b: a & b, (c(k).eqNullSafe(c(f"__{k}")) for k in FLOW)), "left_semi")
            medians = quantiles(those.where("iat is not null"), FLOW, {"ms": ms}, (0.5,))
            out = join_keys(out, medians, FLOW, "left").withColumn("median_iat", F.coalesce("ms_0", "median_iat")).drop("ms_0")
    out = out.withColumn("sa_oui", oui("sa")).withColumn("throughput_bps", c("total_bytes") * 8 / F.greatest("duration_sec", F.lit(0.001)))
    out = out.withColumn("cv_iat", c("std_iat") / F.greatest("mean_iat", F.lit(1e-9))).withColumn("rssi_range", c("max_rssi") - c("min_rssi"))
    return out.withColumn("is_known_camera_oui", _flag(c("sa_oui").isin(*S.CAMERA_OUIS))).withColumn("camera_heuristic_score", camera_score())


def bursts(sessions: DataFrame, min_packets: int = 3) -> DataFrame:
    """Bursts of flows with at least ``min_packets`` frames."""
    found = sessions.groupBy(*FLOW, "burst_id").agg(
        F.min("pos").alias("__a"), F.max("pos").alias("__b"), F.count("*").alias("packet_count"), F.sum(F.col("frame_len").cast("bigint")).alias("total_bytes"),
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
    ).where(F.col("packet_count") >= min_packets)
    return found.select(*FLOW, "burst_id", (F.col("__a") - F.col("flow_id")).alias("start_idx"), (F.col("__b") - F.col("flow_id")).alias("end_idx"), "packet_count", "total_bytes", ((F.col("end_ts") - F.col("start_ts")) * 1000).alias("duration_ms"), "start_ts", "end_ts")


def burst_statistics(found: DataFrame) -> DataFrame:
    """Burst statistics of each flow that has a burst."""
    before = F.lag("end_ts").over(Window.partitionBy(*FLOW).orderBy("burst_id"))
    rows = found.withColumn("__gap", F.when(before.isNotNull(), F.greatest(F.col("start_ts") - before, F.lit(0.0)) * 1000))
    stats = rows.groupBy(*FLOW).agg(
        F.count("*").alias("burst_count"), F.avg("packet_count").alias("mean_burst_packets"), F.stddev_pop("packet_count").alias("std_burst_packets"),
        F.avg("total_bytes").alias("mean_burst_bytes"), F.stddev_pop("total_bytes").alias("std_burst_bytes"), F.avg("duration_ms").alias("mean_burst_duration_ms"),
        _or_zero(F.avg("__gap")).alias("mean_burst_interval_ms"), _or_zero(F.stddev_pop("__gap")).alias("std_burst_interval_ms"), (F.max("end_ts") - F.min("start_ts")).alias("__span"),
    )
    c = F.col
    stats = stats.withColumn("burst_regularity", c("std_burst_interval_ms") / F.greatest("mean_burst_interval_ms", F.lit(1e-9)))
    stats = stats.withColumn("bursts_per_sec", c("burst_count") / F.greatest("__span", F.lit(0.001)))
    return stats.withColumn("burst_density", c("mean_burst_bytes") / F.greatest("mean_burst_interval_ms", F.lit(0.001))).drop("__span")


BURST_COLUMNS = ("burst_count", "mean_burst_packets", "std_burst_packets", "mean_burst_bytes", "std_burst_bytes", "mean_burst_duration_ms", "mean_burst_interval_ms", "std_burst_interval_ms", "burst_regularity", "bursts_per_sec", "burst_density")


def flow_burst_features(sessions: DataFrame, min_packets: int = 3) -> DataFrame:
    """Flow features with burst statistics: 46 numbers for each flow.

    Flows without a burst have 0 in all but the two deviations, which are
    null in every case.
    """
    joined = flow_features(sessions).join(burst_statistics(bursts(sessions, min_packets)), FLOW, "left")
    zero = {"burst_count": 0} | {c: 0.0 for c in BURST_COLUMNS[1:] if not c.startswith("std_burst_p") and not c.startswith("std_burst_b")}
    return joined.fillna(zero)


def camera_pattern(stats: DataFrame) -> DataFrame:
    """Add ``camera_like`` and ``confidence`` to burst statistics."""
    c = F.col

    def graded(full: Column, half: Column | None = None) -> Column:
        out = F.when(full, 1.0)
        return (out if half is None else out.when(half, 0.5)).otherwise(0.0)

    score = (
        graded(c("burst_count") >= 5) + graded(c("mean_burst_packets") >= 5, c("mean_burst_packets") >= 3)
        + graded(c("burst_regularity") < 0.3, c("burst_regularity") < 0.6) + graded(c("burst_density") > 100, c("burst_density") > 50)
        + graded(c("mean_burst_bytes") > 10000, c("mean_burst_bytes") > 5000)
    )
    return stats.withColumn("confidence", score / 5).withColumn("camera_like", F.col("confidence") > 0.5)
