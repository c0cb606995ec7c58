"""Structured Streaming forms of windows, sessions and live capture."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from aircadence.functions.frames import _flag
from aircadence.operators.flows import PAIR


def with_event_time(frames: DataFrame) -> DataFrame:
    """Add ``event_time`` from the seconds in ``timestamp``, if it is missing."""
    return frames if "event_time" in frames.columns else frames.withColumn("event_time", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")))


def window_counts(features: DataFrame, window_sec: int = 10, delay: str = "30 seconds") -> DataFrame:
    """Window volume and ratios over epoch-aligned windows, append mode.

    Frames later than the watermark are dropped.  A window is first summed for each of
    its addresses, and these sums then meet, so an address is one small row of state,
    dealt over all tasks, and the number of sources is a count of rows.
    """
    count = lambda condition: F.sum(_flag(condition).cast("bigint"))
    rows = with_event_time(features).withWatermark("event_time", delay)
    each = rows.groupBy("source_file", F.window("event_time", f"{window_sec} seconds").alias("window"), "sa").agg(
        F.count("*").alias("n"), F.sum(F.col("frame_len").cast("bigint")).alias("bytes"), count(F.col("is_data") == 1).alias("data"), count(F.col("is_uplink") == 1).alias("up"), F.count("rssi").alias("heard"), F.sum("rssi").alias("signal"),
    )
    whole = each.groupBy("source_file", "window").agg(
        F.sum("n").alias("packet_count"), F.sum("bytes").alias("total_traffic_volume"), F.count("sa").cast("int").alias("unique_sources"),
        (F.sum("data") / F.sum("n")).alias("data_frame_ratio"), (F.sum("up") / F.sum("n")).alias("uplink_ratio"), (F.sum("signal") / F.nullif(F.sum("heard"), F.lit(0))).alias("mean_global_rssi"),
    )
    return whole.select("source_file", F.col("window.start").alias("window_start"), *whole.columns[2:])


#: Of an open session: its figures, those of its open run, and frames that the watermark has not reached.
_STATE = "start double, last double, packets bigint, bytes bigint, uplink bigint, run_packets bigint, run_bytes bigint, bursts bigint, burst_bytes bigint, waiting binary"
_SESSION = "packet_count bigint, total_bytes bigint, start_ts double, end_ts double, uplink_ratio double, burst_count bigint, burst_bytes bigint"


#: Seconds from frame times to event times of sessions. Before its first watermark Spark takes rows up to 1970 for late.
_LATER = 36_525 * 86_400


class _Session:
    """Running sums of one session."""

    def __init__(self, start, last, packets, size, uplink, run_packets, run_bytes, bursts, burst_bytes):
        self.start, self.last, self.packets, self.bytes, self.uplink = start, last, packets, size, uplink
        self.run_packets, self.run_bytes, self.bursts, self.burst_bytes = run_packets, run_bytes, bursts, burst_bytes

    def end_run(self, least: int) -> None:
        if self.run_packets >= least:
            self.bursts += 1
            self.burst_bytes += self.run_bytes
        self.run_packets = self.run_bytes = 0

    def add_run(self, packets: int, size: int, uplink: int, last: float) -> None:
        self.packets += packets
        self.bytes += size
        self.uplink += uplink
        self.run_packets += packets
        self.run_bytes += size
        self.last = last

    def state(self) -> tuple:
        return (float(self.start), float(self.last), self.packets, self.bytes, self.uplink, self.run_packets, self.run_bytes, self.bursts, self.burst_bytes)

    def row(self) -> tuple:
        return (self.packets, self.bytes, self.start, self.last, self.uplink / self.packets, self.bursts, self.burst_bytes)


def _fold(session: _Session | None, frames: np.ndarray, timeout_sec: float, burst_ms: float, least: int) -> tuple[_Session | None, list[tuple]]:
    """Take frames ``(time, number, length, uplink)`` in order into a session; returns the open one and closed rows."""
    closed: list[tuple] = []
    if not len(frames):
        return session, closed
    gaps = np.diff(frames[:, 0], prepend=session.last if session else -np.inf)
    breaks = gaps > timeout_sec
    heads = np.flatnonzero(breaks | (gaps * 1000 > burst_ms) | (np.arange(len(frames)) == 0))
    for a, b in zip(heads, [*heads[1:], len(frames)], strict=True):
        part = frames[a:b]
        if session and gaps[a] * 1000 > burst_ms:
            session.end_run(least)
        if session is None or breaks[a]:
            if session:
                session.end_run(least)
                closed.append(session.row())
            session = _Session(part[0, 0], part[0, 0], 0, 0, 0, 0, 0, 0, 0)
        session.add_run(len(part), int(part[:, 2].sum()), int(part[:, 3].sum()), part[-1, 0])
    return session, closed


def flow_sessions(features: DataFrame, timeout_sec: float = 5.0, burst_ms: float = 1.0, min_packets: int = 3, delay: str = "30 seconds") -> DataFrame:
    """Flows of closed sessions with size, rate and burst figures, append mode.

    The state of a pair is the running sums of its open session and the frames
    that the watermark has not reached, as these may still come out of order;
    a session that never pauses takes no more.  A gap over the timeout closes a
    session, one over ``burst_ms`` a run; a run of ``min_packets`` is a burst.
    """
    kinds = dict(features.dtypes)

    def step(key, chunks, state):
        held = state.get if state.exists else (None,) * 9 + (b"",)
        session = _Session(*held[:9]) if held[0] is not None else None
        parts = [np.frombuffer(held[9], np.float64).reshape(-1, 4)]
        parts += [np.stack([chunk[c].to_numpy(dtype=np.float64) for c in ("timestamp", "frame_no", "frame_len", "is_uplink")], axis=1) for chunk in chunks]
        frames = np.concatenate(parts)
        frames = frames[np.lexsort((frames[:, 1], frames[:, 0]))]
        reached = state.getCurrentWatermarkMs() / 1000 - _LATER
        session, closed = _fold(session, frames[frames[:, 0] < reached], timeout_sec, burst_ms, min_packets)
        waiting = frames[frames[:, 0] >= reached]
        if session and session.last + timeout_sec < reached:
            session.end_run(min_packets)
            closed.append(session.row())
            session = None
        if session or len(waiting):
            state.update((*(session.state() if session else (None,) * 9), waiting.tobytes()))
            nearest = min([waiting[0, 0]] * bool(len(waiting)) + ([session.last + timeout_sec] if session else []))
            state.setTimeoutTimestamp(max(int((nearest + _LATER) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame([(*key, *row) for row in closed], columns=[*PAIR, *(c.split()[0] for c in _SESSION.split(", "))])

    later = F.timestamp_micros(F.unix_micros("event_time") + _LATER * 1_000_000)
    rows = with_event_time(features).withColumn("event_time", later).withWatermark("event_time", delay)
    schema = ", ".join(f"{c} {kinds[c]}" for c in PAIR) + ", " + _SESSION
    needed = rows.select(*PAIR, "event_time", "timestamp", "frame_no", "frame_len", "is_uplink")
    return needed.groupBy(*PAIR).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_alerts(features: DataFrame, least_score: int = 3) -> DataFrame:
    """Single frames with at least so many signs of a camera."""
    c = F.col
    score = _flag((c("is_data") == 1) & (c("is_uplink") == 1)) + _flag(c("is_qos_data") == 1) + _flag(c("protected_flag") == 1) + _flag(c("frame_len") > 1000) + _flag(c("data_rate") > 50)
    return features.withColumn("score", score).where(F.col("score") >= least_score)


def start_live(frames: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "5 seconds") -> StreamingQuery:
    """Call ``callback(batch, number)`` for each micro-batch; ``stop()`` ends it."""
    return frames.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
