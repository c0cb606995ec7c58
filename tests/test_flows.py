"""Flows and bursts: hand-written cases and a plain-Python comparison."""

from __future__ import annotations

import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from aircadence.functions.frames import frame_features
from aircadence.operators import flows
from tests.test_frames import frames


def sessions(spark, times, timeout=5.0, burst=1.0, bucket=3600.0, **fields):
    return flows.sessionise(frame_features(frames(spark, *({"timestamp": t} | fields for t in times))), timeout, burst, bucket)


def test_gap_equal_to_timeout_stays(spark):
    assert sessions(spark, [0.0, 5.0, 10.5]).select("flow_id").distinct().count() == 2


def test_order_and_ties(spark):
    got = sessions(spark, [3.0, 1.0, 1.0, 2.0]).orderBy("pos").select("frame_no").collect()
    assert [r[0] for r in got] == [1, 2, 3, 0]


def test_one_burst(spark):
    (b,) = flows.bursts(sessions(spark, [7 + i * 0.0008 for i in range(11)], frame_len=90)).collect()
    assert (b.packet_count, b.total_bytes, b.start_idx, b.end_idx) == (11, 990, 0, 10)


def test_bursts_of_one_flow(spark):
    """Runs of 4, 2 and 3 frames: the short one is no burst; indexes count all frames."""
    runs = [1.0, 1.0002, 1.0004, 1.0006, 1.5, 1.5002, 3.25, 3.2504, 3.2508]
    assert [(b.start_idx, b.end_idx) for b in flows.bursts(sessions(spark, runs)).orderBy("burst_id").collect()] == [(0, 3), (6, 8)]
    assert flows.bursts(sessions(spark, runs), min_packets=2).count() == 3
    assert flows.bursts(sessions(spark, [i * 0.7 for i in range(9)])).count() == 0
    assert flows.bursts(sessions(spark, [])).count() == 0


def test_burst_statistics(spark):
    one = flows.burst_statistics(flows.bursts(sessions(spark, [0.0, 0.0005, 0.001]))).first()
    assert (one.burst_count, one.mean_burst_interval_ms, one.burst_regularity) == (1, 0.0, 0.0)
    assert one.burst_density == pytest.approx(4500 / 0.001)
    three = flows.burst_statistics(flows.bursts(sessions(spark, [s + k * 0.0005 for s in (0.0, 0.101, 0.202) for k in range(3)]))).first()
    assert three.burst_count == 3 and three.mean_burst_interval_ms == pytest.approx(100) and three.burst_regularity == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("row,low,high", [((10, 8.0, 15000.0, 0.1, 200.0), 0.8, 1.0), ((0, 0.0, 0.0, 2.0, 0.0), 0.0, 0.5), ((3, 4.0, 6000.0, 0.4, 60.0), 0.35, 0.65)])
def test_camera_pattern(spark, row, low, high):
    stats = spark.createDataFrame([row], "burst_count int, mean_burst_packets double, mean_burst_bytes double, burst_regularity double, burst_density double")
    assert low <= flows.camera_pattern(stats).first().confidence <= high


def test_camera_flow(spark):
    f = flows.flow_features(sessions(spark, [i * 0.033 for i in range(100)])).first()
    assert (f.packet_count, f.large_frame_ratio, f.uplink_ratio, f.qos_data_ratio, f.protected_ratio) == (100, 1.0, 1.0, 1.0, 1.0)
    assert f.camera_heuristic_score >= 8


def test_flow_without_burst(spark):
    f = flows.flow_burst_features(sessions(spark, [0.0])).first()
    assert (f.burst_count, f.mean_burst_bytes, f.std_burst_bytes, f.mean_iat, f.rssi_trend) == (0, 0.0, None, 0.0, 0.0)


def _python_flows(rows, timeout, burst):
    """Flows as (count, mean gap ms, slope, bursts), by a plain loop."""
    out, flow = [], []
    for t, r in sorted(rows, key=lambda x: x[0]):
        if flow and t - flow[-1][0] > timeout:
            out.append(flow)
            flow = []
        flow.append((t, r))
    out += [flow] if flow else []
    res = []
    for flow in out:
        ts = [t for t, _ in flow]
        gaps = [(b - a) * 1000 for a, b in zip(ts, ts[1:])]
        ys = [r for _, r in flow if r is not None]
        slope = 0.0
        if len(ys) > 2:
            mx, my = (len(ys) - 1) / 2, statistics.fmean(ys)
            slope = sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(len(ys)))
        runs, n = 0, 1
        for a, b in zip(ts, ts[1:]):
            if (b - a) * 1000 > burst:
                runs, n = runs + (n >= 3), 1
            else:
                n += 1
        res.append((len(flow), round(statistics.fmean(gaps) if gaps else 0.0, 6), round(slope, 6) + 0.0, runs + (n >= 3)))
    return sorted(res)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 200), st.one_of(st.none(), st.integers(-90, -30))), max_size=40), bucket=st.sampled_from([3.0, 10.0, 3600.0]))
def test_equals_plain_loop(spark, rows, bucket):
    """Buckets of any width give the flows of a loop over all frames."""
    rows = [(t / 8, None if r is None else float(r)) for t, r in rows]
    se = flows.sessionise(frame_features(frames(spark, *({"timestamp": t, "rssi": r} for t, r in rows))), 2.0, 300.0, bucket)
    got = flows.flow_burst_features(se).select("packet_count", F.round("mean_iat", 6), F.round("rssi_trend", 6), "burst_count").collect()
    assert sorted((a, b, c + 0.0, d) for a, b, c, d in got) == _python_flows(rows, 2.0, 300.0)


@settings(max_examples=30, deadline=None)
@given(times=st.lists(st.integers(0, 400), max_size=60), cut=st.integers(0, 60))
def test_stream_fold_equals_plain_loop(times, cut):
    """Sessions folded in two parts are those of a loop over all frames."""
    from aircadence.streaming.streams import _fold

    times = sorted(times)
    data = np.array([(t / 8, i, 100 + i, i % 2) for i, t in enumerate(times)], dtype=float).reshape(-1, 4)
    session, rows = _fold(None, data[:cut], 2.0, 300.0, 3)
    session, more = _fold(session, data[cut:], 2.0, 300.0, 3)
    rows += more
    if session:
        session.end_run(3)
        rows.append(session.row())
    assert sorted((r[0], r[5]) for r in rows) == sorted((n, b) for n, _, _, b in _python_flows([(t / 8, None) for t in times], 2.0, 300.0))
    assert sum(r[1] for r in rows) == sum(range(100, 100 + len(times)))
