"""Captures in ranges, pushed filters, growing files."""

from __future__ import annotations

import io
import random
import struct

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from aircadence.schema import FRAME_SCHEMA
from aircadence.sources import capture_index as ci, pcap
from tests.test_sources import PACKETS, data_frame, pcap_bytes, pcapng_bytes, radiotap_header


def packets(n, seed=0, first=1_700_000_000, planted=()):
    """Frames of all sizes; some hold whole captures, or heads that look like records."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        body = data_frame(sa=bytes([2, 0, 0, 0, 0, k % 7]), to_ds=k % 2)
        kind = rng.random()
        if kind < 0.15 and planted:
            body += rng.choice(planted)
        elif kind < 0.2:
            body += bytes(rng.randrange(3000))
        elif kind < 0.3:
            body += rng.randbytes(rng.randrange(400))
        out.append((first + k, rng.randrange(1_000_000), radiotap_header(signal=-30 - k % 60) + body))
    return out


def block(kind, body, order="<"):
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def sections(seed=1):
    """A pcapng file of three sections, one in the other byte order, with interfaces described late."""
    raw = pcapng_bytes(packets(60, seed))
    for order in "><":
        raw += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
        for k, (s, u, p) in enumerate(packets(80, seed + 1)):
            if k in (5, 40):
                raw += block(1, struct.pack(order + "HHI", 127, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9 if k == 40 else 6), order)
            t = s * 10**6 + u
            raw += block(6, struct.pack(order + "IIIII", k % 3, t >> 32, t & 0xFFFFFFFF, len(p), len(p)) + p + b"\0" * (-len(p) % 4), order)
            if k % 9 == 0:
                raw += block(5, b"statistics..", order)
            if k % 11 == 0:
                raw += block(3, struct.pack(order + "I", len(p)) + p + b"\0" * (-len(p) % 4), order)
    return raw


def in_ranges(raw, split):
    """Frames of a file by its ranges, and how many ranges hold some."""
    ranges = []
    for start in range(0, len(raw), split):
        stop = min(start + split, len(raw))
        ranges.append({"start": start, "stop": stop, "chains": ci.chains(io.BytesIO(raw), "x", start, stop, len(raw))})
    out, used = [], 0
    decoder = pcap.Decoder(FRAME_SCHEMA.fieldNames())
    for start, stop, first, section in ci.compose(io.BytesIO(raw), "x", ranges):
        handle = io.BytesIO(raw)
        handle.seek(start)
        own = list(decoder.frames(pcap.records(pcap.Bytes(handle, start), pcap.Section.of(section), stop), "x", first))
        out += own
        used += bool(own)
    return out, used, ranges


LATER = packets(40, 9)
PLANTED = [pcap_bytes(LATER[:12]), pcap_bytes(LATER[:8], ">"), pcapng_bytes(LATER[:8]), struct.pack("<IIII", 1_700_000_001, 5, 40, 40) * 30]
FILES = {
    "plain": pcap_bytes(packets(300)), "big-endian": pcap_bytes(packets(300), ">"), "nanoseconds": pcap_bytes(packets(200), magic=0xA1B23C4D),
    "captures inside": pcap_bytes(packets(300, 2, planted=PLANTED)), "pcapng": pcapng_bytes(packets(300, 3, planted=PLANTED)), "sections": sections(),
    "one long record": pcap_bytes([*packets(5), (1_700_000_100, 0, radiotap_header() + data_frame() + bytes(90_000)), *packets(50, 4)]),
    "old clock": pcap_bytes([(0 if k % 5 == 0 else s, u, p) for k, (s, u, p) in enumerate(packets(200, 5))]),
    "cut": pcap_bytes(packets(100, 6))[:-7], "only a head": pcap_bytes([]), "empty": b"",
}


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("split", [512, 4096, 50_000])
def test_ranges_give_the_frames_of_the_whole(name, split):
    raw = FILES[name]
    want = list(pcap.read_frames(io.BytesIO(raw), "x"))
    got, used, _ = in_ranges(raw, split)
    assert got == want
    if split == 4096 and name in ("plain", "captures inside", "pcapng", "sections"):
        assert used > 5


def test_chains_hold_nearly_every_true_start():
    """Few ranges need a second walk, planted captures or not."""
    for name in ("plain", "big-endian", "captures inside", "pcapng"):
        raw = FILES[name]
        _, _, ranges = in_ranges(raw, 4096)
        starts = {}
        for start, stop, _, _ in ci.compose(io.BytesIO(raw), "x", ranges):
            starts[stop] = start
        known = [any(m["at"] == starts[r["stop"]] for c in r["chains"] for m in c["marks"]) for r in ranges if r["stop"] in starts]
        assert sum(known) >= 0.9 * len(known), (name, sum(known), len(known))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(40, 3000), st.booleans())
def test_any_ranges_of_any_capture(seed, split, blocks):
    raw = (pcapng_bytes if blocks else pcap_bytes)(packets(40, seed, planted=PLANTED[:3]))
    assert in_ranges(raw, split)[0] == list(pcap.read_frames(io.BytesIO(raw), "x"))


def test_an_impossible_record_raises_in_ranges_too():
    raw = pcap_bytes(packets(50)) + struct.pack("<IIII", 1_700_000_000, 1, 1 << 30, 5) + bytes(3000)
    with pytest.raises(ValueError, match="record of"):
        in_ranges(raw, 2048)


def test_indexed_scan_equals_whole_scan(spark, tmp_path):
    for folder in ("one", "two/deep"):
        (tmp_path / folder).mkdir(parents=True)
    for k, (folder, name) in enumerate([("one", "captures inside"), ("two/deep", "sections"), ("one", "cut"), ("two/deep", "plain")]):
        (tmp_path / folder / ("same.pcap" if k in (0, 3) else f"{k}.pcapng")).write_bytes(FILES[name])
    pcap.register(spark)
    whole = spark.read.format("pcap").load(str(tmp_path))
    split = ci.read_captures(spark, str(tmp_path), split_bytes=5000)
    assert split.rdd.getNumPartitions() > 20 > whole.rdd.getNumPartitions() == 4
    assert {r.source_file for r in whole.select("source_file").distinct().collect()} == {"one/same.pcap", "two/deep/same.pcap", "one/2.pcapng", "two/deep/1.pcapng"}
    columns = ["source_file", "frame_no", "timestamp", "frame_len", "sa", "rssi", "to_ds"]
    assert sorted(split.select(columns).collect()) == sorted(whole.select(columns).collect())
    assert ci.read_captures(spark, str(tmp_path), split_bytes=1 << 30).count() == whole.count()


CONDITIONS = [
    "frame_type = 2", "to_ds = 0 AND sa = '02:00:00:00:00:03'", "frame_len > 500 AND timestamp >= 1700000100", "sa IN ('02:00:00:00:00:01', '02:00:00:00:00:02') OR to_ds = 1",
    "bssid IS NOT NULL AND NOT (sa = '02:00:00:00:00:01')", "sa <> '02:00:00:00:00:01'", "sa LIKE '02:00%' AND da LIKE '%03'", "source_file = 'a.pcap' AND frame_no < 17", "qos_priority = 4", "ra <=> NULL", "rssi > -40 AND retry = 0", "ta IS NULL",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_filters_equal_unpushed(spark, tmp_path, condition):
    control = struct.pack("<HH", 1 << 2 | 13 << 4, 0) + b"\x05" * 6
    mixed = [*packets(80, 7), (1_700_000_200, 0, radiotap_header() + control), (1_700_000_201, 0, b"\x01"), (1_700_000_202, 0, radiotap_header())]
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(mixed))
    (tmp_path / "b.pcapng").write_bytes(pcapng_bytes(mixed))
    pcap.register(spark)
    pushed = spark.read.format("pcap").load(str(tmp_path)).where(condition)
    every = spark.createDataFrame(spark.read.format("pcap").load(str(tmp_path)).collect(), FRAME_SCHEMA).where(condition)
    assert sorted(map(str, pushed.collect())) == sorted(map(str, every.collect()))


def test_plan_shows_what_is_pushed(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(PACKETS))
    pcap.register(spark)
    rows = spark.read.format("pcap").load(str(tmp_path)).where("frame_type = 2 AND sa = 'x' AND rssi > 1")
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted").split("\n")
    pushed = next(line for line in plan if line.startswith("PushedFilters"))
    assert "EqualTo(frame_type,2)" in pushed and "EqualTo(sa,x)" in pushed
    # What the scan does not know is left to Spark, and nothing else.
    assert "rssi" not in pushed and next(line for line in plan if line.startswith("Condition")).count("rssi") == 2


def test_filters_come_before_decoding(monkeypatch):
    """What a type or a length turns away has no address decoded."""
    decoded = []
    monkeypatch.setattr(pcap, "mac_header", lambda data, real=pcap.mac_header: decoded.append(1) or real(data))
    test = lambda name, f: [(name, f)]
    raw = pcap_bytes(packets(50))
    for filters, most in ((test("frame_type", lambda x: x == 0), 0), (test("frame_len", lambda x: x > 10**6), 0), (test("to_ds", lambda x: x == 1), 25)):
        decoded.clear()
        data = pcap.Bytes(io.BytesIO(raw))
        section, _ = pcap.opened(data, "x")
        list(pcap.Decoder(["sa", "frame_no"], filters).frames(pcap.records(data, section), "x"))
        assert len(decoded) == most


def test_a_given_schema_prunes(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(PACKETS))
    pcap.register(spark)
    rows = spark.read.format("pcap").schema("frame_no bigint, sa string").load(str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(0, "b8:27:eb:01:02:03"), (1, "03:03:03:03:03:03")] or len(rows) == 2


def drained(spark, source, where, sink):
    query = spark.readStream.format("pcap").load(str(source)).writeStream.format("parquet").option("checkpointLocation", str(where)).option("path", str(sink)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.source_file, r.frame_no, r.sa) for r in spark.read.parquet(str(sink)).collect()) if any(sink.glob("*.parquet")) else []


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_stream_of_growing_files_across_restarts(spark, tmp_path, kind):
    """Each start is a new query from the checkpoint; files are cut anywhere, also inside a head."""
    pcap.register(spark)
    raw = {"a": (pcap_bytes(packets(40, 1)) if kind == "pcap" else sections()), "b": (pcap_bytes if kind == "pcap" else pcapng_bytes)(packets(30, 2))}
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for shares in ((0.001, 0.0), (0.3, 0.002), (0.301, 0.5), (0.7001, 0.77), (0.7001, 1.0), (1.0, 1.0)):
        for (name, data), share in zip(raw.items(), shares):
            if share:
                (source / f"{name}.{kind}").write_bytes(data[: int(len(data) * share)])
        got = drained(spark, source, tmp_path / "log", sink)
        want = []
        for name, share in zip(raw, shares):
            data = raw[name][: int(len(raw[name]) * share)]
            want += [(f"{name}.{kind}", f["frame_no"], f.get("sa")) for f in pcap.read_frames(io.BytesIO(data), name)]
        assert got == sorted(want)


def test_start_live_follows_a_growing_capture(spark, tmp_path):
    from aircadence.functions.frames import frame_features
    from aircadence.streaming import streams

    pcap.register(spark)
    raw = pcap_bytes(packets(30, 8))
    (tmp_path / "in").mkdir()
    live, seen = tmp_path / "in" / "live.pcap", []
    live.write_bytes(raw[:2000])
    frames = spark.readStream.format("pcap").load(str(tmp_path / "in"))
    query = streams.start_live(streams.live_alerts(frame_features(frames), 2), lambda batch, number: seen.extend(r.frame_no for r in batch.collect()), str(tmp_path / "log"), "0 seconds")
    try:
        query.processAllAvailable()
        first = len(seen)
        live.write_bytes(raw)
        query.processAllAvailable()
    finally:
        query.stop()
    want = streams.live_alerts(frame_features(spark.read.format("pcap").load(str(tmp_path / "in"))), 2).select(F.col("frame_no")).collect()
    assert 0 < first < len(seen) and sorted(seen) == sorted(r.frame_no for r in want)
