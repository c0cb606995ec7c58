"""Capture decoding from hand-built bytes, text exports, labels."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from aircadence.operators import labels
from aircadence.sources import pcap, readers


def radiotap_header(rate=130, freq=5180, signal=-45):
    body = struct.pack("<BBHHb", 0, rate, freq, 0x0140, signal)
    return struct.pack("<BBHI", 0, 0, 8 + len(body), 1 << 1 | 1 << 2 | 1 << 3 | 1 << 5) + body


def data_frame(sa=b"\xb8\x27\xeb\x01\x02\x03", to_ds=1):
    control = 2 << 2 | 8 << 4 | to_ds << 8 | 1 << 14
    one, two, three = (b"\x01" * 6, sa, b"\x03" * 6)
    return struct.pack("<HH", control, 44) + one + two + three + struct.pack("<H", 7 << 4) + b"\x04\x00" + b"x" * 40


def pcap_bytes(packets, order="<", magic=0xA1B2C3D4, link=127):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for s, u, p in packets:
        out += struct.pack(order + "IIII", s, u, len(p), len(p) + 5) + p
    return out


def pcapng_bytes(packets):
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 127, 0, 0))
    for s, u, p in packets:
        t = s * 1_000_000 + u
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(p), len(p) + 5) + p + b"\0" * (-len(p) % 4))
    return out


PACKETS = [(10, 500000, radiotap_header() + data_frame()), (11, 0, radiotap_header(signal=-60) + data_frame(to_ds=0))]


def test_pcap_source(spark, tmp_path):
    pcap.register(spark)
    (tmp_path / "a.pcap").write_bytes(pcap_bytes(PACKETS))
    (tmp_path / "b.pcapng").write_bytes(pcapng_bytes(PACKETS))
    (tmp_path / "c.pcap").write_bytes(pcap_bytes(PACKETS, ">")[:-10])
    (tmp_path / "note.txt").write_text("no capture")
    rows = spark.read.format("pcap").load(str(tmp_path)).orderBy("source_file", "frame_no").collect()
    assert [(r.source_file, r.frame_no) for r in rows] == [("a.pcap", 0), ("a.pcap", 1), ("b.pcapng", 0), ("b.pcapng", 1), ("c.pcap", 0)]
    r = rows[0]
    assert (r.timestamp, r.frame_len, r.rssi, r.data_rate, r.channel_freq) == (10.5, len(PACKETS[0][2]) + 5, -45.0, 65.0, 5180)
    assert (r.frame_type, r.frame_subtype, r.to_ds, r.from_ds, r.protected, r.retry) == (2, 0x28, 1, 0, 1, 0)
    assert (r.sa, r.da, r.bssid, r.seq_num, r.duration, r.qos_priority) == ("b8:27:eb:01:02:03", "03:03:03:03:03:03", "01:01:01:01:01:01", 7, 44, 4)
    assert rows[2].timestamp == 10.5 and rows[4].timestamp == 10.5


def test_missing_file_raises(spark, tmp_path):
    pcap.register(spark)
    with pytest.raises(Exception, match="none.pcap"):
        spark.read.format("pcap").load(str(tmp_path / "none.pcap")).count()


def test_radiotap_record(spark):
    names = ["radiotap.dbm_antsignal", "radiotap.ant_signal", "radiotap.ant_noise", "radiotap.datarate", "radiotap.channel.freq", "radiotap.mcs.index"]
    rows = spark.createDataFrame([("-45", "60", "-95", "65.0", "5180", "7"), ("", "", "", "", "", ""), (None, "60", "0", "x", "0x973", None)], ", ".join(f"`{n}` string" for n in names))
    full, empty, part = readers.radiotap_record(rows).collect()
    assert tuple(full) == (-45.0, 60, -95, 65.0, 5180, 7)
    assert tuple(empty) == (None,) * 6
    assert tuple(part) == (60.0, 60, None, None, 0x973, None)


def test_mac_fields(spark):
    rows = spark.createDataFrame([("2", "0x0028", "True", "0", "aa", "5")], "`wlan.fc.type` string, `wlan.fc.type_subtype` string, `wlan.fc.tods` string, `wlan.fc.fromds` string, `wlan.sa` string, `wlan.qos.priority` string")
    r = readers.mac_fields(rows).first()
    assert (r.frame_type, r.frame_subtype, r.to_ds, r.from_ds, r.sa, r.qos_priority, r.frame_type_str, r.retry) == (2, 40, 1, 0, "aa", 5, "QoS Data", 0)


def test_capture_json(spark, tmp_path):
    frame = {"_source": {"layers": {"frame": {"frame.time_epoch": ["1.5"], "frame.len": ["99"]}, "wlan": {"wlan.sa": "aa:bb:cc:dd:ee:ff", "wlan.fc.type": ["2"]}}}}
    (tmp_path / "x.json").write_text(json.dumps([frame]))
    r = readers.read_capture_json(spark, str(tmp_path / "x.json")).first()
    assert (r.timestamp, r.frame_len, r.sa, r.frame_type, r.rssi, r.wlan_radio_signal_percent) == (1.5, 99, "aa:bb:cc:dd:ee:ff", 2, None, None)
    frame["_source"]["layers"]["wlan_radio"] = {"wlan_radio.signal_percent": ["62"]}
    heard = {"_source": {"layers": frame["_source"]["layers"] | {"radiotap": {"radiotap.dbm_antsignal": "-50"}}}}
    (tmp_path / "y.json").write_text(json.dumps([frame, heard]))
    rows = readers.read_capture_json(spark, str(tmp_path / "y.json")).collect()
    assert [(r.rssi, r.wlan_radio_signal_percent) for r in rows] == [(None, 62.0), (-50.0, None)]


def test_label_prefixes(spark):
    rows = spark.createDataFrame([("x_1.pcap",), ("x_10.pcap",), ("y.pcap",)], "source_file string")
    known = spark.createDataFrame([(0, "x_1", "old"), (1, "x_10", "laptop"), (2, "x_1", "camera"), (3, None, "z"), (4, "", "z")], "label_order int, session_id string, device_type string")
    got = {r.source_file: r.device_type for r in labels.label_files(rows, known).collect()}
    assert got == {"x_1.pcap": "camera", "x_10.pcap": "camera", "y.pcap": "unknown"}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ('b"q', 2)], "sa string, frame_len int")
    readers.write_field_csv(rows, str(tmp_path / "o"), ["sa", "frame_len"])
    assert sorted(tuple(r) for r in readers.read_field_csv(spark, str(tmp_path / "o")).collect()) == [("a", "1"), ('b"q', "2")]
    readers.append_labels(spark.createDataFrame([("m", "t", "s", "n", "z")], readers.LABEL_SCHEMA), str(tmp_path / "l"))
    readers.append_labels(spark.createDataFrame([("m2", "t", "s", "n", "z")], readers.LABEL_SCHEMA), str(tmp_path / "l"))
    assert readers.read_labels(spark, str(tmp_path / "l")).where(F.col("device_mac").startswith("m")).count() == 2


def test_pcapng_other_packet_blocks(spark, tmp_path):
    """Simple and obsolete packet blocks give frames too."""
    import io

    packet = PACKETS[0][2]
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    pad = b"\0" * (-len(packet) % 4)
    raw = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 127, 0, 0))
    raw += block(3, struct.pack("<I", len(packet)) + packet + pad)
    raw += block(2, struct.pack("<HHIIII", 0, 0, 0, 7_000_000, len(packet), len(packet) + 5) + packet + pad)
    got = list(pcap.read_frames(io.BytesIO(raw), "x"))
    assert [(f["timestamp"], f["frame_len"], f["sa"]) for f in got] == [(0.0, len(packet), "b8:27:eb:01:02:03"), (7.0, len(packet) + 5, "b8:27:eb:01:02:03")]


def test_impossible_lengths_raise():
    import io

    bad = pcap_bytes(PACKETS) + struct.pack("<IIII", 1, 0, 1 << 30, 5)
    with pytest.raises(ValueError, match="record of"):
        list(pcap.read_frames(io.BytesIO(bad), "x"))
    with pytest.raises(ValueError, match="block of"):
        list(pcap.read_frames(io.BytesIO(pcapng_bytes(PACKETS) + struct.pack("<II", 6, 5)), "x"))


def test_evaluation_files_hold_all_rows(spark, tmp_path):
    readers.write_evaluation(spark.range(3), str(tmp_path / "a.json"))
    readers.write_evaluation(spark.range(0), str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}] and json.loads((tmp_path / "b.json").read_text()) == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from aircadence import workspace

    class Cluster:
        class sparkContext:
            master = "spark://x:1"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default if name == "spark.checkpoint.dir" else "/tmp/w"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Cluster)
