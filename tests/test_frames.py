"""Frame expressions on hand-written rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aircadence import schema as S
from aircadence.functions import frames as X

BASE = dict(source_file="a.pcap", frame_no=0, timestamp=0.0, frame_len=1500, rssi=-45.0, data_rate=65.0, frame_type=2, frame_subtype=0x28, to_ds=1, from_ds=0, sa="aa:bb:cc:dd:ee:ff", da="11:22:33:44:55:66", retry=0, protected=1, qos_priority=4)


def frames(spark, *rows):
    names = S.FRAME_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple((BASE | {"frame_no": i} | r).get(n) for n in names) for i, r in enumerate(rows)], S.FRAME_SCHEMA)


@pytest.mark.parametrize("to_ds,from_ds,one,two", [(0, 0, "ad_hoc_or_direct", "ad_hoc"), (1, 0, "sta_to_ap", "sta_to_ap"), (0, 1, "ap_to_sta", "ap_to_sta"), (1, 1, "wds", "wds"), (None, None, "unknown", "ad_hoc")])
def test_ds_modes(spark, to_ds, from_ds, one, two):
    row = frames(spark, {"to_ds": to_ds, "from_ds": from_ds}).select(X.ds_interpretation().alias("a"), X.ds_mode().alias("b")).first()
    assert (row.a, row.b) == (one, two)


@pytest.mark.parametrize("mac,want", [("b8:27:eb:01:02:03", "B8:27:EB"), ("b8-27-eb-01-02-03", "B8:27:EB"), ("b8:27", None), ("", None), (None, None)])
def test_oui(spark, mac, want):
    assert frames(spark, {"sa": mac}).select(X.oui("sa")).first()[0] == want


def test_frame_features_and_defaults(spark):
    full, empty = X.frame_features(frames(spark, {}, dict.fromkeys(("rssi", "data_rate", "frame_type", "frame_subtype", "to_ds", "from_ds", "sa", "da", "qos_priority")))).orderBy("frame_no").collect()
    assert (full.is_data, full.is_qos_data, full.is_uplink, full.size_bin, full.is_5ghz) == (1, 1, 1, 3, 0)
    assert (empty.rssi, empty.data_rate, empty.frame_type, empty.to_ds, empty.qos_priority, empty.sa, empty.da) == (None, 0.0, -1, 0, -1, "unknown", "unknown")
    assert (empty.is_data, empty.is_mgmt, empty.is_ctrl, empty.sa_oui, empty.channel_freq, empty.seq_num) == (0, 0, 0, None, 0, -1)


def test_distance(spark):
    rows = frames(spark, {"rssi": -40.0, "channel_freq": 2437}, {"rssi": None}, {"rssi": 25.0})
    near, none, strong = [r[0] for r in rows.orderBy("frame_no").select(X.estimated_distance()).collect()]
    assert 0 < near < 20 and none is None and strong == 0.1


def test_camera_like(spark):
    rows = X.frame_features(frames(spark, {}, {"frame_len": 60, "protected": 0, "data_rate": 1.0, "frame_type": 0, "frame_subtype": 8}))
    assert [r[0] for r in rows.orderBy("frame_no").select(X.is_camera_like()).collect()] == [True, False]


def test_effective_addresses(spark):
    rows = frames(spark, {"ra": ""}, {"ra": "r"}, {"to_ds": 0, "from_ds": 1, "ta": "t"}, {"to_ds": 1, "from_ds": 1, "ta": "t", "ra": "r"})
    got = rows.orderBy("frame_no").select(X.effective_source(), X.effective_destination()).collect()
    assert [tuple(r) for r in got] == [(BASE["sa"], BASE["da"]), (BASE["sa"], "r"), ("t", BASE["da"]), ("t", "r")]


def test_names_and_limits(spark):
    rows = frames(spark, {}, {"frame_subtype": 99}, {"frame_subtype": None}, {"frame_type": 0, "frame_subtype": 8})
    assert [r[0] for r in rows.orderBy("frame_no").select(X.subtype_name()).collect()] == ["QoS Data", "Unknown", None, "Beacon"]
    assert [X.head_per_file(rows, n).count() for n in (None, 0, 2)] == [4, 0, 2]
    assert rows.select(X.normal_mac(F.lit(" AA:Bb "))).first()[0] == "aa:bb"
