"""Schemas and fixed tables of the frame data model."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("frame_no", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("frame_len", T.IntegerType()),
    T.StructField("rssi", T.DoubleType()),
    T.StructField("ant_signal", T.IntegerType()),
    T.StructField("ant_noise", T.IntegerType()),
    T.StructField("data_rate", T.DoubleType()),
    T.StructField("channel_freq", T.IntegerType()),
    T.StructField("mcs_index", T.IntegerType()),
    T.StructField("frame_type", T.IntegerType()),
    T.StructField("frame_subtype", T.IntegerType()),
    T.StructField("to_ds", T.IntegerType()),
    T.StructField("from_ds", T.IntegerType()),
    T.StructField("sa", T.StringType()),
    T.StructField("da", T.StringType()),
    T.StructField("ta", T.StringType()),
    T.StructField("ra", T.StringType()),
    T.StructField("bssid", T.StringType()),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("retry", T.IntegerType()),
    T.StructField("protected", T.IntegerType()),
    T.StructField("qos_priority", T.IntegerType()),
    T.StructField("wlan_radio_signal_percent", T.DoubleType()),
    T.StructField("raw_frame_type_str", T.StringType()),
])

#: Vendors of address prefixes seen on cameras and small boards.
CAMERA_OUIS = {
    "00:01:4A": "Sony", "00:01:73": "Samsung", "00:04:DA": "Panasonic", "00:0D:C5": "Panasonic", "00:0E:8F": "Sony",
    "00:16:6B": "Samsung", "00:1C:10": "Hikvision", "00:1D:73": "Buffalo", "00:22:75": "Belkin", "00:23:35": "Hikvision",
    "00:23:99": "Samsung", "00:24:A5": "Buffalo", "00:40:48": "Hikvision", "00:80:F0": "Panasonic", "00:E0:4C": "Hikvision",
    "08:00:46": "Sony", "24:0A:C4": "ESP32", "28:ED:E0": "Dahua", "30:AE:A4": "ESP32", "4C:11:BF": "Dahua",
    "70:4F:57": "TP-Link", "94:10:3E": "Belkin", "A4:CF:12": "ESP32", "B0:95:75": "TP-Link", "B8:27:EB": "Raspberry Pi",
    "C0:56:27": "Belkin", "D8:0D:17": "TP-Link", "DC:A6:32": "Raspberry Pi", "E4:5F:01": "Raspberry Pi",
}
ESP32_OUIS = tuple(o for o, v in CAMERA_OUIS.items() if v == "ESP32")
RPI_OUIS = tuple(o for o, v in CAMERA_OUIS.items() if v == "Raspberry Pi")

#: Names of frame subtypes (type * 16 + subtype).
SUBTYPE_NAMES = {
    0x00: "Association Request", 0x01: "Association Response", 0x02: "Reassociation Request", 0x03: "Reassociation Response",
    0x04: "Probe Request", 0x05: "Probe Response", 0x08: "Beacon", 0x0A: "Disassociation", 0x0B: "Authentication",
    0x0C: "Deauthentication", 0x0D: "Action",
    0x1B: "RTS", 0x1C: "CTS", 0x1D: "ACK", 0x1E: "Block Ack Request", 0x1F: "Block Ack",
    0x20: "Data", 0x21: "Data+CF-Ack", 0x22: "Data+CF-Poll", 0x23: "Data+CF-Ack+CF-Poll", 0x24: "Null", 0x25: "CF-Ack",
    0x26: "CF-Poll", 0x27: "CF-Ack+CF-Poll", 0x28: "QoS Data", 0x29: "QoS Data+CF-Ack", 0x2A: "QoS Data+CF-Poll",
    0x2B: "QoS Data+CF-Ack+CF-Poll", 0x2C: "QoS Null", 0x2E: "QoS CF-Poll", 0x2F: "QoS CF-Ack+CF-Poll",
}
TYPE_NAMES = {0: "Management", 1: "Control", 2: "Data"}

#: Columns that identify a flow or window and are no model features.
IDENTIFIERS = ("source_file", "sa", "da", "sa_oui", "flow_id", "dominant_sa", "label", "device_type")

#: Features that tell cameras from other devices best.
SIGNATURE_FEATURES = (
    "large_frame_ratio", "mean_frame_size", "uplink_ratio", "qos_data_ratio", "mean_iat", "cv_iat", "burst_count", "burst_regularity",
    "burst_density", "mean_burst_packets", "mean_burst_bytes", "mean_data_rate", "protected_ratio", "mean_rssi", "rssi_range", "is_5ghz", "throughput_bps",
)
#: Features grouped by what they tell of.
FEATURE_GROUPS = {
    "frame_size": ("mean_frame_size", "std_frame_size", "large_frame_ratio", "small_frame_ratio"),
    "inter_arrival_time": ("mean_iat", "std_iat", "cv_iat", "median_iat"),
    "direction": ("uplink_ratio",),
    "signal_strength": ("mean_rssi", "std_rssi", "rssi_range", "rssi_trend"),
    "frame_type": ("data_frame_ratio", "mgmt_frame_ratio", "qos_data_ratio"),
    "burst": ("burst_count", "mean_burst_packets", "mean_burst_bytes", "burst_regularity", "burst_density"),
    "data_rate": ("mean_data_rate", "max_data_rate"),
    "qos_encryption": ("protected_ratio", "retry_ratio"),
    "throughput": ("throughput_bps", "packet_count", "total_bytes"),
}
DEVICE_TYPES = ("wireless_camera", "smartphone", "laptop", "tablet", "iot_device", "smart_tv", "router", "unknown")
