"""Readers of tool exports and labels, and writers of results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aircadence.functions.frames import is_qos_subtype, subtype_name
from aircadence.workspace import file_system

#: Export column, result column, type.
RADIOTAP_FIELDS = (
    ("radiotap.dbm_antsignal", "rssi", "double"), ("radiotap.ant_signal", "ant_signal", "bigint"), ("radiotap.ant_noise", "ant_noise", "bigint"),
    ("radiotap.datarate", "data_rate", "double"), ("radiotap.channel.freq", "channel_freq", "bigint"), ("radiotap.mcs.index", "mcs_index", "bigint"),
)
MAC_FIELDS = (
    ("wlan.fc.type", "frame_type", "int"), ("wlan.fc.type_subtype", "frame_subtype", "int"), ("wlan.fc.tods", "to_ds", "int"), ("wlan.fc.fromds", "from_ds", "int"),
    ("wlan.sa", "sa", "string"), ("wlan.da", "da", "string"), ("wlan.ta", "ta", "string"), ("wlan.ra", "ra", "string"), ("wlan.bssid", "bssid", "string"),
    ("wlan.seq", "seq_num", "int"), ("wlan.frag", "frag_num", "int"), ("wlan.duration", "duration", "int"), ("wlan.fc.retry", "retry", "int"),
    ("wlan.fc.protected", "protected", "int"), ("wlan.qos.priority", "qos_priority", "int"),
)
_ZERO = ("to_ds", "from_ds", "retry", "protected")


def number(text: Column, kind: str) -> Column:
    """A number from decimal, hexadecimal or true/false text; null for others."""
    t = F.lower(F.trim(text))
    if kind == "string":
        return F.nullif(text, F.lit(""))
    if kind == "double":
        return text.try_cast("double")
    hexed = F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).cast("bigint"))
    word = F.when(t == "true", 1).when(t == "false", 0).cast("bigint")
    return F.coalesce(t.try_cast("bigint"), hexed, word).cast(kind)


def _picked(rows: DataFrame, fields: Sequence[tuple[str, str, str]]) -> list[Column]:
    have = set(rows.columns)
    return [(number(F.col(f"`{source}`").cast("string"), kind) if source in have else F.lit(None).cast(kind)).alias(name) for source, name, kind in fields]


def radiotap_fields(rows: DataFrame) -> DataFrame:
    """Radiotap columns of a flat text export beside its other columns."""
    names = {f for f, _, _ in RADIOTAP_FIELDS}
    return rows.select(*(c for c in rows.columns if "." not in c and c not in names), *_picked(rows, RADIOTAP_FIELDS))


def radiotap_record(rows: DataFrame) -> DataFrame:
    """As :func:`radiotap_fields`; signal falls back to the relative one, and a
    noise of 0 counts as missing."""
    return radiotap_fields(rows).withColumn("rssi", F.coalesce("rssi", F.col("ant_signal").cast("double"))).withColumn("ant_noise", F.nullif(F.col("ant_noise"), F.lit(0)))


def mac_fields(rows: DataFrame) -> DataFrame:
    """MAC header columns of a flat text export; QoS only for QoS subtypes."""
    out = rows.select(*(c for c in rows.columns if "." not in c), *_picked(rows, MAC_FIELDS)).fillna(0, list(_ZERO))
    return out.withColumn("qos_priority", F.when(is_qos_subtype(), F.col("qos_priority"))).withColumn("frame_type_str", subtype_name())


def read_field_csv(spark: SparkSession, path: str) -> DataFrame:
    """A field export with header; all columns are text."""
    return spark.read.csv(path, header=True, quote='"', escape='"')


def write_field_csv(frames: DataFrame, path: str, fields: Sequence[str]) -> None:
    frames.select(*fields).write.csv(path, header=True, quoteAll=True, escape="\"", mode="overwrite")


_LEAVES = ("frame.time_epoch", "frame.len", "radiotap.dbm_antsignal", "radiotap.datarate", "radiotap.channel.freq", "wlan.fc.type", "wlan.fc.type_subtype", "wlan.fc.tods", "wlan.fc.fromds", "wlan.sa", "wlan.da", "wlan.bssid", "wlan_radio.signal_percent")


def read_capture_json(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a JSON export; leaves may be arrays or single values."""
    layers = {}
    for leaf in _LEAVES:
        layers.setdefault(leaf.split(".")[0], []).append(leaf)
    inner = ", ".join(f"{layer}: STRUCT<{', '.join(f'`{x}`: STRING' for x in leaves)}>" for layer, leaves in layers.items())
    raw = spark.read.json(path, schema=f"_source STRUCT<layers: STRUCT<{inner}>>", multiLine=True).withColumn("source_file", F.col("_metadata.file_name"))

    def leaf(name: str, kind: str) -> Column:
        text = F.col("_source")["layers"][name.split(".")[0]][name]
        # An array read as text keeps its brackets and quotes.
        first = F.coalesce(F.get_json_object(text, "$[0]"), text)
        return number(first, kind)

    return raw.select(
        "source_file", F.coalesce(leaf("frame.time_epoch", "double"), F.lit(0.0)).alias("timestamp"), F.coalesce(leaf("frame.len", "int"), F.lit(0)).alias("frame_len"), leaf("radiotap.dbm_antsignal", "double").alias("rssi"),
        leaf("radiotap.datarate", "double").alias("data_rate"), leaf("radiotap.channel.freq", "int").alias("channel_freq"), leaf("wlan.fc.type", "int").alias("frame_type"), leaf("wlan.fc.type_subtype", "int").alias("frame_subtype"),
        leaf("wlan.fc.tods", "int").alias("to_ds"), leaf("wlan.fc.fromds", "int").alias("from_ds"), leaf("wlan.sa", "string").alias("sa"), leaf("wlan.da", "string").alias("da"), leaf("wlan.bssid", "string").alias("bssid"),
        # The receiver's own measure stands in where a frame has no signal.
        F.when(leaf("radiotap.dbm_antsignal", "double").isNull(), leaf("wlan_radio.signal_percent", "double")).alias("wlan_radio_signal_percent"),
    )


LABEL_SCHEMA = "device_mac STRING, device_type STRING, session_id STRING, notes STRING, timestamp STRING"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows in file order (``label_order``); the file is small."""
    rows = spark.read.csv(path, header=True, schema=LABEL_SCHEMA)
    return rows.withColumn("label_order", F.monotonically_increasing_id())


def append_labels(rows: DataFrame, path: str) -> None:
    rows.select("device_mac", "device_type", "session_id", "notes", "timestamp").write.csv(path, header=True, mode="append")


def capture_summary(frames: DataFrame) -> DataFrame:
    """Frame count, first and last time, and bytes of each file."""
    return frames.groupBy("source_file").agg(F.count("*").alias("frames"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sum(F.col("frame_len").cast("bigint")).alias("bytes"))


def write_features(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def save_profiles(rows: DataFrame, table: str) -> None:
    rows.write.mode("overwrite").saveAsTable(table)


def write_evaluation(metrics: DataFrame, path: str) -> None:
    """One JSON file of a metrics table, all rows, written as they come."""
    system, where = file_system(path)
    with system.open_output_stream(where) as sink:
        mark = b"["
        for row in metrics.toLocalIterator():
            sink.write(mark + json.dumps(row.asDict(recursive=True), default=str).encode())
            mark = b", "
        sink.write(b"[]" if mark == b"[" else b"]")
