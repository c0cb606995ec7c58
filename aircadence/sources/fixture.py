"""Frames derived from the ``events`` table, for tests and benchmarks.

The projection compresses 30 days to about 130 seconds, so that the default
timeouts apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_EPOCH_US = 1704067200000000


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u, kind, v = (F.col(c) for c in ("event_id", "user_id", "event_type", "value"))
    hexed = F.format_string("%04x", u)
    text = lambda x: x.cast("string")
    return e.select(
        i.alias("frame_no"), F.concat(F.lit("session_"), text(u % 4), F.lit(".pcap")).alias("source_file"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - _EPOCH_US) / F.lit(2e10)).alias("timestamp"),
        F.floor(F.least(60.0 + v * 20.0, F.lit(1560.0))).cast("int").alias("frame_len"),
        F.when(i % 10 != 0, -30.0 - F.floor(v / 5.0)).alias("rssi"), F.when(i % 11 != 0, -95).alias("ant_noise"),
        F.when(i % 13 == 0, None).when(i % 5 == 0, 0.0).when(i % 5 == 1, 24.0).when(i % 5 == 2, 65.0).otherwise(130.0).alias("data_rate"),
        F.when(i % 17 == 0, None).when(u % 3 == 0, 5180).otherwise(2437).alias("channel_freq"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("mcs_index"),
        F.when(kind == "signup", 0).when(kind == "error", 1).otherwise(2).alias("frame_type"),
        F.when(kind == "signup", 8).when(kind == "error", 29).when(kind == "click", 32).otherwise(40).alias("frame_subtype"),
        F.when(i % 29 == 0, None).when(i % 4 == 3, 0).otherwise(1).alias("to_ds"),
        F.when(i % 29 == 0, None).when(i % 4 == 3, 1).when(i % 31 == 0, 1).otherwise(0).alias("from_ds"),
        F.concat(F.when(u % 10 == 0, "b8:27:eb:00:").when(u % 10 == 1, "24:0a:c4:00:").otherwise("02:00:5e:00:"), F.substring(hexed, 1, 2), F.lit(":"), F.substring(hexed, 3, 2)).alias("sa"),
        F.when(i % 19 != 0, F.concat(F.lit("0a:00:00:00:00:0"), text(i % 2))).alias("da"), F.lit("0a:00:00:00:00:aa").alias("ta"),
        F.when(i % 23 == 0, "").otherwise("0a:00:00:00:00:bb").alias("ra"), F.lit("0a:00:00:00:00:cc").alias("bssid"),
        (i % 4096).cast("int").alias("seq_num"), F.lit(44).alias("duration"), F.when(i % 7 == 0, 1).otherwise(0).alias("retry"),
        F.when(kind.isin("click", "view", "purchase") & (i % 5 != 0), 1).otherwise(0).alias("protected"),
        F.when(kind.isin("view", "purchase"), (i % 8).cast("int")).alias("qos_priority"),
    )


def session_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "session_0", "wireless_camera"), (1, "session_1", "smartphone"), (2, "session_", "laptop")], "label_order int, session_id string, device_type string")
