"""Scalar expressions over frame columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence import schema as S


def _flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def oui(mac: str | Column) -> Column:
    """First three bytes of an address in upper case; null for what is none."""
    parts = F.split(F.replace(_c(mac), F.lit("-"), F.lit(":")), ":")
    return F.when((_c(mac) != "") & (F.size(parts) >= 3), F.upper(F.array_join(F.slice(parts, 1, 3), ":")))


def normal_mac(mac: str | Column) -> Column:
    return F.lower(F.trim(_c(mac)))


def ds_interpretation(to_ds="to_ds", from_ds="from_ds") -> Column:
    """Direction by the two distribution-system bits, "unknown" if one is null."""
    a, b = _c(to_ds), _c(from_ds)
    return (
        F.when((a == 0) & (b == 0), "ad_hoc_or_direct").when((a == 1) & (b == 0), "sta_to_ap")
        .when((a == 0) & (b == 1), "ap_to_sta").when((a == 1) & (b == 1), "wds").otherwise("unknown")
    )


def ds_mode(to_ds="to_ds", from_ds="from_ds") -> Column:
    """As :func:`ds_interpretation` for parsed headers: null bits count as 0."""
    mode = ds_interpretation(F.coalesce(_c(to_ds), F.lit(0)), F.coalesce(_c(from_ds), F.lit(0)))
    return F.when(mode == "ad_hoc_or_direct", "ad_hoc").otherwise(mode)


def is_uplink() -> Column:
    return (F.col("to_ds") == 1) & (F.col("from_ds") == 0)


def is_downlink() -> Column:
    return (F.col("to_ds") == 0) & (F.col("from_ds") == 1)


def is_qos_data() -> Column:
    return (F.col("frame_type") == 2) & (F.col("frame_subtype") == 0x28)


def is_qos_subtype() -> Column:
    """The parsed header's test: any of four subtypes, whatever the type."""
    return F.col("frame_subtype").isin(0x28, 0x29, 0x2A, 0x2B)


def effective_source() -> Column:
    return F.when(F.coalesce(F.col("from_ds"), F.lit(0)) == 1, F.col("ta")).otherwise(F.col("sa"))


def effective_destination() -> Column:
    mode = ds_mode()
    return F.when(mode == "sta_to_ap", F.coalesce(F.nullif(F.col("ra"), F.lit("")), F.col("da"))).when(mode == "wds", F.col("ra")).otherwise(F.col("da"))



def subtype_name() -> Column:
    known = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(S.SUBTYPE_NAMES.items()))), F.col("frame_subtype"))
    return F.when(F.col("frame_subtype").isNotNull(), F.coalesce(known, F.lit("Unknown")))


def type_name() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(S.TYPE_NAMES.items()))), F.col("frame_type")), F.lit("Unknown"))


def size_bin(length="frame_len") -> Column:
    n = _c(length)
    return F.when(n < 100, 0).when(n < 500, 1).when(n < 1000, 2).otherwise(3)


def estimated_distance(rssi="rssi", freq="channel_freq") -> Column:
    """Metres by free-space loss from 20 dBm; 2437 MHz where unknown."""
    f = F.coalesce(F.nullif(_c(freq), F.lit(0)), F.lit(2437))
    loss = 20.0 - _c(rssi)
    metres = F.round(F.pow(F.lit(10.0), (loss - 20.0 * F.log10(f) + 27.55) / 20.0), 2)
    return F.when(_c(rssi).isNull(), None).when(loss <= 0, 0.1).otherwise(metres)


def frame_features(frames: DataFrame) -> DataFrame:
    """The 27 frame features with their defaults, beside the frame's keys.

    Missing signal and noise stay null, so that averages pass over them.
    """
    prefix = oui("sa")
    freq = F.coalesce("channel_freq", F.lit(0))
    return frames.select(
        "source_file", "frame_no",
        F.coalesce(F.nullif(F.col("sa"), F.lit("")), F.lit("unknown")).alias("sa"), F.coalesce(F.nullif(F.col("da"), F.lit("")), F.lit("unknown")).alias("da"),
        "frame_len", "timestamp", "rssi", F.coalesce("data_rate", F.lit(0.0)).alias("data_rate"), freq.alias("channel_freq"),
        F.coalesce("mcs_index", F.lit(-1)).alias("mcs_index"), "ant_noise", F.coalesce("frame_type", F.lit(-1)).alias("frame_type"), F.coalesce("frame_subtype", F.lit(-1)).alias("frame_subtype"),
        F.coalesce("to_ds", F.lit(0)).alias("to_ds"), F.coalesce("from_ds", F.lit(0)).alias("from_ds"), F.coalesce("seq_num", F.lit(-1)).alias("seq_num"), F.coalesce("duration", F.lit(0)).alias("duration"),
        F.col("retry").alias("retry_flag"), F.col("protected").alias("protected_flag"), F.coalesce("qos_priority", F.lit(-1)).alias("qos_priority"),
        _flag(F.col("frame_type") == 2).alias("is_data"), _flag(F.col("frame_type") == 0).alias("is_mgmt"), _flag(F.col("frame_type") == 1).alias("is_ctrl"),
        _flag(is_qos_data()).alias("is_qos_data"), _flag(is_uplink()).alias("is_uplink"), _flag(freq > 4000).alias("is_5ghz"),
        prefix.alias("sa_oui"), _flag(prefix.isin(*S.CAMERA_OUIS)).alias("is_known_camera_oui"), _flag(prefix.isin(*S.ESP32_OUIS)).alias("is_esp32_oui"), _flag(prefix.isin(*S.RPI_OUIS)).alias("is_rpi_oui"),
        size_bin().alias("size_bin"),
    )


def radiotap_struct() -> Column:
    """Radiotap fields of a parsed frame with what is derived from them, as one struct."""
    freq = F.coalesce("channel_freq", F.lit(0))
    fields = ("rssi", "ant_noise", "data_rate", "channel_freq", "mcs_index")
    return F.struct(*fields, (freq > 4000).alias("is_5ghz"), estimated_distance().alias("estimated_distance_m"))


def mac_struct() -> Column:
    """MAC fields of a parsed frame with what is derived from them, as one struct."""
    fields = ("frame_type", "frame_subtype", "to_ds", "from_ds", "sa", "da", "ta", "ra", "bssid", "seq_num", "duration", "retry", "protected", "qos_priority")
    told = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(*fields, ds_mode().alias("ds_mode"), told(is_uplink()).alias("is_uplink"), told(is_downlink()).alias("is_downlink"), told(is_qos_data()).alias("is_qos_data"))


def frame_batch(frames: DataFrame, max_frames: int | None = None) -> DataFrame:
    """Frame features of the first frames of each file; None and 0 mean all."""
    return frame_features(head_per_file(frames, max_frames or None))


def is_camera_like() -> Column:
    """At least three of five signs, on frame features."""
    signs = (F.col("is_data") * F.col("is_uplink") == 1, F.col("is_qos_data") == 1, F.col("protected_flag") == 1, F.col("frame_len") > 1000, F.col("data_rate") > 50)
    return sum((_flag(s) for s in signs), F.lit(0)) >= 3


def head_per_file(frames: DataFrame, max_frames: int | None) -> DataFrame:
    """The first frames of each file (None: all; 0: none).

    Spark keeps only so many frames of a file in each task before it ranks them.
    """
    if max_frames is None:
        return frames
    name = "__place"
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("frame_no"))
    return frames.withColumn(name, place).where(F.col(name) <= max_frames).drop(name)
