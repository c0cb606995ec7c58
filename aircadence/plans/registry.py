"""All registered queries with their DuckDB equivalents.

Numbers that depend on the order of summation are rounded to four places on
both sides: engines add in different orders, and a sixth place can fall either way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence import schema as S
from aircadence.functions import frames as X
from aircadence.functions.filters import display_filter as display_filter_of
from aircadence.ml import metrics as M, prep
from aircadence.operators import flows, identify, labels as L, stats, windows
from aircadence.plans import oracle as O
from aircadence.sources import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TIMEOUT_SEC, BURST_MS = 30.0, 2000.0


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return fixture.frames(spark, d)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return X.frame_features(_frames(spark, d))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return flows.sessionise(_features(spark, d), TIMEOUT_SEC, BURST_MS, bucket_sec=60.0)


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_features(_sessions(spark, d))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null and toxic is not null")
    return rows.select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"), ((F.col("doc_id") * 37 % 101) / F.lit(101.0)).alias("score"), "doc_id")


def _round(df: DataFrame, columns: str, exact: str = "") -> DataFrame:
    return df.select(*exact.split(), *((F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in columns.split()))


_FRAME_COLUMNS = "source_file frame_no sa da frame_len timestamp rssi data_rate channel_freq mcs_index ant_noise frame_type frame_subtype to_ds from_ds seq_num duration retry_flag protected_flag qos_priority is_data is_mgmt is_ctrl is_qos_data is_uplink is_5ghz sa_oui is_known_camera_oui is_esp32_oui is_rpi_oui size_bin"
_ID = "source_file sa da flow_id"
_SIZE = "mean_frame_size std_frame_size median_frame_size large_frame_ratio small_frame_ratio"
_IAT = "mean_iat std_iat min_iat max_iat median_iat cv_iat"
_RSSI = "mean_rssi std_rssi min_rssi max_rssi rssi_range"
_RATIO = "uplink_ratio data_frame_ratio mgmt_frame_ratio ctrl_frame_ratio qos_data_ratio retry_ratio protected_ratio"
_RATE = "mean_data_rate max_data_rate throughput_bps"
_FLOW_EXACT = f"{_ID} sa_oui packet_count total_bytes min_frame_size max_frame_size is_5ghz is_known_camera_oui camera_heuristic_score"
_FLOW_ROUND = f"duration_sec {_SIZE} {_IAT} {_RSSI} rssi_trend {_RATIO} {_RATE}"
_BURST = "mean_burst_packets std_burst_packets mean_burst_bytes std_burst_bytes mean_burst_duration_ms mean_burst_interval_ms std_burst_interval_ms burst_regularity bursts_per_sec burst_density"


@query(O.sql(f"SELECT {_FRAME_COLUMNS.replace(' ', ', ')} FROM ff", O.FF))
def frame_features(spark, d):
    return _features(spark, d)


@query(O.sql("SELECT frame_no, frame_type = 2 AS is_data, frame_type = 0 AS is_mgmt, frame_type = 1 AS is_ctrl, frame_type = 2 AND frame_subtype = 40 AS is_qos_frame, frame_subtype IN (40, 41, 42, 43) AS is_qos_header, to_ds = 1 AND from_ds = 0 AS is_uplink, to_ds = 0 AND from_ds = 1 AS is_downlink FROM fr"))
def frame_flags(spark, d):
    t = F.col("frame_type")
    return _frames(spark, d).select("frame_no", (t == 2).alias("is_data"), (t == 0).alias("is_mgmt"), (t == 1).alias("is_ctrl"), X.is_qos_data().alias("is_qos_frame"), X.is_qos_subtype().alias("is_qos_header"), X.is_uplink().alias("is_uplink"), X.is_downlink().alias("is_downlink"))


_DS = "CASE WHEN {0} = 0 AND {1} = 0 THEN '{2}' WHEN {0} = 1 AND {1} = 0 THEN 'sta_to_ap' WHEN {0} = 0 AND {1} = 1 THEN 'ap_to_sta' WHEN {0} = 1 AND {1} = 1 THEN 'wds' ELSE 'unknown' END"
_MODE = _DS.format("coalesce(to_ds, 0)", "coalesce(from_ds, 0)", "ad_hoc")


@query(O.sql(f"SELECT frame_no, {_DS.format('to_ds', 'from_ds', 'ad_hoc_or_direct')} AS interpretation, {_MODE} AS ds_mode FROM fr"))
def frame_ds_mode(spark, d):
    return _frames(spark, d).select("frame_no", X.ds_interpretation().alias("interpretation"), X.ds_mode().alias("ds_mode"))


@query(O.sql(f"SELECT frame_no, CASE WHEN from_ds = 1 THEN ta ELSE sa END AS source, CASE {_MODE} WHEN 'sta_to_ap' THEN coalesce(nullif(ra, ''), da) WHEN 'wds' THEN ra ELSE da END AS destination FROM fr"))
def frame_effective_addresses(spark, d):
    return _frames(spark, d).select("frame_no", X.effective_source().alias("source"), X.effective_destination().alias("destination"))


@query(O.sql(f"SELECT frame_no, {O.OUI} AS oui, {O.OUI} IN ({O._list(S.CAMERA_OUIS)}) AS camera FROM fr"))
def frame_oui(spark, d):
    return _frames(spark, d).select("frame_no", X.oui("sa").alias("oui"), X.oui("sa").isin(*S.CAMERA_OUIS).alias("camera"))


_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.SUBTYPE_NAMES.items())


@query(O.sql(f"SELECT frame_no, CASE frame_subtype {_NAMES} ELSE 'Unknown' END AS subtype_name FROM fr"))
def frame_subtype_name(spark, d):
    return _frames(spark, d).select("frame_no", X.subtype_name().alias("subtype_name"))


@query(O.sql("SELECT size_bin, count(*) AS frames FROM ff GROUP BY size_bin", O.FF))
def frame_size_bin(spark, d):
    return _frames(spark, d).groupBy(X.size_bin().alias("size_bin")).agg(F.count("*").alias("frames"))


@query(O.sql("SELECT frame_no, CASE WHEN rssi IS NULL THEN NULL WHEN 20 - rssi <= 0 THEN 1e-1 ELSE round(pow(10e0, (20 - rssi - 20 * log10(coalesce(nullif(channel_freq, 0), 2437)) + 2755e-2) / 20e0), 2) END AS metres FROM fr"))
def frame_distance(spark, d):
    return _frames(spark, d).select("frame_no", X.estimated_distance().alias("metres"))


@query(O.sql("SELECT frame_no FROM ff WHERE (is_data * is_uplink) + is_qos_data + protected_flag + (frame_len > 1000)::INT + (data_rate > 50)::INT >= 3", O.FF))
def camera_like_frames(spark, d):
    return _features(spark, d).where(X.is_camera_like()).select("frame_no")


@query(O.sql("SELECT frame_no, try_cast(nullif(CAST(rssi AS VARCHAR), '') AS DOUBLE) AS rssi, try_cast(CAST(data_rate AS VARCHAR) AS DOUBLE) AS data_rate, CAST(channel_freq AS BIGINT) AS channel_freq, CAST(mcs_index AS BIGINT) AS mcs_index, CAST(ant_noise AS BIGINT) AS ant_noise FROM fr"))
def radiotap_from_fields(spark, d):
    from aircadence.sources import readers

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    export = _frames(spark, d).select("frame_no", text("rssi").alias("radiotap.dbm_antsignal"), text("data_rate").alias("radiotap.datarate"), text("channel_freq").alias("radiotap.channel.freq"), text("mcs_index").alias("radiotap.mcs.index"), text("ant_noise").alias("radiotap.ant_noise"))
    return readers.radiotap_fields(export).select("frame_no", "rssi", "data_rate", "channel_freq", "mcs_index", "ant_noise")


@query(O.sql("SELECT frame_no, CAST(coalesce(rssi, CASE WHEN event_no % 2 = 0 THEN seq_num % 100 END) AS DOUBLE) AS rssi, nullif(CASE WHEN event_no % 3 = 0 THEN 0 ELSE CAST(ant_noise AS BIGINT) END, 0) AS ant_noise FROM (SELECT *, frame_no AS event_no FROM fr)"))
def radiotap_record(spark, d):
    from aircadence.sources import readers

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number, noise = F.col("frame_no"), F.col("ant_noise")
    export = _frames(spark, d).select(
        "frame_no", text(F.col("rssi")).alias("radiotap.dbm_antsignal"), text(F.when(number % 2 == 0, F.col("seq_num") % 100)).alias("radiotap.ant_signal"),
        text(F.when(number % 3 == 0, 0).otherwise(noise)).alias("radiotap.ant_noise"),
    )
    return readers.radiotap_record(export).select("frame_no", "rssi", "ant_noise")


@query(O.sql("""SELECT frame_no, frame_type, frame_subtype, coalesce(to_ds, 0) AS to_ds, coalesce(from_ds, 0) AS from_ds, sa, da, nullif(ra, '') AS ra, retry, protected,
  CASE WHEN frame_subtype IN (40, 41, 42, 43) THEN qos_priority END AS qos_priority, CASE frame_subtype WHEN 8 THEN 'Beacon' WHEN 29 THEN 'ACK' WHEN 32 THEN 'Data' WHEN 40 THEN 'QoS Data' END AS frame_type_str FROM fr"""))
def mac_from_fields(spark, d):
    from aircadence.sources import readers

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda c: F.when(F.col(c) == 1, "True").otherwise("False")
    export = _frames(spark, d).select(
        "frame_no", text("frame_type").alias("wlan.fc.type"), F.format_string("0x%04x", "frame_subtype").alias("wlan.fc.type_subtype"), text("to_ds").alias("wlan.fc.tods"), text("from_ds").alias("wlan.fc.fromds"),
        text("sa").alias("wlan.sa"), text("da").alias("wlan.da"), text("ra").alias("wlan.ra"), flag("retry").alias("wlan.fc.retry"), flag("protected").alias("wlan.fc.protected"), text("qos_priority").alias("wlan.qos.priority"),
    )
    return readers.mac_fields(export).select("frame_no", "frame_type", "frame_subtype", "to_ds", "from_ds", "sa", "da", "ra", "retry", "protected", "qos_priority", "frame_type_str")


@query(O.sql("SELECT frame_no, lower(sa) AS mac FROM fr"))
def normal_addresses(spark, d):
    written = F.concat(F.lit("  "), F.upper("sa"), F.lit(" "))
    return _frames(spark, d).select("frame_no", X.normal_mac(written).alias("mac"))


@query(O.sql("SELECT frame_no, coalesce(rssi, 0) AS rssi, 0e0 AS not_measured, CAST(frame_len AS DOUBLE) AS frame_len FROM ff", O.FF))
def aligned_columns(spark, d):
    rows = _features(spark, d).select("frame_no", "frame_len", "rssi")
    return prep.align(rows, ["rssi", "not_measured", "frame_len"]).select("frame_no", "rssi", "not_measured", "frame_len")


_NUMERIC = "frame_no frame_len timestamp rssi data_rate channel_freq mcs_index ant_noise frame_type frame_subtype to_ds from_ds seq_num duration retry_flag protected_flag qos_priority is_data is_mgmt is_ctrl is_qos_data is_uplink is_5ghz is_known_camera_oui is_esp32_oui is_rpi_oui".split()


@query(O.sql(f"SELECT unnest({_NUMERIC}) AS feature, unnest([{', '.join(f'count({c})' for c in _NUMERIC)}]) AS present FROM ff", O.FF))
def numeric_columns(spark, d):
    """The columns that models use, each with its number of values."""
    rows = _features(spark, d)
    counts = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("present")) for c in prep.feature_columns(rows, ["size_bin"])]
    return rows.agg(F.array(*counts).alias("x")).select(F.inline("x"))


@query(O.sql("SELECT frame_no, frame_len, rssi FROM fr WHERE source_file = 'session_0.pcap' UNION ALL SELECT frame_no, frame_len, NULL FROM fr WHERE source_file = 'session_1.pcap'"))
def united_files(spark, d):
    rows = _frames(spark, d).select("source_file", "frame_no", "frame_len", "rssi")
    one, two = rows.where("source_file = 'session_0.pcap'"), rows.where("source_file = 'session_1.pcap'").drop("rssi")
    return stats.union_all([one, two]).select("frame_no", "frame_len", "rssi")


@query(O.sql("SELECT doc_id, round(greatest((2 * score + 3 * score2) / 5, 1 - (2 * score + 3 * score2) / 5), 4) AS confidence, 'good' AS predicted_type FROM vt WHERE (2 * score + 3 * score2) / 5 > 5e-1 AND round((2 * score + 3 * score2) / 5, 9) >= 7e-1", O.PR, "vt AS (SELECT *, ((doc_id * 53) % 97) / 97e0 AS score2 FROM pr)"))
def confident_alerts(spark, d):
    from aircadence.ml import models

    told = models.with_vote(_votes(spark, d), ["p1", "p2"], [2, 3])
    named = told.select("doc_id", F.round("confidence", 9).alias("confidence"), F.element_at(F.array(F.lit("bad"), F.lit("good")), F.col("y_pred") + 1).alias("predicted_type"))
    return _round(models.alerts(named, "good", 0.7), "confidence", "doc_id predicted_type")


@query(O.sql("SELECT source_file, sa, da, frame_no, flow_id, pos, burst_id FROM se", O.FF, O.SE))
def flow_sessions(spark, d):
    return _sessions(spark, d).select("source_file", "sa", "da", "frame_no", "flow_id", "pos", "burst_id")


def _flow_part(name: str, columns: str, exact: str = ""):
    def run(spark, d):
        return _round(_flows(spark, d), columns, f"{_ID} {exact}")

    run.__name__ = name
    query(O.sql(f"SELECT {O.rounded(columns, f'{_ID} {exact}')} FROM fl", O.FF, O.SE, O.FL))(run)


_flow_part("flow_size_stats", _SIZE, "min_frame_size max_frame_size packet_count total_bytes")
_flow_part("flow_iat_stats", f"duration_sec {_IAT}")
_flow_part("flow_rssi_stats", _RSSI)
_flow_part("flow_rssi_trend", "rssi_trend")
_flow_part("flow_ratios", _RATIO)
_flow_part("flow_rates", _RATE, "is_5ghz")


@query(O.sql(f"SELECT {O.rounded(_FLOW_ROUND, _FLOW_EXACT)} FROM fl", O.FF, O.SE, O.FL))
def flow_features(spark, d):
    return _round(_flows(spark, d), _FLOW_ROUND, _FLOW_EXACT)


@query(O.sql("SELECT source_file, sa, da, flow_id, packet_count, camera_heuristic_score FROM fl", O.FF, O.SE, O.FL))
def flow_camera_score(spark, d):
    return flows.flow_features(_sessions(spark, d), median_gap=False).select(*flows.FLOW, "packet_count", "camera_heuristic_score")


@query(O.sql(f"SELECT {O.rounded('duration_ms start_ts end_ts', f'{_ID} start_idx end_idx packet_count total_bytes')} FROM bu", O.FF, O.SE, O.BU))
def bursts(spark, d):
    return _round(flows.bursts(_sessions(spark, d)), "duration_ms start_ts end_ts", f"{_ID} start_idx end_idx packet_count total_bytes")


@query(O.sql(f"SELECT {O.rounded(_BURST, f'{_ID} burst_count')} FROM bs", O.FF, O.SE, O.BU, O.BS))
def burst_statistics(spark, d):
    return _round(flows.burst_statistics(flows.bursts(_sessions(spark, d))), _BURST, f"{_ID} burst_count")


_PATTERN = "((burst_count >= 5)::INT + CASE WHEN mean_burst_packets >= 5 THEN 1e0 WHEN mean_burst_packets >= 3 THEN 5e-1 ELSE 0 END + CASE WHEN burst_regularity < 3e-1 THEN 1e0 WHEN burst_regularity < 6e-1 THEN 5e-1 ELSE 0 END + CASE WHEN burst_density > 100 THEN 1e0 WHEN burst_density > 50 THEN 5e-1 ELSE 0 END + CASE WHEN mean_burst_bytes > 10000 THEN 1e0 WHEN mean_burst_bytes > 5000 THEN 5e-1 ELSE 0 END) / 5"


@query(O.sql(f"SELECT source_file, sa, da, flow_id, {_PATTERN} AS confidence, {_PATTERN} > 5e-1 AS camera_like FROM bs", O.FF, O.SE, O.BU, O.BS))
def burst_camera_pattern(spark, d):
    return flows.camera_pattern(flows.burst_statistics(flows.bursts(_sessions(spark, d)))).select(*flows.FLOW, "confidence", "camera_like")


_B0 = ", ".join(f"round(coalesce({c}, 0), 4) + 0e0 AS {c}" if not c.startswith(("std_burst_p", "std_burst_b")) else f"round({c}, 4) + 0e0 AS {c}" for c in _BURST.split())


@query(O.sql(f"SELECT {O.rounded(_FLOW_ROUND, _FLOW_EXACT)}, coalesce(burst_count, 0) AS burst_count, {_B0} FROM fl LEFT JOIN bs USING (source_file, sa, da, flow_id)", O.FF, O.SE, O.FL, O.BU, O.BS))
def flow_burst_features(spark, d):
    return _round(flows.flow_burst_features(_sessions(spark, d)), f"{_FLOW_ROUND} {_BURST}", f"{_FLOW_EXACT} burst_count")


_WIN = "time_start dominant_source_ratio source_entropy data_frame_ratio mgmt_frame_ratio ctrl_frame_ratio mean_global_rssi max_global_rssi uplink_ratio qos_ratio"
_WIN_EXACT = "source_file window_idx unique_sources unique_destinations total_traffic_volume packet_count dominant_sa"


@query(O.sql(f"""SELECT {O.rounded(_WIN, _WIN_EXACT)} FROM (
  SELECT source_file, window_idx, min(time_start) AS time_start, count(DISTINCT da) AS unique_destinations, CAST(sum(frame_len) AS BIGINT) AS total_traffic_volume, count(*) AS packet_count,
    avg(is_data) AS data_frame_ratio, avg(is_mgmt) AS mgmt_frame_ratio, avg(is_ctrl) AS ctrl_frame_ratio, coalesce(avg(rssi), 0) AS mean_global_rssi, coalesce(max(rssi), 0) AS max_global_rssi, avg(is_uplink) AS uplink_ratio, avg(is_qos_data) AS qos_ratio
  FROM wi GROUP BY ALL) JOIN wd USING (source_file, window_idx)""", O.FF, O.WI))
def window_features(spark, d):
    return _round(windows.window_features(_features(spark, d)), _WIN, _WIN_EXACT)


@query(O.sql(f"SELECT {O.rounded('dominant_source_ratio', 'source_file window_idx dominant_sa')} FROM wd", O.FF, O.WI))
def window_dominant_source(spark, d):
    return _round(windows.dominant_source(windows.assign_windows(_features(spark, d))), "dominant_source_ratio", "source_file window_idx dominant_sa")


@query(O.sql(f"SELECT {O.rounded('source_entropy', 'source_file window_idx unique_sources')} FROM wd", O.FF, O.WI))
def window_entropy(spark, d):
    return _round(windows.dominant_source(windows.assign_windows(_features(spark, d))), "source_entropy", "source_file window_idx unique_sources")


@query(O.sql("""SELECT s.source_file, s.bin, s.bin * 1e0 + 5e-1 AS centre, round(coalesce(b.bytes, 0) * 8 / 1e0 / 1e6, 4) AS mbps, coalesce(b.n, 0) / 1e0 AS pps FROM sp s
  LEFT JOIN (SELECT fr.source_file, CAST(floor((timestamp - t0) / 1e0) AS INT) AS bin, sum(frame_len) AS bytes, count(*) AS n FROM fr JOIN t USING (source_file) GROUP BY ALL) b ON s.source_file = b.source_file AND s.bin = b.bin""",
  "t AS (SELECT source_file, min(timestamp) AS t0, max(timestamp) AS t1 FROM fr GROUP BY source_file HAVING count(*) >= 2)", "sp AS (SELECT source_file, CAST(unnest(range(0, CAST(trunc(t1 - t0) AS INT) + 1)) AS INT) AS bin FROM t)"))
def throughput_series(spark, d):
    return _round(windows.throughput_series(_frames(spark, d)), "mbps", "source_file bin centre pps")


@query(O.sql("SELECT frame_type, count(*) AS frames FROM fr WHERE frame_type IN (0, 1, 2) GROUP BY 1"))
def frame_type_counts(spark, d):
    return stats.type_counts(_frames(spark, d))


@query(O.sql("SELECT channel_freq, count(*) AS frames FROM fr WHERE channel_freq > 0 GROUP BY 1"))
def channel_usage(spark, d):
    return stats.channel_usage(_frames(spark, d))


def _hist(name: str, column: str, bins: int, by: str, positive: bool):
    where = f"{column} > 0" if positive else f"{column} IS NOT NULL"
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""

    def run(spark, d):
        return _round(stats.histogram(_frames(spark, d).where(where), column, bins, [by] if by else []), "edge density", f"{by} bin frames")

    run.__name__ = name
    query(O.sql(f"SELECT {keys}bin, round(lo + bin * w, 4) + 0e0 AS edge, count(*) AS frames, round(count(*) / any_value(n) / w, 4) + 0e0 AS density FROM y GROUP BY {keys}bin, lo, w",
      f"x AS (SELECT {keys}CAST({column} AS DOUBLE) AS v, min({column}) OVER ({part}) AS lo, (max({column}) OVER ({part}) - min({column}) OVER ({part})) / {bins}e0 AS w, count(*) OVER ({part}) * 1e0 AS n FROM fr WHERE {where})",
      f"y AS (SELECT *, CAST(least(floor((v - lo) / w), {bins - 1}) AS INT) AS bin FROM x)"))(run)


_hist("size_histogram", "frame_len", 60, "", False)
_hist("size_histogram_by_type", "frame_len", 50, "frame_type", False)
_hist("rssi_histogram", "rssi", 40, "", False)
_hist("rssi_histogram_by_file", "rssi", 30, "source_file", False)
_hist("rate_histogram", "data_rate", 50, "", True)


@query(O.sql("SELECT round(avg(data_rate), 4) AS mean_data_rate FROM fr WHERE data_rate > 0"))
def mean_rate(spark, d):
    return _round(stats.mean_rate(_frames(spark, d)), "mean_data_rate")


@query(O.sql("""SELECT source_file, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(min(x) FILTER (x BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1)), 4) AS whisker_low,
  round(max(x) FILTER (x BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1)), 4) AS whisker_high, count(*) FILTER (NOT x BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1)) AS fliers, count(*) AS n
  FROM (SELECT source_file, iat * 1000 AS x FROM se WHERE iat IS NOT NULL) JOIN (SELECT source_file, quantile_cont(iat * 1000, 25e-2) AS q1, quantile_cont(iat * 1000, 5e-1) AS m, quantile_cont(iat * 1000, 75e-2) AS q3 FROM se WHERE iat IS NOT NULL GROUP BY 1) USING (source_file) GROUP BY source_file, q1, m, q3""", O.FF, O.SE))
def iat_boxplot(spark, d):
    rows = _sessions(spark, d).where("iat is not null").withColumn("iat_ms", F.col("iat") * 1000)
    return _round(stats.box_statistics(rows, "iat_ms", "source_file"), "q1 median q3 whisker_low whisker_high", "source_file fliers n")


_CORR = ("mean_frame_size", "mean_iat", "mean_rssi", "uplink_ratio", "packet_count")
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]


@query(O.sql(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM fl" for a, b in _PAIRS), O.FF, O.SE, O.FL))
def feature_correlation(spark, d):
    return _round(stats.correlation_pairs(_flows(spark, d), _CORR), "corr", "a b")


@query(O.sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(var_samp({c}), 4) AS variance FROM fl" for c in _CORR), O.FF, O.SE, O.FL))
def feature_stats(spark, d):
    return _round(stats.feature_stats(_flows(spark, d), _CORR), "mean std variance", "feature")


@query(O.sql(f"SELECT feature, round(variance, 4) AS variance FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, var_samp({c}) AS variance FROM fl''' for c in _CORR)}) ORDER BY variance DESC LIMIT 3", O.FF, O.SE, O.FL))
def top_variance_features(spark, d):
    return _round(stats.top_by_variance(_flows(spark, d), _CORR, 3), "variance", "feature")


@query(O.sql("SELECT source_file, sa, da, flow_id, count(*) AS n, round(regr_slope(rssi, x), 4) + 0e0 AS slope, round(regr_intercept(rssi, x), 4) + 0e0 AS intercept FROM (SELECT *, rssi_pos - min(rssi_pos) OVER (PARTITION BY source_file, sa, da, flow_id) AS x FROM se WHERE rssi IS NOT NULL) GROUP BY ALL HAVING count(*) > 1", O.FF, O.SE))
def rssi_linear_fit(spark, d):
    return _round(stats.line_fit(_sessions(spark, d), flows.FLOW), "slope intercept", f"{_ID} n")


@query(O.sql("SELECT lower(sa) AS mac, count(*) AS frames, min(frame_no) AS first_no FROM fr WHERE frame_type = 2 AND sa <> '' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10"))
def source_mac_ranking(spark, d):
    return windows.source_ranking(_frames(spark, d))


_PROFILE = "first_seen last_seen mean_frame_size uplink_ratio qos_ratio mean_rssi"


@query(O.sql(f"SELECT {O.rounded(_PROFILE, 'sa frames total_bytes known_oui')}, (mean_frame_size > 500)::INT + (uplink_ratio > 7e-1)::INT + (qos_ratio > 5e-1)::INT + 2 * known_oui AS suspicion FROM (SELECT sa, count(*) AS frames, CAST(sum(frame_len) AS BIGINT) AS total_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen, avg(frame_len) AS mean_frame_size, avg(is_uplink) AS uplink_ratio, avg(is_qos_data) AS qos_ratio, coalesce(avg(rssi), 0) AS mean_rssi, max(is_known_camera_oui) AS known_oui FROM ff GROUP BY sa)", O.FF))
def device_profile(spark, d):
    return _round(windows.device_profile(_features(spark, d)), _PROFILE, "sa frames total_bytes known_oui suspicion")


@query(O.sql("SELECT count(*) FILTER (said AND truth) AS hits, count(*) FILTER (said AND NOT truth) AS false_alarms, count(*) FILTER (truth AND NOT said) AS misses FROM (SELECT sa, avg(frame_len) > 600 AS said, max(is_known_camera_oui) = 1 AS truth FROM ff GROUP BY sa)", O.FF))
def candidate_truth(spark, d):
    per = _features(spark, d).groupBy(F.col("sa").alias("mac")).agg(F.avg("frame_len").alias("size"), F.max("is_known_camera_oui").alias("truth"))
    return windows.candidate_truth(per.where("size > 600"), per.where("truth = 1"))


@query(O.sql("SELECT source_file, sa, bin, round(m, 4) + 0e0 AS mean_rssi, round(m - lag(m) OVER (PARTITION BY source_file, sa ORDER BY bin), 4) + 0e0 AS change FROM (SELECT source_file, sa, CAST(floor(timestamp / 10e0) AS INT) AS bin, avg(rssi) AS m FROM fr WHERE rssi IS NOT NULL GROUP BY ALL)"))
def proximity_trend(spark, d):
    return _round(windows.proximity_trend(_frames(spark, d)), "mean_rssi change", "source_file sa bin")


@query(O.sql("SELECT source_file, sa, da, flow_id, CASE source_file WHEN 'session_0.pcap' THEN 'wireless_camera' WHEN 'session_1.pcap' THEN 'smartphone' ELSE 'laptop' END AS device_type FROM fl", O.FF, O.SE, O.FL))
def label_prefix_join(spark, d):
    return L.label_files(_flows(spark, d).select(*flows.FLOW), fixture.session_labels(spark))


@query(O.sql("SELECT source_file, frame_no, coalesce(rssi, (SELECT median(rssi) FROM ff)) AS rssi, coalesce(CAST(ant_noise AS DOUBLE), (SELECT median(ant_noise) FROM ff)) AS ant_noise FROM ff", O.FF))
def median_impute(spark, d):
    return prep.impute(_features(spark, d).select("source_file", "frame_no", "rssi", "ant_noise"), ["rssi", "ant_noise"])


@query(O.sql(f"SELECT source_file, sa, da, flow_id, {', '.join(f'round(({c} - (SELECT avg({c}) FROM fl)) / (SELECT stddev_pop({c}) FROM fl), 4) + 0e0 AS {c}' for c in ('mean_iat', 'mean_rssi', 'uplink_ratio'))} FROM fl", O.FF, O.SE, O.FL))
def standard_scale(spark, d):
    rows = _flows(spark, d)
    return _round(prep.scale(rows, prep.scaling(rows, ["mean_iat", "mean_rssi", "uplink_ratio"])), "mean_iat mean_rssi uplink_ratio", _ID)


@query("SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS label_index FROM events")
def label_encode(spark, d):
    return prep.encode_labels(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_type").select("event_id", "event_type", "label_index")


_WORD = "(doc_id % 4294967296 + 4294967296 + 42) % 4294967296"
_MIXED = f"PARTITION BY quality ORDER BY (({_WORD})::HUGEINT * 2654435761) % 4294967296, doc_id"


@query(f"SELECT doc_id, quality, row_number() OVER ({_MIXED}) <= round(count(*) OVER (PARTITION BY quality) * 3e-1) AS is_test FROM labels")
def stratified_split(spark, d):
    return prep.stratified_split(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "quality", "doc_id")


@query(f"SELECT doc_id, quality, CAST((row_number() OVER ({_MIXED}) - 1) % 5 AS INT) AS fold FROM labels")
def stratified_folds(spark, d):
    return prep.stratified_folds(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "quality", "doc_id")


@query("SELECT doc_id, quality, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 4) AS weight FROM labels")
def class_weights(spark, d):
    return _round(prep.class_weights(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "quality"), "weight", "doc_id quality")


@query(O.sql("SELECT a.c AS y_true, b.c AS y_pred, count(pr.y_true) AS n, round(coalesce(count(pr.y_true) / nullif(sum(count(pr.y_true)) OVER (PARTITION BY a.c), 0), 0), 4) AS share FROM (VALUES (0), (1)) a(c) CROSS JOIN (VALUES (0), (1)) b(c) LEFT JOIN pr ON pr.y_true = a.c AND pr.y_pred = b.c GROUP BY a.c, b.c", O.PR))
def confusion_matrix(spark, d):
    return _round(M.confusion_matrix(_outcomes(spark, d), [0, 1]), "share", "y_true y_pred n")


_CM = "cm AS (SELECT c AS label, count(*) FILTER (y_true = c AND y_pred = c) * 1e0 AS tp, count(*) FILTER (y_true = c) AS support, count(*) FILTER (y_pred = c) AS said FROM pr, (SELECT y_true AS c FROM pr UNION SELECT y_pred FROM pr) GROUP BY c), cp AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM cm), cf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cp)"


@query(O.sql(f"SELECT {O.rounded('precision recall f1', 'label support')} FROM cf", O.PR, _CM))
def class_metrics(spark, d):
    return _round(M.class_metrics(_outcomes(spark, d)), "precision recall f1", "label support")


_OVERALL = "accuracy precision_macro recall_macro f1_macro precision_weighted recall_weighted f1_weighted"


@query(O.sql(f"SELECT {O.rounded(_OVERALL)} FROM (SELECT sum(tp) / sum(support) AS accuracy, {', '.join(f'avg({c}) AS {c}_macro, sum({c} * support) / sum(support) AS {c}_weighted' for c in ('precision', 'recall', 'f1'))} FROM cf)", O.PR, _CM))
def macro_weighted_metrics(spark, d):
    return _round(M.overall_metrics(_outcomes(spark, d)), _OVERALL)


@query(O.sql("SELECT tp, fp, tn, fn, round(tp / greatest(tp + fn, 1), 4) AS detection_rate, round(fp / greatest(fp + tn, 1), 4) AS false_alarm_rate, round(tp / greatest(tp + fp, 1), 4) AS precision, round(2 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1 FROM (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true <> 1 AND y_pred = 1) AS fp, count(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tn, count(*) FILTER (y_true = 1 AND y_pred <> 1) AS fn FROM pr)", O.PR))
def binary_detection(spark, d):
    return _round(M.binary_detection(_outcomes(spark, d)), "detection_rate false_alarm_rate precision f1", "tp fp tn fn")


_ST = "st AS (SELECT score, sum(sum(y_true = 1)) OVER (ORDER BY score DESC) AS tp, sum(sum(y_true <> 1)) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, (y_true = 1)::INT AS p, y_true FROM pr) GROUP BY score)".replace("sum(sum(y_true = 1))", "sum(count(*) FILTER (y_true = 1))").replace("sum(sum(y_true <> 1))", "sum(count(*) FILTER (y_true <> 1))")


@query(O.sql("SELECT round(avg((a.score > b.score)::INT + 5e-1 * (a.score = b.score)::INT), 4) AS auc FROM pr a JOIN pr b ON a.y_true = 1 AND b.y_true <> 1", O.PR))
def roc_auc(spark, d):
    return _round(M.roc_auc(_outcomes(spark, d)), "auc")


@query(O.sql("SELECT round(score, 4) AS score, round(fp / max(fp) OVER (), 4) AS fpr, round(tp / max(tp) OVER (), 4) AS tpr FROM st", O.PR, _ST))
def roc_curve(spark, d):
    return _round(M.roc_curve(_outcomes(spark, d)), "score fpr tpr")


@query(O.sql("SELECT round(score, 4) AS score, round(tp / (tp + fp), 4) AS precision, round(tp / max(tp) OVER (), 4) AS recall FROM st", O.PR, _ST))
def pr_curve(spark, d):
    return _round(M.pr_curve(_outcomes(spark, d)), "score precision recall")


def _votes(spark: SparkSession, d: str) -> DataFrame:
    s, t = F.col("score"), (F.col("doc_id") * 53 % 97) / F.lit(97.0)
    return _outcomes(spark, d).select("doc_id", "y_true", F.array(1 - s, s).alias("p1"), F.array(1 - t, t).alias("p2"))


_VT = "vt AS (SELECT *, ((doc_id * 53) % 97) / 97e0 AS score2 FROM pr)"


@query(O.sql("SELECT doc_id, round((2 * score + 3 * score2) / 5, 4) AS p_good, CAST((2 * score + 3 * score2) / 5 > (2 * (1 - score) + 3 * (1 - score2)) / 5 AS INT) AS y_pred FROM vt", O.PR, _VT))
def weighted_vote(spark, d):
    p = M.weighted_vote(["p1", "p2"], [2, 3])
    return _votes(spark, d).select("doc_id", F.round(p[1], 4).alias("p_good"), M.argmax(p).cast("int").alias("y_pred"))


@query(O.sql("SELECT CAST(a AS INT) AS w1, CAST(b AS INT) AS w2, round(avg(((a * score + b * score2 > a * (1 - score) + b * (1 - score2))::INT = y_true)::INT), 4) AS accuracy FROM vt, range(1, 6) x(a), range(1, 6) y(b) GROUP BY a, b", O.PR, _VT))
def weight_search(spark, d):
    return _round(M.weight_search(_votes(spark, d), "y_true", "p1", "p2"), "accuracy", "w1 w2")


_IMP = "im AS (SELECT event_type AS feature, count(*) / (SELECT count(*) FROM events) AS importance FROM events GROUP BY 1)"


def _importance(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("event_type").alias("feature")).agg((F.count("*") / F.lit(e.count())).alias("importance"))


@query(O.sql("SELECT feature, round(importance, 4) AS importance, CAST(row_number() OVER w AS INT) AS rank, round(sum(importance) OVER w, 4) AS cumulative FROM im WINDOW w AS (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING)", _IMP))
def feature_rank(spark, d):
    return _round(M.rank_features(_importance(spark, d)), "importance cumulative", "feature rank")


@query(O.sql("SELECT feature FROM im ORDER BY importance DESC, feature LIMIT 3", _IMP))
def top_k_features(spark, d):
    return M.top_features(_importance(spark, d), 3).select("feature")


@query(O.sql("SELECT frame_no FROM fr WHERE frame_type = 2 AND frame_subtype = 40 AND sa LIKE 'b8:27:eb%' AND lower(sa) = (SELECT min(lower(sa)) FROM fr WHERE sa LIKE 'b8:27:eb%')"))
def display_filter(spark, d):
    rows = _frames(spark, d)
    mac = rows.where("sa like 'b8:27:eb%'").agg(F.min(F.lower("sa"))).first()[0]
    return rows.where(display_filter_of(f"wlan && wlan.fc.type == 2 && wlan.fc.type_subtype == 0x28 && wlan.addr == {mac}")).select("frame_no")


#: Short windows, so that the small tables have many; the fixture's frames are short, so few signs are asked for.
_DW = """dw AS (
  SELECT source_file, sa, CAST(floor(timestamp / 2) AS BIGINT) AS window_id, CAST(sum(frame_len) AS BIGINT) AS bytes, avg(rssi) AS mean_rssi, max(channel_freq) AS channel_freq,
    CASE WHEN avg(frame_len) > 1000 THEN 2 ELSE 0 END + CASE WHEN avg((frame_len > 1000)::INT) > 0.5 THEN 2 ELSE 0 END + CASE WHEN avg(is_uplink) > 0.7 THEN 2 ELSE 0 END
    + CASE WHEN avg(is_qos_data) > 0.5 THEN 1 ELSE 0 END + CASE WHEN avg(protected_flag) > 0.5 THEN 1 ELSE 0 END + CASE WHEN avg(CASE WHEN data_rate > 0 THEN data_rate END) > 50 THEN 1 ELSE 0 END AS score
  FROM ff GROUP BY ALL)"""


@query(O.sql("""SELECT d.source_file, d.sa, d.windows, d.camera_windows, round(d.camera_windows / d.windows, 4) AS stability, d.overlap_windows, round(d.mean_share, 4) AS mean_share,
  round(-b.best[1], 4) AS alignment, CAST(b.best[3] AS INT) AS lag, d.camera_windows >= 2 AND d.camera_windows / d.windows >= 5e-1 AS is_camera FROM d LEFT JOIN b USING (source_file, sa)""", O.FF, _DW,
    "o AS (SELECT *, (score >= 4)::INT AS likely, sum((score >= 4)::INT) OVER w AS alike, sum(bytes) OVER w AS whole FROM dw WINDOW w AS (PARTITION BY source_file, window_id))",
    "d AS (SELECT source_file, sa, count(*) AS windows, CAST(sum(likely) AS BIGINT) AS camera_windows, CAST(sum((likely = 1 AND alike > 1)::INT) AS BIGINT) AS overlap_windows, avg(bytes / whole) AS mean_share, sum(bytes) AS total FROM o GROUP BY ALL)",
    "l AS (SELECT source_file, sa AS leader FROM d QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY camera_windows DESC, total DESC, sa) = 1)",
    "m AS (SELECT a.source_file, a.sa, g.lag, count(*) AS n, var_pop(a.bytes) AS v, var_pop(z.bytes) AS w, corr(a.bytes, z.bytes) AS r FROM dw a CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) g JOIN l ON l.source_file = a.source_file AND l.leader <> a.sa JOIN dw z ON z.source_file = l.source_file AND z.sa = l.leader AND z.window_id = a.window_id - g.lag GROUP BY ALL)",
    "b AS (SELECT source_file, sa, min([-round(r, 6), abs(lag), lag]) AS best FROM m WHERE n >= 3 AND v > 0 AND w > 0 GROUP BY ALL)"))
def joint_cameras(spark, d):
    """Several cameras at once: how steady each is, how they overlap, and which follow the leading one."""
    out = identify.joint_cameras(identify.device_windows(_features(spark, d), 2.0), least_score=4)
    return _round(out, "stability mean_share alignment", "source_file sa windows camera_windows overlap_windows lag is_camera")


@query(O.sql("""SELECT source_file, sa, window_id, round(mean_rssi, 4) + 0e0 AS mean_rssi, round(rise, 4) + 0e0 AS rise, round(fall, 4) + 0e0 AS fall, trend,
  CASE trend WHEN 'approaching' THEN rise_low + 1 WHEN 'receding' THEN fall_low + 1 END AS since_window FROM z""", O.FF, _DW,
    "h AS (SELECT *, mean_rssi - avg(mean_rssi) OVER (PARTITION BY source_file, sa) AS off FROM dw WHERE mean_rssi IS NOT NULL)",
    "s AS (SELECT *, round(sum(off - 1) OVER w, 6) AS up, round(sum(-off - 1) OVER w, 6) AS down FROM h WINDOW w AS (PARTITION BY source_file, sa ORDER BY window_id))",
    "t AS (SELECT *, round(up - least(0, min(up) OVER w), 6) AS rise, round(down - least(0, min(down) OVER w), 6) AS fall FROM s WINDOW w AS (PARTITION BY source_file, sa ORDER BY window_id))",
    "z AS (SELECT *, max(CASE WHEN rise = 0 THEN window_id END) OVER w AS rise_low, max(CASE WHEN fall = 0 THEN window_id END) OVER w AS fall_low, CASE WHEN rise > 8 AND (fall <= 8 OR rise >= fall) THEN 'approaching' WHEN fall > 8 THEN 'receding' ELSE 'steady' END AS trend FROM t WINDOW w AS (PARTITION BY source_file, sa ORDER BY window_id))"))
def device_approaches(spark, d):
    """Whether each device comes nearer, by cumulative sums of its signal."""
    out = identify.approaches(identify.device_windows(_features(spark, d), 2.0))
    return _round(out, "mean_rssi rise fall", "source_file sa window_id trend since_window")


#: Filters and their SQL.
_FILTERS = (
    ("wlan.fc.type == 2 && !(wlan.fc.retry == 1)", "frame_type = 2 AND NOT coalesce(retry = 1, false)"),
    ("wlan.fc.type == 0 || wlan.fc.type == 1 && wlan.fc.retry", "frame_type = 0 OR frame_type = 1 AND retry IS NOT NULL"),
    ("(wlan.fc.type eq 0 or wlan.fc.type eq 1) and frame.len ge 100", "(frame_type = 0 OR frame_type = 1) AND frame_len >= 100"),
    ("wlan.addr == 0A-00-00-00-00-01 || wlan.addr == b8:27:eb:00:00:00", "coalesce(lower(sa) IN ('0a:00:00:00:00:01', 'b8:27:eb:00:00:00'), false) OR coalesce(da IN ('0a:00:00:00:00:01', 'b8:27:eb:00:00:00'), false)"),
    ("wlan.da != 0a:00:00:00:00:01", "da <> '0a:00:00:00:00:01'"),
    ("!(wlan.da == 0a:00:00:00:00:01)", "coalesce(da <> '0a:00:00:00:00:01', true)"),
    ("wlan.sa[0:3] == b8:27:eb or wlan.sa[:3] == 24:0a:c4", "substr(sa, 1, 8) IN ('b8:27:eb', '24:0a:c4')"),
    ("wlan.sa contains 5e:00 && wlan.sa matches \":0[0-3]:..$\"", "contains(sa, ':5e:00:') AND regexp_matches(sa, ':0[0-3]:..$')"),
    ("wlan.qos.priority in {1, 4..6} && wlan.fc.type_subtype & 0x08", "(qos_priority = 1 OR qos_priority BETWEEN 4 AND 6) AND frame_subtype & 8 <> 0"),
    ("radiotap.dbm_antsignal < -40 && !wlan.ra && frame.time_epoch > 10.5", "rssi < -40 AND coalesce(ra, '') = '' AND timestamp > 10.5e0"),
)


@query(O.sql(" UNION ALL ".join(f"SELECT {k} AS filter, count(*) AS frames, CAST(coalesce(sum(frame_no), 0) AS BIGINT) AS frame_nos FROM fr WHERE {sql}" for k, (_, sql) in enumerate(_FILTERS))))
def filter_language(spark, d):
    """Frames that each of ten filters lets through, counted in one pass."""
    held = [F.when(display_filter_of(text), F.struct(F.lit(k).alias("filter"), F.col("frame_no"))) for k, (text, _) in enumerate(_FILTERS)]
    rows = _frames(spark, d).select(F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return rows.groupBy("filter").agg(F.count("*").alias("frames"), F.sum("frame_no").alias("frame_nos"))


@query(O.sql("SELECT source_file, frame_no FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY frame_no) AS k FROM fr) WHERE k <= 100"))
def frames_per_file(spark, d):
    return X.head_per_file(_frames(spark, d), 100).select("source_file", "frame_no")


_DISTANCE = "CASE WHEN rssi IS NULL THEN NULL WHEN 20 - rssi <= 0 THEN 1e-1 ELSE round(10 ** ((20 - rssi - 20 * log10(coalesce(nullif(channel_freq, 0), 2437)) + 2755e-2) / 20), 2) END"


@query(O.sql(f"SELECT source_file, frame_no, channel_freq, coalesce(channel_freq, 0) > 4000 AS is_5ghz, {_DISTANCE} AS estimated_distance_m FROM fr"))
def radiotap_struct(spark, d):
    rows = _frames(spark, d).select("source_file", "frame_no", X.radiotap_struct().alias("r"))
    return rows.select("source_file", "frame_no", "r.channel_freq", "r.is_5ghz", "r.estimated_distance_m")


@query(O.sql("""SELECT source_file, frame_no, seq_num, CASE WHEN coalesce(to_ds, 0) = 0 AND coalesce(from_ds, 0) = 0 THEN 'ad_hoc' WHEN coalesce(from_ds, 0) = 0 THEN 'sta_to_ap' WHEN coalesce(to_ds, 0) = 0 THEN 'ap_to_sta' ELSE 'wds' END AS ds_mode,
  coalesce(to_ds = 1 AND from_ds = 0, false) AS is_uplink, coalesce(to_ds = 0 AND from_ds = 1, false) AS is_downlink, frame_type = 2 AND frame_subtype = 40 AS is_qos_data FROM fr"""))
def mac_struct(spark, d):
    rows = _frames(spark, d).select("source_file", "frame_no", X.mac_struct().alias("m"))
    return rows.select("source_file", "frame_no", "m.seq_num", "m.ds_mode", "m.is_uplink", "m.is_downlink", "m.is_qos_data")


@query(O.sql("SELECT source_file, frame_no, size_bin FROM ff", O.FF))
def frame_batch_unlimited(spark, d):
    return X.frame_batch(_frames(spark, d), 0).select("source_file", "frame_no", "size_bin")


@query(O.sql("SELECT source_file, frame_no, size_bin FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY frame_no) AS k FROM ff) WHERE k <= 50", O.FF))
def frame_batch(spark, d):
    return X.frame_batch(_frames(spark, d), 50).select("source_file", "frame_no", "size_bin")


@query(O.sql("SELECT CAST(g AS VARCHAR) AS label, round(sum(q * (2 * tp - p)) / 2e0 / any_value(pp) / any_value(nn), 4) AS auc FROM (SELECT g, p, q, sum(p) OVER (PARTITION BY g ORDER BY s DESC) AS tp, sum(p) OVER (PARTITION BY g) AS pp, sum(q) OVER (PARTITION BY g) AS nn FROM st) GROUP BY g",
  O.PR, "oc AS (SELECT 0 AS g, (y_true = 0)::INT AS y, 1 - score AS s FROM pr UNION ALL SELECT 1, (y_true = 1)::INT, score FROM pr)", "st AS (SELECT g, s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM oc GROUP BY g, s)"))
def roc_auc_by_class(spark, d):
    rows = _outcomes(spark, d).select("y_true", F.array(1 - F.col("score"), F.col("score")).alias("p"))
    return _round(M.roc_auc(M.one_vs_rest(rows, "y_true", "p", ["0", "1"]), ["label"]), "auc", "label")


@query(O.sql("SELECT w1, w2, round(sum(CASE WHEN t + s > 0 THEN 2e0 * tp / (t + s) ELSE 0 END * t) / sum(t), 4) AS f1_weighted FROM wf GROUP BY w1, w2", O.PR, _VT,
  "wp AS (SELECT CAST(a AS INT) AS w1, CAST(b AS INT) AS w2, y_true, (a * score + b * score2 > a * (1 - score) + b * (1 - score2))::INT AS said FROM vt, range(1, 6) x(a), range(1, 6) y(b))",
  "wf AS (SELECT w1, w2, k, count(*) FILTER (y_true = k AND said = k) AS tp, count(*) FILTER (y_true = k) AS t, count(*) FILTER (said = k) AS s FROM wp, range(0, 2) c(k) GROUP BY w1, w2, k)"))
def weight_search_f1(spark, d):
    return _round(M.weight_search(_votes(spark, d), "y_true", "p1", "p2", metric="f1_weighted"), "f1_weighted", "w1 w2")


@query(O.sql("SELECT source_file, count(*) AS frames, round(min(timestamp), 4) AS first_ts, round(max(timestamp), 4) AS last_ts, CAST(sum(frame_len) AS BIGINT) AS bytes FROM fr GROUP BY 1"))
def capture_summary(spark, d):
    from aircadence.sources import readers

    return _round(readers.capture_summary(_frames(spark, d)), "first_ts last_ts", "source_file frames bytes")


from aircadence.plans import models as _models  # noqa: E402

QUERIES.update(_models.QUERIES)
SQL.update(_models.SQL)
