"""DuckDB equivalents of the registered queries.

The statements are built from common table expressions: ``fr`` (frames from
events), ``ff`` (frame features), ``se`` (frames with gaps, flows and bursts),
``fl`` (flow features), ``bu`` (bursts), ``bs`` (burst statistics) and ``wi``
(frames with windows).
"""

from __future__ import annotations

from aircadence import schema as S


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FR = """fr AS (
  SELECT event_id AS frame_no, concat('session_', CAST(user_id % 4 AS VARCHAR), '.pcap') AS source_file,
    (epoch_us(ts) - 1704067200000000) / 2e10 AS timestamp, CAST(floor(least(60e0 + value * 20e0, 1560e0)) AS INT) AS frame_len,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE -30e0 - floor(value / 5e0) END AS rssi, CASE WHEN event_id % 11 = 0 THEN NULL ELSE -95 END AS ant_noise,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0e0 WHEN event_id % 5 = 1 THEN 24e0 WHEN event_id % 5 = 2 THEN 65e0 ELSE 130e0 END AS data_rate,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 5180 ELSE 2437 END AS channel_freq,
    CAST(json_extract_string(props, '$.k') AS INT) % 10 AS mcs_index,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS frame_type,
    CASE event_type WHEN 'signup' THEN 8 WHEN 'error' THEN 29 WHEN 'click' THEN 32 ELSE 40 END AS frame_subtype,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS to_ds,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 4 = 3 THEN 1 WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS from_ds,
    concat(CASE WHEN user_id % 10 = 0 THEN 'b8:27:eb:00:' WHEN user_id % 10 = 1 THEN '24:0a:c4:00:' ELSE '02:00:5e:00:' END, substr(printf('%04x', user_id), 1, 2), ':', substr(printf('%04x', user_id), 3, 2)) AS sa,
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('0a:00:00:00:00:0', CAST(event_id % 2 AS VARCHAR)) END AS da,
    '0a:00:00:00:00:aa' AS ta, CASE WHEN event_id % 23 = 0 THEN '' ELSE '0a:00:00:00:00:bb' END AS ra, '0a:00:00:00:00:cc' AS bssid,
    CAST(event_id % 4096 AS INT) AS seq_num, 44 AS duration, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS retry,
    CASE WHEN event_type IN ('click', 'view', 'purchase') AND event_id % 5 <> 0 THEN 1 ELSE 0 END AS protected,
    CASE WHEN event_type IN ('view', 'purchase') THEN CAST(event_id % 8 AS INT) END AS qos_priority
  FROM events)"""

OUI = "upper(substr(sa, 1, 8))"

FF = f"""ff AS (
  SELECT source_file, frame_no, coalesce(nullif(sa, ''), 'unknown') AS sa, coalesce(nullif(da, ''), 'unknown') AS da, frame_len, timestamp, rssi,
    coalesce(data_rate, 0) AS data_rate, coalesce(channel_freq, 0) AS channel_freq, coalesce(mcs_index, -1) AS mcs_index, ant_noise, coalesce(frame_type, -1) AS frame_type,
    coalesce(frame_subtype, -1) AS frame_subtype, coalesce(to_ds, 0) AS to_ds, coalesce(from_ds, 0) AS from_ds, coalesce(seq_num, -1) AS seq_num, coalesce(duration, 0) AS duration,
    retry AS retry_flag, protected AS protected_flag, coalesce(qos_priority, -1) AS qos_priority,
    CASE WHEN frame_type = 2 THEN 1 ELSE 0 END AS is_data, CASE WHEN frame_type = 0 THEN 1 ELSE 0 END AS is_mgmt, CASE WHEN frame_type = 1 THEN 1 ELSE 0 END AS is_ctrl,
    CASE WHEN frame_type = 2 AND frame_subtype = 40 THEN 1 ELSE 0 END AS is_qos_data, CASE WHEN to_ds = 1 AND from_ds = 0 THEN 1 ELSE 0 END AS is_uplink,
    CASE WHEN channel_freq > 4000 THEN 1 ELSE 0 END AS is_5ghz, {OUI} AS sa_oui,
    CASE WHEN {OUI} IN ({_list(S.CAMERA_OUIS)}) THEN 1 ELSE 0 END AS is_known_camera_oui, CASE WHEN {OUI} IN ({_list(S.ESP32_OUIS)}) THEN 1 ELSE 0 END AS is_esp32_oui,
    CASE WHEN {OUI} IN ({_list(S.RPI_OUIS)}) THEN 1 ELSE 0 END AS is_rpi_oui,
    CASE WHEN frame_len < 100 THEN 0 WHEN frame_len < 500 THEN 1 WHEN frame_len < 1000 THEN 2 ELSE 3 END AS size_bin
  FROM fr)"""

SE = """g AS (
  SELECT *, timestamp - lag(timestamp) OVER p AS gap, row_number() OVER p - 1 AS pos, count(rssi) OVER p - 1 AS rssi_pos
  FROM ff WINDOW p AS (PARTITION BY source_file, sa, da ORDER BY timestamp, frame_no)
), se AS (
  SELECT *, CASE WHEN gap <= 30 THEN gap END AS iat, max(CASE WHEN gap IS NULL OR gap > 30 THEN pos END) OVER p AS flow_id,
    max(CASE WHEN gap IS NULL OR gap > 30 OR gap * 1000 > 2000 THEN pos END) OVER p AS burst_id
  FROM g WINDOW p AS (PARTITION BY source_file, sa, da ORDER BY timestamp, frame_no ROWS UNBOUNDED PRECEDING))"""

FL = f"""fa AS (
  SELECT source_file, sa, da, flow_id, max(timestamp) - min(timestamp) AS duration_sec, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS total_bytes,
    avg(frame_len) AS mean_frame_size, stddev_pop(frame_len) AS std_frame_size, min(frame_len) AS min_frame_size, max(frame_len) AS max_frame_size, median(frame_len) AS median_frame_size,
    avg(CASE WHEN frame_len > 1000 THEN 1e0 ELSE 0 END) AS large_frame_ratio, avg(CASE WHEN frame_len < 100 THEN 1e0 ELSE 0 END) AS small_frame_ratio,
    coalesce(avg(iat * 1000), 0) AS mean_iat, coalesce(stddev_pop(iat * 1000), 0) AS std_iat, coalesce(min(iat * 1000), 0) AS min_iat, coalesce(max(iat * 1000), 0) AS max_iat, coalesce(median(iat * 1000), 0) AS median_iat,
    avg(is_uplink) AS uplink_ratio, coalesce(avg(rssi), 0) AS mean_rssi, coalesce(stddev_pop(rssi), 0) AS std_rssi, coalesce(min(rssi), 0) AS min_rssi, coalesce(max(rssi), 0) AS max_rssi,
    CASE WHEN count(rssi) > 2 THEN regr_slope(rssi, rssi_pos) ELSE 0 END AS rssi_trend,
    avg(is_data) AS data_frame_ratio, avg(is_mgmt) AS mgmt_frame_ratio, avg(is_ctrl) AS ctrl_frame_ratio, avg(is_qos_data) AS qos_data_ratio, avg(retry_flag) AS retry_ratio, avg(protected_flag) AS protected_ratio,
    coalesce(avg(CASE WHEN data_rate > 0 THEN data_rate END), 0) AS mean_data_rate, coalesce(max(CASE WHEN data_rate > 0 THEN data_rate END), 0) AS max_data_rate, max(is_5ghz) AS is_5ghz
  FROM se GROUP BY source_file, sa, da, flow_id
), fb AS (
  SELECT *, CASE WHEN sa = 'unknown' THEN NULL ELSE {OUI} END AS sa_oui, total_bytes * 8 / greatest(duration_sec, 1e-3) AS throughput_bps, std_iat / greatest(mean_iat, 1e-9) AS cv_iat, max_rssi - min_rssi AS rssi_range,
    CASE WHEN {OUI} IN ({_list(S.CAMERA_OUIS)}) THEN 1 ELSE 0 END AS is_known_camera_oui FROM fa
), fl AS (
  SELECT *, 2 * (mean_frame_size > 1000)::INT + 2 * (large_frame_ratio > 5e-1)::INT + 2 * (uplink_ratio > 7e-1)::INT + (qos_data_ratio > 5e-1)::INT + (protected_ratio > 5e-1)::INT
    + (cv_iat < 5e-1 AND mean_iat > 0)::INT + (mean_data_rate > 50)::INT AS camera_heuristic_score FROM fb)"""

BU = """bu AS (
  SELECT source_file, sa, da, flow_id, burst_id, min(pos) - flow_id AS start_idx, max(pos) - flow_id AS end_idx, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS total_bytes,
    (max(timestamp) - min(timestamp)) * 1000 AS duration_ms, min(timestamp) AS start_ts, max(timestamp) AS end_ts
  FROM se GROUP BY source_file, sa, da, flow_id, burst_id HAVING count(*) >= 3)"""

BS = """bg AS (
  SELECT *, CASE WHEN lag(end_ts) OVER w IS NOT NULL THEN greatest(start_ts - lag(end_ts) OVER w, 0) * 1000 END AS gap FROM bu WINDOW w AS (PARTITION BY source_file, sa, da, flow_id ORDER BY burst_id)
), bh AS (
  SELECT source_file, sa, da, flow_id, count(*) AS burst_count, avg(packet_count) AS mean_burst_packets, stddev_pop(packet_count) AS std_burst_packets, avg(total_bytes) AS mean_burst_bytes, stddev_pop(total_bytes) AS std_burst_bytes,
    avg(duration_ms) AS mean_burst_duration_ms, coalesce(avg(gap), 0) AS mean_burst_interval_ms, coalesce(stddev_pop(gap), 0) AS std_burst_interval_ms, max(end_ts) - min(start_ts) AS span
  FROM bg GROUP BY source_file, sa, da, flow_id
), bs AS (
  SELECT * EXCLUDE (span), std_burst_interval_ms / greatest(mean_burst_interval_ms, 1e-9) AS burst_regularity, burst_count / greatest(span, 1e-3) AS bursts_per_sec, mean_burst_bytes / greatest(mean_burst_interval_ms, 1e-3) AS burst_density FROM bh)"""

WI = """wi AS (
  SELECT ff.*, CAST(trunc((timestamp - t0) / 10e0) AS INT) AS window_idx, t0 + CAST(trunc((timestamp - t0) / 10e0) AS INT) * 10e0 AS time_start
  FROM ff JOIN (SELECT source_file, arg_min(timestamp, frame_no) AS t0 FROM ff GROUP BY source_file) USING (source_file)
), wc AS (SELECT source_file, window_idx, sa, count(*) AS cnt, min(frame_no) AS first_no FROM wi GROUP BY ALL
), wd AS (
  SELECT source_file, window_idx, count(*) AS unique_sources, arg_max(sa, (cnt, -first_no)) AS dominant_sa, max(cnt) / sum(cnt) AS dominant_source_ratio,
    greatest(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 0) AS source_entropy FROM wc GROUP BY ALL)"""

#: Truth and prediction of the metric queries; a made-up score of few values.
PR = "pr AS (SELECT quality AS y_true, toxic AS y_pred, ((doc_id * 37) % 101) / 101e0 AS score, doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def sql(select: str, *parts: str) -> str:
    return "WITH " + ", ".join((FR, *parts)) + " " + select


def rounded(columns: str, exact: str = "") -> str:
    """Select list with ``columns`` rounded to four places."""
    return ", ".join([*exact.split(), *(f"round({c}, 4) + 0e0 AS {c}" for c in columns.split())])
