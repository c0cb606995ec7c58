"""Registered queries of models, which SQL cannot express, and of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.functions.frames import frame_features
from aircadence.ml import models, prep
from aircadence.ml.wide_forests import WideForest, fit_wide_forest
from aircadence.operators.flows import PAIR
from aircadence.plans import oracle as O
from aircadence.sources import fixture
from aircadence.streaming import streams
from aircadence.workspace import Workspace

_DIMS = 64
_COLUMNS = [f"e{i}" for i in range(_DIMS)]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Scaled embeddings with label index, weight and split."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null and label is not null")
    flat = rows.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_COLUMNS)))
    split = prep.stratified_split(flat, "label", "vec_id")
    train = split.where("not is_test")
    # Imputation and scaling are fitted on the training rows alone.
    filled = prep.impute(split, _COLUMNS, prep.medians(train, _COLUMNS))
    scaled = prep.scale(filled, prep.scaling(filled.where("not is_test"), _COLUMNS))
    ready = prep.class_weights(prep.encode_labels(scaled, "label"), "label")
    vectors = models.assembled(ready, _COLUMNS).select("vec_id", "label", F.col("label_index").cast("double").alias("label_index"), "weight", "is_test", "features")
    # Every training step runs over all partitions, so small tables get few.
    dealt = vectors.repartition(max(1, rows.count() // 20_000)).withColumn("row", F.monotonically_increasing_id())
    return Workspace(spark, "models").stage(dealt, "vectors")


def _forest(rows: DataFrame) -> WideForest:
    return fit_wide_forest(rows.where("not is_test"), "vec_id", "row")


def _kernel(rows: DataFrame) -> models.KernelSvm:
    return models.fit_kernel_svm(rows.where("not is_test"), _DIMS)


def _told(rows: DataFrame, names: list[str]) -> DataFrame:
    return models.with_vote(rows, names, [1.0] * len(names)).select("vec_id", "label", "label_index", "y_pred", F.round("confidence", 6).alias("confidence"))


def rf_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _told(models.predictions(_forest(rows), rows.where("is_test"), "rf"), ["rf"])


def svm_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return _told(models.predictions(_kernel(rows), rows.where("is_test"), "svm"), ["svm"])


def ensemble_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    both = models.predictions(_kernel(rows), models.predictions(_forest(rows), rows.where("is_test"), "rf"), "svm")
    return _told(both, ["svm", "rf"])


def importance(spark: SparkSession, d: str) -> DataFrame:
    return models.importances(_forest(_vectors(spark, d)), _COLUMNS, spark)


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    flat = rows.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_COLUMNS)))
    out, _ = models.pca(flat, _COLUMNS)
    return out.select("vec_id", "label", "pc1", "pc2")


def _drained(spark: SparkSession, d: str, build) -> DataFrame:
    """Run a stream over the frames to its end and return what it appended."""
    work = Workspace(spark, "stream")
    batch = frame_features(fixture.frames(spark, d))
    source = work.path("source")
    batch.write.parquet(source)
    # A last frame far in the future lets the watermark close all windows.
    closing = batch.limit(1).withColumn("timestamp", F.lit(1e6)).withColumn("source_file", F.lit("closing"))
    closing.write.mode("append").parquet(source)
    sink = work.path("sink")
    stream = build(spark.readStream.schema(batch.schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", work.path(f"checkpoint-{uuid.uuid4().hex}")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink).where("source_file <> 'closing'")


def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, d, streams.window_counts)
    ratios = (F.round(F.col(c), 4).alias(c) for c in ("data_frame_ratio", "uplink_ratio", "mean_global_rssi"))
    return out.select("source_file", F.unix_seconds("window_start").alias("window_sec"), "packet_count", "total_traffic_volume", "unique_sources", *ratios)


def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, d, lambda s: streams.flow_sessions(s, 30.0, 2000.0))
    return out.select(*PAIR, "packet_count", "total_bytes", *(F.round(c, 4).alias(c) for c in ("start_ts", "end_ts", "uplink_ratio")), "burst_count", "burst_bytes")


QUERIES = {f.__name__: f for f in (rf_predictions, svm_predictions, ensemble_predictions, importance, pca_projection, streaming_windows, streaming_sessions)}

#: What a stream has appended at its end equals one query over all frames.
SQL = {
    "streaming_windows": O.sql("""SELECT source_file, CAST(floor(timestamp / 10) * 10 AS BIGINT) AS window_sec, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS total_traffic_volume,
  CAST(count(DISTINCT sa) AS INT) AS unique_sources, round(avg(is_data), 4) AS data_frame_ratio, round(avg(is_uplink), 4) AS uplink_ratio, round(avg(rssi), 4) AS mean_global_rssi
  FROM ff GROUP BY ALL""", O.FF),
    "streaming_sessions": O.sql("""SELECT source_file, sa, da, packet_count, total_bytes, round(start_ts, 4) AS start_ts, round(end_ts, 4) AS end_ts, round(up, 4) AS uplink_ratio,
  coalesce(n, 0) AS burst_count, coalesce(b, 0) AS burst_bytes
  FROM (SELECT source_file, sa, da, flow_id, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS total_bytes, min(timestamp) AS start_ts, max(timestamp) AS end_ts, avg(is_uplink) AS up FROM se GROUP BY ALL)
  LEFT JOIN (SELECT source_file, sa, da, flow_id, count(*) AS n, CAST(sum(total_bytes) AS BIGINT) AS b FROM bu GROUP BY ALL) USING (source_file, sa, da, flow_id)""", O.FF, O.SE, O.BU),
}
