"""Frames at time 0 and before it are frames of a stream like others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aircadence.streaming import streams


def test_sessions_of_early_frames(spark, tmp_path):
    rows = [(t, k, 100, 1) for k, t in enumerate((-70.0, -69.5, -20.0, 0.0, 0.5, 2.0, 40.0, 1e6))]
    frames = spark.createDataFrame(rows, "timestamp double, frame_no long, frame_len int, is_uplink int").select(F.lit("f").alias("source_file"), F.lit("a").alias("sa"), F.lit("b").alias("da"), "*")
    frames.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = streams.flow_sessions(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in"), 30.0, 2000.0)
    name = f"early_{uuid.uuid4().hex}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.start_ts, r.end_ts, r.packet_count, r.burst_count) for r in spark.table(name).collect())
    assert got == [(-70.0, -69.5, 2, 0), (-20.0, 2.0, 4, 1), (40.0, 40.0, 1, 0)]
