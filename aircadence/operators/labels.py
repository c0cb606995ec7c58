"""Labels of capture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def label_map(labels: DataFrame) -> DataFrame:
    """One row for each session: its last device type, at its first position.

    ``labels`` needs ``label_order, session_id, device_type``; null and empty
    sessions are dropped.
    """
    rows = labels.where("session_id is not null and session_id <> ''")
    return rows.groupBy("session_id").agg(F.min("label_order").alias("label_order"), F.max_by("device_type", "label_order").alias("device_type"))


def label_files(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``device_type``: the first label whose session the file's name starts with.

    Prefixes are matched by equality on the name's own prefixes, once for each
    file, so that many labels cost no cross product.
    """
    files = rows.select("source_file").distinct()
    prefixes = files.select("source_file", F.explode(F.sequence(F.lit(1), F.length("source_file"))).alias("n")).select("source_file", F.expr("left(source_file, n)").alias("session_id"))
    found = prefixes.join(label_map(labels), "session_id").groupBy("source_file").agg(F.min_by("device_type", "label_order").alias("device_type"))
    return rows.join(found, "source_file", "left").fillna("unknown", ["device_type"])
