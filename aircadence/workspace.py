"""Staging of intermediate tables in a folder that all machines share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
and all runs on one machine, a folder beside the warehouse is used instead; a
cluster without the setting is refused.  A staged
table cuts the lineage: a lost executor costs the re-reading of a file, not the
recomputation of all before it.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all machines share")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{os.path.dirname(base) if base.endswith('spark-warehouse') else base}/spark-warehouse-stage"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a file or folder, given as URI or plain path."""
    parsed = urllib.parse.urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), urllib.parse.unquote(parsed.path) if parsed.scheme else uri
    return fs.FileSystem.from_uri(uri)


#: Folders of this process's workspaces.
_STAGED: list[str] = []


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete what this process has staged; results not yet written are lost."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


class Workspace:
    """A new folder of staged tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _STAGED.append(self.root)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back with the same schema."""
        where = self.path(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that no later result reads."""
        for table in tables:
            for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                _delete(self.spark, name)


def broadcast_if_small(table: DataFrame, most_bytes: int = 128 << 20) -> DataFrame:
    """Mark a staged table for broadcast if it is small; larger ones are left to a shuffled join.

    A row counts 40 bytes, and 8 more for each number or flag and 64 for each other column.
    """
    plain = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp")
    width = 40 + sum(8 if kind in plain else 64 for _, kind in table.dtypes)
    return F.broadcast(table) if table.count() * width <= most_bytes else table
