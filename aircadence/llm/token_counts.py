"""Token counts of documents in flat token files that have no index.

A flat file is ids of a fixed width, one document after the other, each closed
by the end-of-document id.  Files are cut into blocks without regard to
documents.  Each task searches its blocks for the end id with one vectorised
comparison and reports the positions; a prefix scan over the blocks of a file
(last end before the block, ends before the block) then closes documents that
blocks cut and numbers them.

No text may give the end id.  It is therefore the greatest number of the id
width, and the writer refuses an end id that the tokenizer has, special tokens
included.

Defined cases: an empty document counts 0 tokens (the end id is not counted);
ids after a file's last end id form one document that is not closed; an empty
file or list of files gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from aircadence.llm.tokens import encoder
from aircadence.workspace import Workspace, file_system

BLOCK_BYTES = 4 << 20
FILE_BYTES = 256 << 20
#: Most documents of a file, which bounds its list of ids.
FILE_DOCS = 1 << 19
END_ID = 65535


def _write(folder: str, tokenizer: str, end_id: int, width: int, limit: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer)
        if not pieces.last_id < end_id < 1 << 8 * width:
            raise ValueError(f"end id {end_id} of {width} bytes: the tokenizer has ids up to {pieces.last_id}")
        encode = pieces.encode
        system, path = file_system(folder)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        part, attempt, sink, size, docs, count = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, [], 0
        schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("docs", pa.list_(pa.int64()))])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sink is None:
                    name = f"{path}/flat-{part:05d}-{count:03d}-{attempt}.bin"
                    sink, size, docs, count = system.open_output_stream(name), 0, [], count + 1
                raw = encode(text.as_py()).astype(f"<u{width}").tobytes() + end
                sink.write(raw)
                size += len(raw)
                docs.append(doc)
                if size >= limit or len(docs) >= most_docs:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "docs": [docs]}, schema)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "docs": [docs]}, schema)

    return run


def write_flat(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write every text to flat files where it lies, without a shuffle.

    Returns the staged list of files ``(file, bytes, docs)``.  Vocabularies of
    65535 ids and more need ``width`` 4 and an ``end_id`` above their last id.
    """
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    files = rows.mapInArrow(_write(folder, tokenizer, end_id, width, FILE_BYTES, file_docs), "file string, bytes bigint, docs array<bigint>")
    where = f"{folder.rstrip('/')}/files"
    files.write.parquet(where)
    return docs.sparkSession.read.schema(files.schema).parquet(where)


def _scan(folder: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["file"]) as handle:
                    handle.seek(row["offset"])
                    ids = np.frombuffer(handle.read(row["size"]), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + row["offset"] // width
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["offset"]]), pa.array([ends], pa.list_(pa.int64()))], ["file", "offset", "ends"])

    return run


def count_tokens(files: DataFrame, folder: str, end_id: int = END_ID, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat files: ``(file, ordinal, start, n_tokens, closed)``.

    ``files`` needs the columns ``file`` and ``bytes``; ``start`` is the
    position of a document's first id in its file.
    """
    block_bytes -= block_bytes % width
    blocks = files.where(F.col("bytes") > 0).select("file", F.col("bytes").alias("whole"), F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(block_bytes))).alias("offset"))
    blocks = blocks.select("file", "offset", F.least(F.lit(block_bytes), F.col("whole") - F.col("offset")).alias("size"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(parts, "file", "offset").mapInArrow(_scan(folder, end_id, width), "file string, offset bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "ends",
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).alias("last"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("ahead"),
    )
    docs = stitched.select("file", "last", "ahead", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.element_at("ends", F.greatest("k", F.lit(1)))) + 1
    closed = docs.select("file", (F.col("ahead") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = closed.groupBy("file").agg((F.max("ordinal") + 1).alias("ordinal"), F.max(F.col("start") + F.col("n_tokens") + 1).alias("start"))
    tails = files.select("file", (F.col("bytes") / width).cast("bigint").alias("ids")).join(tails, "file", "left").withColumn("start", F.coalesce("start", F.lit(0)))
    tails = tails.where("start < ids").select("file", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def corpus_token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Write all texts as flat files, scan them, and name the documents.

    Returns ``(id_col, n_tokens)``, a row for each row of ``docs``.
    """
    work = Workspace(docs.sparkSession, "token-counts")
    folder = work.path("flat")
    files = write_flat(docs, folder, tokenizer, id_col, text_col, end_id, width)
    counts = work.stage(count_tokens(files, folder, end_id, width), "counts")
    names = files.select("file", F.posexplode("docs").alias("ordinal", "id"))
    return names.join(counts.select("file", "ordinal", "n_tokens"), ["file", "ordinal"], "left").select(F.col("id").alias(id_col), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
