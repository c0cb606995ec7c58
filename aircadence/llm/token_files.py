"""Token files with Simple-8b blocks, written and read by Spark tasks.

A shard file holds the ids of consecutive documents, each closed by an end id:

* header: ``S8BT`` and the version, as two little-endian 32-bit words;
* blocks: up to ``BLOCK_IDS`` ids each, as 64-bit words.  The low 4 bits of a
  word select a layout, the other 60 hold its ids, the first in the lowest
  bits.  An id of 60 bits or more is an escape: selector 15, then the id in a
  word of its own;
* block table: for each block its byte offset, word count and id count;
* document table: the id count of each document;
* footer: offsets of both tables, counts of blocks, documents and ids.

Encoding and decoding are vectorised: an array of blocks is encoded in step,
one word of every block at a time, and a block is decoded selector by selector.

Tasks write under a name of their own attempt and report it; readers use only
reported files, so a repeated or lost attempt leaves nothing that is read.
Files go to the session's shared folder through ``pyarrow.fs``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from aircadence.llm import textkernel as tk
from aircadence.llm.tokens import encoder
from aircadence.workspace import Workspace, file_system

BLOCK_IDS = 4096
#: Most documents of a shard, which bounds the lists of ids and lengths however short they are.
SHARD_DOCS = 1 << 19
#: (ids in a word, bits of each) by selector, fixed by the format.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_MAGIC = b"S8BT" + struct.pack("<I", 1)
_FOOTER = struct.Struct("<QQQQQ")


_SHORT_BITS = np.array([k.bit_length() for k in range(1 << 16)], dtype=np.uint8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < len(_SHORT_BITS):
        return _SHORT_BITS[ids]
    bits = np.zeros(len(ids), dtype=np.uint8)
    for k in range(int(ids.max()).bit_length() if len(ids) else 0):
        bits += (ids >> np.uint64(k)) > 0
    return bits


def _choices(ids: np.ndarray) -> np.ndarray:
    """For each position the selector with the most ids that fit from there."""
    bits = np.maximum(_bit_lengths(ids), 1)
    n = len(bits)
    best = np.full(n, ESCAPE, dtype=np.uint8)
    span, widest = 1, bits
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[selector]
        if count > n:
            break
        while span < count:
            step = min(span, count - span)
            widest = np.maximum(widest[: n - span - step + 1], widest[step: step + n - span - step + 1])
            span += step
        np.copyto(best[: len(widest)], selector, where=widest <= width)
    return best


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encode ids as blocks: all words, and the word count of each block."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    begins = np.arange(0, n, BLOCK_IDS)
    stops = np.minimum(begins + BLOCK_IDS, n)
    choice = _choices(ids)
    counts = np.array([c for c, _ in SELECTORS] + [0, 1])
    # A choice may not cross its block's end: near the end, take a smaller one that fits.
    tail = (stops[:, None] - np.arange(1, SELECTORS[0][0])).ravel()
    tail = tail[tail >= np.repeat(begins, SELECTORS[0][0] - 1)]
    room, held = stops[tail // BLOCK_IDS] - tail, choice[tail]
    for selector, (count, _) in enumerate(SELECTORS[:-1]):
        held[(held == selector) & (room < count)] = selector + 1
    held[(held == len(SELECTORS) - 1) & (ids[tail] >> np.uint64(60) > 0)] = ESCAPE
    choice[tail] = held
    # Follow the choices of all blocks in step to find where words begin.
    taken = counts[choice]
    is_word = np.zeros(n, dtype=bool)
    at = begins.copy()
    while len(at):
        is_word[at] = True
        at = at + taken[at]
        live = at < stops[: len(at)] if len(at) == len(stops) else at < ends
        ends = (stops if len(live) == len(stops) else ends)[live]
        at = at[live]
    heads = np.flatnonzero(is_word)
    chosen = choice[heads]
    slots = 1 + (chosen == ESCAPE)
    where = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), dtype=np.uint64)
    for selector, (count, width) in enumerate(SELECTORS):
        mine = chosen == selector
        if mine.any():
            start = heads[mine]
            value = np.full(len(start), selector, dtype=np.uint64)
            for k in range(count):
                value |= ids[start + k] << np.uint64(4 + k * width)
            words[where[mine]] = value
    escaped = chosen == ESCAPE
    words[where[escaped]] = ESCAPE
    words[where[escaped] + 1] = ids[heads[escaped]]
    per_block = np.bincount(heads // BLOCK_IDS, weights=slots, minlength=len(begins)).astype(np.int64)
    return words.astype("<u8"), per_block


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, in order."""
    words = words.astype(np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    marks = np.flatnonzero(selector == ESCAPE)
    if len(marks):
        # A raw word may look like an escape: in a run of marks, every other one is raw.
        last = -1
        for m in marks.tolist():
            if m != last:
                raw[m + 1] = True
                last = m + 1
    counts = np.array([c for c, _ in SELECTORS] + [0, 0])[selector]
    counts[raw] = 1
    where = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << width) - 1)
            for k in range(count):
                out[where[mine] + k] = (words[mine] >> np.uint64(4 + k * width)) & mask
    out[where[raw]] = words[raw]
    return out


class _ShardWriter:
    """Collects documents and writes full blocks as they fill."""

    def __init__(self, path: str, sink):
        self.path, self._sink, self._at = path, sink, len(_MAGIC)
        sink.write(_MAGIC)
        self._open: list[np.ndarray] = []
        self._held = 0
        self._blocks: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.lengths.append(len(ids))
        self.ids += len(ids)
        self._open.append(ids)
        self._held += len(ids)
        if self._held >= 512 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._open) if self._open else np.zeros(0, "<u4")
        cut = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        words, per_block = encode_blocks(ids[:cut])
        sizes = np.minimum(BLOCK_IDS, cut - np.arange(len(per_block)) * BLOCK_IDS)
        offsets = self._at + 8 * (np.cumsum(per_block) - per_block)
        self._blocks.append(np.stack([offsets, per_block, sizes], axis=1).astype("<u8"))
        self._sink.write(words.tobytes())
        self._at += 8 * len(words)
        self._open, self._held = [ids[cut:].copy()], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        blocks = np.concatenate(self._blocks)
        self._sink.write(blocks.tobytes())
        self._sink.write(np.array(self.lengths, "<u8").tobytes())
        self._sink.write(_FOOTER.pack(self._at, self._at + blocks.nbytes, len(blocks), len(self.lengths), self.ids))
        self._sink.close()


def _write(folder: str, tokenizer: str, end_id: int, shard_ids: int, shard_docs: int):
    """Encode the sorted documents of a partition into shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        system, path = file_system(folder)
        part = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        writer, docs, count = None, [], 0

        def report() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [count], "file": [writer.path], "ids": [writer.ids], "docs": [docs]}, pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.list_(pa.int64()))]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    name = f"{path}/shard-{part:05d}-{count:03d}-{attempt}.s8b"
                    writer = _ShardWriter(name, system.open_output_stream(name))
                writer.add(np.append(encode(text.as_py()), np.uint32(end_id)))
                docs.append(doc)
                if writer.ids >= shard_ids or len(docs) >= shard_docs:
                    yield report()
                    writer, docs, count = None, [], count + 1
        if writer is not None:
            yield report()

    return run


def read_shard(handle) -> Iterator[np.ndarray]:
    """The ids of each document of an open shard file, some blocks at a time."""
    size = handle.size()
    handle.seek(size - _FOOTER.size)
    block_at, docs_at, n_blocks, n_docs, n_ids = _FOOTER.unpack(handle.read(_FOOTER.size))
    handle.seek(block_at)
    blocks = np.frombuffer(handle.read(docs_at - block_at), "<u8").reshape(n_blocks, 3).astype(np.int64)
    lengths = np.frombuffer(handle.read(8 * n_docs), "<u8").astype(np.int64)
    ends = np.cumsum(lengths)
    held, held_from, doc = np.zeros(0, np.uint64), 0, 0
    for first in range(0, n_blocks, 512):
        group = blocks[first: first + 512]
        handle.seek(int(group[0, 0]))
        ids = decode_words(np.frombuffer(handle.read(8 * int(group[:, 1].sum())), "<u8"))
        held = np.concatenate([held, ids])
        have = held_from + len(held)
        while doc < n_docs and ends[doc] <= have:
            yield held[ends[doc] - lengths[doc] - held_from: ends[doc] - held_from]
            doc += 1
        done = int(ends[doc - 1]) if doc else 0
        held, held_from = held[done - held_from:], done
    for k in range(doc, n_docs):
        yield np.zeros(0, np.uint64)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["start"], ([], [], [], [])
                with system.open_input_file(row["file"]) as handle:
                    for doc, ids in zip(row["docs"], read_shard(handle), strict=True):
                        for column, value in zip(rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 1 << 24, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Write ``docs`` in ascending id order; returns the staged list of files.

    The list has a row for each shard, ``(part, seq, file, ids, docs)``; order
    by part and seq is document order.
    """
    spark = docs.sparkSession
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    files = ordered.mapInArrow(tk.trimmed(_write(folder, tokenizer, end_id, shard_ids, shard_docs)), "part bigint, seq bigint, file string, ids bigint, docs array<bigint>")
    where = f"{folder.rstrip('/')}/files"
    files.write.parquet(where)
    return spark.read.schema(files.schema).parquet(where)


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: ``(id, start, n_tokens, ids_crc32)``."""
    # One row for each file: the window is over a list that is smaller than the files by many orders.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", "part", "seq", "ids").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "start")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by turns: a hash of the file would be taken for the join's own exchange, which may become one task.
    placed = files.select("file", "docs").join(F.broadcast(starts), "file").repartition(parts)
    return placed.select("file", "start", "docs").mapInArrow(tk.trimmed(_read(folder)), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write all texts as token files and describe them from what is read back.

    Returns ``(id_col, start, n_tokens, ids_crc32)``, a row for each row of
    ``docs``.  A null or empty text has the end id alone; null ids come last;
    rows that repeat an id follow each other in text order; an empty table
    writes nothing.
    """
    folder = Workspace(docs.sparkSession, "tokens").path("shards")
    files = write_tokens(docs, folder, tokenizer, id_col, text_col, end_id)
    return read_tokens(files, folder).withColumnRenamed("id", id_col)
