"""Indexes of captures, by which large files are read in many tasks.

Records have no marks to start from, and a capture can hold other captures in its
payload.  So every range of a file is walked from each place in it that looks like
a record, as long as what follows looks like records too.  It reports these chains:
where each begins, where it leaves the range, and how many frames it has.  Chains of
different starts soon meet, so there are few.  Only then, file by file, the true
chain is put together from the start of the file: each range begins where the one
before it was left.  A range that has no chain from there (its records look unlike
any, or one is longer than the search) is walked from that very place, so the result
is that of reading in one piece, whatever a file holds.

The index is a small table, ``(path, name, start, stop, first, section)``: where the
records of a range begin, the number of its first frame, and what the section has
said before.  It serves as the option ``index`` of the ``pcap`` format.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aircadence.sources.pcap import _MAX_RECORD, SECTION, Bytes, Section, byte_order, captures, opened, register, steps
from aircadence.workspace import Workspace, file_system

SPLIT_BYTES = 64 << 20
#: Bytes at the start of a range in which records may begin.
SEARCH = 1 << 18
#: A record's time may be so far from the file's first one.
_NEAR = 10 * 366 * 86400
_END = 1 << 62
#: Chains of one range; a start that is not among them is walked when it turns out to be the true one.
MOST_CHAINS = 32
#: First places of a chain at which another one may turn out to join it.
MARKS = 64
_BLOCKS = (1, 2, 3, 4, 5, 6)


def _words(data: bytes, order: str, shift: int) -> np.ndarray:
    """32-bit numbers at every fourth byte from ``shift`` on."""
    data = data[shift:]
    return np.frombuffer(data, order + "u4", len(data) // 4).astype(np.int64)


def _record_starts(data: bytes, section: Section, near: int) -> list[int]:
    """Places of the search range that look like the head of a pcap record."""
    found = []
    for shift in range(4):
        w = _words(data[: SEARCH + 16], section.order, shift)
        if len(w) < 4:
            continue
        seconds, part, held, length = w[:-3], w[1:-2], w[2:-1], w[3:]
        good = (np.abs(seconds - near) <= _NEAR) & (part * section.unit < 1) & (held <= length) & (length <= _MAX_RECORD) & (length > 0)
        found += (np.flatnonzero(good) * 4 + shift).tolist()
    return sorted(found)


def _block_starts(data: bytes, section: Section) -> list[int]:
    """The same for pcapng blocks, whose lengths are multiples of four."""
    w = _words(data[: SEARCH + 8], section.order, 0)
    kind, total = w[:-1], w[1:]
    known = np.isin(kind, (*_BLOCKS, int.from_bytes(SECTION, "little")))
    return (np.flatnonzero(known & (total % 4 == 0) & (total >= 12) & (total <= _MAX_RECORD)) * 4).tolist()


class _Chain:
    """What a walk over a range has found."""

    def __init__(self, entry: int, order: str):
        self.entry, self.at = entry, entry
        self.places: list[int] = []
        self.marks: list[dict] = []
        self.frames = 0
        #: Frames that need so many interfaces from before the range.
        self.need: Counter = Counter()
        #: Interfaces and sections of the range itself.
        self.section, self.fresh = Section(True, order), False

    def meets(self, seen: dict[int, bool]) -> bool:
        """Whether a walk is over: it begins where an earlier one came by, or runs into one that failed."""
        return self.at in seen and (self.at == self.entry or not seen[self.at])

    def mark(self) -> None:
        """Note the place, and what the chain has up to there as long as no interface came by."""
        self.places.append(self.at)
        if len(self.marks) < MARKS and not self.fresh and not self.section.links:
            self.marks.append({"at": self.at, "frames": self.frames, "need": [{"links": n, "frames": k} for n, k in self.need.items()]})

    def row(self) -> dict:
        return {"marks": self.marks, "exit": self.at, "frames": self.frames, "need": [{"links": n, "frames": k} for n, k in sorted(self.need.items())], "fresh": self.fresh, "section": self.section.text()}


def _walk_records(chain: _Chain, data: bytes, base: int, stop: int, size: int, section: Section, near: int, seen: dict[int, bool]) -> _Chain | None:
    unpack = struct.Struct(section.order + "IIII").unpack_from
    while chain.at < stop:
        if chain.meets(seen):
            return None
        if chain.at + 16 > size:
            chain.at = _END
            break
        seconds, part, held, length = unpack(data, chain.at - base)
        if held > length or length > _MAX_RECORD or part * section.unit >= 1 or abs(seconds - near) > _NEAR:
            return None
        chain.mark()
        if chain.at + 16 + held > size:
            chain.at = _END
            break
        chain.at += 16 + held
        chain.frames += 1
    return chain


def _walk_blocks(chain: _Chain, data: bytes, base: int, stop: int, size: int, seen: dict[int, bool]) -> _Chain | None:
    while chain.at < stop:
        if chain.meets(seen):
            return None
        here = chain.at - base
        if chain.at + 12 > size:
            chain.at = _END
            break
        mark = data[here + 8: here + 12] if data[here: here + 4] == SECTION else None
        order = byte_order(mark) if mark else chain.section.order
        kind, total = struct.unpack_from(order + "II", data, here)
        if total % 4 or not 12 <= total <= _MAX_RECORD or not (mark or kind in _BLOCKS):
            return None
        chain.mark()
        if chain.at + total > size:
            chain.at = _END
            break
        body = data[here + 8: here + total - 4]
        if here + total <= len(data) and data[here + total - 4: here + total] != data[here + 4: here + 8]:
            return None
        if mark:
            chain.section.begin(mark)
            chain.fresh = True
        elif kind == 1 and total >= 20:
            if here + total > len(data):
                return None
            chain.section.describe(body + bytes(4))
        elif kind in (2, 6) and total >= 32 or kind == 3 and total >= 16:
            face = 0 if kind == 3 else struct.unpack_from(order + ("I" if kind == 6 else "H"), body)[0]
            missing = face + 1 - len(chain.section.links)
            if missing <= 0:
                chain.frames += 1
            elif not chain.fresh:
                chain.need[missing] += 1
        chain.at += total
    return chain


def chains(handle, name: str, start: int, stop: int, size: int) -> list[dict]:
    """Chains of records of a range, from every place at its start that looks like one."""
    head = opened(Bytes(handle, piece=64), name)
    if head is None:
        return []
    section, at = head
    # The end of a block's body may stand after the range.
    handle.seek(start)
    data = bytes(handle.read(min(size, stop + 64) - start))
    if section.blocks:
        handle.seek(0)
        section.order = byte_order(bytes(handle.read(12))[8:])
        places = [at] if start == 0 else _block_starts(data, section)
        walk = lambda chain: _walk_blocks(chain, data, start, stop, size, seen)
    else:
        handle.seek(at)
        first = bytes(handle.read(4))
        near = struct.unpack(section.order + "I", first)[0] if len(first) == 4 else 0
        places = [at] if start == 0 else _record_starts(data, section, near)
        walk = lambda chain: _walk_records(chain, data, start, stop, size, section, near, seen)
    out: list[_Chain] = []
    #: Whether the chain that came by a place held to the end of the range.
    seen: dict[int, bool] = {}
    for place in places:
        if start + place >= stop:
            break
        chain = _Chain(start + place, section.order)
        held = walk(chain) is not None
        for at in chain.places:
            seen[at] = held or seen.get(at, False)
        if held:
            out.append(chain)
            if len(out) == MOST_CHAINS:
                break
    return [c.row() for c in out]


_CHAINS = "array<struct<marks: array<struct<at: bigint, frames: bigint, need: array<struct<links: bigint, frames: bigint>>>>, exit: bigint, frames: bigint, need: array<struct<links: bigint, frames: bigint>>, fresh: boolean, section: string>>"
_FOUND = f"path string, name string, start bigint, stop bigint, chains {_CHAINS}"
_INDEX = "path string, name string, start bigint, stop bigint, first bigint, section string"
_NEED_ARROW = pa.list_(pa.struct([("links", pa.int64()), ("frames", pa.int64())]))
_CHAIN_ARROW = pa.list_(pa.struct([("marks", pa.list_(pa.struct([("at", pa.int64()), ("frames", pa.int64()), ("need", _NEED_ARROW)]))), ("exit", pa.int64()), ("frames", pa.int64()), ("need", _NEED_ARROW), ("fresh", pa.bool_()), ("section", pa.string())]))
_INDEX_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()), ("section", pa.string())])


def _searched(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(root)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["path"]) as handle:
                    found = chains(handle, r["name"], r["start"], r["stop"], r["size"])
                yield pa.RecordBatch.from_arrays([pa.array([r[c]]) for c in ("path", "name", "start", "stop")] + [pa.array([found], _CHAIN_ARROW)], ["path", "name", "start", "stop", "chains"])

    return run


def compose(handle, name: str, ranges: list[dict]) -> Iterator[tuple[int, int, int, str]]:
    """``(start, stop, first, section)`` of each range of a file that holds the start of a record."""
    head = opened(Bytes(handle, piece=64), name)
    if head is None:
        return
    section, at = head
    frames = 0
    for r in ranges:
        if at >= r["stop"]:
            continue
        yield at, r["stop"], frames, section.text()
        chain, mark = next(((c, m) for c in r["chains"] for m in c["marks"] if m["at"] == at), (None, None))
        if chain is None:
            data = Bytes(handle, at)
            handle.seek(at)
            last = at
            try:
                for packet in steps(data, section, r["stop"]):
                    last, frames = data.at, frames + (packet is not None)
            except ValueError:  # whoever reads this range meets it again
                return
            if last < r["stop"]:
                return
            at = last
            continue
        # Without what the chain had before it came here.
        frames += chain["frames"] - mark["frames"] + sum(sign * n["frames"] for of, sign in ((chain, 1), (mark, -1)) for n in of["need"] if n["links"] <= len(section.links))
        if section.blocks:
            own = Section.of(chain["section"])
            if chain["fresh"]:
                section = own
            else:
                section.links, section.units, section.limits = section.links + own.links, section.units + own.units, section.limits + own.limits
        at = chain["exit"]


def _composed(root: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ranges = table.sort_by("start").to_pylist()
        system, _ = file_system(root)
        with system.open_input_file(key[0].as_py()) as handle:
            rows = [(key[0].as_py(), ranges[0]["name"], *row) for row in compose(handle, ranges[0]["name"], ranges)]
        return pa.Table.from_pylist([dict(zip(_INDEX_ARROW.names, r, strict=True)) for r in rows], _INDEX_ARROW)

    return run


def index_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Write an index of the captures of a file, glob or folder; returns where it is.

    A task of the search holds one range in memory; one of the composition has the
    few chains of each range of a file, not its bytes.
    """
    work = Workspace(spark, "captures")
    files = spark.createDataFrame(captures(path), "path string, name string, size bigint").where("size > 0")
    ranges = files.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start")).withColumn("stop", F.least(F.col("start") + split_bytes, F.col("size")))
    tasks = max(1, sum(-(-size // split_bytes) for _, _, size in captures(path)))
    found = work.stage(ranges.repartition(min(tasks, 100_000), "path", "start").mapInArrow(_searched(path), _FOUND), "chains")
    where = work.path("index")
    found.groupBy("path").applyInArrow(_composed(path), _INDEX).write.parquet(where)
    work.drop(found)
    return where


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of all captures; files of more than ``split_bytes`` are read by an index, in many tasks."""
    register(spark)
    reader = spark.read.format("pcap")
    if any(size > split_bytes for _, _, size in captures(path)):
        reader = reader.option("index", index_captures(spark, path, split_bytes))
    return reader.load(path)
