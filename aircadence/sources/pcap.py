"""Capture files as rows of the frame schema: the ``pcap`` data source.

Reads pcap (both byte orders, micro- and nanoseconds) and pcapng files (enhanced,
simple and obsolete packet blocks) with radiotap or bare 802.11 frames, record by
record.  A capture that was cut off in its last record ends there; a length that
no record can have is an error, as the rest of the file cannot be read.

* ``spark.read.format("pcap").load(path)`` takes a file, a glob or a folder with
  all below it.  ``source_file`` is the path below the folder, so files of one name
  in different folders stay apart.
* A schema given to the reader prunes: only its columns are decoded.
* Filters on columns are pushed into the scan: times and lengths are tested on the
  record header, types and flags on the first bytes of the frame, addresses on the
  MAC header, and a row is only built for what passes.  A filter on
  ``source_file`` leaves out whole files.
* One file is one task, unless the option ``index`` names an index of
  :mod:`aircadence.sources.capture_index`, which cuts large files.
* ``spark.readStream.format("pcap")`` follows growing files: a record counts once
  its last byte is there, and the log keeps for each file the place of the next one.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyarrow import fs, parquet
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from aircadence.schema import FRAME_SCHEMA, SUBTYPE_NAMES
from aircadence.workspace import file_system

LINK_80211, LINK_RADIOTAP = 105, 127
#: Fixed values of the radiotap header: size and alignment of fields by bit.
_RADIOTAP = {0: (8, 8), 1: (1, 1), 2: (1, 1), 3: (4, 2), 4: (2, 2), 5: (1, 1), 6: (1, 1), 7: (2, 2), 8: (2, 2), 9: (2, 2), 10: (1, 1), 11: (1, 1), 12: (1, 1), 13: (1, 1), 14: (2, 2), 15: (2, 2), 16: (1, 1), 17: (1, 1), 18: (8, 4), 19: (3, 1)}
_MAX_RECORD = 1 << 24


def radiotap(data: bytes) -> tuple[int, dict]:
    """Header length and the fields that frames use."""
    if len(data) < 8:
        return len(data), {}
    _, _, length, present = struct.unpack_from("<BBHI", data)
    at, word = 8, present
    while word >> 31 and at + 4 <= min(length, len(data)):
        word = struct.unpack_from("<I", data, at)[0]
        at += 4
    out: dict = {}
    for bit in range(20):
        if not present >> bit & 1:
            continue
        size, align = _RADIOTAP[bit]
        at += -at % align
        if at + size > min(length, len(data)):
            break
        if bit == 2:
            out["data_rate"] = data[at] / 2
        elif bit == 3:
            out["channel_freq"] = struct.unpack_from("<H", data, at)[0]
        elif bit == 5:
            out["rssi"] = float(struct.unpack_from("b", data, at)[0])
        elif bit == 6:
            out["ant_noise"] = struct.unpack_from("b", data, at)[0]
        elif bit == 12:
            out["ant_signal"] = data[at]
        elif bit == 19 and data[at] & 2:
            out["mcs_index"] = data[at + 2]
        at += size
    if "rssi" not in out and "ant_signal" in out:
        out["rssi"] = float(out["ant_signal"])
    return length, out


def _mac(data: bytes) -> str:
    return data.hex(":")


def control_bits(data: bytes) -> dict:
    """Type, subtype and flags of the first two bytes."""
    control = struct.unpack_from("<H", data)[0]
    kind = control >> 2 & 3
    return {"frame_type": kind, "frame_subtype": kind << 4 | control >> 4 & 15, "to_ds": control >> 8 & 1, "from_ds": control >> 9 & 1, "retry": control >> 11 & 1, "protected": control >> 14 & 1}


def mac_header(data: bytes) -> dict:
    """Fields of an 802.11 header; a short one gives what it has."""
    if len(data) < 10:
        return {}
    out = control_bits(data)
    kind, subtype, to_ds, from_ds = out["frame_type"], out["frame_subtype"] & 15, out["to_ds"], out["from_ds"]
    out |= {"duration": struct.unpack_from("<H", data, 2)[0], "ra": _mac(data[4:10]), "raw_frame_type_str": SUBTYPE_NAMES.get(out["frame_subtype"], "Unknown")}
    if len(data) >= 16 and not (kind == 1 and subtype in (12, 13)):
        out["ta"] = _mac(data[10:16])
    if kind == 1 or len(data) < 24:
        return out
    one, two, three = (_mac(data[k: k + 6]) for k in (4, 10, 16))
    out["seq_num"] = struct.unpack_from("<H", data, 22)[0] >> 4
    four = _mac(data[24:30]) if to_ds and from_ds and len(data) >= 30 else None
    out["da"] = three if to_ds else one
    out["sa"] = four if to_ds and from_ds else three if from_ds else two
    if not (to_ds and from_ds):
        out["bssid"] = one if to_ds else two if from_ds else three
    at = 30 if to_ds and from_ds else 24
    if kind == 2 and subtype & 8 and len(data) >= at + 2:
        out["qos_priority"] = data[at] & 7
    return out


class Bytes:
    """Buffered reading of an open file from a place on."""

    def __init__(self, handle, at: int = 0, piece: int = 1 << 20):
        self.handle, self.piece, self.at = handle, piece, at
        self._held, self._from = b"", 0
        if at:
            handle.seek(at)

    def read(self, n: int) -> bytes:
        while len(self._held) - self._from < n:
            more = self.handle.read(max(self.piece, n))
            if not more:
                break
            self._held, self._from = self._held[self._from:] + bytes(more), 0
        out = self._held[self._from: self._from + n]
        self._from += len(out)
        self.at += len(out)
        return out

    def exactly(self, n: int) -> bytes | None:
        """The next n bytes, or None at or inside the end of the file."""
        out = self.read(n)
        return out if len(out) == n else None


def byte_order(mark: bytes) -> str:
    """Of a pcapng section, by its mark."""
    return "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"


@dataclass
class Section:
    """What the records of a file need from what stands before them."""

    blocks: bool  #: pcapng
    order: str = "<"
    unit: float = 1e-6
    link: int = 0
    links: list[int] = field(default_factory=list)
    units: list[float] = field(default_factory=list)
    limits: list[int] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Section:
        return cls(**json.loads(text))

    def describe(self, body: bytes) -> None:
        """Take the interface of a block."""
        unit, at = 1e-6, 8
        while at + 4 <= len(body) - 4:
            code, n = struct.unpack_from(self.order + "HH", body, at)
            if code == 9 and n == 1:
                r = body[at + 4]
                unit = 2.0 ** -(r & 127) if r & 128 else 10.0 ** -r
            if code == 0:
                break
            at += 4 + n + -n % 4
        self.links.append(struct.unpack_from(self.order + "H", body)[0])
        self.limits.append(struct.unpack_from(self.order + "I", body, 4)[0])
        self.units.append(unit)

    def begin(self, mark: bytes) -> None:
        """A section header: another byte order, no interfaces yet."""
        self.order = byte_order(mark)
        self.links, self.units, self.limits = [], [], []


SECTION = b"\x0a\x0d\x0d\x0a"
_MAGICS = (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")


def opened(data: Bytes, name: str) -> tuple[Section, int] | None:
    """The section at the start of a file and the place of its first record; None for an empty or cut head."""
    magic = data.exactly(4)
    if magic is None:
        return None
    if magic == SECTION:
        return Section(True), 0
    if magic not in _MAGICS:
        raise ValueError(f"{name} is no capture file")
    order = "<" if magic[0] in (0xD4, 0x4D) else ">"
    head = data.exactly(20)
    if head is None:
        return None
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    return Section(False, order, 1e-9 if nano else 1e-6, struct.unpack_from(order + "I", head, 16)[0] & 0xFFFF), 24


def _pcap(data: Bytes, section: Section, stop: int) -> Iterator[tuple[float, int, int, bytes]]:
    unpack = struct.Struct(section.order + "IIII").unpack
    while data.at < stop and (record := data.exactly(16)) is not None:
        seconds, part, held, length = unpack(record)
        if held > _MAX_RECORD:
            raise ValueError(f"a record of {held} bytes")
        if (body := data.exactly(held)) is None:
            return
        yield seconds + part * section.unit, length, section.link, body


def _pcapng(data: Bytes, section: Section, stop: int) -> Iterator[tuple[float, int, int, bytes] | None]:
    while data.at < stop and (head := data.exactly(8)) is not None:
        skip = 8
        order, mark = section.order, None
        if head[:4] == SECTION:
            if (mark := data.exactly(4)) is None:
                return
            order, skip = byte_order(mark), 12
        kind, total = struct.unpack(order + "II", head)
        if not skip + 4 <= total <= _MAX_RECORD:
            raise ValueError(f"a block of {total} bytes")
        body = data.exactly(total - skip)
        if body is None:
            return
        if mark is not None:
            section.begin(mark)
        elif kind == 1 and len(body) >= 12:
            section.describe(body)
        elif kind in (2, 6) and len(body) >= 24:
            face, high, low, held, length = struct.unpack_from(order + ("IIIII" if kind == 6 else "HxxIIII"), body)
            if face < len(section.links):
                yield (high << 32 | low) * section.units[face], length, section.links[face], body[20: 20 + held]
                continue
        elif kind == 3 and len(body) >= 8 and section.links:
            # A simple block has no time, and its data may be padded.
            length = struct.unpack_from(order + "I", body)[0]
            yield 0.0, length, section.links[0], body[4: 4 + min(length, section.limits[0] or length, len(body) - 8)]
            continue
        yield None


def steps(data: Bytes, section: Section, stop: int = 1 << 62) -> Iterator[tuple[float, int, int, bytes] | None]:
    """Whole records and blocks that begin before ``stop``: ``(time, length, link, data)`` of a packet, None for
    others.  After each, ``data.at`` is its end and ``section`` holds up to there."""
    return _pcapng(data, section, stop) if section.blocks else _pcap(data, section, stop)


def records(data: Bytes, section: Section, stop: int = 1 << 62) -> Iterator[tuple[float, int, int, bytes]]:
    return (x for x in steps(data, section, stop) if x is not None)


_RADIO = {"rssi", "ant_signal", "ant_noise", "data_rate", "channel_freq", "mcs_index"}
_CONTROL = {"frame_type", "frame_subtype", "to_ds", "from_ds", "retry", "protected"}
_ADDRESS = {"sa", "da", "ta", "ra", "bssid"}
_RECORD = {"timestamp", "frame_len", "frame_no", "source_file"}


def _compiled(one: D.Filter) -> tuple[str, Callable[[object], bool]] | None:
    """Column and test of a pushed filter, false for unknown; None if the scan does not know it."""
    if isinstance(one, D.Not):
        inner = _compiled(one.child)
        if inner is None or isinstance(one.child, (D.Not, D.IsNull, D.IsNotNull, D.EqualNullSafe)):
            return None
        return inner[0], lambda x, t=inner[1]: x is not None and not t(x)
    name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
    if name not in _RECORD | _CONTROL | _ADDRESS:
        return None
    v = getattr(one, "value", None)
    tests = {
        D.EqualTo: lambda x: x is not None and x == v, D.GreaterThan: lambda x: x is not None and x > v, D.GreaterThanOrEqual: lambda x: x is not None and x >= v,
        D.LessThan: lambda x: x is not None and x < v, D.LessThanOrEqual: lambda x: x is not None and x <= v, D.In: lambda x: x is not None and x in v,
        D.IsNull: lambda x: x is None, D.IsNotNull: lambda x: x is not None, D.EqualNullSafe: lambda x: x == v,
        D.StringStartsWith: lambda x: x is not None and x.startswith(v), D.StringEndsWith: lambda x: x is not None and x.endswith(v), D.StringContains: lambda x: x is not None and v in x,
    }
    return (name, tests[type(one)]) if type(one) in tests else None


class Decoder:
    """Rows of some columns from packets, under some filters."""

    def __init__(self, names: list[str], filters: list[tuple[str, Callable]] = ()):
        self.names = names
        used = set(names)
        self.radio = bool(used & _RADIO)
        self.stages = [[f for f in filters if f[0] in group] for group in (_RECORD - {"source_file"}, _CONTROL, _ADDRESS)]
        self.address = bool(self.stages[2])
        self.mac = bool(used - _RECORD - _RADIO - {"event_time"})
        self.when = "event_time" in used

    def frames(self, packets: Iterator[tuple[float, int, int, bytes]], name: str, first: int = 0) -> Iterator[dict]:
        early, control, address = self.stages
        for number, (when, length, link, data) in enumerate(packets, first):
            frame = {"source_file": name, "frame_no": number, "timestamp": when, "frame_len": length}
            if early and not all(test(frame[c]) for c, test in early):
                continue
            known = link in (LINK_RADIOTAP, LINK_80211)
            skip = 0
            if link == LINK_RADIOTAP:
                skip = struct.unpack_from("<H", data, 2)[0] if len(data) >= 8 else len(data)
            if control:
                own = {"retry": 0, "protected": 0} | (control_bits(data[skip: skip + 2]) if known and len(data) >= skip + 10 else {})
                if not all(test(own.get(c)) for c, test in control):
                    continue
            frame["retry"] = frame["protected"] = 0
            if self.mac or address:
                frame |= mac_header(data[skip:]) if known else {}
                if address and not all(test(frame.get(c)) for c, test in address):
                    continue
            if self.radio and link == LINK_RADIOTAP:
                frame |= radiotap(data)[1]
            yield frame

    def rows(self, frames: Iterator[dict]) -> Iterator[tuple]:
        import datetime

        for frame in frames:
            if self.when:
                frame["event_time"] = datetime.datetime.fromtimestamp(frame["timestamp"], datetime.UTC)
            yield tuple(map(frame.get, self.names))


def read_frames(stream, name: str) -> Iterator[dict]:
    """Frames of an open capture file; a file that breaks off ends there.

    Raises ValueError for a file of another kind or with impossible lengths.
    """
    data = Bytes(stream)
    found = opened(data, name)
    if found is None:
        return
    section, at = found
    # pcapng sections are read from their first byte.
    data = Bytes(_Again(SECTION, data) if section.blocks else data)
    data.at = at
    yield from Decoder(FRAME_SCHEMA.fieldNames()).frames(records(data, section), name)


class _Again:
    """A stream that gives some bytes back first."""

    def __init__(self, first: bytes, rest: Bytes):
        self.first, self.rest = first, rest

    def read(self, n: int) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.rest.read(n)


def captures(path: str) -> list[tuple[str, str, int]]:
    """``(path, name, bytes)`` of the captures of a file, glob or folder; the name is the path below what was given."""
    system, where = file_system(path)
    if isinstance(system, fs.LocalFileSystem) and glob.has_magic(where):
        found = [f for f in glob.glob(where, recursive=True) if os.path.isfile(f)]
        base = os.path.commonpath([os.path.dirname(f) for f in found]) if found else where
    elif (info := system.get_file_info(where)).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.path.endswith((".pcap", ".pcapng")) and f.type == fs.FileType.File]
        base = where
    else:
        found, base = [where], os.path.dirname(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    if not found:
        raise FileNotFoundError(path)
    return [(f.path, os.path.relpath(f.path, base or "."), f.size) for f in system.get_file_info(sorted(found))]


@dataclass
class _Part(InputPartition):
    """Records of a file that begin in a range."""

    path: str
    name: str
    start: int = 0
    stop: int = 1 << 62
    first: int = 0  #: number of the first frame
    section: str | None = None  #: of the start; None at the start of the file


class _Reader(DataSourceReader):
    def __init__(self, path: str, index: str | None, names: list[str]):
        self.path, self.index, self.names = path, index, names
        self.filters: list[tuple[str, Callable]] = []

    def pushFilters(self, filters: list[D.Filter]):
        for one in filters:
            test = _compiled(one)
            if test is None:
                yield one
            else:
                self.filters.append(test)

    def partitions(self) -> list[InputPartition]:
        tests = [t for c, t in self.filters if c == "source_file"]
        if self.index:
            system, where = file_system(self.index)
            table = parquet.read_table(where, filesystem=system).to_pylist()
            parts = [_Part(r["path"], r["name"], r["start"], r["stop"], r["first"], r["section"]) for r in table if r["start"] < r["stop"]]
        else:
            parts = [_Part(path, name) for path, name, _ in captures(self.path)]
        return [p for p in parts if all(t(p.name) for t in tests)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        decoder = Decoder(self.names, self.filters)
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as handle:
            if partition.section is None:
                found = opened(Bytes(handle), partition.name)
                if found is None:
                    return
                section, at = found
                handle.seek(0)
            else:
                section, at = Section.of(partition.section), partition.start
            yield from decoder.rows(decoder.frames(records(Bytes(handle, at), section, partition.stop), partition.name, partition.first))


class _StreamReader(DataSourceStreamReader):
    """Follows growing captures.

    An offset has, for each file, the place after its last whole record, the
    number of frames before it and what its section has said.
    """

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _advanced(self, path: str, name: str, size: int, state: dict | None) -> dict | None:
        """The state of a file of now ``size`` bytes."""
        if state and size < state["at"]:
            raise ValueError(f"{name} has shrunk below what was read")
        if state and size == state["at"]:
            return state
        system, _ = file_system(self.path)
        with system.open_input_file(path) as handle:
            if state is None:
                found = opened(Bytes(handle), name)
                if found is None:
                    return None
                section, at, first = *found, 0
                handle.seek(0)
            else:
                section, at, first = Section.of(state["section"]), state["at"], state["frames"]
            data = Bytes(handle, at)
            for packet in steps(data, section):
                at, first = data.at, first + (packet is not None)
            # What stands after the last whole record waits.
            return {"at": at, "frames": first, "section": section.text(), "name": name}

    def latestOffset(self) -> dict:
        try:
            found = captures(self.path)
        except FileNotFoundError:
            found = []
        for path, name, size in found:
            state = self._advanced(path, name, size, self.known.get(path))
            if state:
                self.known[path] = state
        return {"files": {p: dict(s) for p, s in sorted(self.known.items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for path, state in end["files"].items():
            before = start["files"].get(path)
            self.known.setdefault(path, state)
            if before is None:
                parts.append(_Part(path, state["name"], 0, state["at"]))
            elif before["at"] < state["at"]:
                parts.append(_Part(path, state["name"], before["at"], state["at"], before["frames"], before["section"]))
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _Reader(self.path, None, self.names).read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class PcapSource(DataSource):
    """``format("pcap")``, for reading and for streams."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> StructType:
        return FRAME_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("index"), schema.fieldNames())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the format known; filters are only pushed if the session allows it for sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PcapSource)
