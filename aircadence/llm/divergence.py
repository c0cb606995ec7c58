"""Divergence of sources: how far the term shares of each (language, source)
group lie from those of every other source of its language, and which terms
stand out in it.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a
language keeps those that at least ``min_docs`` of its documents hold.  Each
group, and each language as a whole, gives every kept term

    p = 1 + floor(10^9 (count + 5) / (N + 5 V)),

in whole numbers.  Method, a systolic rotation:

1. texts are counted where they lie, a group's counts being added up in the
   task before they are sent;
2. the kept terms of a language are dealt by hash to slices of about
   ``SLICE_TERMS`` and numbered inside them, so no row grows with the language;
3. a group's counts in a slice are one compressed row.  The groups of a language
   sit in seats of ``SEAT_GROUPS``.  Seats stay in their partitions, in memory
   or on disk, while the rows of other seats come by: seats meet as in a
   round-robin tournament, one of the two travels, and both directions are
   evaluated at the meeting.  Some rounds make one job, which bounds what is in
   the network at a time;
4. the vector of the whole language visits every seat too, and a heap for each
   group ranks its terms; sums and best terms of the slices are then merged.

A sum of differences needs only the terms that one of the two groups has: all
others add the same value each.

Defined cases: null text, language and source count as empty; a text without
terms counts for no term, but its group occurs; repeated rows count as often as
they stand; equal values rank by the UTF-8 bytes of the item; an empty table
gives no rows.  Totals up to 9 * 10^15 words are exact.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from aircadence.workspace import Workspace, broadcast_if_small

SCALE, ADDED = 1_000_000_000, 5
SLICE_TERMS = 1 << 13
SEAT_GROUPS = 8
ROUNDS_PER_JOB = 8
TOP_TERMS = 50
#: Distinct terms that a task holds before it sends their counts.
HELD_TERMS = 1 << 18

#: A-Z lower-cased, all other ASCII but letters to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group."""
    words: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), counter in words.items():
            n = len(counter)
            if n:
                terms = pa.array(list(counter), pa.binary()).cast(pa.string())
                seen = docs[lang, source]
                columns = [pa.array([lang] * n), pa.array([source] * n), terms, pa.array(list(counter.values()), pa.int64()), pa.array([seen[t] for t in counter], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        words.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = Counter(text.as_buffer().to_pybytes().translate(_LETTERS).split()) if text.is_valid else Counter()
            key = lang, source
            if key not in words:
                words[key], docs[key] = Counter(), Counter()
            before = len(words[key])
            words[key].update(own)
            docs[key].update(own.keys())
            held += len(words[key]) - before
            if held >= HELD_TERMS:
                yield from sent()
                held = 0
    yield from sent()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The p of counts of a group of ``total`` words, in whole numbers."""
    whole = np.int64(total + ADDED * kept)
    if whole == 0:  # no kept term
        return np.zeros(len(counts), np.int64)
    if whole > np.iinfo(np.int64).max // 1000:
        raise ValueError("more words than exact shares can be given for")
    quotient, rest = np.divmod(counts.astype(np.int64) + ADDED, whole)
    for _ in range(3):  # 10^9 in steps of 1000, so that no product overflows
        digits, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Term numbers as gaps, and counts, compressed."""
    order = np.argsort(ids)
    gaps = np.diff(ids[order], prepend=0).astype("<u4")
    return zlib.compress(np.uint32(len(ids)).tobytes() + gaps.tobytes() + counts[order].astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 + 4 * n)


_ROW = "lang string, slice int, seat int, source string, total bigint, kept bigint, terms bigint, vector binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("counts")
        vectors = []
        for k in range(len(batch)):
            own = lists[k].values
            ids, counts = (own.field(0).to_numpy(), own.field(1).to_numpy()) if own is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            vectors.append(_packed(ids, counts))
        columns = [batch.column(c) for c in ("lang", "slice", "seat", "source", "total", "kept", "terms")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary())], ["lang", "slice", "seat", "source", "total", "kept", "terms", "vector"])


class _Group:
    """A group's shares in one slice."""

    def __init__(self, row: dict):
        self.source, self.terms = row["source"], row["terms"]
        self.ids, self.counts = _unpacked(row["vector"])
        self.p = shares(self.counts, row["total"], row["kept"])
        #: What a term gets that the group does not have.
        self.none = int(shares(np.zeros(1, np.int64), row["total"], row["kept"])[0])

    def dense(self) -> np.ndarray:
        out = np.full(self.terms, self.none, np.int64)
        out[self.ids] = self.p
        return out


def _distance(group: _Group, dense: np.ndarray, other: _Group) -> int:
    """Sum of differences over the slice's terms; ``dense`` holds all shares of ``group``."""
    apart = abs(group.none - other.none) * (group.terms - len(group.ids)) + int(np.abs(group.p - other.none).sum())
    at = dense[other.ids]
    return apart + int((np.abs(at - other.p) - np.abs(at - other.none)).sum())


_FOUND = "lang string, source string, part string, item string, value bigint"
_FOUND_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _meet(top: int):
    """All meetings of one seat in one job: its rows, and those that come by."""

    def run(key: tuple, seat: pa.Table, visitors: pa.Table) -> pa.Table:
        lang, own_seat = key[0].as_py(), key[2].as_py()
        own = [_Group(row) for row in seat.to_pylist()]
        dense = [g.dense() for g in own]
        out: list[tuple] = []
        for at in range(len(visitors)):
            row = visitors.slice(at, 1).to_pylist()[0]
            other = _Group(row)
            if row["names"] is not None:  # the whole language
                q, names = other.dense(), row["names"]
                for g in own:
                    over = g.p - q[g.ids]
                    above = np.flatnonzero((over > 0) & (g.counts > 0))
                    # Numbers are in the order of the terms, so they settle ties.
                    best = heapq.nsmallest(top, zip((-over[above]).tolist(), g.ids[above].tolist(), strict=True))
                    out += [("term", g.source, names[i], -value) for value, i in best]
                continue
            inside = row["from_seat"] == own_seat
            for g, p in zip(own, dense, strict=True):
                if inside and g.source >= other.source:  # a seat's own groups meet once
                    continue
                value = _distance(g, p, other)
                out += [("pair", g.source, other.source, value), ("pair", other.source, g.source, value)]
        parts, sources, items, values = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.Table.from_pydict({"lang": [lang] * len(out), "source": list(sources), "part": list(parts), "item": list(items), "value": list(values)}, _FOUND_ARROW)

    return run


def meetings(seats: int) -> list[tuple[int, int, int]]:
    """``(round, host, guest)`` of a tournament in which all seats meet once, no seat twice in a round."""
    n = seats + seats % 2
    out = []
    for i in range(seats):
        for j in range(i + 1, seats):
            out.append((2 * i % (n - 1) if j == n - 1 else (i + j) % (n - 1), *((i, j) if (i + j) % 2 else (j, i))))
    return out


def _guests(packed: DataFrame, first: int, rounds: int) -> DataFrame:
    """Rows that travel in some rounds, each with the seat it goes to: :func:`meetings` as columns."""
    n = F.col("seats") + F.col("seats") % 2
    low, high = F.least("seat", "host"), F.greatest("seat", "host")
    number = F.when(high == n - 1, 2 * low % (n - 1)).otherwise((low + high) % (n - 1))
    travels = F.when((low + high) % 2 == 1, F.col("seat") == high).otherwise(F.col("seat") == low)
    all_hosts = packed.withColumn("host", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    met = all_hosts.where((F.col("host") != F.col("seat")) & travels & (number >= first) & (number < first + rounds))
    if first == 0:
        met = met.unionByName(packed.withColumn("host", F.col("seat")))
    return met.select("lang", "slice", F.col("host").alias("seat"), F.col("seat").alias("from_seat"), "source", "total", "kept", "terms", "vector", F.lit(None).cast("array<string>").alias("names"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = 30, top: int = TOP_TERMS, slice_terms: int = SLICE_TERMS, seat_groups: int = SEAT_GROUPS, rounds_per_job: int = ROUNDS_PER_JOB,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group the other sources
    by distance (part ``pair``) and its ``top`` terms above the language's share (part ``term``)."""
    spark = docs.sparkSession
    work = Workspace(spark, "divergence")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    counts = work.stage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n")
    kept = work.stage(kept, "kept")
    groups = rows.select("lang", "source").distinct()
    seats = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumn("seat", F.floor((F.row_number().over(seats) - 1) / seat_groups).cast("int"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg((F.max("seat") + 1).alias("seats")).join(sizes, "lang", "left").na.fill(0, ["kept", "total"])
    langs = work.stage(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("kept") / slice_terms)).cast("int")), "langs")
    dealt = kept.join(broadcast_if_small(langs.select("lang", "slices")), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    order = Window.partitionBy("lang", "slice").orderBy("term")
    numbered = work.stage(dealt.select("lang", "slice", "term", "n", (F.row_number().over(order) - 1).alias("id")), "terms")
    named = counts.join(numbered.select("lang", "slice", "term", "id"), ["lang", "term"])
    vectors = named.groupBy("lang", "slice", "source").agg(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "n")).alias("counts"), F.sum("n").alias("here"))
    vectors = work.stage(vectors, "vectors")
    whole = numbered.groupBy("lang", "slice").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "n", "term"))).alias("all"))
    in_slice = whole.select("lang", "slice", F.size("all").cast("bigint").alias("terms"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("here").alias("total"))
    of_lang = broadcast_if_small(langs)
    base = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(of_lang.select("lang", "kept", "slices", "seats"), "lang")
    base = base.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    base = base.join(in_slice, ["lang", "slice"], "left").na.fill(0, ["terms"]).join(vectors.drop("here"), ["lang", "slice", "source"], "left")
    packed = base.select("lang", "slice", "seat", "source", "total", "kept", "terms", "counts").mapInArrow(_pack, _ROW)
    packed = work.stage(packed.join(of_lang.select("lang", "seats"), "lang"), "packed")
    # The vector of a language goes to all its seats.
    visitor = whole.join(of_lang, "lang").select(
        "lang", "slice", F.lit(0).alias("seat"), F.lit("").alias("source"), "total", "kept", F.size("all").cast("bigint").alias("terms"),
        F.expr("transform(all, x -> struct(x.id, x.n))").alias("counts"), F.expr("transform(all, x -> x.term)").alias("names"), "seats",
    )
    names = visitor.select("lang", "slice", "names", "seats")
    visitor = visitor.drop("names", "seats").mapInArrow(_pack, _ROW).join(names, ["lang", "slice"])
    visitor = work.stage(visitor, "languages").withColumn("host", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    visitor = visitor.select("lang", "slice", F.col("host").alias("seat"), F.lit(-1).alias("from_seat"), "source", "total", "kept", "terms", "vector", "names")

    place = ["lang", "slice", "seat"]
    resident = packed.drop("seats").repartition(parts, *place).persist(StorageLevel.MEMORY_AND_DISK)
    most = langs.agg(F.max("seats")).first()[0] or 0
    found = []
    for first in range(0, max(1, most + most % 2 - 1), rounds_per_job):
        guests = _guests(packed, first, rounds_per_job)
        guests = guests.unionByName(visitor) if first == 0 else guests
        met = resident.groupBy(*place).cogroup(guests.groupBy(*place)).applyInArrow(_meet(top), _FOUND)
        # What slices have found of the same groups meets in sums.
        found.append(work.stage(met.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), f"round-{first}"))
    resident.unpersist()
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = all_found.withColumn("rank", F.row_number().over(ranks))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
