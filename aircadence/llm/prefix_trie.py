"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is its turns in order; a node of depth d stands for all
conversations that share their first d turns, down from the textless root.

1. a turn is replaced where it lies by 20 bytes: 16 of the SHA-256 of role and
   text, and the number of words.  A conversation is the path of these, and
   text is never sent;
2. equal paths become one row with their number and least conversation, and the
   hash of all their ids, which are joined in parts, so a large group of copies is
   few rows;
3. each task sorts its paths into runs.  Every row of a run carries its LCP, the
   number of turns that it shares with the row before it;
4. splitters from a sample cut the order of all paths into ranges of bounded
   size.  In each range the parts of all runs are merged by a tree of losers that
   keeps, for each run, the LCP with the last winner: the greater LCP wins without
   a look at the turns, equal ones are compared from there on, so shared turns are
   compared once;
5. the merged stream of paths keeps one open path as a stack.  What the next path
   does not share is finished, and is added to its parent;
6. a node can lie in two ranges only if it begins a splitter.  Such nodes, no more
   than the splitters have turns, leave their ranges in parts and are put together
   at the end.

Defined cases: a row without a conversation id belongs to none; null role and
text are empty; turns of one number stand in the order of their digests; a
conversation without turns ends in the root; an empty table has no nodes.  A
path must fit a row: up to 50 million turns in one conversation.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from aircadence.workspace import Workspace, broadcast_if_small

TURN = 20
#: Bytes of paths in one run, and in one range.
RUN_BYTES, RANGE_BYTES = 32 << 20, 16 << 20
#: Sampled paths for each range.
SAMPLED = 20
#: Ids of one part of a list of ids: those that agree but for so many low bits.
PART_BITS = 16


def turn_key(role: Column, text: Column) -> Column:
    """The 20 bytes of a turn, as hexadecimal digits."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(digest, F.lpad(F.lower(F.hex(words.cast("bigint"))), 8, "0"))


def paths_of(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, family: int, most_shared: int) -> DataFrame:
    """``(conv_id, path)`` of rebuilt conversations.

    A conversation c takes the first h turns of conversation ``c - c % family``,
    h being the CRC-32 of c modulo ``most_shared + 1``, and its own after its first h.
    """
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("c"), F.struct(F.col(turn_col).cast("bigint").alias("t"), turn_key(F.col(role_col), F.col(text_col)).alias("k")).alias("turn"))

    def ordered(c: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(c)), lambda x: x.k)

    own = rows.groupBy("c").agg(ordered("turn").alias("own"))
    shared = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(most_shared + 1)).cast("int")
    heads = rows.where(F.col("c") % family == 0).groupBy("c").agg(F.slice(ordered("turn"), 1, most_shared).alias("head"))
    own = own.withColumn("giver", F.col("c") - F.col("c") % family).withColumn("h", shared)
    rebuilt = own.join(heads.withColumnRenamed("c", "giver"), "giver", "left")
    path = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), 1, F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return rebuilt.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(path, "")).alias("path"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each path with its members: number, least, and hash of their ids in order."""
    path, n, least, digest = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []

    def sent() -> pa.RecordBatch:
        paths, counts, ids, hashes = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(counts, pa.int64()), pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["path", "n", "least", "ends"])

    for batch in batches:
        for own, count, first, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "ids")), strict=True):
            if own != path:
                if path is not None:
                    out.append((path, n, least, digest.hexdigest()))
                path, n, least, digest = own, 0, first, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if out:
            yield sent()
    if path is not None:
        out.append((path, n, least, digest.hexdigest()))
        yield sent()


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share from the start, ``known`` of which are known."""
    most = min(len(a), len(b)) // TURN
    at, step = known, 1
    # Steps double while all is equal, so long shared parts take few comparisons.
    while at < most:
        take = min(step, most - at)
        if a[at * TURN: (at + take) * TURN] == b[at * TURN: (at + take) * TURN]:
            at += take
            step *= 2
        elif take == 1:
            break
        else:
            step = take // 2
    return at


def _runs(shared: Broadcast):
    """Sorted runs of a task's paths, cut at the splitters, with the LCP of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value
        held: list[tuple] = []
        size = number = 0

        def sent(number: int) -> pa.RecordBatch:
            held.sort()
            place, lcps, before = [], [], b""
            for path, *_ in held:
                at = bisect_right(splitters, path)
                # The first of a part has no neighbour in its range.
                lcps.append(shared_turns(before, path) if place and place[-1] == at else 0)
                place.append(at)
                before = path
            paths, n, least, ends = zip(*held, strict=True)
            columns = [pa.array(place, pa.int32()), pa.array([number] * len(held), pa.int32()), pa.array(lcps, pa.int32()), pa.array(paths, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(ends, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["place", "run", "lcp", "path", "n", "least", "ends"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "ends")), strict=True):
                held.append(row)
                size += len(row[0]) + 120
                if size >= RUN_BYTES:
                    yield sent(number)
                    held, size, number = [], 0, number + 1
        if held:
            yield sent(number)

    return run


class LoserTree:
    """Merge of sorted runs of ``(path, lcp, payload)``; gives ``(path, lcp, payload)``
    with the LCP to the path given before."""

    def __init__(self, runs: Iterable[list[tuple]]):
        self.sources = [iter(r) for r in runs]
        width = 1
        while width < len(self.sources):
            width *= 2
        self.width = width
        #: Current row of each run, and its LCP with the last winner; none when a run is over.
        self.rows: list[tuple | None] = [next(s, None) for s in self.sources] + [None] * (width - len(self.sources))
        self.lcp = [0] * width
        self.losers = [0] * width
        self.compared = 0

    def _winner(self, a: int, b: int) -> tuple[int, int]:
        """The run with the smaller row, and the other, which gets its LCP with it."""
        x, y = self.rows[a], self.rows[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        self.compared += 1
        at = shared_turns(x[0], y[0], self.lcp[a])
        lower = x[0][at * TURN: (at + 1) * TURN] <= y[0][at * TURN: (at + 1) * TURN]
        first, second = (a, b) if lower else (b, a)
        self.lcp[second] = at
        return first, second

    def __iter__(self) -> Iterator[tuple]:
        if not self.sources:
            return
        level = list(range(self.width))
        base = self.width
        while len(level) > 1:
            base //= 2
            played = [self._winner(level[2 * k], level[2 * k + 1]) for k in range(len(level) // 2)]
            for k, (_, loser) in enumerate(played):
                self.losers[base + k] = loser
            level = [first for first, _ in played]
        top = level[0]
        while (row := self.rows[top]) is not None:
            yield row[0], self.lcp[top], row[2]
            following = next(self.sources[top], None)
            self.rows[top] = following
            self.lcp[top] = following[1] if following is not None else 0
            node, best = (self.width + top) // 2, top
            while node:
                best, self.losers[node] = self._winner(best, self.losers[node])
                node //= 2
            top = best


_NODE = "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends string"
_NODE_ARROW = pa.schema([(c, {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[t]) for c, t in (x.split() for x in _NODE.split(", "))])
_NO_ENDS = hashlib.sha256().hexdigest()


def _key(above: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(above + turn, digest_size=16).digest()


class _Open:
    """A node on the open path."""

    __slots__ = ("turn", "key", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, turn: bytes, key: bytes | None):
        self.turn, self.key = turn, key  #: the key of a node that begins a splitter
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends = None
        self.waiting: list[list] = []  #: finished children, which need this node's least conversation


def finished_nodes(merged: Iterable[tuple], low: bytes | None, high: bytes | None) -> Iterator[list]:
    """Rows of ``_NODE`` from sorted paths with LCPs, between two splitters.

    Nodes that begin a splitter have a key; what they hold from below is only of this range.
    """
    root = _Open(b"", b"")
    stack = [root]

    def close() -> Iterator[list]:
        node = stack.pop()
        parent = stack[-1] if stack else None
        words = int.from_bytes(node.turn[16:], "big")
        for row in node.waiting:
            if node.key is None:
                row[4] = node.least
            else:
                row[1] = node.key
            yield row
        leaves, saved = node.leaves, node.saved
        if node.key is None:
            leaves, saved = max(1, leaves), saved + (node.n - 1) * words
        row = [node.key, None, node.least, len(stack), None, node.n, node.children, leaves, saved, words, node.ends or _NO_ENDS]
        if parent is None:
            yield row
            return
        parent.n += node.n
        parent.least = node.least if parent.least is None else min(parent.least, node.least)
        if node.key is None:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            parent.waiting.append(row)
        else:  # its own part of the whole is counted when the parts are together
            row[1] = parent.key
            yield row

    for path, lcp, (n, least, ends) in merged:
        while len(stack) - 1 > lcp:
            yield from close()
        # As deep as this path begins a splitter.
        limit = max([shared_turns(path, s) for s in (low, high) if s is not None], default=0)
        for depth in range(lcp, len(path) // TURN):
            turn = path[depth * TURN: (depth + 1) * TURN]
            stack.append(_Open(turn, _key(stack[-1].key, turn) if depth < limit else None))
        top = stack[-1]
        top.n += n
        top.least = least if top.least is None else min(top.least, least)
        top.ends = ends
    while stack:
        yield from close()


def _merge(shared: Broadcast):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        splitters, at = shared.value, key[0].as_py()
        runs: dict[tuple, list[tuple]] = {}
        table = table.sort_by([("task", "ascending"), ("run", "ascending"), ("path", "ascending")])
        for batch in table.to_batches():
            for task, number, lcp, path, n, least, ends in zip(*(batch.column(c).to_pylist() for c in ("task", "run", "lcp", "path", "n", "least", "ends")), strict=True):
                runs.setdefault((task, number), []).append((path, lcp, (n, least, ends)))
        rows = list(finished_nodes(LoserTree(runs.values()), splitters[at - 1] if at else None, splitters[at] if at < len(splitters) else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

    return run


def splitters_of(sample: list[bytes], ranges: int) -> list[bytes]:
    """Up to ``ranges - 1`` splitters, no longer than needed to part them from the sample before."""
    sample = sorted(set(sample))
    out: list[bytes] = []
    for k in range(1, ranges):
        at = k * len(sample) // ranges
        if 0 < at < len(sample):
            own = sample[at][: (shared_turns(sample[at - 1], sample[at]) + 1) * TURN]
            if not out or own > out[-1]:
                out.append(own)
    return out


def _whole(parts: list[dict]) -> list[dict]:
    """Nodes that begin splitters, with all that lies below them; deepest first."""
    by_key = {row["key"]: row for row in parts}
    for row in sorted(parts, key=lambda r: -r["depth"]):
        row["n_leaves"] = max(1, row["n_leaves"])
        row["saved"] += (row["n_convs"] - 1) * row["words"]
        parent = by_key.get(row["parent_key"])
        row["parent_conv_id"] = parent["conv_id"] if parent else None
        if parent:
            parent["n_children"] += 1
            parent["n_leaves"] += row["n_leaves"]
            parent["saved"] += row["saved"]
    return parts


def prefix_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = 20, most_shared: int = 3, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row for each node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    spark = turns.sparkSession
    work = Workspace(spark, "trie")
    columns = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    convs = paths_of(turns, id_col, turn_col, role_col, text_col, family, most_shared)
    part = F.shiftright("conv_id", PART_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    joined = convs.groupBy("path", part.alias("part")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = joined.repartition(count, "path").sortWithinPartitions("path", "part").select("path", "n", "least", "ids")
    paths = work.stage(listed.mapInArrow(_ended, "path binary, n bigint, least bigint, ends string"), "paths")
    total = paths.agg(F.count("*").alias("n"), F.sum(F.octet_length("path") + 120).alias("bytes")).first()
    if not total.n:
        return spark.createDataFrame([], columns)
    ranges = max(1, min(total.n, max(count, -(-total.bytes // range_bytes))))
    share = min(1.0, SAMPLED * ranges / total.n)
    sample = paths.select("path") if share == 1.0 else paths.select("path").sample(share, seed=7)
    shared = spark.sparkContext.broadcast(splitters_of(sample.toArrow().column(0).to_pylist(), ranges))
    runs = paths.mapInArrow(_runs(shared), "place int, run int, lcp int, path binary, n bigint, least bigint, ends string").withColumn("task", F.spark_partition_id())
    nodes = work.stage(runs.groupBy("place").applyInArrow(_merge(shared), _NODE), "nodes")
    split = nodes.where("key is not null").groupBy("key", "parent_key", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.coalesce(F.max(F.when(F.col("ends") != _NO_ENDS, F.col("ends"))), F.lit(_NO_ENDS)).alias("ends"),
    )
    # As many as the splitters have turns.
    split = _whole([{**r.asDict(), "key": bytes(r.key), "parent_key": None if r.parent_key is None else bytes(r.parent_key)} for r in split.collect()])
    names = [f.name for f in _NODE_ARROW]
    split = work.stage(spark.createDataFrame([tuple(r.get(c) for c in names) for r in split], _NODE), "split")
    above = broadcast_if_small(split.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    below = nodes.where("key is null").join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return split.select(*names).unionByName(below.select(*names)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
