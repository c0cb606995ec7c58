"""Nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product.  Vectors are first turned into points of a unit
sphere, so that the nearest point is the one of largest inner product: a vector
x becomes (x / M, sqrt(1 - |x|^2 / M^2)) with M the greatest norm, a query q
becomes (q / |q|, 0).  A table has ``K`` functions floor((a x + b) / w) with
normal a, and a bucket is a vector of their values.

1. equal vectors are one point with the ids that can be among its nearest, so a
   large group of copies is one row;
2. a bounded sample of queries (``HEAVY`` that most rows ask with, ``SAMPLE`` others) is compared with every point.  Its
   true neighbours fit the distance d to which the success of a bucket is
   estimated, and the number of probes at which the sample reaches the recall
   asked for.  K grows with the logarithm of the points and is lowered only if
   that number passes ``MOST_PROBES``;
3. every point is put into its bucket of each table, and buckets are packed into
   rows of at most about ``BLOCK`` points, so a large bucket is many rows;
4. a query visits buckets in the order of their estimated success: the chance
   that a point at distance d from the query, whose projections differ by normal
   steps, falls in the bucket.  The best buckets are found function by function,
   keeping as many prefixes as probes.  Queries of a batch that visit one bucket
   go there as one row;
5. where they meet, the best of a block are found by one product of matrices and
   ranked again exactly, in double precision and in the order of components; the
   candidates of all tables and probes are merged.

A query that has found fewer than k rows, which small buckets far from all others
can cause, is compared with every block.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, neither do rows without an id or of another length than
most; repeated rows count once, and of several vectors of one id the smallest
stands; fewer than k candidates give them all; equal scores rank by id; an inner product that
overflows in both directions counts as minus infinity; an empty table gives no
rows.  One vector of far greater norm than all others brings these close
together on the sphere: results stay right, but more buckets are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from aircadence.workspace import Workspace, broadcast_if_small

TABLES = 2
WIDTH = 1.5
#: Points that a bucket should hold, and points of a packed row.
BUCKET, BLOCK = 1024, 1024
#: Sample of queries that fits distance and probes; its size is fixed.
HEAVY, SAMPLE = 32, 96
RECALL = 0.97
MOST_PROBES = 256
#: Slots that a table tells apart on either side of a query's own.
_REACH = 8

_erf = np.frompyfunc(math.erf, 1, 1)


def _below(x: np.ndarray) -> np.ndarray:
    """Share of the normal distribution below x."""
    return 0.5 * (1.0 + _erf(x / math.sqrt(2.0)).astype(np.float64))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Arrow lists of one length as rows in double precision."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def _points(x: np.ndarray, scale: float, most: float) -> np.ndarray:
    """Vectors on the sphere; ``scale`` keeps squares in range, ``most`` is the greatest scaled norm."""
    x = x / scale / most
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))[:, None]])


def _queries(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])


@dataclass(frozen=True)
class Hashing:
    """Functions of all tables; the same for the same numbers everywhere."""

    directions: np.ndarray  #: components, tables, functions
    shifts: np.ndarray  #: tables, functions
    width: float

    @classmethod
    def of(cls, dims: int, tables: int, functions: int, width: float, seed: int = 0) -> Hashing:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((tables, functions, dims))
        return cls(np.ascontiguousarray(directions.transpose(2, 0, 1)), rng.uniform(0, width, (tables, functions)), width)

    def projected(self, points: np.ndarray) -> np.ndarray:
        """Projections, in slots: rows, tables, functions."""
        return (np.tensordot(points, self.directions, 1) + self.shifts) / self.width

    @staticmethod
    def bucket(slots: np.ndarray) -> np.ndarray:
        """A 64-bit name of slot vectors along the last axis."""
        name = np.zeros(slots.shape[:-1], np.uint64)
        for k in range(slots.shape[-1]):
            name = (name + slots[..., k].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            name ^= name >> np.uint64(32)
        return name.view(np.int64)

    def probes(self, at: np.ndarray, distance: float, count: int) -> np.ndarray:
        """The ``count`` buckets of greatest estimated success for projections ``at``
        (rows, functions), best first; fewer if there are fewer."""
        own = np.floor(at).astype(np.int64)
        steps = np.arange(-_REACH, _REACH + 1)
        slots = own[:, :, None] + steps
        edges = own[:, :, None] + np.arange(-_REACH, _REACH + 2)
        success = np.log(np.maximum(np.diff(_below((edges - at[:, :, None]) * (self.width / distance)), axis=2), 1e-300))
        n, functions = at.shape
        total, chosen = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
        for k in range(functions):
            width = total.shape[1]
            both = (total[:, :, None] + success[:, k, None, :]).reshape(n, -1)
            # The best buckets have the best prefixes: each further function adds to all alike.
            keep = np.argsort(-both, axis=1, kind="stable")[:, :count]
            total = np.take_along_axis(both, keep, 1)
            prefix, step = np.divmod(keep, both.shape[1] // width)
            chosen = np.concatenate([np.take_along_axis(chosen, prefix[:, :, None], 1), np.take_along_axis(slots[:, k, :], step, 1)[:, :, None]], axis=2)
        return chosen


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component in order."""
    with np.errstate(all="ignore"):
        out = np.zeros(len(queries))
        for k in range(queries.shape[1]):
            out += queries[:, k] * vectors[:, k]
    return np.where(np.isnan(out), -np.inf, out)


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query index, id, score)`` of each query's k best, best first, ties to smaller ids."""
    with np.errstate(all="ignore"):
        rough = queries @ vectors.T
        rough = np.where(np.isnan(rough), -np.inf, rough)
        if len(ids) > k:
            least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            # Twice what the order of the sum can change.
            slack = 4e-16 * queries.shape[1] * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
            least = least - np.where(np.isfinite(slack), slack, 0)
            row, col = np.nonzero((rough >= least[:, None]) | ~np.isfinite(rough))
        else:
            row, col = np.nonzero(np.ones(rough.shape, bool))
    score = exact_scores(queries[row], vectors[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], ids[col[keep]], score[keep]


def _sampled(shared: Broadcast, k: int):
    """The best of each task's points for the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = shared.value
        ids, rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            row, own, score = best(sample, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
            rows, ids, scores = np.concatenate([rows, row]), np.concatenate([ids, own]), np.concatenate([scores, score])
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, ids, scores = rows[keep], ids[keep], scores[keep]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids), pa.array(scores)], ["sample", "vid", "score"])

    return run


def _buckets(shared: Broadcast, vectors: bool):
    """Each point's bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, scale, most = shared.value
        for batch in batches:
            slots = np.floor(hashing.projected(_points(_matrix(batch.column(1)), scale, most))).astype(np.int64)
            names = hashing.bucket(slots)
            for table in range(names.shape[1]):
                columns = [pa.array(np.full(len(batch), table, np.int32)), pa.array(names[:, table]), *batch.columns[: 2 if vectors else 1]]
                yield pa.RecordBatch.from_arrays(columns, ["tab", "bucket", "vid", "v"][: len(columns)])

    return run


def _visits(shared: Broadcast):
    """Buckets that the queries of a batch visit, each with those that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, distance, count = shared.value
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                at = hashing.projected(_queries(x))
                for table in range(at.shape[1]):
                    names = hashing.bucket(hashing.probes(at[:, table], distance, count))
                    # A name that two of a query's buckets share is visited once.
                    pairs = np.unique(np.stack([names.ravel(), np.repeat(np.arange(len(ids)), names.shape[1])], axis=1), axis=0)
                    values, starts = np.unique(pairs[:, 0], return_index=True)
                    groups = np.split(pairs[:, 1], starts[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), table, np.int32)), pa.array(values), pa.array([ids[g].tobytes() for g in groups]), pa.array([x[g].tobytes() for g in groups])],
                        ["tab", "bucket", "qids", "qs"],
                    )

    return run


def _pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries in blocks, for a visit to everything."""
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            part = batch.slice(first, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([_matrix(part.column(1)).tobytes()])], ["qids", "qs"])


_FOUND = "qvid bigint, best array<struct<down: double, vid: bigint>>"
_BEST = pa.list_(pa.struct([("down", pa.float64()), ("vid", pa.int64())]))


def _compare(k: int):
    """The k best of a block for each query that visits it.

    Blocks that the same visitors meet one after the other give one row for each query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows = ids = scores = None

        def merged(row, own, score) -> tuple:
            order = np.lexsort((own, -score, row))
            row, own, score = row[order], own[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[keep], own[keep], score[keep]

        def sent() -> pa.RecordBatch:
            qids = np.frombuffer(held[0], np.int64)
            ends = np.searchsorted(rows, np.arange(len(qids) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(-scores), pa.array(ids)], fields=list(_BEST.value_type))
            return pa.RecordBatch.from_arrays([pa.array(qids), pa.ListArray.from_arrays(pa.array(ends), items, type=_BEST)], ["qvid", "best"])

        for batch in batches:
            for at in range(len(batch)):
                qids, qs = batch.column(0)[at].as_buffer().to_pybytes(), batch.column(1)[at].as_buffer().to_pybytes()
                block = batch.column(2)[at].values
                vids, vectors = block.field(0).to_numpy(), _matrix(block.field(1))
                n = len(qids) // 8
                found = best(np.frombuffer(qs, np.float64).reshape(n, -1), vectors, vids, k)
                if held == (qids, qs):
                    rows, ids, scores = merged(np.concatenate([rows, found[0]]), np.concatenate([ids, found[1]]), np.concatenate([scores, found[2]]))
                else:
                    if held is not None:
                        yield sent()
                    held, (rows, ids, scores) = (qids, qs), found
        if held is not None:
            yield sent()

    return run


def _merged(k: int):
    """The k best of all that tables and probes have found for a query, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            items = lists.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            down, vid = items.field(0).to_numpy(), items.field(1).to_numpy()
            order = np.lexsort((vid, down, row))
            row, down, vid = row[order], down[order], vid[order]
            # A point has the same score wherever it is met.
            once = np.r_[True, (row[1:] != row[:-1]) | (vid[1:] != vid[:-1])][: len(row)]
            row, down, vid = row[once], down[once], vid[once]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            ends = np.searchsorted(row[keep], np.arange(len(batch) + 1)).astype(np.int32)
            best = pa.StructArray.from_arrays([pa.array(down[keep]), pa.array(vid[keep])], fields=list(_BEST.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), best, type=_BEST)], ["qvid", "best"])

    return run


def _fit(work: Workspace, points: DataFrame, asked: DataFrame, total: int, dims: int, scale: float, most: float, k: int, recall: float, tables: int, width: float) -> tuple[Hashing, float, int]:
    """Functions, distance and probes at which the sample's neighbours are found."""
    spark = points.sparkSession
    # Vectors that many rows ask with count as all of these, any others for all the rest.
    heavy = asked.orderBy(F.desc("asks"), "vid").limit(HEAVY).collect()
    light = [r for r in asked.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).collect() if r.vid not in {h.vid for h in heavy}]
    sample = heavy + light
    own = [r.vid for r in sample]
    rest = asked.agg(F.sum("asks")).first()[0] - sum(r.asks for r in heavy)
    asks = [r.asks for r in heavy] + [rest / max(1, len(light))] * len(light)
    queries = np.array([r.v for r in sample], np.float64).reshape(len(sample), -1)
    near = points.select("vid", "v").mapInArrow(_sampled(spark.sparkContext.broadcast(queries), k), "sample bigint, vid bigint, score double")
    order = Window.partitionBy("sample").orderBy(F.col("score").desc(), "vid")
    near = work.stage(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "sample")
    # At most SAMPLE times k rows.
    pairs = points.select("vid", "v", F.size("ids").alias("n")).join(F.broadcast(near.select("vid", "sample", "score")), "vid").collect()
    pairs.sort(key=lambda r: (r.sample, -r.score, r.vid))
    # A point weighs as many of its query's nearest as it stands for, times those that ask.
    weights, left = [], {}
    for r in pairs:
        weights.append(min(r.n - (r.vid == own[r.sample]), left.setdefault(r.sample, k - 1)))
        left[r.sample] -= weights[-1]
    pairs, weights = [r for r, w in zip(pairs, weights, strict=True) if w], np.array([w * asks[r.sample] for r, w in zip(pairs, weights, strict=True) if w])
    if not pairs:
        return Hashing.of(dims + 1, tables, 1, width), 1.0, 1
    true_of = np.array([r.sample for r in pairs])
    unit = _queries(queries)
    truth = _points(np.array([r.v for r in pairs], np.float64), scale, most)
    apart = np.linalg.norm(unit[true_of] - truth, axis=1)
    distance = max(float(np.median(apart)), 1e-3)
    functions = max(2, round(math.log2(max(1.0, total / BUCKET)) / max(0.5, 2.05 - math.log2(width))))
    while True:
        hashing = Hashing.of(dims + 1, tables, functions, width)
        slots = np.floor(hashing.projected(truth)).astype(np.int64)
        at = hashing.projected(unit)
        place = np.full(len(pairs), np.iinfo(np.int64).max)
        for table in range(tables):
            # Where each true neighbour's bucket stands in its query's order.
            names = hashing.bucket(hashing.probes(at[:, table], distance, MOST_PROBES))
            met = names[true_of] == hashing.bucket(slots[:, table])[:, None]
            place = np.minimum(place, np.where(met.any(axis=1), met.argmax(axis=1), np.iinfo(np.int64).max))
        order = np.argsort(place, kind="stable")
        reached = np.searchsorted(np.cumsum(weights[order]), recall * weights.sum() - 1e-9)
        needed = place[order[reached]]
        if needed < MOST_PROBES or functions == 1:
            return hashing, distance, int(min(needed, MOST_PROBES - 1)) + 1
        functions -= 1


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the k rows of largest inner product found for
    each row whose id is divisible by ``every``, itself left out."""
    spark = vectors.sparkSession
    work = Workspace(spark, "neighbours")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where("id is not null and v is not null").where(sound)
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = f"query_id bigint, rank int, {id_col} bigint, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    dims = lengths.dims
    rows = rows.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    # The k + 1 smallest ids of equal vectors are all that can be among the nearest.
    copies = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    points = copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "v")
    points = work.stage(points.select(F.xxhash64("v").alias("key"), "*"), "points")
    askers = rows.where(F.col("id") % every == 0).withColumn("key", F.xxhash64("v"))
    askers = askers.join(points.select("key", "v", "vid"), ["key", "v"]).select(F.col("id").alias("query_id"), "vid")
    askers = work.stage(askers, "askers")
    asked = work.stage(points.join(askers.groupBy("vid").agg(F.count("*").alias("asks")), "vid").select("vid", "v", "asks"), "asked")
    if asked.isEmpty():
        return spark.createDataFrame([], empty)
    sums = points.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("scale"), F.count("*").alias("n")).first()
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: (x / F.lit(sums.scale)) * (x / F.lit(sums.scale))), F.lit(0.0), lambda a, x: a + x))
    most = points.agg(F.max(norm)).first()[0] * (1 + 1e-12)
    hashing, distance, count = _fit(work, points, asked, sums.n, dims, sums.scale, most, k + 1, recall, tables, width)

    shared = spark.sparkContext.broadcast((hashing, sums.scale, most))
    names = "tab int, bucket bigint, vid bigint"
    sizes = points.select("vid", "v").mapInArrow(_buckets(shared, False), names).groupBy("tab", "bucket").count()
    large = work.stage(sizes.where(F.col("count") > BLOCK).select("tab", "bucket", F.ceil(F.col("count") / BLOCK).alias("blocks")), "large")
    placed = points.select("vid", "v").mapInArrow(_buckets(shared, True), f"{names}, v array<double>")
    placed = placed.join(broadcast_if_small(large), ["tab", "bucket"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("vid"), "blocks"), F.lit(0)))
    blocks = placed.groupBy("tab", "bucket", "block").agg(F.collect_list(F.struct("vid", "v")).alias("members"))
    blocks = work.stage(blocks, "blocks")
    visits = asked.mapInArrow(_visits(spark.sparkContext.broadcast((hashing, distance, count))), "tab int, bucket bigint, qids binary, qs binary")
    met = visits.join(blocks, ["tab", "bucket"]).select("qids", "qs", "members").mapInArrow(_compare(k + 1), _FOUND)

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("qvid").agg(F.flatten(F.collect_list("best")).alias("best")).mapInArrow(_merged(k + 1), _FOUND)

    results = work.stage(merged(met), "found")
    copied = work.stage(points.where(F.size("ids") > 1).select("vid", "ids"), "copied")
    rest = asked.join(results.where(F.size("best") >= min(k + 1, sums.n)).select(F.col("qvid").alias("vid")), "vid", "left_anti")
    rest = work.stage(rest, "rest")
    if not rest.isEmpty():
        # Every point is in one block of the first table.
        all_blocks = blocks.where("tab = 0").select("members")
        every_pair = rest.mapInArrow(_pack_all, "qids binary, qs binary").crossJoin(all_blocks)
        full = work.stage(merged(every_pair.mapInArrow(_compare(k + 1), _FOUND)), "full")
        results = results.join(rest.select(F.col("vid").alias("qvid")), "qvid", "left_anti").unionByName(full)
    # Points stand for their copies; a query leaves out its own id.
    near = results.select("qvid", F.explode("best").alias("at")).select("qvid", "at.vid", (F.lit(0.0) - F.col("at.down")).alias("score"))
    near = near.join(broadcast_if_small(copied), "vid", "left").withColumn("ids", F.coalesce("ids", F.array("vid")))
    lists = near.withColumn("ids", F.transform("ids", lambda i: F.struct((-F.col("score")).alias("down"), i.alias("id"))))
    lists = lists.groupBy("qvid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("best"))
    answers = askers.join(lists, askers.vid == lists.qvid).select("query_id", F.expr(f"slice(filter(best, x -> x.id <> query_id), 1, {k})").alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("pos", "at")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("at.id").alias(id_col), (F.lit(0.0) - F.col("at.down")).alias("score"))
