"""Near-duplicate groups: one-permutation MinHash, banded buckets, star edges.

1. ``sign``: a document's set of word shingles is hashed once.  The high bits
   of a hash name one of 256 bins, and each bin keeps its least hash.  Empty
   bins take the value of a filled one, each empty bin drawing it in its own
   random order (optimal densification).  Six bins make a band.
2. Documents with equal sets are one class, found by a pre-aggregated
   ``groupBy`` of a 128-bit digest; only the class's least id goes on.
3. Classes that share a band bucket are candidates.  A bucket with m members
   gives m - 1 edges, all to its least member (a star).
4. Candidates are confirmed on their full sets, and components of the
   confirmed links are found by alternating large and small stars.
5. A star can miss a link between two members that both differ from the
   centre.  Buckets whose members lie in several components are therefore
   completed: pairs across components that may still be similar are confirmed
   too.  The test for "may" loses nothing: each document has a bit array in
   which every shingle flips one bit, so two arrays never differ in more bits
   than the sets differ in shingles.
6. Buckets of more than ``max_block`` members are cut without losing a pair,
   and no task holds a large group.  Where all but a few members are of one
   component, its members are dealt into blocks, and the few go to each block.
   Families of texts that share much but not enough have many components;
   their members meet under their rarest shingles instead: if two sets are
   similar, the first few shingles of each, the rarest first, have one in
   common, and those of one shingle more have two.  Blocks of one rare shingle
   that are still too large are cut by a second one, and what is then left is
   dealt into pairs of bounded blocks.

A pair at similarity 0.85 shares none of the 42 bands with probability 2e-9.

Defined cases: a null or wordless text has an empty set, links with nothing
and is its own component; a row with a null id links with nothing, its
component is null and it is kept; rows that repeat an id with other words are
nodes of their own, which that id names; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from aircadence.llm import textkernel as tk
from aircadence.workspace import Workspace, broadcast_if_small

BINS, ROWS, BANDS = 256, 6, 42
SLOTS = ROWS * BANDS
PARITY_BITS = 2048
SHINGLE_WORDS = 5
#: Frequent shingles whose counts order them; all others count as rare.
ORDERED = 1 << 18

_donor_order = np.argsort(np.random.default_rng(20240117).random((BINS, BINS)), axis=1).astype(np.uint16)
_row_factors = tk.constants(ROWS, 5)
_band_terms = tk.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(ordered: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted non-empty hash set."""
    bins = (ordered >> np.uint64(56)).astype(np.int64)
    firsts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = bins[firsts]
    out = np.zeros(BINS, dtype=np.uint64)
    out[filled] = ordered[firsts]
    empty = np.ones(BINS, dtype=bool)
    empty[filled] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        donors = filled[np.argmin(_donor_order[np.ix_(empty, filled)], axis=1)]
        out[empty] = out[donors]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of a signature."""
    return tk.mix((sig[:SLOTS].reshape(BANDS, ROWS) * _row_factors).sum(axis=1) + _band_terms)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(tk.shingles(hashes, SHINGLE_WORDS))


def parity(ordered: np.ndarray) -> bytes:
    """Bit array in which every element of the set flips one bit."""
    at = (tk.mix(ordered) & np.uint64(PARITY_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=PARITY_BITS) & 1).tobytes()


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for first, stop, data, bounds in tk.chunks(texts):
        words = tk.scan(data, bounds, tk.NON_SPACE)
        hashes = tk.hashes(data, words)
        for i in range(stop - first):
            yield shingle_set(hashes[words.first[i]: words.first[i + 1]])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands, flips = [], [], [], []
        for ordered in _sets(batch.column(2)):
            sizes.append(len(ordered))
            if len(ordered) == 0:
                digests.append(None)
                bands.append(None)
                flips.append(None)
                continue
            sig = signature(ordered)
            digests.append(hashlib.blake2b(ordered.tobytes(), digest_size=16).digest())
            bands.append(band_keys(sig).view(np.int64))
            flips.append(parity(ordered))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(flips, pa.binary())],
            ["doc", "text_hash", "n_shingles", "digest", "bands", "flips"],
        )


def _confirm(percent: int):
    """Keep the edges whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                100 * (common := len(np.intersect1d(a, b, assume_unique=True))) >= percent * (len(a) + len(b) - common) and common > 0
                for a, b in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)
            ]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _across(percent: int):
    """Pairs of one bucket across components that may reach the similarity.

    Rows arrive sorted by bucket; a bucket that a batch cuts is carried over.
    """

    def pairs(ids, comp, size, bits) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(ids) - 1):
            total = size[i + 1:] + size[i]
            near = (comp[i + 1:] != comp[i]) & (100 * np.minimum(size[i + 1:], size[i]) >= percent * np.maximum(size[i + 1:], size[i]))
            j = np.flatnonzero(near)
            if len(j):
                differ = np.bitwise_count(bits[j + i + 1] ^ bits[i]).sum(axis=1, dtype=np.int64)
                # Similar sets differ in at most this share of their sizes' sum.
                j = j[differ * (100 + percent) <= (100 - percent) * total[j]] + i + 1
                if len(j):
                    yield ids[i], ids[j]

    def solve(table: pa.Table) -> pa.RecordBatch:
        bucket, ids, comp, size = (table.column(c).to_numpy() for c in ("bucket", "id", "comp", "n_shingles"))
        bits = np.frombuffer(b"".join(table.column("flips").to_pylist()), dtype=np.uint64).reshape(len(ids), PARITY_BITS // 64)
        cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(ids)]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            at = slice(start, stop)
            for one, others in pairs(ids[at], comp[at], size[at], bits[at]):
                left.append(np.full(len(others), one))
                right.append(others)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            bucket = table.column("bucket").to_numpy()
            open_from = int(np.flatnonzero(bucket == bucket[-1])[0])
            if open_from:
                yield solve(table.slice(0, open_from))
            held = table.slice(open_from)
        if held is not None:
            yield solve(held)

    return run


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Connected components of ``(a, b)`` as rows ``(id, comp)``.

    Alternates large and small stars until the edge set stays the same; every
    node with an edge is returned with the least id of its component.
    """
    edges = work.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = work.stage(small, "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(edges)
        edges = new
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a batch has more than once, with their counts in it."""
    for batch in batches:
        sets = list(_sets(batch.column(1)))
        values, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])


def _rarest(percent: int, order: Broadcast):
    """The shingles of each set by which similar sets meet, the rarest first.

    Sets of n shingles that reach the similarity share at least k = n * percent
    / 100 of them, rounded up, so they share one of the first n - k + 1 in any
    common order, and two of the first n - k + 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = order.value
        for batch in batches:
            shingles, places, firsts, ids, comps = [], [], [], [], []
            for node, comp, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch.column(1)), strict=True):
                n = len(own)
                if not n:
                    continue
                w = np.zeros(n, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    w = np.where(known[at] == own, weight[at], 0)
                first = n - -(-n * percent // 100) + 1
                take = np.lexsort((own, w))[: first + 1]
                shingles.append(own[take].view(np.int64))
                places.append(np.arange(len(take)))
                firsts.append(np.arange(len(take)) < first)
                ids.append(np.full(len(take), node))
                comps.append(np.full(len(take), comp))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, comps, shingles, places, firsts)], ["id", "comp", "shingle", "place", "first"])

    return run


def _bounded(rows: DataFrame, max_block: int, work: Workspace, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks ``(bucket, id, comp)`` of bounded size, and what must be cut otherwise.

    Buckets of one component are left out.  A larger bucket is cut if all but
    some members, its few, are of one component: pairs within that are of no
    interest, so its members are dealt into blocks at least as large as the few
    are, and the few go to each: no more than about twice the rows come out.
    Buckets with more than four times ``max_block`` of the few, which would
    make large blocks, are returned with their size ``n``.
    """
    half = max_block // 2
    shares = rows.groupBy("bucket", "comp").agg(F.count("*").alias("own")).groupBy("bucket").agg(F.sum("own").alias("n"), F.max("own").alias("most"), F.max_by("comp", F.struct("own", "comp")).alias("main"))
    shares = work.stage(shares.where("n > most"), f"{name}-sizes")
    mixed = work.stage(rows.join(broadcast_if_small(shares), "bucket"), name)
    small, large = mixed.where(F.col("n") <= max_block), mixed.where(F.col("n") > max_block)
    others = F.col("n") - F.col("most")
    few = others <= 4 * max_block
    parts = F.ceil(F.col("most") / F.greatest(others, F.lit(half)))
    part = F.when(F.col("comp") == F.col("main"), F.array(F.pmod(F.xxhash64("id"), parts))).otherwise(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    dealt = large.where(few).select("bucket", "id", "comp", F.explode(part).alias("part")).select(F.xxhash64("bucket", "part").alias("bucket"), "id", "comp")
    return [small.select("bucket", "id", "comp"), dealt], large.where(~few).drop("most", "main")


def _rare_blocks(texts: DataFrame, percent: int, max_block: int, work: Workspace) -> list[DataFrame]:
    """Blocks ``(bucket, id, comp)`` in which all similar pairs of ``texts`` meet.

    ``texts`` has ``(id, text, comp)``.
    """
    # A fixed number of shingles at most, whatever the input; the order need not be exact, only common.
    top = texts.select("id", "text").mapInArrow(tk.trimmed(_frequent), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(ORDERED).toArrow()
    shingle, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(shingle)
    order = texts.sparkSession.sparkContext.broadcast((shingle[by], n[by]))
    rare = work.stage(texts.select("id", "text", "comp").mapInArrow(tk.trimmed(_rarest(percent, order)), "id bigint, comp bigint, shingle bigint, place bigint, first boolean"), "rare")
    out, large = _bounded(rare.where("first").select("id", "comp", "shingle", "place", F.col("shingle").alias("bucket")), max_block, work, "rare-blocks")
    if large.head(1):
        later = rare.select("id", F.col("shingle").alias("second"), F.col("place").alias("after"))
        finer = large.drop("n").join(later, "id").where("after > place").select("id", "comp", F.xxhash64("shingle", "second").alias("bucket"))
        blocks, large = _bounded(finer, max_block, work, "rarer-blocks")
        out += blocks
        if large.head(1):
            out.append(_dealt(large, max_block).select("bucket", "id", "comp"))
    return out


def _dealt(large: DataFrame, max_block: int) -> DataFrame:
    """Buckets that no second shingle could cut, as pairs of bounded blocks.

    Members are dealt into blocks by a hash of their id, and every two blocks
    of a bucket make a new bucket, so that each pair of members still meets.
    """
    parts = F.ceil(F.col("n") / (max_block // 2))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = large.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))


def _with_texts(ids: DataFrame, classes: DataFrame, texts: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Staged ``(id, text)`` of the given nodes."""
    wanted = work.stage(classes.select("id", "doc", "text_hash").join(broadcast_if_small(work.stage(ids.distinct(), f"{name}-ids")), "id", "left_semi"), f"{name}-rows")
    return work.stage(texts.join(broadcast_if_small(wanted), ["doc", "text_hash"]).select("id", "text"), f"{name}-texts")


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """Staged pairs ``(a, b)`` that reach the similarity on full sets."""
    pairs = work.stage(pairs, f"{name}-pairs")
    known = _with_texts(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), classes, texts, work, name)
    joined = pairs.join(known.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(known.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    links = work.stage(joined.select("a", "b", "text_a", "text_b").mapInArrow(tk.trimmed(_confirm(percent)), "a bigint, b bigint").distinct(), f"{name}-links")
    work.drop(known, pairs)
    return links


def _classes(signed: DataFrame, work: Workspace) -> tuple[DataFrame, bool]:
    """Classes of equal sets as nodes, and whether some id names several.

    ``id`` is the node: the class's least document id, or a hash of its digest
    if another class has the same one.
    """
    rows = signed.where("digest is not null and doc is not null")
    classes = rows.groupBy("digest").agg(F.min(F.struct("doc", "text_hash", "n_shingles", "bands", "flips")).alias("m")).select("digest", "m.*")
    key = F.xxhash64("digest")
    several = rows.groupBy("doc").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least < most").select("doc", "least")
    several = work.stage(several, "several")
    if not several.head(1):
        return work.stage(classes.withColumn("id", F.col("doc")), "classes"), False
    other = F.col("least").isNotNull() & (key != F.col("least"))
    classes = classes.join(broadcast_if_small(several), "doc", "left").withColumn("id", F.when(other, F.xxhash64("digest", F.lit(1))).otherwise(F.col("doc")))
    return work.stage(classes.drop("least"), "classes"), True


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int, max_block: int, work: Workspace) -> DataFrame:
    """Each row's ``(doc, text_hash, n_shingles, node_comp, component_id)``.

    ``node_comp`` tells components apart, ``component_id`` is the least
    document id in them; rows without a set or an id have no ``node_comp``.
    """
    texts = _rows(docs, id_col, text_col)
    signed = work.stage(texts.mapInArrow(tk.trimmed(_sign), "doc bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, flips binary"), "signed")
    classes, several = _classes(signed, work)
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = work.stage(banded.join(shared, "bucket"), "members")
    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(texts, classes, stars, percent, work, "star")
    comps = work.stage(components(links, work), "comps")

    # Buckets that hold members of several components.
    placed = members.select("bucket", "id").join(broadcast_if_small(comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    blocks, large = _bounded(placed, max_block, work, "crossed")
    large = work.stage(large.select("id", "comp").distinct(), "large")
    if large.head(1):
        held = _with_texts(large.select("id"), classes, texts, work, "large").join(broadcast_if_small(large), "id")
        blocks += _rare_blocks(held, percent, max_block, work)
    details = classes.select("id", "n_shingles", "flips")
    pairs = None
    for block in blocks:
        wanted = work.stage(block.select("id").distinct(), "block-ids")
        rows = block.join(details.join(broadcast_if_small(wanted), "id", "left_semi"), "id").select("bucket", "id", "comp", "n_shingles", "flips")
        found = rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(tk.trimmed(_across(percent)), "a bigint, b bigint")
        pairs = found if pairs is None else pairs.union(found)
    late = _verified(texts, classes, pairs.distinct(), percent, work, "late")
    comps = work.stage(components(links.union(late), work), "comps")

    nodes = classes.select("digest", "doc", "id").join(comps, "id", "left").select("digest", "doc", F.coalesce("comp", "id").alias("node_comp"))
    if several:
        least = nodes.groupBy("node_comp").agg(F.min("doc").alias("component_id"))
        nodes = nodes.join(least, "node_comp").select("digest", "node_comp", "component_id")
    else:
        nodes = nodes.select("digest", "node_comp", F.col("node_comp").alias("component_id"))
    out = signed.select("doc", "text_hash", "n_shingles", "digest").join(nodes, "digest", "left")
    named = F.col("doc").isNotNull()
    return out.select("doc", "text_hash", "n_shingles", F.when(named, F.col("node_comp")).alias("node_comp"), F.when(named, F.coalesce("component_id", "doc")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, max_block: int = 512) -> DataFrame:
    """Label every row with its near-duplicate component.

    Returns ``(id_col, n_shingles, component_id, kept)``, one row for each row
    of ``docs``.  ``percent`` is the least similarity in per cent; ids are
    integers.
    """
    out = _labelled(docs, id_col, text_col, percent, max_block, Workspace(docs.sparkSession, "near-dedup"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, max_block: int = 512) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Of each component one row stays, that of the least id (then the least text
    hash); so do rows without words or with a null id.  A row is known by its
    id and text, not by its id alone.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    rows = _labelled(docs, id_col, text_col, percent, max_block, work).where("node_comp is not null")
    counted = rows.groupBy("node_comp", "doc", "text_hash").count()
    kept = work.stage(counted.groupBy("node_comp").agg(F.min(F.struct("doc", "text_hash", "count")).alias("m")).select("m.*"), "kept")
    again = work.stage(kept.where("count > 1").select("doc", "text_hash"), "again")

    def among(table: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        same = (table[id_col].cast("bigint") == rows["doc"]) & (F.xxhash64(table[text_col]) == rows["text_hash"])
        return table.join(broadcast_if_small(rows), same, how)

    has_words = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    single = docs.where(F.col(id_col).isNull() | ~F.coalesce(has_words, F.lit(False)))
    stay = among(docs.where(has_words), kept, "left_semi")
    if not again.head(1):
        return stay.union(single)
    # Only rows that repeat another are shuffled to drop the others.
    return among(stay, again, "left_anti").union(among(stay, again, "left_semi").dropDuplicates([id_col, text_col])).union(single)
