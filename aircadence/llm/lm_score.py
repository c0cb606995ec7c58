"""Cross-entropy difference of matched target and background n-gram models.

A text is its words, lower-cased, and one boundary sign before the first and
after the last.  Both models share one vocabulary, every word of the corpus and
the sign, V of them.  The background model counts all documents, the target
model those labelled good; background counts are scaled to the target's total,
so that the models are matched in size.  A sign's loss is the mean of its
losses under a unigram and a bigram model,

    p(w) = (c(w) + 1) / (n + V),   p(w | v) = (c(v, w) + a) / (c(v) + a V),

where c counts all documents but the scored one itself, so that a labelled
document does not score as target for its own words.  A document's score is its
mean loss per sign under the target model minus that under the background
model, in nats; lower is more like the target.

Everything grows with the corpus: no word and no bigram is left out.  A loss
difference is a sum of terms of single n-grams, so each n-gram of a text is sent
once, as a 64-bit key, to the bucket that counts it, and the bucket sends back
sums for documents, not n-grams:

1. words are counted exactly; of words and bigrams with more than a fixed share
   of all signs, of which there are few whatever the input, all counts are
   broadcast, so no key of the exchange is hot;
2. each task turns its texts into keys, adds up what it knows from the
   broadcast, and sends the other keys of about ``GROUP_SIGNS`` signs at a time
   as one row for each bucket that has some, each key with its document;
3. a bucket counts its keys and sends back, for each row, the sums of the documents
   that have keys in it;
4. the sums of a group of documents meet, and its documents are named.

What is sent and sent back grows with the text, not with the number of buckets, which
follows from the number of signs.  A group is known by its task, number and content, and
tells how many rows it sent.  A lost task that comes to other groups when it is run
again, because its input has no fixed order, is noticed and fails the job.

Defined cases: a null or wordless text has no words and a null score; labels
of unknown or null ids are ignored; without target documents all scores are 0;
rows that repeat an id are judged one by one; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from aircadence.llm import textkernel as tk
from aircadence.workspace import Workspace, broadcast_if_small

#: Broadcast are n-grams with at least one in so many signs.
HOT = 100_000
GROUP_SIGNS = 1 << 19
#: Keys that a bucket should count, which bounds its task's memory.
BUCKET_KEYS = 4_000_000
_SIGN = np.uint64(0x5DEECE66D0000002)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_ONE = np.uint64(1)


def _ngrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a chunk's words and bigrams, and the documents' bounds in both.

    Keys of words are even, those of bigrams odd.  A document of n words has
    n + 1 of each, one without words has none.
    """
    words = tk.scan(data, bounds, tk.NON_SPACE)
    hashes = tk.hashes(data, words)
    filled = words.first[1:] > words.first[:-1]
    second = np.insert(hashes, words.first[1:][filled], _SIGN)
    first = np.r_[_SIGN, second[:-1]] if len(second) else second
    return second & ~_ONE, tk.mix(first * _PAIR + second) | _ONE, words.first + np.r_[0, np.cumsum(filled)]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first, stop, words, pairs, bounds)`` of some documents at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin = signs = 0

    def joined(stop: int):
        ahead = np.cumsum([0, *(len(w) for w, _, _ in held)])
        bounds = np.concatenate([[0], *(at[1:] + k for (_, _, at), k in zip(held, ahead, strict=False))])
        return begin, stop, np.concatenate([w for w, _, _ in held]), np.concatenate([p for _, p, _ in held]), bounds.astype(np.int64)

    for _, stop, data, bounds in tk.chunks(texts):
        held.append(_ngrams(data, bounds))
        signs += len(held[-1][0])
        if signs >= GROUP_SIGNS:
            yield joined(stop)
            held, begin, signs = [], stop, 0
    if held:
        yield joined(stop)


def _counted(keys: np.ndarray, good: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with all and target counts, of at least some occurrences."""
    values, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    m = np.bincount(back, weights=good, minlength=len(values)).astype(np.int64)
    often = n >= least
    return values[often], n[often].astype(np.int64), m[often]


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words, and bigrams that are frequent in their group, with counts."""
    for batch in batches:
        flags = _flags(batch)
        for first, stop, words, pairs, at in _groups(batch.column(0)):
            good = np.repeat(flags[first:stop], np.diff(at))
            for keys, least in ((words, 1), (pairs, max(2, len(pairs) // (HOT // 4)))):
                columns = _counted(keys, good, least)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], ["key", "n", "m"])


def _count_known(shared: Broadcast):
    """Exact counts of the given keys of bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            flags = _flags(batch)
            for first, stop, _, pairs, at in _groups(batch.column(0)):
                place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                mine = known[place] == pairs
                n = np.bincount(place[mine], minlength=len(known))
                m = np.bincount(place[mine], weights=np.repeat(flags[first:stop], np.diff(at))[mine], minlength=len(known))
                seen = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(known[seen].view(np.int64)), pa.array(n[seen]), pa.array(m[seen].astype(np.int64))], ["key", "n", "m"])

    return run


@dataclass(frozen=True)
class Terms:
    """Terms of the loss difference from counts of n-grams."""

    scale: float  #: target signs over all signs
    size: int  #: V
    smoothing: float

    def __call__(self, keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        n = n * self.scale
        pair = (keys & _ONE).astype(bool)
        add = np.where(pair, self.smoothing, 1.0)
        all_signs = self.smoothing * self.size
        return 0.5 * (np.log((n + add) / (m + add)) - np.where(pair, 0.0, np.log((n + all_signs) / (m + all_signs))))


_SENT = "bucket int, uid bigint, keys binary, docs binary, rows int, ids array<bigint>, n_words array<bigint>, part array<double>"
_SENT_ARROW = pa.schema([
    ("bucket", pa.int32()), ("uid", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("rows", pa.int32()),
    ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("part", pa.list_(pa.float64())),
])
_BACK = "uid bigint, docs binary, rows int, ids array<bigint>, n_words array<bigint>, part array<double>"
_BACK_ARROW = pa.schema([_SENT_ARROW.field(c) for c in ("uid", "docs", "rows", "ids", "n_words", "part")])
#: A document's number in its group, and this bit for a target document.
_GOOD = np.uint32(1 << 31)


def _own(slots: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct n-grams: slot, document, and count in the document."""
    both, counts = np.unique(slots.astype(np.int64) * max(1, n_docs) + docs, return_counts=True)
    return both // max(1, n_docs), both % max(1, n_docs), counts


def _sums(terms: Terms, keys: np.ndarray, n: np.ndarray, m: np.ndarray, slots: np.ndarray, docs: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Sum of the terms of each document's n-grams, by the counts of the other documents."""
    slot, doc, own = _own(slots, docs, len(good))
    each = terms(keys[slot], n[slot] - own, m[slot] - own * good[doc])
    return np.bincount(doc, weights=own * each, minlength=len(good))


def _send(hot: Broadcast, terms: Terms, buckets: int):
    """Rows of keys for each bucket, and a row of the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, m = hot.value
        number = 0
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for first, stop, words, pairs, at in _groups(batch.column(0)):
                docs = np.repeat(np.arange(stop - first, dtype=np.uint32), np.diff(at))
                good = flags[first:stop]
                part, rest, rest_docs = np.zeros(stop - first), [], []
                for keys in (words, pairs):
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    mine = known[place] == keys
                    part += _sums(terms, known, n, m, place[mine], docs[mine], good)
                    rest.append(keys[~mine])
                    rest_docs.append(docs[~mine])
                keys, docs = np.concatenate(rest), np.concatenate(rest_docs)
                bucket = ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys, docs, bucket = keys[order], docs[order], bucket[order]
                docs = docs | np.where(good[docs] > 0, _GOOD, np.uint32(0))
                ids = batch.column(2).slice(first, stop - first).to_pylist()
                name = hashlib.blake2b(repr((TaskContext.get().partitionId(), number, ids)).encode(), digest_size=8)
                name.update(keys.tobytes() + docs.tobytes())
                uid = int.from_bytes(name.digest(), "big", signed=True)
                values, starts = np.unique(bucket, return_index=True)
                rows = [{"bucket": int(b), "uid": uid, "keys": k.tobytes(), "docs": d.tobytes()} for b, k, d in zip(values, np.split(keys, starts[1:]), np.split(docs, starts[1:]), strict=True)] if len(values) else []
                rows.append({"bucket": uid % buckets, "uid": uid, "rows": len(rows), "ids": ids, "n_words": np.maximum(np.diff(at) - 1, 0), "part": part})
                yield pa.RecordBatch.from_pylist(rows, _SENT_ARROW)
                number += 1

    return run


def _answer(terms: Terms):
    """Count a bucket's keys and sum their terms for the documents of each row."""

    def run(table: pa.Table) -> pa.Table:
        out = table.filter(pa.compute.is_valid(table.column("ids"))).select(_BACK_ARROW.names).cast(_BACK_ARROW)
        asked = table.filter(pa.compute.is_valid(table.column("keys")))
        if not len(asked):
            return out
        keys, docs = ([np.frombuffer(x.as_buffer(), kind) for x in asked.column(c)] for c, kind in (("keys", np.uint64), ("docs", np.uint32)))
        # The documents of all rows in one range, without those that have no key here.
        row = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs])
        own, doc = np.unique(row << 32 | np.concatenate(docs), return_inverse=True)
        good = (own >> 31 & 1).astype(np.float64)
        values, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        m = np.bincount(back, weights=good[doc], minlength=len(values))
        part = _sums(terms, values, n, m, back, doc, good)
        cuts = np.searchsorted(own >> 32, np.arange(1, len(docs)))
        names = [(x & 0x7FFFFFFF).astype(np.uint32).tobytes() for x in np.split(own, cuts)]
        none = [None] * len(names)
        return pa.concat_tables([out, pa.Table.from_pydict({"uid": asked.column("uid"), "docs": names, "rows": none, "ids": none, "n_words": none, "part": np.split(part, cuts)}, _BACK_ARROW)])

    return run


def _named(table: pa.Table) -> pa.Table:
    """The documents of one group, with the sums of all buckets."""
    own = table.filter(pa.compute.is_valid(table.column("ids")))
    parts = table.filter(pa.compute.is_null(table.column("ids")))
    if len(own) != 1 or own.column("rows")[0].as_py() != len(parts):
        raise RuntimeError("a task that was run again has seen its texts in another order; write them to a table first")
    n_words = own.column("n_words").combine_chunks().flatten().to_numpy()
    docs = np.concatenate([np.arange(len(n_words)), *(np.frombuffer(x.as_buffer(), np.uint32) for x in parts.column("docs"))])
    sums = np.concatenate([own.column("part").combine_chunks().flatten().to_numpy(), *(x.values.to_numpy() for x in parts.column("part"))])
    # In a fixed order, so that reruns agree to the last digit.
    order = np.lexsort((sums, docs))
    starts = np.searchsorted(docs[order], np.arange(len(n_words)))
    sums = np.add.reduceat(sums[order], starts) if len(n_words) else np.zeros(0)
    empty = n_words == 0
    return pa.table({"id": own.column("ids").combine_chunks().flatten(), "n_words": n_words, "score": pa.array(sums / (n_words + 1), mask=empty)})


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", smoothing: float = 0.01, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``(id_col, n_words, score)``, scores to 6 places.

    ``smoothing`` is the a of the bigram model.  ``buckets`` share the n-grams; by
    default each counts up to about ``BUCKET_KEYS``, and there are twice as many as
    shuffle partitions at least.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    good = work.stage(labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct().withColumn("good", F.lit(True)), "good")
    small = broadcast_if_small(good)
    marked = rows.join(small, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"), "id")
    if small is good:  # a shuffled join has no order that a lost task would find again
        marked = work.stage(marked, "marked")

    def summed(counts: DataFrame) -> DataFrame:
        return counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    counts = work.stage(summed(marked.mapInArrow(_count, "key bigint, n bigint, m bigint")), "counts")
    is_word = F.col("key").bitwiseAND(F.lit(1)) == 0
    whole = counts.where(is_word).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("size")).first()
    total = whole.n or 0
    buckets = buckets or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // BUCKET_KEYS))
    # At most HOT words and HOT bigrams, whatever the input.
    hot = counts.where(F.col("n") >= max(1.0, total / HOT)).orderBy("key").toArrow()
    key, n, m = (hot.column(c).to_numpy() for c in ("key", "n", "m"))
    word = key % 2 == 0
    pairs = np.sort(key[~word].view(np.uint64))
    if len(pairs):
        exact = summed(marked.mapInArrow(_count_known(spark.sparkContext.broadcast(pairs)), "key bigint, n bigint, m bigint")).toArrow()
        key, n, m = (np.concatenate([x[word], exact.column(c).to_numpy()]) for c, x in (("key", key), ("n", n), ("m", m)))
    terms = Terms((whole.m or 0) / max(1, total), whole.size, smoothing)
    keys = key.view(np.uint64)
    order = np.argsort(keys)
    known = (keys[order], n[order], m[order]) if len(keys) else (np.zeros(1, np.uint64), np.zeros(1), np.zeros(1))
    sent = marked.mapInArrow(_send(spark.sparkContext.broadcast(known), terms, buckets), _SENT)
    back = sent.groupBy("bucket").applyInArrow(_answer(terms), _BACK)
    scored = back.groupBy("uid").applyInArrow(_named, "id bigint, n_words bigint, score double")
    return scored.select(F.col("id").alias(id_col), "n_words", F.round("score", 6).alias("score"))
