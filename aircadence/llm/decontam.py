"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised test items, with words
as letters.  A document's words are streamed through it; after each word the
state and the length of the longest match that ends there are known.  A match
of at least ``window`` words, or a whole item of fewer, is a hit.

Words outside the items' vocabulary reset the automaton, so whole batches are
first mapped to vocabulary numbers by vectorised search and only runs of known
words that are long enough are streamed.

The automaton is sent to the executors as flat arrays, in parts of at most
``MAX_ITEM_CHARS`` characters of items (or one item); more items mean more
parts, ``PARTS_HELD`` of which a pass over the texts holds; between passes the texts
are staged with their hits.  A part of that size takes about 16 MB in each Python
worker, and 350 MB in the driver while it is built.

Defined cases: null texts and items have no words; an item with a null id
counts for hits but is not listed; repeated items are listed once; rows that
repeat an id are judged one by one; empty tables give empty results or no
hits.  Columns of ``docs`` keep their names, whatever they are.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from aircadence.llm import textkernel as tk
from aircadence.workspace import Workspace

WINDOW_WORDS = 10
MAX_ITEM_CHARS = 2_000_000
#: Automata that a worker holds in one pass over the texts.
PARTS_HELD = 8

_HITS = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>,items:array<string>>"
_HITS_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "stop")]))),
    ("items", pa.list_(pa.string())),
])


class Automaton:
    """Suffix automaton of word sequences with the items of each window."""

    def __init__(self, items: list[tuple[tuple[str, ...], str | None]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        per_item: list[np.ndarray] = []
        for first, stop, data, bounds in tk.chunks(texts):
            words = tk.scan(data, bounds, tk.ALNUM, lower=True)
            hashes = tk.hashes(data, words)
            per_item += [hashes[words.first[i]: words.first[i + 1]] for i in range(stop - first)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate(per_item)) if per_item else np.zeros(0, np.uint64)
        sequences = [np.searchsorted(self.vocabulary, h).tolist() for h in per_item]
        self.shortest = min((min(len(s), window) for s in sequences if s), default=window)
        builder = _Builder()
        for s in sequences:
            builder.add(s)
        self._flatten(builder, [i for i, _ in items], sequences)

    def _flatten(self, built: _Builder, ids: list[tuple[str, ...]], sequences: list[list[int]]) -> None:
        """Keep the states as arrays; an edge is a number of its state and letter."""
        n, letters = len(built.length), max(1, len(self.vocabulary))
        edges = np.array([(v * letters + letter, to) for v, out in enumerate(built.next) for letter, to in out.items()], dtype=np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self._letters = letters
        self._edges, self._targets = array("q", edges[:, 0].tobytes()), array("i", edges[:, 1].astype(np.int32).tobytes())
        self._link, self._length = array("i", built.link), array("i", built.length)
        by_length = sorted(range(n), key=built.length.__getitem__)
        # The ancestor of a state whose strings include its suffix of ``window`` words.
        window_state = [-1] * n
        for v in by_length:
            if built.length[v] >= self.window:
                up = built.link[v]
                window_state[v] = window_state[up] if up >= 0 and built.length[up] >= self.window else v
        found: dict[int, set] = {}
        whole: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
        for item, s in zip(ids, sequences, strict=True):
            state, last = 0, -1
            for letter in s:
                state = built.next[state][letter]
                at = window_state[state]
                if at >= 0 and at != last:
                    found.setdefault(at, set()).add(item)
                    last = at
            if 0 < len(s) < self.window:
                whole.setdefault(state, []).append((len(s), item))
        # Most windows belong to one item, so equal sets of items are kept once.
        sets: dict[frozenset, int] = {}
        in_state = {v: sets.setdefault(frozenset(found[v]), len(sets)) for v in found}
        self._sets = list(sets)
        #: For each state the set of items with the window that ends there (-1: none).
        self._window_set = array("i", [in_state.get(v, -1) for v in window_state])
        #: Short items that end in a state, and the nearest such state up the links.
        self._whole = whole
        up_to = [-1] * n
        for v in by_length:
            up = built.link[v]
            up_to[v] = v if v in whole else (up_to[up] if up >= 0 else -1)
        self._whole_up = array("i", up_to)

    def _step(self, state: int, letter: int) -> int:
        """The state that a letter leads to (none: -1)."""
        key = state * self._letters + letter
        at = bisect_left(self._edges, key)
        return self._targets[at] if at < len(self._edges) and self._edges[at] == key else -1

    def stream(self, letters: list[int], offset: int, covered: np.ndarray, found: set) -> None:
        """Mark hit words of one run of known words in ``covered``."""
        step, link, length, window, whole_up = self._step, self._link, self._length, self.window, self._whole_up
        state = matched = 0
        for i, letter in enumerate(letters, offset + 1):
            to = step(state, letter)
            while to < 0 and state:
                state = link[state]
                matched = length[state]
                to = step(state, letter)
            state = max(to, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                covered[i - window: i] = True
                found.update(self._sets[self._window_set[state]])
            up = whole_up[state]
            while up > 0:
                for size, item in self._whole[up]:
                    if size <= matched:
                        covered[i - size: i] = True
                        found.add(item)
                up = whole_up[link[up]]


class _Builder:
    """The automaton while it grows."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, letters: list[int]) -> None:
        last = 0
        for letter in letters:
            last = self._extend(last, letter)

    def _state(self, length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(out)
        return len(self.length) - 1

    def _split(self, p: int, q: int, letter: int) -> int:
        """The state of the strings of ``q`` that extend ``p`` by the letter."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(letter) == q:
            self.next[p][letter] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, letter: int) -> int:
        if letter in self.next[last]:
            return self._split(last, self.next[last][letter], letter)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and letter not in self.next[p]:
            self.next[p][letter] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][letter], letter)
        return new


def _runs(marks: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of true values of at least the given length."""
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= least
    yield from zip(starts[long].tolist(), stops[long].tolist(), strict=True)


def _match(shared: list[Broadcast], text_at: int, cut: tuple[int, float] | None = None):
    """Add what some automata find to the last column, the hits.

    With ``cut`` the hits are applied at once and the column goes, so that the
    texts pass through one Python worker only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for first, stop, data, bounds in tk.chunks(batch.column(text_at)):
                words = tk.scan(data, bounds, tk.ALNUM, lower=True)
                hashes = tk.hashes(data, words)
                covered = np.zeros(len(hashes), dtype=bool)
                # A document's end is a break, like an unknown word.
                found: dict[int, set] = {}
                for automaton in (s.value for s in shared):
                    vocabulary = automaton.vocabulary
                    at = np.searchsorted(vocabulary, hashes)
                    known = at < len(vocabulary)
                    known[known] = vocabulary[at[known]] == hashes[known]
                    for a, b in _runs(known, automaton.shortest):
                        doc = int(np.searchsorted(words.first, a, side="right")) - 1
                        while a < b:
                            end = min(b, int(words.first[doc + 1]))
                            if end - a >= automaton.shortest:
                                automaton.stream(at[a:end].tolist(), a, covered, found.setdefault(doc, set()))
                            a, doc = end, doc + 1
                for i in range(stop - first):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    old = before[first + i]
                    spans, items = [], set()
                    if found.get(i):
                        items = {x for ids in found[i] for x in ids}
                        spans = [(s, e) for s, e in _runs(covered[a:b], 1)]
                    if old is not None:
                        items |= set(old["items"])
                        if old["spans"]:
                            both = np.zeros(b - a, dtype=bool)
                            for s, e in [*spans, *((x["first"], x["last"] + 1) for x in old["spans"])]:
                                both[s:e] = True
                            spans = list(_runs(both, 1))
                    begin = int(bounds[i])
                    out.append({
                        "n_words": b - a,
                        "spans": [{"first": s, "last": e - 1, "start": int(words.starts[a + s]) - begin, "stop": int(words.ends[a + e - 1]) - begin} for s, e in spans],
                        "items": sorted(items),
                    })
            if cut is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, _HITS_ARROW)], names=batch.schema.names)
            else:
                yield _without_hits(batch, text_at, out, *cut)

    return run


def _without_hits(batch: pa.RecordBatch, text_at: int, hits: list[dict], max_words: int, max_share: float) -> pa.RecordBatch:
    texts, keep = batch.column(text_at).to_pylist(), []
    for i, row in enumerate(hits):
        total = sum(s["last"] - s["first"] + 1 for s in row["spans"])
        keep.append(total <= max_share * row["n_words"])
        long = [s for s in row["spans"] if s["last"] - s["first"] + 1 > max_words]
        if long and keep[-1]:
            raw, pieces, at = texts[i].encode(), [], 0
            for s in long:
                pieces.append(raw[at: s["start"]])
                at = s["stop"]
            texts[i] = b"\n".join([*pieces, raw[at:]]).decode()
    columns = batch.columns[:-1]
    columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, cut: tuple[int, float] | None = None) -> DataFrame:
    """``docs`` with a last column of hits: word count, hit spans and items.

    The column is named ``__hits``, with more underscores if ``docs`` has that.
    Spans are maximal runs of hit words, with byte offsets in the text.  With
    ``cut`` (see :func:`decontaminate`) ``docs`` without its hits instead.
    """
    spark = docs.sparkSession
    # Items of one text are one sequence, with all their ids.
    items = items.groupBy(F.col(item_text).alias("text")).agg(F.sort_array(F.collect_set(F.col(item_id).cast("string"))).alias("ids"))
    chars = items.agg(F.sum(F.length("text") + 16 * F.size("ids"))).first()[0] or 0
    parts = max(1, -(-chars // MAX_ITEM_CHARS))
    work = None
    name = "__hits"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    out = docs.select("*", F.lit(None).cast(_HITS).alias(name))
    items = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    for first in range(0, parts, PARTS_HELD):
        shared = []
        for part in range(first, min(first + PARTS_HELD, parts)):
            rows = items.where(F.col("part") == part).collect()
            shared.append(spark.sparkContext.broadcast(Automaton([(tuple(r.ids), r.text) for r in rows], window)))
        final = first + PARTS_HELD >= parts
        last = cut if final else None
        out = out.mapInArrow(tk.trimmed(_match(shared, docs.columns.index(text_col), last)), docs.schema if last else out.schema)
        if not final:
            # One Python worker for each slot, however many passes there are.
            work = work or Workspace(spark, "decontam")
            out = work.stage(out, "hits")
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Per row: ``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)``."""
    hits = find_hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, "text", window=window)
    n_hit = F.aggregate("__hits.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return hits.select(F.col("id").alias(id_col), F.col("__hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__hits.items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("__hits.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW_WORDS, max_words: int = 0, max_share: float = 0.1) -> DataFrame:
    """``docs`` without benchmark passages, all other columns as they were.

    Hit spans of more than ``max_words`` words are cut from the text, leaving
    a line break; rows with more than ``max_share`` of their words hit go.
    """
    return find_hits(docs, items, text_col, window=window, cut=(max_words, max_share))
