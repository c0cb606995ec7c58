"""Vectorised word scanning shared by the text operators.

The functions work on the UTF-8 bytes of many texts at once.  A chunk of texts
is one byte array with document bounds; words are maximal runs of bytes that a
256-entry table marks, and never cross a bound.  All separators are ASCII, so
byte tables are exact for UTF-8 text.

Memory is bounded: :func:`chunks` hands out at most ``CHUNK_BYTES`` of text at
a time (one document more if a single document is longer), and a chunk needs
about 40 bytes for each byte of text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Longer words are hashed by their bytes: among long words a polynomial modulo 2**64 has known collisions.
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z lower-cased, every other byte kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

#: Bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def forget() -> None:
    """Give back what this worker keeps from task to task."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back to the machine.

    Workers stay for the next tasks and stages, and the C library keeps what numpy has freed.
    """

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return then


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string array into ``(first, stop, bytes, bounds)`` pieces.

    Null texts appear as empty ones.  ``bounds`` has ``stop - first + 1``
    entries and starts at 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        stop = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        stop = min(n, max(stop, first + 1))
        yield first, stop, data[offsets[first]: offsets[stop]], offsets[first: stop + 1] - offsets[first]
        first = stop


@dataclass
class Words:
    """Words of a chunk in text order."""

    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    first: np.ndarray  #: index of each document's first word, and the word count at the end


def scan(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """Find the words of a chunk; ``table`` marks word bytes."""
    marks = table[LOWER] if lower else table
    inside = marks[data]
    n = len(data)
    opening = inside.copy()
    opening[1:] &= ~inside[:-1]
    closing = inside.copy()
    closing[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    if n:
        opening[heads] = inside[heads]
        closing[tails] = inside[tails]
    starts = np.flatnonzero(opening)
    return Words(starts, np.flatnonzero(closing) + 1, np.searchsorted(starts, bounds))


def hashes(data: np.ndarray, words: Words, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes everywhere."""
    if len(words.starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    letters = (LOWER[data] if lower else data).astype(np.uint64)
    letters += np.uint64(1)
    letters *= powers[: len(data)]
    np.cumsum(letters, out=sums[1:])
    out = mix((sums[words.ends] - sums[words.starts]) * inverse[words.starts])
    for k in np.flatnonzero(words.ends - words.starts > LONG_WORD).tolist():
        raw = data[words.starts[k]: words.ends[k]]
        digest = hashlib.blake2b((LOWER[raw] if lower else raw).tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def shingles(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of one document's shingles in text order, repeats included.

    A document of fewer words has its whole sequence as one shingle; a
    document without words has none.
    """
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    step = constants(width, 17)
    take = min(n, width)
    total = np.zeros(n - take + 1, dtype=np.uint64)
    for k in range(take):
        total += word_hashes[k: n - take + 1 + k] * step[k]
    return mix(total + np.uint64(take))
