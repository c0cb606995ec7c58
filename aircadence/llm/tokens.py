"""Token ids of whole texts, encoded word by word with a cache.

The tokenizer first lower-cases and splits a text, and no token crosses white
space, so a text's ids are the ids of its pieces between spaces and line feeds,
joined.  Pieces repeat, so each task's Python worker keeps the ids of pieces
it has met, up to ``CACHE_PIECES``, and asks the library for new ones only.
That holds for tokenizers that drop white space, such as ``word_bpe_49k``.
"""

from __future__ import annotations

import os
import re

import numpy as np

from aircadence.llm import textkernel as tk

CACHE_PIECES = 160_000

#: Printable ASCII and Latin-1 without the no-break space: such a piece needs no
#: normal form, and its lower case is that of its characters one by one.
_LATIN = re.compile("[!-~\u00a1-\u00ff]*")
#: The pre-tokenizer's split of a lower-cased piece of these characters.
_LATIN_SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+"
    "|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
    "|[^a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+"
)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies use for each byte: itself where
    it is printable, else the next free one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_PROBES = ("It's", "a1b22", "x--y", "we'll,", "No.1!", "'tis", "_a_", "\u00c9t\u00e9,", "Stra\u00dfe\u00bd\u00bfx\u00b5", "\u00ab\u00e0\u00bb\u00d7\u00ba\u00ad")


def _split_latin(piece: str) -> list[str]:
    parts = _LATIN_SPLIT.findall(piece.lower())
    if piece.isascii():
        return parts
    return [p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS) for p in parts]


class PieceEncoder(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__({"": b""})
        self._tokenizer = Tokenizer.from_file(path)
        #: The greatest id that any text can give, special tokens included.
        self.last_id = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        self._parts: dict[str, bytes] = {}
        # Only a tokenizer with this kind of split takes the short way.
        self._short = all(self._split(x) == _split_latin(x) for x in _PROBES)

    def _split(self, piece: str) -> list[str]:
        normal = self._tokenizer.normalizer.normalize_str(piece)
        return [p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _part(self, part: str) -> bytes:
        known = self._parts.get(part)
        if known is None:
            known = np.array([t.id for t in self._tokenizer.model.tokenize(part)], dtype="<u4").tobytes()
            if len(self._parts) < CACHE_PIECES:
                self._parts[part] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        if "<" in piece:  # may hold a special token's text, which the whole encoder knows
            ids = np.array(self._tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            short = self._short and _LATIN.fullmatch(piece)
            ids = b"".join(map(self._part, _split_latin(piece) if short else self._split(piece)))
        if len(self) < CACHE_PIECES:  # frequent pieces come early, so a full cache stays as it is
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text (null: none)."""
        if not text:
            return np.zeros(0, dtype="<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), dtype="<u4")


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if path not in _encoders:
        tk.forget()
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
