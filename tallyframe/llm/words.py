"""Words of many texts at once: spans and 64-bit hashes as numpy arrays.

Texts arrive as Arrow string arrays.  Their UTF-8 bytes are read in place, in
pieces of about ``PIECE`` bytes (one text at least), so that the memory of a task
does not follow the size of an Arrow batch.  No per-word Python code runs.

Hashes are polynomials over mixed byte codes (words) or mixed word hashes
(windows), taken from running sums, so any window length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE`` and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_table(matches: bytes | str) -> np.ndarray:
    """A lookup table over byte values: true for those given."""
    out = np.zeros(256, bool)
    out[list(matches.encode() if isinstance(matches, str) else matches)] = True
    return out


BLANK = byte_table(b"\t\n\v\f\r ")
# all ASCII but digits and letters
NOT_ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Piece:
    """Consecutive texts: their bytes, and the first byte of each (and the end)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Cut an Arrow string array into pieces; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), n)
        bounds = offsets[start : end + 1]
        yield Piece(start, data[bounds[0] : bounds[-1]], bounds - bounds[0])
        start = end


@dataclass
class Words:
    """Words of a piece in text order: text number, first byte, end byte."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self, texts: int) -> np.ndarray:
        return np.bincount(self.text, minlength=texts).astype(np.int64)

    def firsts(self, texts: int) -> np.ndarray:
        """Number of the first word of each text, and of all words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts(texts))])


def split(piece: Piece, blank: np.ndarray = BLANK, kinds: np.ndarray | None = None) -> Words:
    """Words are runs of bytes outside ``blank``; with ``kinds``, of one kind each."""
    kind = (~blank[piece.data]).astype(np.uint8) if kinds is None else kinds[piece.data]
    change = np.empty(len(kind) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[piece.bounds] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    inside = kind[start] > 0 if len(kind) else np.zeros(0, bool)
    if not len(kind):
        start = end = np.zeros(0, np.int64)
    start, end = start[inside], end[inside]
    return Words(np.searchsorted(piece.bounds, start, side="right") - 1, start, end)


def hashes(data: np.ndarray, words: Words, fold: np.ndarray | None = None) -> np.ndarray:
    """A hash per word, equal for equal bytes (after ``fold``, a table over bytes)."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    codes = _CODES if fold is None else _CODES[fold]
    np.cumsum(codes[data] * power[:-1], out=total[1:])
    h = (total[words.end] - total[words.start]) * inverse[words.start]
    return mix(h + (words.end - words.start).astype(np.uint64))


def windows(word_hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``width`` words from each word on, and whether it stays in its text."""
    n = len(word_hashes)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * power[:-1], out=total[1:])
    at = np.arange(n)
    end = np.minimum(at + width, n)
    h = mix((total[end] - total[:-1]) * inverse[:-1] + np.uint64(width))
    last = np.repeat(firsts[1:], np.diff(firsts))
    return h, at + width <= last
