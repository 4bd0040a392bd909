"""Whole texts as byte arrays inside Arrow tasks: words, shingles and their 64-bit hashes without a loop over words.

A batch is cut into pieces of about ``PIECE`` bytes (a longer text is a piece of its own), so temporary arrays stay small whatever
the batch holds. Hashes are the same on every machine: the byte table comes from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
SEED = 20_240_501

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_STRETCH = 2 * PIECE  # bytes that are hashed at once; longer texts and words take several turns
_UP, _DOWN = _powers(_BASE, _STRETCH + 1), _powers(_INVERSE, _STRETCH + 1)


def lowered() -> np.ndarray:
    """Byte table that maps A-Z to a-z and leaves the rest."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def table(keep) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


@dataclass
class Piece:
    """Some texts as one byte array; ``starts`` has one more entry than there are texts."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Pieces of a string column; a null text counts as empty."""
    if len(texts) == 0:
        return
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Piece(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a piece: byte spans, 64-bit hashes and, for each text, where its words begin."""

    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(piece: Piece, is_word: np.ndarray, fold: np.ndarray) -> Words:
    """Maximal runs of word bytes inside each folded text, hashed."""
    n = len(piece.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(piece) + 1, np.int64))
    inside = is_word[fold[piece.data]]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[piece.starts[:-1][piece.starts[:-1] < n]] = False
    begin = np.flatnonzero(inside & ~before)
    stop = np.ones(n, bool)
    stop[:-1] = ~inside[1:]
    stop[piece.starts[1:][piece.starts[1:] > 0] - 1] = True
    end = np.flatnonzero(inside & stop) + 1
    hashes = mix(_sums(piece.data, fold, begin, end) + (end - begin).astype(np.uint64))
    return Words(begin, end, hashes, np.searchsorted(begin, piece.starts))


def _sums(data: np.ndarray, fold: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of byte codes times powers of the base over each word; the arrays stay small however long the text or a word is."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        first = begin[at]
        stop = max(at + 1, int(np.searchsorted(end, first + _STRETCH, "right")))
        if end[at] - first > _STRETCH:
            value, scale = 0, 1
            for k in range(first, end[at], _STRETCH):
                part = _BYTES[fold[data[k:min(k + _STRETCH, end[at])]]]
                value = value + int(np.sum(part * _UP[:len(part)])) * scale & (1 << 64) - 1
                scale = scale * int(_UP[len(part)]) & (1 << 64) - 1
            out[at] = value
        else:
            part = _BYTES[fold[data[first:end[stop - 1]]]]
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(part * _UP[:len(part)], out=total[1:])
            b, e = begin[at:stop] - first, end[at:stop] - first
            out[at:stop] = (total[e] - total[b]) * _DOWN[b]
        at = stop
    return out


def windows(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of ``length`` words fits inside its text, and the windows' hashes."""
    m = len(w.hashes) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(length):
        out *= _BASE
        out += w.hashes[j:j + m]
    fits = np.ones(m, bool)
    inner = w.bounds[1:-1]
    for back in range(1, length):
        at = inner - back
        fits[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(fits)
    return at, mix(out[at] + np.uint64(length))


def shingles(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of every text and, for each text, where its shingles begin; a shorter text is one shingle of all its words."""
    at, hashes = windows(w, length)
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(1, length):
            pick = counts[short] == k
            first = w.bounds[short[pick]]
            h = np.zeros(int(pick.sum()), np.uint64)
            for j in range(k):
                h = h * _BASE + w.hashes[first + j]
            extra[pick] = mix(h + np.uint64(k))
        at = np.concatenate([at, w.bounds[short]])
        hashes = np.concatenate([hashes, extra])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    return hashes, np.searchsorted(at, w.bounds)


def members(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of every ``x`` in ``sorted_values``, -1 where absent."""
    if len(sorted_values) == 0 or len(x) == 0:
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


class Sieve:
    """Bit table of 2**bits entries in front of an exact membership test: most absent values never reach the search."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.values = np.unique(values)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[(self.values * _SPREAD >> self.shift).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``x`` holds a known value, and the position of that value."""
        near = np.flatnonzero(self.marks[(x * _SPREAD >> self.shift).astype(np.int64)])
        at = members(self.values, x[near])
        return near[at >= 0], at[at >= 0]
