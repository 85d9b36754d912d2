"""Vectorised text kernels over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``.  Word and
window hashes are polynomial prefix sums modulo 2**64, so every window costs the
same whatever its length, and no Python object is made per word.  The kernels
work on chunks of half a megabyte of whole texts, which bounds their memory; texts of
many megabytes are cut at white space (``pieces``), and what is counted in the pieces
is put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A little under a power of two, the sizes in which the tables of powers grow.
CHUNK_BYTES = (1 << 19) - 1024

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1

#: True for the six white-space bytes that end a word.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_RAW = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.empty(0, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << (n - 1).bit_length(), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(self.n, b, dtype=U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_STEP)
_BYTES_2, _WORDS_2 = _Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB)
_RAW_2 = mix(np.arange(1, 257, dtype=U64) * U64(0x8EBC6AF09C88C6E3))
#: Items whose sums are made at a time.
STRETCH = 1 << 19


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def chunked(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


def pieces(raw: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """``(row, end row, from byte, to byte)`` of chunks of whole texts, and of the parts of texts of more than two chunks.

    Parts end behind a white-space byte, so no word is cut; a stretch without any stays whole.
    """
    for a, b in chunked(offsets, size):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= 2 * size:
            yield a, b, low, high
            continue
        while low < high:
            cut = min(high, low + size)
            while cut < high:
                near = np.flatnonzero(IS_SPACE[raw[cut - 1 : cut - 1 + size]])
                if len(near):
                    cut += int(near[0])
                    break
                cut = min(high, cut + size)
            yield a, b, low, cut
            low = cut


def word_bounds(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[raw]
    first = np.empty(len(raw), dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(len(raw), dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cut = offsets[:-1]
    first[cut[cut < len(raw)]] = True
    cut = offsets[1:]
    last[cut[cut > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    return starts, np.flatnonzero(last & inside) + 1, np.searchsorted(starts, offsets)


def _polynomials(values: Callable[[int, int], np.ndarray], starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Sum of value times power over each run ``starts:ends`` (both ascending), counted from the run's own start.

    ``values(a, b)`` gives the values of a stretch.  Runs are taken stretch by stretch
    and a run longer than a stretch in parts, so tables and sums stay small however
    long the text is.
    """
    out, a, n = np.empty(len(starts), dtype=U64), 0, len(starts)
    while a < n:
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(starts, low + STRETCH)))
        if b > a + 1 and ends[b - 1] - low > 2 * STRETCH:
            b -= 1
        high = int(ends[b - 1])
        if high - low > 2 * STRETCH:
            total = 0
            for x in range(low, high, STRETCH):
                part = values(x, min(high, x + STRETCH))
                total += int((part * powers.get(len(part))[0]).sum(dtype=U64)) * pow(powers.base, x - low, 1 << 64)
            out[a] = total & _MASK
        else:
            up, down = powers.get(high - low + 1)
            sums = np.empty(high - low + 1, dtype=U64)
            sums[0] = 0
            np.cumsum(values(low, high) * up[: high - low], out=sums[1:])
            begin = starts[a:b] - low
            out[a:b] = (sums[ends[a:b] - low] - sums[begin]) * down[begin]
        a = b
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z; ``second`` gives one independent of the first."""
    table, powers = (_RAW_2, _BYTES_2) if second else (_LOWER if lower else _RAW, _BYTES)
    return mix(_polynomials(lambda a, b: table[raw[a:b]], starts, ends, powers) + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, starts: np.ndarray, n: int | np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the ``n`` words from each start (ascending)."""
    return mix(_polynomials(lambda a, b: words[a:b], starts, starts + n, _WORDS_2 if second else _WORDS))


def window_starts(first: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each window of ``n`` words that lies in one row, and the index of each row's first window."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=begin[1:])
    return np.arange(begin[-1], dtype=np.int64) + np.repeat(first[:-1] - begin[:-1], counts), begin


def _long_set(raw: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one long text, piece by piece; the last words of a piece go on into the next."""
    kept, before = [], np.empty(0, U64)
    for _, _, low, high in pieces(raw, np.array([0, len(raw)])):
        starts, ends, _ = word_bounds(raw[low:high], np.array([0, high - low]))
        words = np.concatenate([before, word_hashes(raw[low:high], starts, ends, lower=True)])
        if len(words) >= n:
            kept.append(np.unique(window_hashes(words, np.arange(len(words) - n + 1), n)))
        before = words[-(n - 1) :] if n > 1 else before
    if not kept:
        return window_hashes(before, np.zeros(1, np.int64), len(before)) if len(before) else before
    return np.unique(np.concatenate(kept))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's lower-cased ``n``-word shingles, and where each row's begin.

    A row of fewer than ``n`` words has its whole sequence as one shingle; a row
    without words has none.
    """
    if len(offsets) == 2 and len(raw) > 2 * CHUNK_BYTES:
        one = _long_set(raw, n)
        return one, np.array([0, len(one)])
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    width = np.clip(np.diff(first), 1, n)
    at, begin = window_starts(first, width)
    hashes = window_hashes(words, at, np.repeat(width, np.diff(begin)))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[begin[:-1][np.diff(begin) > 0]] = True
    sizes = np.zeros(len(begin), np.int64)
    np.cumsum(keep, out=(sums := np.empty(len(hashes), np.int64)))
    sizes[1:] = np.r_[0, sums][begin[1:]]
    return hashes[keep], sizes


def word_counts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Number of words of each row."""
    raw, offsets = texts_of(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b, low, high in pieces(raw, offsets, 4 * CHUNK_BYTES):
        inner = np.clip(offsets[a : b + 1], low, high) - low
        out[a:b] += np.diff(word_bounds(raw[low:high], inner)[2])
    return out
