"""Words and their hashes over Arrow string columns, as NumPy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All hashes
depend only on a word's bytes, so any task of any run gives the same value.

Where hashes stand for words (near dedup, substring dedup), each word has the two
halves of its 128-bit XXH3, and runs of words join them pairwise by a mixing that
is not linear, so no family of strings collides by its form. The rolling hashes
modulo 2**64 only choose features of the regression models.

Texts are taken in slices of bounded bytes, but a text is never cut: the arrays
made from one take some twelve times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text is taken in slices of about so many bytes, which bounds the arrays made from it.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: For runs of letters: what parts them, and small letters for capitals (the two-byte ones of Latin-1 too).
_NO_LETTER = ~np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.n - 1, b, np.uint64), dtype=np.uint64)])
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_BYTE = seeded(256, 1)
_POW = _Powers(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Slice:
    """Some rows of a batch: their bytes, and where each row and word starts and ends in them."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # row r has the words first[r] : first[r + 1]
    apart: np.ndarray  # the bytes that part words

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.n_words)

    @cached_property
    def _halves(self) -> np.ndarray:
        """word x 2: the halves of each word's XXH3, taken once for each distinct word."""
        n = len(self.starts)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        inner = self.data[~self.apart[self.data]]
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(inner)])
        coded = words.dictionary_encode()
        digests = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
        return np.frombuffer(digests, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]

    def word_hashes(self, second: bool = False) -> np.ndarray:
        """64 bits of each word's 128-bit hash, or the other 64."""
        return np.ascontiguousarray(self._halves[:, int(second)])

    def rolled_hashes(self) -> np.ndarray:
        """A cheaper hash of each word, for features."""
        up, down = _POW.upto(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
            length = (self.ends - self.starts).astype(np.uint64)
            return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + length)

    def piece_hashes(self, head: int = 0, tail: int = 0) -> np.ndarray:
        """Hash of each word's first ``head`` or last ``tail`` bytes."""
        up, down = _POW.upto(len(self.data) + 1)
        starts = self.starts if head else np.maximum(self.starts, self.ends - tail)
        ends = np.minimum(self.ends, self.starts + head) if head else self.ends
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(1000 + head * 16 + tail))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return low


def slices(texts: pa.Array, limit: int = SLICE_BYTES, letters: bool = False) -> Iterator[Slice]:
    """The rows, some at a time; with letters, words are runs of small letters instead."""
    data, offsets = buffers(texts)
    n, a = len(texts), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        own, apart = (lowered(own), _NO_LETTER) if letters else (own, _SPACE)
        yield Slice(range(a, b), own, at, *_words(own, at, apart), apart)
        a = b


def _words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = parts[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = ~space, ~space
    start[1:] &= space[:-1] | edge[1:-1]
    end[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run of words from the hashes of its two parts."""
    return mix((a << np.uint64(23) | a >> np.uint64(41)) * _JOIN + b)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for positions 0 to len(words) - n: runs of 1, 2, 4, ... words are joined."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    run, size, out, done = words, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                m = len(words) - done - size + 1
                out, done = (run if out is None else _both(out[:m], run[done : done + m])), done + size
            if size * 2 > n:
                return out
            run, size = _both(run[:-size], run[size:]), size * 2


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one and the same row start."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return ranges(first[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, then likewise for the next."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
