"""Words and word windows of whole Arrow text columns as numpy arrays.

A text column is read as one UTF-8 buffer. All separators are ASCII, so words are found on bytes. A word's 64-bit hash comes
from prefix sums of a polynomial, which makes the cost per byte constant however long a word or a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93  # odd multiplier of word windows
CHUNK = 2 << 20  # bytes of text worked on at once; a longer text is taken alone

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
WORD_LIKE = np.zeros(256, bool)
WORD_LIKE[48:58] = WORD_LIKE[97:123] = WORD_LIKE[128:] = True

_powers = {b: np.ones(1, U64) for b in (BASE, BASE_INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept for the chunk size, made anew for a single longer text."""
    if len(_powers[base]) >= n:
        return _powers[base][:n]
    m = max(n, CHUNK + 1)
    out = np.full(m, base, U64)
    out[0] = 1
    np.cumprod(out, out=out)
    if m == CHUNK + 1:
        _powers[base] = out
    return out[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finalizer that spreads every bit; another seed gives another hash."""
    h = h + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """The words of texts ``lo`` … ``hi - 1`` of a column; ``offsets[i]`` … ``offsets[i + 1] - 1`` are those of text lo + i."""

    lo: int
    hi: int
    data: np.ndarray  # bytes, lower-cased if asked for
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of the given byte ranges."""
        starts, ends = self.starts if starts is None else starts, self.ends if ends is None else ends
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(BASE, len(self.data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(self.data) + 1)[starts]
        return mix(h + (ends - starts).astype(U64) * U64(STEP))

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode()

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The (kept) words of text ``lo + i``, joined by one space."""
        a, b = self.offsets[i], self.offsets[i + 1]
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        size = e - s + 1
        at = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[np.cumsum(size) - 1] = 32
        return out[:-1].tobytes()


def word_chunks(column: pa.Array, is_word: np.ndarray = NON_SPACE, lower: bool = False) -> Iterator[Words]:
    """The words of a string column, some texts at a time. A null text has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, "right")) - 1)
        hi = min(hi, n)
        data, at = whole[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        if lower:
            data = LOWER[data]
        inside = is_word[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < len(data)]] = False
        if len(data):
            after[at[1:] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield Words(lo, hi, data, starts, ends, np.searchsorted(starts, at))
        lo = hi


def window_hashes(h: np.ndarray, k: int, step: int = STEP) -> np.ndarray:
    """Hashes of all windows of ``k`` neighbours, by doubling. Windows over text borders are to be left out by the caller."""
    if len(h) < k:
        return np.zeros(0, U64)
    out, done, cur, size, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            if out is None:
                out = cur
            else:
                m = len(h) - (done + size) + 1
                out = out[:m] * U64(pow(step, size, 1 << 64)) + cur[done:done + m]
            done += size
        rest >>= 1
        if rest:
            m = len(cur) - size
            cur = cur[:m] * U64(pow(step, size, 1 << 64)) + cur[size:size + m]
            size *= 2
    return mix(out[:len(h) - k + 1])


def window_starts(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``k`` words lies inside one text, and the number of such windows of each text."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(counts.sum()), counts


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the (rightmost) least value in each window of ``w`` neighbours."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    idx, size = np.arange(len(v)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(v[b] <= v[a], b, a)

    while size * 2 <= w:
        m = len(v) - 2 * size + 1
        idx = better(idx[:m], idx[size:size + m])
        size *= 2
    return better(idx[:n], idx[w - size:w - size + n])
