"""Vectorised word and n-gram hashing over Arrow string batches.

A word is a maximal run of bytes other than space and 0x09-0x0D. In UTF-8 these
six separators occur only as themselves, so splitting bytes equals splitting
characters. Hashes are 64-bit polynomial sums passed through a finaliser; all
constants come from one seed, so every task and every retry agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INV = pow(_BASE, -1, 2**64)
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """base**i mod 2**64 for i < n; the table is kept and only grows."""
    have = cache.get(base)
    if have is None or len(have) < n:
        m = max(n, SLICE_BYTES + 64)
        have = np.full(m, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if m <= 4 * SLICE_BYTES:
            cache[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of a run of texts: byte bounds, hash, and the first word of each text."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        n = len(data)
        word = ~_IS_SEP[data]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        before[edges] = False
        self.data = data
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
            inner = edges[edges > 0]
            after[inner - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words of text i: first[i]..first[i+1]
        self.hashes = None
        if hashed:
            total = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[data] * _powers(_BASE, n), out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * _powers(_INV, n)[self.starts] if n else np.zeros(0, U64))

    def __len__(self) -> int:
        return len(self.starts)


def slices(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of about SLICE_BYTES: (from row, to row, bytes, offsets from 0). Null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    _, offs, buf = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes (also across texts: mask with gram_ok)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    q = U64((0x9E3779B97F4A7C15 + 2 * salt * 0xD1342543DE82EF95) % 2**64 | 1)
    g = h[:m].copy()
    for j in range(1, k):
        g *= q
        g += h[j : j + m]
    return mix(g + U64(salt))


def text_of(first: np.ndarray, n_words: int) -> np.ndarray:
    """For each word, the index of its text."""
    out = np.zeros(n_words + 1, np.int64)
    np.add.at(out, first[1:-1], 1)
    return np.cumsum(out[:-1])


def spans_inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Starts of all k-word spans that lie in one text."""
    t = text_of(first, n_words)
    m = n_words - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(t[:m] == t[k - 1 :])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
