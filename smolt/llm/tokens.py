"""Words of a batch of texts as 64-bit hashes, without Python objects.

Texts are UTF-8; words are runs of bytes other than the ASCII blanks
x20, x09-x0D. A word's hash is a polynomial over a random value per byte,
taken from prefix sums modulo 2**64 and mixed; two different words share a
hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Base of a second hash of the same words.
CHECK_BASE = 0xA24BAED4963EE407
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base, _U)
        x[0] = 1
        have = _powers[base] = np.cumprod(x)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def ranges(values: np.ndarray, base: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of values[lo:hi] for each pair of positions."""
    s = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(base, len(values)), out=s[1:])
    return mix((s[hi] - s[lo]) * powers(inverse(base), len(values) + 1)[lo] + (hi - lo).astype(_U))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a binary or string array; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


class Words:
    """Word positions and hashes of texts ``data[at[i]:at[i+1]]``.

    ``start``/``end`` are byte positions, ``row`` is the first word of each
    text (len + 1 offsets); hashes ignore the case of A-Z if ``lower``.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        solid = ~_BLANK[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        begin, finish = solid.copy(), solid.copy()
        if len(data):
            begin[1:] &= ~solid[:-1] | first[1:-1]
            finish[:-1] &= ~solid[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.row = np.searchsorted(self.start, at)
        self.hash = ranges(_BYTE[_LOWER[data]] if lower else _BYTE[data], BASE, self.start, self.end)

    def grams(self, n: int, base: int = GRAM_BASE) -> np.ndarray:
        """Hash of the n words at each position (only where n words remain
        in the batch; rows are not minded)."""
        lo = np.arange(max(0, len(self.hash) - n + 1))
        return ranges(mix(self.hash + _U(base)) if base != GRAM_BASE else self.hash, base, lo, lo + n)


def text_chunks(at: np.ndarray, most: int = 1 << 19):
    """(lo, hi) of consecutive texts with about ``most`` bytes together."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
