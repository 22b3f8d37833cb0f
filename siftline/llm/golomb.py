"""Golomb-Rice codes of sorted integers, for lists of fingerprints that travel between partitions.

A list is coded as gaps: each gap's low bits as they are, its high part in unary. With the low bits
chosen from the mean gap, n evenly spread values below a range R take about log2(R / n) + 1.5 bits
each. Equal values are gaps of zero. Coding and decoding are array operations.
"""

from __future__ import annotations

import numpy as np


def low_bits(n: int, reach: int) -> int:
    """The width of a gap's low part for n values below reach."""
    return max(0, (reach // max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray, reach: int) -> bytes:
    """Sorted values in [0, reach), reach at most 2^63; the decoder is told their number and reach."""
    n = len(values)
    if not n:
        return b""
    k = low_bits(n, reach)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(np.r_[low.ravel(), unary]).tobytes()


def decode(code: bytes, n: int, reach: int) -> np.ndarray:
    """The n values as unsigned 64-bit integers."""
    if not n:
        return np.zeros(0, np.uint64)
    k = low_bits(n, reach)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    low = (bits[: n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    ends = np.flatnonzero(bits[n * k :])[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)
