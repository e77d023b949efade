"""Vectorised 64-bit hashes of pieces of a byte string."""

from __future__ import annotations

import numpy as np

#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        _powers = tuple(np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, base, dtype=np.uint64))]) for base in (BASE, inverse))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every ``data[start:end]``, from prefix sums of one polynomial."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
