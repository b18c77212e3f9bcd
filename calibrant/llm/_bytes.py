"""Vectorised hashing of the words of one UTF-8 text."""

from __future__ import annotations

import numpy as np

#: ASCII white space: tab to carriage return, and the space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_random = np.random.RandomState(20240229)
_TABLE = _random.randint(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.empty(0, np.uint64)
_inverses = np.empty(0, np.uint64)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _powers = np.concatenate([one, np.cumprod(np.full(size, _BASE))])
        _inverses = np.concatenate([one, np.cumprod(np.full(size, _U(_inverse(int(_BASE)))))])
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end bytes of the words between white space."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``values[begin:end]``; equal runs have equal ones."""
    power, inverse = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
    return mix((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order."""
    begins, ends = word_places(text)
    return range_hashes(_TABLE[np.frombuffer(text, np.uint8)], begins, ends)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    begins = np.arange(n)
    return range_hashes(hashes, begins, begins + size)
