"""Words of a text as arrays of 64-bit hashes, worked out a whole text at a time with NumPy.

Words are runs of anything but space and the five control characters from tab to carriage
return. Hashes depend on the bytes alone, so every executor and every run agrees on them.
"""

from __future__ import annotations

import numpy as np

# Texts are hashed in stretches of about this many bytes, so that the work arrays stay small.
STRETCH = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _MULTIPLIER)]), dtype=np.uint64)
    return _powers[:n]


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def _stretches(data: bytes):
    """The text cut after white space, in stretches of about STRETCH bytes."""
    at = 0
    while len(data) - at > STRETCH:
        end = at + STRETCH
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def hashes(data: bytes) -> np.ndarray:
    """One uint64 per word."""
    found = []
    for part in _stretches(data):
        starts, ends = bounds(part)
        if not len(starts):
            continue
        sizes = ends - starts
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        at = np.arange(len(inside)) + inside
        values = _BYTE_KEYS[np.frombuffer(part, np.uint8)[at]] * _power(int(sizes.max()))[at - np.repeat(starts, sizes)]
        sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        found.append(mix(sums + sizes.astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``k`` words; ``seed`` chooses the function.

    Runs are put together from runs of 1, 2, 4, ... words: ``h(a + b) = h(a) * f**b + h(b)``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    f = (0xD1B54A32D192ED03 * (2 * seed + 1)) & (2**64 - 1) | 1
    done, out, size, double = 0, None, 1, words
    while True:
        if k & size:
            part = double[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(f, size, 2**64)) + part
            done += size
        if size * 2 > k:
            break
        double = double[: len(double) - size] * np.uint64(pow(f, size, 2**64)) + double[size:]
        size *= 2
    return mix(out + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(h).view(np.int64)
