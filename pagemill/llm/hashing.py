"""Hashes of many words or byte strings at once, with NumPy."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SHIFT, _FACTOR = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        values = np.full(size, base, np.uint64)
        values[0] = 1
        both.append(np.cumprod(values))
    return both[0], both[1]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _FACTOR
    return values ^ (values >> _SHIFT)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and inverse powers d: ``(s[j] - s[i]) * d[i]`` identifies the bytes i to j."""
    up, down = powers(1 << max(1, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (a run without ASCII white space) in order, and how many each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = SPACE[data]
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums, down = prefix_sums(LOWER[data] if lower else data)
    hashes = mixed((sums[stops] - sums[starts]) * down[starts])
    ends = np.cumsum(np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts)))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


#: Runs of letters and digits (1), of other signs (2), and white space (0).
_KIND = np.array([0 if SPACE[b] else 1 if chr(b).isalnum() or b >= 0x80 or b == ord("_") else 2 for b in range(256)], np.int8)


def run_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of letters and digits or of other signs, in order, and how many each text has."""
    data = np.frombuffer(b"".join(text + b" " for text in texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    kind = _KIND[data]
    edges = np.flatnonzero(np.diff(kind, prepend=0))
    starts = edges[kind[edges] > 0]
    stops = np.append(edges, len(data))[np.searchsorted(edges, starts) + 1]
    sums, down = prefix_sums(data)
    hashes = mixed((sums[stops] - sums[starts]) * down[starts])
    ends = np.cumsum(np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts)))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
