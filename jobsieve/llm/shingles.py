"""Word shingles and MinHash signatures in numpy, one Arrow slice of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240607)
#: one random 64-bit value per byte, A-Z mapped like a-z; white space marks word ends
_BYTE = _RNG.integers(1, 2**64, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_STEP = _U(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(32))
    h = h * _STEP
    h ^= h >> _U(29)
    h = h * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and per text the number of its first word (one longer)."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    size = 1 << max(int(len(raw)).bit_length(), 21)
    up, down = _powers(size)
    gap = _SPACE[raw]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=total[1:])
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mix((total[ends] - total[starts]) * down[starts])
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return words, np.searchsorted(starts, offsets[:len(texts) + 1])


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text: the sorted distinct 64-bit hashes of its ``width``-word shingles; fewer words are one shingle, a
    text without words has none."""
    words, first = word_hashes(texts)
    whole = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        whole = whole * _STEP + words[j:j + len(whole)]
    whole = mix(whole + _U(width))
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif n:
            h = _U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _STEP + w
                out.append(mix(np.array([h + _U(n)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``size`` 32-bit permutations."""
    rng = np.random.default_rng(4242)
    return rng.integers(0, 2**32, size=size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, size=size, dtype=np.uint32)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash signature (32-bit minima) of a non-empty set."""
    a, b = family
    x = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        y = np.multiply.outer(a, x[i:i + 1024])
        y += b[:, None]
        np.minimum(low, y.min(axis=1), out=low)
    return low


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit hash of every band of ``rows`` consecutive minima (``rows`` even), salted by the band's number."""
    n, k = signatures.shape
    pairs = np.ascontiguousarray(signatures).view(np.uint64).reshape(n, k // rows, rows // 2)
    h = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _STEP, (n, k // rows)).copy()
    for j in range(rows // 2):
        h = mix(h ^ pairs[:, :, j])
    return h
