"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20260101)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, n of them at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and where each text's words start (n + 1)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _grown(len(data) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[last] - total[first]) * down[first]
    return mix(h ^ (last - first).astype(np.uint64) * _PLACE[-1]), np.concatenate([[0], np.searchsorted(first, ends)])


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; a text with fewer words is one shingle, without words none."""
    h, at = word_hashes(texts)
    grams = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words if len(grams) else 0):
        grams += h[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams)
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= words:
            x = np.sort(grams[a : z - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif z > a:
            out.append(mix((h[a:z] * _PLACE[: z - a]).sum(keepdims=True) ^ np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
