"""Word and shingle hashes of many texts at a time, in whole-array steps.

A word's hash is a polynomial in its bytes, each mapped to a random 64-bit value, modulo 2**64, then mixed. It depends on
the word alone: not on its place, its document, the batch or the process.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.Generator(np.random.PCG64(20_24)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, _SEGMENT) + 1, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _segment(data: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * down[first])


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last byte of each run of ``solid`` bytes within a text."""
    if not len(solid):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(solid))]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[inner] |= solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of byte spans in ascending order, in segments of about a megabyte cut between spans."""
    values = _FOLDED if fold else _BYTES
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + _SEGMENT, "right")))
        base = first[at]
        out[at:to] = _segment(data[base : last[to - 1]], first[at:to] - base, last[at:to] - base, values)
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` and, for each text, where its words begin (one more entry than texts).

    ``fold`` lower-cases A-Z.
    """
    first, last = spans(~_SPACE[data], offsets)
    return hash_spans(data, first, last, fold), np.searchsorted(first, offsets)


def one(text: str) -> int:
    """The hash of one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])


_PLACES = np.random.Generator(np.random.PCG64(55)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    hashes, at = words(data, offsets)
    n = len(hashes)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        full += hashes[i : n - k + 1 + i] * _PLACES[i] if len(full) else full
    full = mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = full[a : b - k + 1].copy()
            x.sort()
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((hashes[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
