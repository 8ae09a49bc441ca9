"""Counts of bytes and of neighbouring bytes over segments of many texts, in whole-array steps."""

from __future__ import annotations

import numpy as np


def table(*chosen) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chosen:
        out[list(c) if isinstance(c, bytes) else c] = True
    return out


UPPER, LOWER, DIGIT = table(range(65, 91)), table(range(97, 123)), table(range(48, 58))
HIGH = table(range(128, 256))
LETTER = UPPER | LOWER | HIGH
SYMBOL = table(b"#*$%&|<>@^~_=+\\")
PUNCTUATION = table(b".,;:!?'\"()-")
BLANK = table([0x20, *range(0x09, 0x0E)])


def upper_mask(data: np.ndarray) -> np.ndarray:
    """Capitals A-Z and the accented ones of Latin-1."""
    out = UPPER[data]
    if len(data) > 1:
        out[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return out


#: Bytes that are summed, or masked, at a time: what a long text takes beside its masks does not grow with it.
SEGMENT = 1 << 20


def sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds between consecutive ``bounds``."""
    out = np.zeros(max(len(bounds) - 1, 0), np.int64)
    for start in range(0, len(mask), SEGMENT):
        part = mask[start : start + SEGMENT]
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(part, out=total[1:])
        out += np.diff(total[np.clip(bounds - start, 0, len(part))])
    return out


def shifted(values: np.ndarray, k: int, offsets: np.ndarray) -> np.ndarray:
    """``values`` k places further on in the same text; 0 or False where the text has no such place."""
    out = np.zeros_like(values)
    size, n = np.diff(offsets), len(values)
    if k > 0:
        out[: max(n - k, 0)] = values[k:]
    else:
        out[-k:] = values[: max(n + k, 0)]
    for d in range(abs(k)):  # the |k| last, or first, places of each text
        some = size > d
        out[(offsets[1:][some] - 1 - d) if k > 0 else (offsets[:-1][some] + d)] = 0
    return out
