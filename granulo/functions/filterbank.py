"""The 32-band filter bank: its 512-value window by a rule, and its steps over arrays.

The prototype is a Kaiser-windowed low pass whose cut-off makes the bank reconstruct best (the autocorrelation vanishes at
multiples of 64). The standard's own window differs from it in the stop band; who needs that one passes it as ``window``
(512 values, in the standard's order and with its signs, as D: 32 times the analysis window).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BANDS, STEPS, TAPS = 32, 18, 512
#: Stop-band attenuation of the prototype in dB.
ATTENUATION = 100.0
SIGNS = np.where(np.arange(TAPS) // 64 % 2 == 0, 1.0, -1.0)
#: Sub-band samples to the synthesis vector (64 by 32) and 64 folded values to sub-bands (32 by 64).
SYNTHESIS = np.cos((16 + np.arange(64))[:, None] * (2 * np.arange(BANDS) + 1) * np.pi / 64)
ANALYSIS = np.cos((2 * np.arange(BANDS)[:, None] + 1) * (np.arange(64) - 16) * np.pi / 64)


def _low_pass(cutoff: float) -> np.ndarray:
    n = np.arange(TAPS) - TAPS // 2
    h = np.sinc(n * cutoff / np.pi) * np.r_[0.0, np.kaiser(TAPS - 1, 0.1102 * (ATTENUATION - 8.7))]
    return h / np.sqrt((h * h).sum())


def _ripple(cutoff: float) -> float:
    h = _low_pass(cutoff)
    return max(abs(h[: TAPS - lag] @ h[lag:]) for lag in range(64, TAPS, 64))


@lru_cache(maxsize=1)
def prototype() -> np.ndarray:
    """The low pass of least ripple, by ternary search over its cut-off, scaled so that the bank has unit gain."""
    low, high = 0.9 * np.pi / 64, 1.4 * np.pi / 64
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if _ripple(a) < _ripple(b) else (a, high)
    return _low_pass((low + high) / 2) / 4  # 1/4: energy of the analysis window that gives the bank unit gain


def synthesis_window(window: list[float] | None = None) -> np.ndarray:
    if window is None:
        return 32 * prototype() * SIGNS
    if len(window) != TAPS:
        raise ValueError("the synthesis window has 512 values")
    return np.asarray(window, float)


def analysis(pcm: np.ndarray, window: list[float] | None = None) -> np.ndarray:
    """Granules of samples with the 576 before them (rows of 1152) to sub-bands: granules by 32 by 18."""
    c = synthesis_window(window) / 32
    ends = TAPS + 64 + BANDS * (np.arange(STEPS) + 1)  # 576 + 32 (t + 1)
    z = pcm[:, ends[:, None] - 1 - np.arange(TAPS)] * c
    return np.einsum("ki,gti->gkt", ANALYSIS, z.reshape(len(pcm), STEPS, 8, 64).sum(2))


def synthesis(subbands: np.ndarray, window: list[float] | None = None) -> np.ndarray:
    """Sub-bands of granules with the granule before (granules by 32 by 36) to 576 samples each."""
    d = synthesis_window(window).reshape(16, BANDS)
    v = np.einsum("ik,gkt->gti", SYNTHESIS, subbands)
    out = np.zeros((len(subbands), STEPS, BANDS))
    for i in range(16):
        half = v[:, STEPS - i : 2 * STEPS - i, :BANDS] if i % 2 == 0 else v[:, STEPS - i : 2 * STEPS - i, BANDS:]
        out += d[i] * half
    return out.reshape(len(subbands), STEPS * BANDS)
