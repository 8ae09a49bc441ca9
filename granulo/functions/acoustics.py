"""Acoustic scales as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulo.functions.tables import BARK_EDGES

TONE_DB, NOISE_DB = 14.5, 5.5


def bark(hz: Column) -> Column:
    return 13.0 * F.atan(0.00076 * hz) + 3.5 * F.atan((hz / 7500.0) * (hz / 7500.0))


def spread_db(dz: Column) -> Column:
    x = dz + 0.474
    return 15.81 + 7.5 * x - 17.5 * F.sqrt(1.0 + x * x)


def line_hz(k: Column, rate: int, lines: int = 576) -> Column:
    return (k + 0.5) * float(rate) / float(2 * lines)


def partition(hz: Column) -> Column:
    """The critical band of a frequency: edges below it, the last band taking all above."""
    return F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in BARK_EDGES]), lambda e: e < hz)), F.lit(len(BARK_EDGES) - 1))


def hann(n: Column, size: int) -> Column:
    return 0.5 * (1.0 - F.cos(2.0 * math.pi * n / float(size - 1)))


def gain_step(gain: Column) -> Column:
    return F.pow(F.lit(2.0), (gain - 210) / 4.0)


def mask_ratio(quality: Column) -> Column:
    return F.pow(F.lit(10.0), (30.0 - F.least(quality, F.lit(9)) / 9.0 * 24.0) / 10.0)


def model_gain(quality: Column) -> Column:
    return F.pow(F.lit(10.0), (30.0 - F.least(quality, F.lit(9)) / 9.0 * 30.0) / 10.0)


def db(ratio: Column) -> Column:
    return 10.0 * F.log10(ratio)
