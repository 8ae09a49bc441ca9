"""Spectra in row form (``frame, k, x``): transforms as matrix products over whole frames, butterflies by pairs of lines, permutations by a dimension."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions.tables import ALIAS_C, LONG_BANDS, PRETAB, SHORT_BANDS, dimension, long_bands


#: Frames that are worked on at a time as one matrix.
ROWS = 512


def transformed(rows: DataFrame, size: int, work: Callable[[np.ndarray], list[np.ndarray]], columns: tuple[str, ...]) -> DataFrame:
    """``frame, j`` and ``columns``: ``work`` over matrices of whole frames, a row each of ``size`` values; missing lines are zero.

    Lines come together by frame (of any type) in one shuffle, are worked on as matrices, and go out as rows again.
    """
    frames = rows.groupBy("frame").agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), F.col("x").cast("double").alias("x"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("lines")
                n = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                x = np.zeros((len(n), size))
                x[np.repeat(np.arange(len(n)), n), flat.field("k").to_numpy()] = flat.field("x").to_numpy()
                out = work(x)
                wide = out[0].shape[1]
                frame = part.column("frame").take(pa.array(np.repeat(np.arange(len(n)), wide)))
                yield pa.RecordBatch.from_arrays([frame, pa.array(np.tile(np.arange(wide, dtype=np.int32), len(n))), *(pa.array(np.ascontiguousarray(y).ravel()) for y in out)], names=["frame", "j", *columns])

    kind = frames.schema["frame"].dataType.simpleString()
    return frames.mapInArrow(run, f"frame {kind}, j int, " + ", ".join(f"{c} double" for c in columns))


def mdct_basis(n: int) -> np.ndarray:
    """The transform of ``n`` samples (36 or 12) to n / 2 lines, unnormalised: samples down, lines across."""
    return np.cos(np.pi / (2 * n) * (2 * np.arange(n)[:, None] + 1 + n // 2) * (2 * np.arange(n // 2) + 1))


def mdct(rows: DataFrame, n: int) -> DataFrame:
    """``frame, j, y``: the forward transform of ``n`` windowed samples to n / 2 lines."""
    basis = mdct_basis(n)
    return transformed(rows, n, lambda x: [x @ basis], ("y",))


def imdct(rows: DataFrame, n: int) -> DataFrame:
    """``frame, j, y``: the backward transform of n / 2 lines to ``n`` samples."""
    basis = mdct_basis(n).T
    return transformed(rows, n // 2, lambda x: [x @ basis], ("y",))


def cut(rows: DataFrame, size: int, length: int = 576) -> DataFrame:
    """Frames of ``length`` lines as consecutive frames of ``size``, numbered on from ``frame * (length / size)``."""
    per = -(-length // size)
    return rows.select((F.col("frame") * per + F.floor(F.col("k") / size)).alias("frame"), (F.col("k") % size).alias("k"), "x")


def overlap_add(raw: DataFrame, half: int = 18, step: int = 1) -> DataFrame:
    """``frame, i, y``: the first half of each frame plus the second half of the one before (``raw``: frame, j, y; frames ``step`` apart)."""
    late = raw.where(F.col("j") >= half).select((F.col("frame") + step).alias("frame"), (F.col("j") - half).alias("i"), F.col("y").alias("carry"))
    early = raw.where(F.col("j") < half).select("frame", F.col("j").alias("i"), "y")
    return early.join(late, ["frame", "i"], "left").select("frame", "i", (F.col("y") + F.coalesce("carry", F.lit(0.0))).alias("y"))


def invert_odd(rows: DataFrame, sub: Column) -> DataFrame:
    """Odd samples of odd sub-bands change sign."""
    return rows.withColumn("y", F.when((sub % 2 == 1) & (F.col("i") % 2 == 1), -F.col("y")).otherwise(F.col("y")))


def hann_window(size: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))


def dft(rows: DataFrame, size: int, bins: int | None = None) -> DataFrame:
    """``frame, j, re, im`` of Hann-windowed frames of ``size`` values by a fast transform; the first ``bins`` bins, or all of them."""
    window, bins = hann_window(size), bins or size // 2 + 1

    def work(x: np.ndarray) -> list[np.ndarray]:
        y = np.fft.rfft(x * window, axis=1)[:, :bins]
        return [y.real, y.imag]

    return transformed(rows, size, work, ("re", "im"))


def power(spectrum: DataFrame) -> DataFrame:
    return spectrum.select("frame", "j", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))


def unpredictability(spectrum: DataFrame) -> DataFrame:
    """``frame, j, c``: distance of a bin from the line through the two bins below it, over both magnitudes; 0.5 for the first two."""
    w = Window.partitionBy("frame").orderBy("j")
    c = F.col
    hat = {p: 2 * F.lag(p, 1).over(w) - F.lag(p, 2).over(w) for p in ("re", "im")}
    rows = spectrum.select("frame", "j", "re", "im", hat["re"].alias("hr"), hat["im"].alias("hi"))
    mag = lambda a, b: F.sqrt(a * a + b * b)
    value = mag(c("re") - c("hr"), c("im") - c("hi")) / (mag(c("re"), c("im")) + mag(c("hr"), c("hi")) + 1e-20)
    return rows.select("frame", "j", F.when(c("j") < 2, 0.5).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("c"))


def mid_side(rows: DataFrame) -> DataFrame:
    """``l, r`` rotated to ``m, s``; twice gives the channels back."""
    return rows.withColumns({"m": (F.col("l") + F.col("r")) / math.sqrt(2.0), "s": (F.col("l") - F.col("r")) / math.sqrt(2.0)})


def antialias(rows: DataFrame, size: int = 576) -> DataFrame:
    """Butterflies of the eight lines on both sides of every border between sub-bands of 18 lines.

    A line meets its mirror image in the border: each pair of lines is grouped, and both are computed in one row.
    """
    at = F.col("k") + 8
    border = F.floor(at / 18)
    place = at % 18
    inside = (place < 16) & (border >= 1) & (border < size // 18)
    i = F.when(place >= 8, place - 8).otherwise(7 - place)
    keyed = rows.select("frame", "k", "x", F.when(inside, border).otherwise(-1 - F.col("k")).alias("b"), F.when(inside, i).otherwise(0).cast("int").alias("i"), (inside & (place >= 8)).alias("up"), inside.alias("inside"))
    pairs = keyed.groupBy("frame", "b", "i").agg(F.max(F.when(~F.col("up"), F.struct("k", "x"))).alias("lo"), F.max(F.when(F.col("up"), F.struct("k", "x"))).alias("hi"), F.max("inside").alias("inside"))
    cs = F.get(F.array(*[F.lit(1 / math.sqrt(1 + c * c)) for c in ALIAS_C]), F.col("i"))
    ca = F.get(F.array(*[F.lit(c / math.sqrt(1 + c * c)) for c in ALIAS_C]), F.col("i"))
    a, b = F.col("lo.x"), F.col("hi.x")
    both = F.array(F.struct(F.col("lo.k").alias("k"), (a * cs - b * ca).alias("y")), F.struct(F.col("hi.k").alias("k"), (b * cs + a * ca).alias("y")))
    out = F.when(F.col("inside"), both).otherwise(F.array(F.struct(F.col("lo.k").alias("k"), a.alias("y"))))
    return pairs.select("frame", F.inline(out))


def short_order(rate: int, mixed: bool = False) -> list[tuple[int, int]]:
    """``(from, to)`` places of a short block's lines: window by window within a band, to frequency by frequency."""
    bands = SHORT_BANDS.get(rate, SHORT_BANDS[44100])
    at = LONG_BANDS.get(rate, LONG_BANDS[44100])[8] if mixed else 0
    out = [(i, i) for i in range(at)]
    for b in range(3 if mixed else 0, 13):
        width = bands[b + 1] - bands[b]
        out += [(at + w * width + j, at + 3 * j + w) for w in range(3) for j in range(width) if at + w * width + j < 576 and at + 3 * j + w < 576]
        at += 3 * width
    return out


def reorder_short(rows: DataFrame, rate: int = 44100, back: bool = False) -> DataFrame:
    """Lines moved by a broadcast dimension of 576 rows; ``back`` undoes it."""
    pairs = [(b, a) if back else (a, b) for a, b in short_order(rate)]
    return rows.join(F.broadcast(dimension(rows.sparkSession, pairs, "k long, to long")), "k").select("frame", F.col("to").alias("k"), "x")


def requantize(rows: DataFrame, rate: int = 44100) -> DataFrame:
    """``frame, k, q, gain, scale_shift, preflag, sf`` to ``frame, k, x`` for long blocks.

    x = sign(q) * |q|^(4/3) * 2^((gain - 210) / 4) * 2^(-shift * (sf + pretab)); lines of the last band stay 0.
    """
    dim = [(first, end, b, PRETAB[b]) for b, first, end in long_bands(rate)[:21]]
    bands = F.broadcast(dimension(rows.sparkSession, dim, "first long, end long, sfb int, pretab int"))
    q = F.col("q").cast("double")
    found = rows.join(bands, (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")), "left")
    exponent = (F.col("gain") - 210) / 4.0 - F.col("scale_shift") * (F.col("sf") + F.when(F.col("preflag"), F.col("pretab")).otherwise(0))
    x = F.signum(q) * F.pow(F.abs(q), F.lit(4.0 / 3.0)) * F.pow(F.lit(2.0), exponent)
    return found.select("frame", "k", F.when(F.col("sfb").isNull(), 0.0).otherwise(x).alias("x"))


def to_pcm(x: Column) -> Column:
    """Clamped to one, scaled by 32767 and cut towards zero."""
    return (F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32767.0).cast("smallint")
