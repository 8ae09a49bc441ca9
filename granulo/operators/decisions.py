"""Searches and decisions of the encoder, as top-1 aggregations and ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions.tables import BITRATES, dimension, intensity_ratio, long_bands


def mid_side_choice(stereo: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``use_ms``: side energy below 0.30 of mid energy."""
    m, s = F.col("l") + F.col("r"), F.col("l") - F.col("r")
    e = stereo.groupBy(*by).agg(F.sum(m * m).alias("mid"), F.sum(s * s).alias("side"))
    return e.select(*by, ((F.col("mid") > 1e-12) & (F.col("side") / F.col("mid") < 0.30)).alias("use_ms"))


def band_sums(stereo: DataFrame, by: list[str], rate: int = 44100) -> DataFrame:
    """Energies and cross term of the bands below the last: ``by, sfb, el, er, c``."""
    bands = F.broadcast(dimension(stereo.sparkSession, long_bands(rate)[:21], "sfb int, first long, end long"))
    rows = stereo.join(bands, (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")))
    l, r = F.col("l").cast("double"), F.col("r").cast("double")  # noqa: E741
    return rows.groupBy(*by, "sfb").agg(F.sum(l * l).alias("el"), F.sum(r * r).alias("er"), F.sum(l * r).alias("c"))


def intensity_bound(bands: DataFrame, by: list[str], lowest: int = 7) -> DataFrame:
    """``by, bound``: the lowest band of the unbroken run, from the top down to ``lowest``, of bands that are silent, panned or coherent; 21 if none."""
    e = F.col("el") + F.col("er")
    silent = e < F.greatest(F.max(e).over(Window.partitionBy(*by)), F.lit(1e-12)) * 1e-4
    panned = F.abs(F.col("el") - F.col("er")) >= 0.85 * e
    root = F.sqrt(F.col("el") * F.col("er"))
    good = silent | panned | ((root > 1e-12) & (F.abs(F.col("c")) >= 0.85 * root))
    rows = bands.withColumn("good", good).where(F.col("sfb") >= lowest)
    run = F.min("good").over(Window.partitionBy(*by).orderBy(F.desc("sfb")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("run"), F.col("sfb"))), F.lit(21)).alias("bound"))


def _nearest(bands: DataFrame, ratios: list[tuple[float, float]]) -> Column:
    """The first position whose share of right energy is nearest."""
    share = F.least(F.greatest(F.col("er") / (F.col("el") + F.col("er")), F.lit(0.0)), F.lit(1.0))
    options = [F.struct(F.abs(F.lit(r * r / (l * l + r * r)) - share).alias("err"), F.lit(p).alias("pos")) for p, (l, r) in enumerate(ratios)]  # noqa: E741
    return F.array_min(F.array(*options))["pos"]


def low_rate_ratios() -> list[tuple[float, float]]:
    """Left and right factors of the positions 0 to 30 at the fine scale."""
    return [(1.0, 1.0) if p == 0 else (0.5 ** ((p + 1) // 2), 1.0) if p % 2 else (1.0, 0.5 ** ((p + 1) // 2)) for p in range(31)]


def intensity_position(bands: DataFrame, low_rate: bool = False) -> DataFrame:
    """With ``is_pos``: of seven positions (at low rates of 31) the first whose share of right energy is nearest; for silence 7 (at low rates 0)."""
    ratios = low_rate_ratios() if low_rate else [intensity_ratio(p) for p in range(7)]
    return bands.withColumn("is_pos", F.when(F.col("el") + F.col("er") <= 0, 0 if low_rate else 7).otherwise(_nearest(bands, ratios)))


def intensity_rewrite(stereo: DataFrame, by: list[str], low_rate: bool = False, rate: int = 44100) -> DataFrame:
    """``by, k, l, r`` after the encoder's intensity rewrite: from the bound up, left is what both channels are rebuilt from and right is zero.

    At the high rates left takes both channels' magnitude and its own sign (right's where it is zero); at the low ones it is their mean at
    position 0, the right channel at odd positions and itself at even ones. Silent bands (below 1e-4 of the loudest) only lose right.
    """
    sums = band_sums(stereo, by, rate)
    e = F.col("el") + F.col("er")
    silent = e < F.greatest(F.max(e).over(Window.partitionBy(*by)), F.lit(1e-12)) * 1e-4
    place = intensity_position(sums, low_rate).withColumn("is_pos", F.when(silent, 0 if low_rate else 7).otherwise(F.col("is_pos")))
    coded = place.join(intensity_bound(sums, by), by).where("sfb >= bound").select(*by, "sfb", "is_pos")
    bands = F.broadcast(dimension(stereo.sparkSession, long_bands(rate)[:21], "sfb int, first long, end long"))
    rows = stereo.select(*by, "k", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
    rows = rows.join(bands, (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")), "left").join(coded, [*by, "sfb"], "left")
    l, r, pos = F.col("l"), F.col("r"), F.col("is_pos")  # noqa: E741
    if low_rate:
        new = F.when(pos == 0, (l + r) / 2).when(pos % 2 == 1, r).otherwise(l)
    else:
        new = F.when(pos == 7, l).otherwise(F.when((l < 0) | ((l == 0) & (r < 0)), -1.0).otherwise(1.0) * F.sqrt(l * l + r * r))
    return rows.select(*by, "k", F.when(pos.isNull(), l).otherwise(new).alias("l"), F.when(pos.isNull(), r).otherwise(0.0).alias("r"))


def low_rate_factors(position: Column, scale: Column) -> tuple[Column, Column]:
    """Left and right factors of a low-rate intensity position."""
    ratio = F.pow(F.when(scale != 0, 0.25).otherwise(0.5), F.floor((position + 1) / 2))
    odd = position % 2 == 1
    return F.when(odd, ratio).otherwise(1.0), F.when(odd | (position == 0), 1.0).otherwise(ratio)


def slot(needs: DataFrame, low_rate: bool = False) -> DataFrame:
    """``needs`` (``need, side_bytes, sample_rate``) with the smallest bitrate whose frame has room, or the largest of all."""
    ks = BITRATES[(2 if low_rate else 1, 3)][1:]
    room = lambda kbps: F.greatest(F.floor((72 if low_rate else 144) * kbps * 1000 / F.col("sample_rate")) - 4 - F.col("side_bytes"), F.lit(0))
    return needs.withColumn("kbps", F.coalesce(*[F.when(room(k) >= F.col("need"), k) for k in ks], F.lit(ks[-1])))


def padded(rows: DataFrame, kbps: int, rate: int, low_rate: bool = False) -> DataFrame:
    """``n`` (frames from 0) with ``pad``: the accumulator of remainders reaches eight times the rate.

    In closed form: after n frames, floor(n * remainder / (8 * rate)) pads were given.
    """
    rest = (72_000 if low_rate else 144_000) * kbps % rate
    given = lambda n: F.floor(n * rest / (8 * rate))
    return rows.withColumn("pad", given(F.col("n") + 1) > given(F.col("n")))


def subblock_gains(energies: DataFrame) -> DataFrame:
    """``frame, window, energy`` to ``frame, window, gain``: a quarter of the log of energy over the quietest window, rounded, 0 to 7; 0 for all below a ratio of two."""
    w = Window.partitionBy("frame")
    low, high = F.min("energy").over(w), F.max("energy").over(w)
    ratio = F.col("energy") / F.greatest(low, F.lit(1e-30))
    gain = F.least(F.greatest(F.floor(0.25 * F.greatest(F.log2(ratio), F.lit(0.0)) + 0.5), F.lit(0)), F.lit(7))
    flat = (high <= 1e-12) | (high / F.greatest(low, F.lit(1e-30)) < 2.0)
    return energies.select("frame", "window", F.when(flat, 0).otherwise(gain).cast("int").alias("gain"))
