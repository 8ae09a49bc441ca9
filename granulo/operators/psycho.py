"""Masking models in row form: bands, critical-band partitions, tonality, spreading, thresholds."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions import acoustics as A
from granulo.functions.tables import BARK_EDGES, LONG_BANDS, SHORT_BANDS, dimension, long_bands

TINY = 1e-20
N = len(BARK_EDGES)


def band_energy(lines: DataFrame, rate: int = 44100) -> DataFrame:
    """``frame, sfb, width, energy`` over the long bands: a broadcast range join of 22 rows, then one aggregation."""
    bands = F.broadcast(dimension(lines.sparkSession, long_bands(rate), "sfb int, first long, end long"))
    rows = lines.join(bands, (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")))
    return rows.groupBy("frame", "sfb").agg(F.first(F.col("end") - F.col("first")).alias("width"), F.sum(F.col("x") * F.col("x")).alias("energy"))


def band_threshold(bands: DataFrame, ratio: float) -> DataFrame:
    """With ``threshold``: energy over the mask ratio, floored relative to the frame's loudest band."""
    floor = F.max("energy").over(Window.partitionBy("frame")) * 1e-7 + 1e-12
    return bands.withColumn("threshold", F.greatest(F.col("energy") / max(ratio, 1.0), floor))


def worst_nmr(bands: DataFrame, step: float) -> DataFrame:
    """``frame, nmr_db``: the worst noise-to-mask ratio of a uniform quantiser; null where every band is silent."""
    noise = step * step / 12.0 * F.col("width")
    ratio = F.when(F.col("energy") > TINY, A.db(F.greatest(noise / F.col("threshold"), F.lit(1e-30))))
    return bands.groupBy("frame").agg(F.max(ratio).alias("nmr_db"))


def smr(bands: DataFrame) -> DataFrame:
    return bands.where(F.col("energy") > TINY).select("frame", "sfb", A.db(F.col("energy") / F.col("threshold")).alias("smr_db"))


def largest_gain(bands: DataFrame, low: int = 60, high: int = 255) -> DataFrame:
    """``frame, gain``: the largest gain in range whose noise stays below every threshold, or ``low``.

    A band's ratio rises with the gain by 1.5 dB a step, so the tightest band gives the answer in closed form:
    step^2 <= min(12 * threshold / width), step = 2^((gain - 210) / 4).
    """
    room = F.min(F.when(F.col("energy") > TINY, 12.0 * F.col("threshold") / F.col("width")))
    gain = F.floor(210 + 2.0 * F.log2(F.col("room")) + 1e-9)
    return bands.groupBy("frame").agg(room.alias("room")).select("frame", F.greatest(F.least(F.coalesce(gain, F.lit(high)), F.lit(high)), F.lit(low)).cast("int").alias("gain"))


def line_partitions(lines: DataFrame, rate: int = 44100, size: int = 576) -> DataFrame:
    return lines.withColumn("p", A.partition(A.line_hz(F.col("k"), rate, size)))


def bin_partitions(power: DataFrame, rate: int = 44100, size: int = 1024) -> DataFrame:
    """Power spectra ``frame, j, p`` as ``frame, k, e, p``: bins of a transform of ``size`` values, their energies and partitions."""
    k = F.col("j")
    return power.select("frame", k.alias("k"), F.col("p").alias("e"), A.partition(k * (rate / size)).alias("p"))


def partition_stats(lines: DataFrame, energy: Column | None = None) -> DataFrame:
    """``frame, p, energy, ln_sum, n, peak`` of rows ``frame, k, p``: peak is the greatest line that exceeds both neighbours, 0 if none does.

    A line's energy is the square of ``x`` unless ``energy`` says otherwise.
    """
    w = Window.partitionBy("frame").orderBy("k")
    e = F.col("x") * F.col("x") if energy is None else energy
    rows = lines.select("frame", "k", "p", e.alias("e"))
    top = (F.col("e") > F.coalesce(F.lag("e").over(w), F.lit(0.0))) & (F.col("e") > F.coalesce(F.lead("e").over(w), F.lit(0.0)))
    rows = rows.withColumn("top", top)
    return rows.groupBy("frame", "p").agg(F.sum("e").alias("energy"), F.sum(F.log(F.greatest("e", F.lit(TINY)))).alias("ln_sum"), F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("top"), F.col("e"))), F.lit(0.0)).alias("peak"))


def tonality(stats: DataFrame) -> DataFrame:
    """With ``t_sfm`` (flatness over 60 dB), ``t_peak`` (peak over mean, 20 dB) and their greater, ``tonality``."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    mean = F.col("energy") / F.col("n")
    flat = F.least(F.greatest(F.exp(F.col("ln_sum") / F.col("n")) / F.greatest(mean, F.lit(TINY)), F.lit(TINY)), F.lit(1.0))
    some = F.col("energy") > TINY
    out = stats.withColumns({"t_sfm": F.when(some, unit(-A.db(flat) / 60.0)).otherwise(0.0), "t_peak": F.when(some, unit(A.db(F.greatest(F.col("peak") / mean, F.lit(1.0))) / 20.0)).otherwise(0.0)})
    return out.withColumn("tonality", F.greatest("t_sfm", "t_peak"))


def centres(rate: int) -> list[tuple[int, float]]:
    """``(partition, Hz)``: middles of the critical bands below half the rate."""
    out, below = [], 0.0
    for p, edge in enumerate(BARK_EDGES):
        top = min(float(edge), rate / 2)
        out.append((p, max(0.5 * (below + top), 1.0)))
        below = top
    return out


def spread_matrix(spark, rate: int = 44100) -> DataFrame:
    """``maskee, masker, db``: 576 rows."""
    c = dimension(spark, centres(rate), "p int, hz double").withColumn("z", A.bark(F.col("hz")))
    a, b = c.select(F.col("p").alias("maskee"), F.col("z").alias("za")), c.select(F.col("p").alias("masker"), F.col("z").alias("zb"))
    return a.crossJoin(F.broadcast(b)).select("maskee", "masker", A.spread_db(F.col("za") - F.col("zb")).alias("db"))


def spread_threshold(tones: DataFrame, gain: float, rate: int = 44100, silent: float = 0.0) -> DataFrame:
    """``frame, p, threshold``: maskers' energies spread over partitions (below -150 dB ignored), less the tone or noise offset.

    The matrix is broadcast; sums are made before the shuffle. Partitions without lines have energy of -200 dB, tonality ``silent``.
    """
    e_db = F.when(F.col("energy") > 1e-30, A.db(F.col("energy"))).otherwise(-200.0)
    rows = tones.select("frame", "p", e_db.alias("e_db")).join(F.broadcast(spread_matrix(tones.sparkSession, rate)), F.col("p") == F.col("masker"))
    level = F.col("e_db") + F.col("db")
    sums = rows.groupBy("frame", F.col("maskee").alias("p")).agg(F.sum(F.when(level >= -150.0, F.pow(F.lit(10.0), level / 10.0)).otherwise(0.0)).alias("spread"))
    t = F.coalesce("tonality", F.lit(silent))
    offset = A.TONE_DB * t + A.NOISE_DB * (1.0 - t)
    return sums.join(tones.select("frame", "p", "tonality"), ["frame", "p"], "left").select("frame", "p", (F.col("spread") * F.pow(F.lit(10.0), -offset / 10.0) / max(gain, 1.0)).alias("threshold"))


def dominant_partition(lines: DataFrame, rate: int = 44100) -> DataFrame:
    """``frame, sfb, p``: the partition that most lines of a band fall into; at a tie the highest."""
    bands = F.broadcast(dimension(lines.sparkSession, long_bands(rate), "sfb int, first long, end long"))
    rows = line_partitions(lines, rate).join(bands, (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end")))
    counts = rows.groupBy("frame", "sfb", "p").agg(F.count("*").alias("c"))
    return counts.groupBy("frame", "sfb").agg(F.max(F.struct("c", "p")).alias("m")).select("frame", "sfb", "m.p")


def _of(hz: float) -> int:
    """The partition of a frequency, as ``acoustics.partition`` has it."""
    return min(sum(e < hz for e in BARK_EDGES), N - 1)


def band_weights(bands: list[tuple[int, int, int]], rate: int, lines: int) -> list[tuple[int, int, float]]:
    """``(p, sfb, weight)``: the part of partition p's lines, of ``lines`` up to half the rate, that lies in band sfb."""
    of = [_of((k + 0.5) * rate / (2 * lines)) for k in range(lines)]
    size = Counter(of)
    return [(p, sfb, c / size[p]) for sfb, a, b in bands for p, c in sorted(Counter(of[a:b]).items())]


def short_bands(rate: int) -> list[tuple[int, int, int]]:
    edges = SHORT_BANDS.get(rate, SHORT_BANDS[44100])
    return [(b, edges[b], edges[b + 1]) for b in range(13)]


def window_places(rate: int, mixed: bool = False) -> list[tuple[int, int, int, int]]:
    """``(k, window, f, sfb)``: where line k of a short granule in stream order is among the 192 lines of its window. A mixed granule's long lines have none."""
    at = LONG_BANDS.get(rate, LONG_BANDS[44100])[8] if mixed else 0
    out = []
    for sfb, a, b in short_bands(rate)[3 if mixed else 0 :]:
        for w in range(3):
            out += [(at + f, w, a + f, sfb) for f in range(b - a) if at + f < 576]
            at += b - a
    return out


def windows(lines: DataFrame, rate: int = 44100, mixed: bool = False) -> DataFrame:
    """``frame, window, f, sfb, x``: the lines of short granules by window, place there and band; a mixed granule's long lines are left out."""
    dim = F.broadcast(dimension(lines.sparkSession, window_places(rate, mixed), "k long, window long, f long, sfb int"))
    return lines.join(dim, "k").select("frame", "window", "f", "sfb", "x")


def _floored(bands: DataFrame) -> DataFrame:
    """Thresholds of no less than 1e-7 of the granule's loudest band."""
    floor = F.max("energy").over(Window.partitionBy("frame")) * 1e-7 + 1e-12
    return bands.withColumn("threshold", F.greatest("threshold", floor))


def _rebinned(thresholds: DataFrame, weights: list[tuple[int, int, float]]) -> DataFrame:
    """``frame, sfb, threshold``: partitions' thresholds dealt to bands by their share of lines. The weights are broadcast."""
    dim = F.broadcast(dimension(thresholds.sparkSession, weights, "p int, sfb int, weight double"))
    return thresholds.join(dim, "p").groupBy("frame", "sfb").agg(F.sum(F.col("threshold") * F.col("weight")).alias("threshold"))


def tones_of(lines: DataFrame, rate: int = 44100, size: int = 576) -> DataFrame:
    return tonality(partition_stats(line_partitions(lines, rate, size)))


def mask_long(lines: DataFrame, gain: float, rate: int = 44100, tones: DataFrame | None = None, silent: float = 0.0) -> DataFrame:
    """``frame, sfb, width, energy, threshold`` of long granules: partitions, spreading, offsets, back to bands.

    ``tones`` (``frame, p, energy, tonality``) may bring other tonalities for the same energies.
    """
    thresholds = spread_threshold(tones if tones is not None else tones_of(lines, rate), gain, rate, silent)
    return _floored(band_energy(lines, rate).join(_rebinned(thresholds, band_weights(long_bands(rate), rate, 576)), ["frame", "sfb"]))


def mask_with_bins(lines: DataFrame, power: DataFrame, gain: float, rate: int = 44100) -> DataFrame:
    """As ``mask_long``, each partition as tonal as its lines or its transform's bins say, whichever says more. ``power``: ``frame, j, p``."""
    bins = tonality(partition_stats(bin_partitions(power, rate), F.col("e"))).select("frame", "p", F.col("tonality").alias("seen"))
    tones = tones_of(lines, rate).join(bins, ["frame", "p"], "left").withColumn("tonality", F.greatest("tonality", F.coalesce("seen", F.lit(0.0))))
    return mask_long(lines, gain, rate, tones)


def _short_entries(lines: DataFrame, gain: float, rate: int, mixed: bool) -> DataFrame:
    """``frame, sfb, window, width, energy, threshold``: every window's spectrum has its own partitions and spreading."""
    rows = windows(lines, rate, mixed).select(F.struct("frame", "window").alias("frame"), F.col("f").alias("k"), "x", "sfb")
    energy = rows.groupBy("frame", "sfb").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    bands = short_bands(rate)[3 if mixed else 0 :]
    spectra = rows.select("frame", "k", "x")
    if mixed:  # lines below the short bands are silent in every window
        low = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands[0][1] - 1).cast("long"))).alias("k")
        spectra = spectra.unionByName(rows.select("frame").distinct().select("frame", low, F.lit(0.0).alias("x")))
    thresholds = _rebinned(spread_threshold(tones_of(spectra, rate, 192), gain, rate), band_weights(bands, rate, 192))
    widths = F.broadcast(dimension(lines.sparkSession, [(b, e - a) for b, a, e in bands], "sfb int, width long"))
    out = energy.join(thresholds, ["frame", "sfb"]).join(widths, "sfb")
    return out.select(F.col("frame.frame").alias("frame"), "sfb", F.col("frame.window").cast("int").alias("window"), "width", "energy", "threshold")


def mask_short(lines: DataFrame, gain: float, rate: int = 44100) -> DataFrame:
    """``frame, entry, width, energy, threshold`` of short granules in stream order: entry 3 * band + window, 39 in all."""
    out = _short_entries(lines, gain, rate, False)
    return _floored(out.select("frame", (F.col("sfb") * 3 + F.col("window")).alias("entry"), "width", "energy", "threshold"))


def mask_mixed(lines: DataFrame, gain: float, rate: int = 44100) -> DataFrame:
    """As ``mask_short`` for mixed granules: entries 0 to 7 are long bands, masked by the whole spectrum, 8 to 37 short bands from the fourth on."""
    low = spread_threshold(tones_of(lines, rate), gain, rate)
    low = band_energy(lines, rate).where("sfb < 8").join(_rebinned(low, band_weights(long_bands(rate), rate, 576)), ["frame", "sfb"])
    high = _short_entries(lines, gain, rate, True)
    return _floored(low.select("frame", F.col("sfb").alias("entry"), "width", "energy", "threshold").unionByName(high.select("frame", (8 + (F.col("sfb") - 3) * 3 + F.col("window")).alias("entry"), "width", "energy", "threshold")))


def predicted_tonality(spread_out: DataFrame, rate: int = 44100) -> DataFrame:
    """``frame, p, tonality`` of bins' unpredictability ``frame, j, c``: one less the partition's mean; 0.5 with fewer than two bins."""
    rows = spread_out.select("frame", "c", A.partition(F.col("j") * (rate / 1024)).alias("p"))
    sums = rows.groupBy("frame", "p").agg(F.avg("c").alias("c"), F.count("*").alias("n"))
    return sums.select("frame", "p", F.when(F.col("n") < 2, 0.5).otherwise(1 - F.least(F.greatest("c", F.lit(0.0)), F.lit(1.0))).alias("tonality"))


def mask_by_prediction(lines: DataFrame, spread_out: DataFrame, gain: float, rate: int = 44100) -> DataFrame:
    """As ``mask_long`` with tonalities from how well bins follow from the two below them: ``spread_out`` is ``frame, j, c``."""
    energy = line_partitions(lines, rate).groupBy("frame", "p").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    return mask_long(lines, gain, rate, energy.join(predicted_tonality(spread_out, rate), ["frame", "p"], "left"), 0.5)


def bin_of_band(rate: int = 44100) -> list[tuple[int, int]]:
    """``(sfb, p)``: the partition that most of a band's lines fall into by their nearest bins of 1024; the highest at a tie."""
    out = []
    for sfb, a, b in long_bands(rate):
        counts = Counter(_of(min(round((k + 0.5) * 1024 / 1152), 512) * rate / 1024) for k in range(a, b))
        out.append((sfb, max(counts, key=lambda p: (counts[p], p))))
    return out


def lifted(bands: DataFrame, power: DataFrame, rate: int = 44100) -> DataFrame:
    """Band thresholds (``frame, sfb, threshold`` and more) up to 3 dB lower where the band's partition is tonal by its bins' flatness."""
    bins = tonality(partition_stats(bin_partitions(power, rate), F.col("e"))).select("frame", "p", "t_sfm")
    dim = F.broadcast(dimension(bands.sparkSession, bin_of_band(rate), "sfb int, p int"))
    rows = bands.join(dim, "sfb").join(bins, ["frame", "p"], "left")
    return rows.withColumn("threshold", F.col("threshold") * F.pow(F.lit(10.0), -0.3 * F.coalesce("t_sfm", F.lit(0.0)))).drop("p", "t_sfm")
