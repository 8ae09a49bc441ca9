"""Quantisation and entropy coding in row form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions.tables import dimension, pair_rows


def quantize(rows: DataFrame, gain: Column) -> DataFrame:
    """``frame, k, q``: sign of x times floor(|x|^0.75 * 2^(-3/16 (gain - 210)) + 0.4054), at most 8191."""
    scale = F.pow(F.lit(2.0), (gain - 210) * (-3.0 / 16.0))
    v = F.least(F.floor(F.pow(F.abs(F.col("x")), F.lit(0.75)) * scale + 0.4054), F.lit(8191))
    return rows.select("frame", "k", F.when(F.col("x") < 0, -v).otherwise(v).cast("int").alias("q"))


def regions(rows: DataFrame) -> DataFrame:
    """``frame, last_nonzero, big_end``: lines in use, and where whole quadruples of at most one begin, counted from the (even) end.

    The run of small quadruples is the distance to the last line above one, so one aggregation finds it.
    """
    a = F.abs(F.col("q"))
    e = rows.groupBy("frame").agg(F.coalesce(F.max(F.when(a > 0, F.col("k") + 1)), F.lit(0)).alias("last_nonzero"), F.coalesce(F.max(F.when(a > 1, F.col("k") + 1)), F.lit(0)).alias("last_big"))
    even = F.col("last_nonzero") + F.col("last_nonzero") % 2
    quads = F.floor((even - F.col("last_big")) / 4)
    return e.select("frame", "last_nonzero", (even - 4 * quads).cast("long").alias("big_end"))


def pairs(rows: DataFrame) -> DataFrame:
    """``frame, i, x, y``: magnitudes of neighbouring lines."""
    return rows.groupBy("frame", F.floor(F.col("k") / 2).alias("i")).agg(F.max(F.when(F.col("k") % 2 == 0, F.abs("q"))).alias("x"), F.max(F.when(F.col("k") % 2 == 1, F.abs("q"))).alias("y"))


def pair_costs(rows: DataFrame) -> DataFrame:
    """``frame, tab, bits`` of ``frame, i, x, y`` under every table that reaches all values: a broadcast join, then a sum."""
    dim = dimension(rows.sparkSession, [(t, n + (x > 0) + (y > 0), x, y) for t, _, n, x, y in pair_rows()], "tab int, cost int, x int, y int")
    priced = rows.join(F.broadcast(dim), ["x", "y"])
    sums = priced.groupBy("frame", "tab").agg(F.sum("cost").alias("bits"), F.count("*").alias("c"))
    all_pairs = rows.groupBy("frame").agg(F.count("*").alias("n"))
    return sums.join(all_pairs, "frame").where(F.col("c") == F.col("n")).select("frame", "tab", "bits")


def cheapest(costs: DataFrame) -> DataFrame:
    """The cheapest table of a frame; of equal ones the first."""
    return costs.groupBy("frame").agg(F.min(F.struct("bits", "tab")).alias("m")).select("frame", "m.tab", "m.bits")


def match_prefix(peeks: DataFrame, table: int) -> DataFrame:
    """``id, peek`` (the next ``len`` bits, left-aligned to the longest word) to the symbol whose code begins there: a broadcast range join."""
    words = [r for r in pair_rows() if r[0] == table]
    most = max(r[2] for r in words)
    dim = [(code << (most - n), (code + 1) << (most - n), n, x, y) for _, code, n, x, y in words]
    d = F.broadcast(dimension(peeks.sparkSession, dim, "low long, high long, len int, x int, y int"))
    return peeks.join(d, (F.col("peek") >= F.col("low")) & (F.col("peek") < F.col("high"))).select("id", "peek", "len", "x", "y")


def low_rate_slen(sfc: Column, intensity: bool = False) -> Column:
    """The four scalefactor lengths that a low-rate ``scalefac_compress`` stands for, and its range."""
    from granulo.functions.tables import LSF_RADIX

    sfc = F.floor(sfc / 2) if intensity else sfc
    first, low, out = (3 if intensity else 0), 0, None
    for k in range(first, first + 3):
        a, b, c, d = LSF_RADIX[k]
        v = sfc - low
        s = F.struct(F.floor(v / (b * c * d)).cast("int").alias("s0"), (F.floor(v / (c * d)) % b).cast("int").alias("s1"), (F.floor(v / d) % c).cast("int").alias("s2"), (v % d).cast("int").alias("s3"), F.lit(k - first).alias("range"))
        hit = (sfc >= low) & (sfc < low + a * b * c * d)
        out = F.when(hit, s) if out is None else out.when(hit, s)
        low += a * b * c * d
    return out


def reuse(rows: DataFrame) -> DataFrame:
    """``frame, ch, gr, grp, own, scfsi``: a group's scalefactor of the second granule is the first granule's where the flag is set."""
    first = F.first("own").over(Window.partitionBy("frame", "ch", "grp").orderBy("gr").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("sf", F.when((F.col("gr") > 0) & F.col("scfsi"), first).otherwise(F.col("own")))
