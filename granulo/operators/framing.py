"""Frames of streams: places, clocks, reservoirs, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK = 511


def offsets(frames: DataFrame, by: str = "stream", order: str = "event_id") -> DataFrame:
    """With ``at``: bytes of the stream's frames before this one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("at", F.coalesce(F.sum("frame_bytes").over(w), F.lit(0)))


def clock(frames: DataFrame, by: str = "stream", order: str = "event_id") -> DataFrame:
    """With ``pts``: frames before this one times the samples of the stream's first frame."""
    w = Window.partitionBy(by).orderBy(order)
    return frames.withColumn("pts", (F.row_number().over(w) - 1) * F.first("samples").over(w))


def cursor(granules: DataFrame) -> DataFrame:
    """With ``bit_at``: where a granule's bits begin in its frame's main data, as a sum of those before it."""
    w = Window.partitionBy("stream", "frame").orderBy("gr", "ch").rowsBetween(Window.unboundedPreceding, -1)
    return granules.withColumn("bit_at", F.coalesce(F.sum("part2_3_length").over(w), F.lit(0)))


def bytes_before(frames: DataFrame, by: str, order: str, data: str, most: int = LOOKBACK) -> DataFrame:
    """With ``__before``: the last ``most`` bytes of ``data`` before this frame in hexadecimal, from as many frames as they take."""
    w = Window.partitionBy(by).orderBy(order)
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("long")
    # A row brings the frame before it, so that its own place is where those bytes end.
    rows = frames.withColumn("__last", F.lag(F.substring(F.hex(data), -2 * most, 2 * most)).over(w))
    rows = rows.withColumn("__at", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = Window.partitionBy(by).orderBy("__at").rangeBetween(1 - most, 0)
    before = F.array_join(F.collect_list(F.when(F.length("__last") > 0, F.col("__last"))).over(near), "")
    return rows.withColumn("__before", F.substring(before, -2 * most, 2 * most)).drop("__last", "__at")


def reservoir(frames: DataFrame, back: Column, by: str = "stream", order: str = "frame", data: str = "data", most: int = LOOKBACK) -> DataFrame:
    """With ``view``: the last ``back`` bytes before this frame's, null where fewer are there, and the frame's own after them.

    At most ``most`` bytes count, from however many frames.
    """
    rows = bytes_before(frames, by, order, data, most).withColumn("__back", back)
    ok = (F.length("__before") >= 2 * F.col("__back")) & (F.col("__back") <= most)
    tail = F.when(F.col("__back") == 0, F.lit("")).otherwise(F.expr("right(__before, 2 * __back)"))
    return rows.withColumn("view", F.when(ok, F.unhex(F.concat(tail, F.hex(F.col(data)))))).drop("__before", "__back")


def merged_tags(newer: DataFrame, older: DataFrame) -> DataFrame:
    """``id, key, value``: all newer tags, and the older ones whose key a stream has none of."""
    return newer.unionByName(older.join(newer.select("id", "key").distinct(), ["id", "key"], "left_anti").select("id", "key", "value"))


def error_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean square error and peak signal-to-noise ratio of ``l`` against ``r``; without an error there is no ratio."""
    d = (F.col("l") - F.col("r")).cast("double")
    e = rows.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.max(F.abs(F.col("r"))).alias("peak"), F.max(F.abs(d)).alias("max_err"))
    return e.select(*by, F.sqrt("mse").alias("rms"), F.when(F.col("mse") > 0, 20 * F.log10(F.col("peak") / F.sqrt("mse"))).alias("psnr_db"), "max_err")
