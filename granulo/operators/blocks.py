"""Blocks of samples: re-blocking, onset detection and block types.

The two detectors with unbounded memory are folds of small maps that compose: the smoothed energy is an affine map and the
block-type machine a map over four states. Each is folded over SEGMENT elements at a time, then over segments, then within
segments from their starting states, so that no row holds a whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SUB = 576, 192
ALPHA, RATIO, FLOOR = 0.25, 4.0, 1e-6
SEGMENT = 256
STATES = ("long", "start", "short", "stop")


def blocks(samples: DataFrame, size: int = BLOCK) -> DataFrame:
    """Tumbling blocks of ``stream, n, s``: how many samples are there (the rest is zero), their sum and energy."""
    return samples.groupBy("stream", F.floor(F.col("n") / size).alias("block")).agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("energy"))


def subframes(samples: DataFrame, size: int = SUB) -> DataFrame:
    """Energies of the sub-frames (three a block), as whole numbers."""
    return samples.groupBy("stream", F.floor(F.col("n") / size).alias("sub")).agg(F.sum(F.col("s") * F.col("s")).alias("energy"))


def overlapped(samples: DataFrame, size: int = BLOCK, history: int = 448) -> DataFrame:
    """Analysis frames: each block with the ``history`` samples before it. ``stream, frame, i, s``, i from 0 at the oldest.

    A sample goes to its own frame and, if late in its block, to the next: one pass without a join.
    """
    block, at = F.floor(F.col("n") / size), F.col("n") % size
    own = F.struct(block.alias("frame"), (at + history).alias("i"))
    later = F.when(at >= size - history, F.struct((block + 1).alias("frame"), (at - (size - history)).alias("i")))
    rows = samples.select("stream", "s", F.explode(F.array(own, later)).alias("f")).where("f IS NOT NULL").select("stream", "f.frame", "f.i", "s")
    last = samples.groupBy("stream").agg(F.max(block).alias("last"))
    return rows.join(last, "stream").where("frame <= last").drop("last")


def _ordered(values: Column, by: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), values.alias("v"))))


def smoothed(energies: DataFrame, order: str = "sub", value: str = "e", segment: int = SEGMENT) -> DataFrame:
    """``stream, order, value, before``: the smoothed energy before each element, and ``after``."""
    seg = F.floor(F.col(order) / segment)
    cut = energies.select("stream", order, F.col(value).alias("e")).groupBy("stream", seg.alias("seg")).agg(_ordered(F.col("e"), order).alias("xs"))
    step = lambda a, x: ALPHA * x["v"] + (1 - ALPHA) * a
    cut = cut.withColumns({"a": F.pow(F.lit(1 - ALPHA), F.size("xs")), "b": F.aggregate("xs", F.lit(0.0), step)})
    maps = cut.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seg", "a", "b"))).alias("ms"))
    starts = F.aggregate("ms", F.struct(F.lit(0.0).alias("now"), F.array().cast("array<struct<seg:bigint,start:double>>").alias("out")), lambda s, m: F.struct((m["a"] * s["now"] + m["b"]).alias("now"), F.concat(s["out"], F.array(F.struct(m["seg"].alias("seg"), s["now"].alias("start")))).alias("out")))["out"]
    begun = maps.select("stream", F.inline(starts))
    shape = "array<struct<o:bigint,e:double,before:double,after:double>>"
    inner = F.aggregate("xs", F.struct(F.col("start").alias("now"), F.array().cast(shape).alias("out")), lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(F.struct(x["o"].alias("o"), x["v"].alias("e"), s["now"].alias("before"), step(s["now"], x).alias("after")))).alias("out")))["out"]
    return cut.join(begun, ["stream", "seg"]).select("stream", F.inline(inner)).withColumnRenamed("o", order)


def onsets(samples: DataFrame) -> DataFrame:
    """``stream, block, onset``: a sub-frame is RATIO times louder than what was smoothed before it. Missing samples are zero."""
    e = subframes(samples).select("stream", "sub", (F.col("energy") / float(SUB)).alias("e"))
    hit = (F.col("e") > FLOOR) & (F.col("before") > 0) & (F.col("e") > F.col("before") * RATIO)
    return smoothed(e).groupBy("stream", F.floor(F.col("sub") / 3).alias("block")).agg(F.max(hit).alias("onset"))


def _next_state(state: Column, now: Column, soon: Column) -> Column:
    """States are numbered as in STATES."""
    return F.when(state == 1, 2).when(state == 2, F.when(now, 2).otherwise(3)).otherwise(F.when(now | soon, 1).otherwise(0))


def block_types(onset: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``stream, block, block_type`` by the four-state machine, which sees this block's and the next one's onset."""
    w = Window.partitionBy("stream").orderBy("block")
    rows = onset.select("stream", "block", "onset", F.coalesce(F.lead("onset").over(w), F.lit(False)).alias("soon"))
    cut = rows.groupBy("stream", F.floor(F.col("block") / segment).alias("seg")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("o"), F.col("onset").alias("now"), "soon"))).alias("xs"))
    run = lambda s: F.aggregate("xs", F.lit(s), lambda a, x: _next_state(a, x["now"], x["soon"]))
    cut = cut.withColumn("to", F.array(*[run(s) for s in range(4)]))
    maps = cut.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("seg", "to"))).alias("ms"))
    starts = F.aggregate("ms", F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<seg:bigint,start:int>>").alias("out")), lambda s, m: F.struct(F.get(m["to"], s["now"]).alias("now"), F.concat(s["out"], F.array(F.struct(m["seg"].alias("seg"), s["now"].alias("start")))).alias("out")))["out"]
    begun = maps.select("stream", F.inline(starts))
    inner = F.aggregate("xs", F.struct(F.col("start").alias("now"), F.array().cast("array<struct<block:bigint,state:int>>").alias("out")), lambda s, x: F.struct(_next_state(s["now"], x["now"], x["soon"]).alias("now"), F.concat(s["out"], F.array(F.struct(x["o"].alias("block"), _next_state(s["now"], x["now"], x["soon"]).alias("state")))).alias("out")))["out"]
    names = F.array(*[F.lit(s) for s in STATES])
    return cut.join(begun, ["stream", "seg"]).select("stream", F.inline(inner)).select("stream", "block", F.get(names, F.col("state")).alias("block_type"))


def type_runs(types: DataFrame) -> DataFrame:
    """Runs of one block type: ``stream, block_type, first_block, blocks``."""
    w = Window.partitionBy("stream").orderBy("block")
    new = (F.lag("block_type").over(w) != F.col("block_type")) | F.lag("block_type").over(w).isNull()
    runs = types.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("stream", "run", "block_type").agg(F.min("block").alias("first_block"), F.count("*").alias("blocks")).drop("run")


def mixed_flags(samples: DataFrame) -> DataFrame:
    """``stream, block, mixed``: high frequencies burst (loudest sub-frame over six times the quietest) while low ones hold (below twice the mean).

    The two filters are 1 2 1 and -1 2 -1 over whole samples, four times the reference scale; a block's outside is zero.
    """
    block = F.floor(F.col("n") / BLOCK)
    w = Window.partitionBy("stream", "block").orderBy("n")
    rows = samples.withColumn("block", block)
    sides = F.coalesce(F.lag("s").over(w), F.lit(0)) + F.coalesce(F.lead("s").over(w), F.lit(0))
    rows = rows.select("stream", "block", (F.floor(F.col("n") % BLOCK / SUB)).alias("sub"), (2 * F.col("s") + sides).alias("lp"), (2 * F.col("s") - sides).alias("hp"))
    e = rows.groupBy("stream", "block", "sub").agg(F.sum(F.col("lp") * F.col("lp")).alias("lo"), F.sum(F.col("hp") * F.col("hp")).alias("hi"))
    e = e.groupBy("stream", "block").agg(F.max("lo").alias("lo_max"), F.sum("lo").alias("lo_sum"), F.max("hi").alias("hi_max"), F.min("hi").alias("hi_min"), F.count("*").alias("subs"))
    quiet = F.when(F.col("subs") < 3, 0).otherwise(F.col("hi_min"))
    mixed = (F.col("lo_sum") > 0) & (F.col("hi_max") > 6 * quiet) & (3 * F.col("lo_max") < 2 * F.col("lo_sum"))
    return e.select("stream", "block", mixed.alias("mixed"))


def goertzel(samples: DataFrame, cycles: float, size: int = BLOCK) -> DataFrame:
    """``stream, block, power``: power of each whole block at ``cycles`` a block, normalised by size squared."""
    import math

    turn = 2 * math.pi * cycles / size
    at = F.col("n") % size
    g = samples.groupBy("stream", F.floor(F.col("n") / size).alias("block")).agg(F.count("*").alias("c"), F.sum(F.col("s") * F.cos(at * turn)).alias("re"), F.sum(F.col("s") * F.sin(at * turn)).alias("im"))
    return g.where(F.col("c") == size).select("stream", "block", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / float(size * size)).alias("power"))
