"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix, in DataFrame functions only.

A uniform random permutation sends to each shard, from each block of rows, a number of rows that follows the multivariate
hypergeometric law. Those numbers are drawn first, as one small matrix of blocks by shards whose margins are the block
sizes and the wanted shard sizes. Each block is then permuted and cut by its row of the matrix, the pieces are exchanged,
and each shard is permuted once more. No step sees more than one block or one part of a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.llm.common import let, stable

#: Rows that a block, or a part of a shard, aims at; and the most blocks, which bounds the matrix to MAX_BLOCKS * shards numbers.
BLOCK_ROWS, MIN_BLOCKS, MAX_BLOCKS = 50_000, 64, 16_384


def _log_factorial(x: Column) -> Column:
    d = x.cast("double")
    stirling = (d + 0.5) * F.log(d) - d + 0.5 * math.log(2 * math.pi) + 1 / (12 * d) - 1 / (360 * d * d * d)
    return F.when(x < 16, F.log(F.factorial(F.greatest(F.least(x, F.lit(16)), F.lit(0)).cast("int")).cast("double"))).otherwise(stirling)


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows taken from ``total`` are among the ``good`` ones, at quantile ``u``.

    The law is summed within ten standard deviations of its mean; what lies beyond has a mass below 1e-20.
    """
    t, g, d = total.cast("double"), good.cast("double"), draws.cast("double")
    mean = d * g / F.greatest(t, F.lit(1.0))
    sd = F.sqrt(F.greatest(mean * (1 - g / F.greatest(t, F.lit(1.0))) * (t - d) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean - 10 * sd - 10))
    high = F.least(draws, good, F.ceil(mean + 10 * sd + 10))

    def of(a: Column) -> Column:
        total, good, draws, u, low, high, mean = (a[n] for n in ("total", "good", "draws", "u", "low", "high", "mean"))

        def log_mass(k: Column) -> Column:
            return -_log_factorial(k) - _log_factorial(good - k) - _log_factorial(draws - k) - _log_factorial(total - good - draws + k)

        def pick(w: Column) -> Column:
            goal = u * F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
            start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
            return F.aggregate(w, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["k"] + F.when(s["sum"] + x < goal, 1).otherwise(0)).alias("k")))["k"]

        top = F.least(F.greatest(F.round(mean).cast("long"), low), high)
        return F.least(high, let(log_mass(top), lambda m: let(F.transform(F.sequence(low, high), lambda k: F.exp(log_mass(k) - m)), pick)))

    named = {"total": total, "good": good, "draws": draws, "u": u, "low": low, "high": high, "mean": mean}
    return let(F.struct(*[c.alias(n) for n, c in named.items()]), of)


def communication_matrix(blocks: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """Rows ``block, bounds``: where, among a block's permuted rows, the rows for each shard end.

    ``blocks`` has ``block`` (0 to 2**levels - 1) and ``n``. The shard sizes are split over halves of the blocks, then over
    quarters and so on; each split draws from a multivariate hypergeometric law, so margins hold at every level.
    """
    spark = blocks.sparkSession
    every = spark.range(1 << levels).select(F.col("id").alias("block"))
    rows = every.join(blocks, "block", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda s: s["n"]).alias("counts"))
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    node = rows.select(F.lit(0).cast("long").alias("first"), "counts", let(n, lambda n: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.expr("0L") + F.floor(n / shards).cast("long") + F.when(k < n % shards, 1).otherwise(0))).alias("sizes"))
    for level in range(levels):
        half = 1 << (levels - level - 1)

        def split(state: Column, k: Column) -> Column:
            good = F.get("sizes", k)
            x = _hypergeometric(state["total"], good, state["draws"], _uniform(F.lit(seed), F.lit(level), F.col("first"), k))
            return let(x, lambda x: F.struct((state["total"] - good).alias("total"), (state["draws"] - x).alias("draws"), F.concat(state["left"], F.array(x)).alias("left")))

        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        draws = F.aggregate(F.slice("counts", 1, half), F.lit(0).cast("long"), lambda s, x: s + x)
        start = F.struct(total.alias("total"), draws.alias("draws"), F.array().cast("array<bigint>").alias("left"))
        left = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, split)["left"]
        node = node.select("first", "counts", "sizes", F.explode(F.array(left)).alias("left"))
        children = F.array(
            F.struct(F.col("first"), F.slice("counts", 1, half).alias("counts"), F.col("left").alias("sizes")),
            F.struct((F.col("first") + half).alias("first"), F.slice("counts", half + 1, half).alias("counts"), F.zip_with("sizes", "left", lambda a, b: a - b).alias("sizes")),
        )
        node = node.select(F.explode(children).alias("c")).select("c.*")
        if 1 << (level + 1) == 64:
            node = node.repartition("first")
    bounds = F.aggregate("sizes", F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(x + F.coalesce(F.get(s, F.size(s) - 1), F.lit(0).cast("long")))))
    return node.select(F.col("first").alias("block"), bounds.alias("bounds"))


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1; sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    Every arrangement of the rows over shards and slots is equally likely, but for the quality of the 64-bit hash that
    stands for chance; the same table, seed and partitioning give the same arrangement. Rows are told apart by a number
    that the scan gives, so null, repeated or equal rows spread as any others. The rows are kept in the shared folder
    once: pass narrow rows and join wide columns afterwards. No rows give no rows. Columns that ``rows`` already calls
    shard or slot are not allowed.
    """
    names = rows.columns
    if {"shard", "slot"} & {n.lower() for n in names}:
        raise ValueError("rows already has a column named shard or slot")
    r = F.col("__row")
    kept = stable(rows.select(F.struct("*").alias("__kept")).withColumn("__row", F.monotonically_increasing_id()))
    total = kept.count()
    levels = math.ceil(math.log2(min(MAX_BLOCKS, max(MIN_BLOCKS, total / block_rows))))
    kept = kept.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), F.lit(1), r), F.lit(1 << levels)))
    matrix = communication_matrix(kept.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")), levels, shards, seed)
    local = F.row_number().over(Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed), F.lit(2), r), r)) - 1
    cut = kept.withColumn("__local", local).join(F.broadcast(matrix), F.col("__block") == F.col("block"))
    dealt = stable(cut.select("__kept", "__row", F.size(F.filter("bounds", lambda b: b <= F.col("__local"))).alias("shard")))

    sub = min(MAX_BLOCKS // shards or 1, max(8, math.ceil(total / shards / block_rows)))
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), F.lit(3), r), F.lit(sub)))
    sizes = dealt.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select("shard", "__part", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(F.xxhash64(F.lit(seed), F.lit(4), r), r)) - 1
    placed = dealt.withColumn("__inner", inner).join(F.broadcast(before), ["shard", "__part"])
    return placed.select("__kept.*", "shard", (F.col("__before") + F.col("__inner")).cast("long").alias("slot"))


def digest(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A null text counts 8 bytes and has the checksum of the empty text; ``grown_shard`` belongs to another law and is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(thin, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
