"""Signals derived from the driver's tables, as DataFrames and as DuckDB text.

Streams are cut from a table by a key, so that every ordering is within a stream and no window spans a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples of one stream cut from the event table.
STREAM = 5760


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, h``: words whose upper eleven bits are set and whose others vary, valid or not."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.lit(4292870144) + F.pmod(e * 40503 + 12345, F.lit(2097152))).alias("h"))


HEADERS = "hdr AS (SELECT event_id, 4292870144 + (event_id * 40503 + 12345) % 2097152 AS h FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream, n, s``: event values in cents; the last third of every fifth block is louder, so that onsets occur."""
    stream = F.floor(F.col("event_id") / STREAM)
    n = F.row_number().over(Window.partitionBy("stream").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(stream.alias("stream"), "event_id", F.floor(F.col("value") * 100 + 0.5).alias("s"))
    rows = rows.withColumn("n", n.cast("long"))
    loud = (F.floor(F.col("n") / 576) % 5 == 3) & (F.col("n") % 576 >= 384)
    return rows.select("stream", "n", F.when(loud, F.col("s") * 6).otherwise(F.col("s")).alias("s"))


SAMPLES = f"""sig AS (SELECT stream, n, CASE WHEN (n // 576) % 5 = 3 AND n % 576 >= 384 THEN s * 6 ELSE s END AS s
  FROM (SELECT event_id // {STREAM} AS stream, row_number() OVER (PARTITION BY event_id // {STREAM} ORDER BY event_id) - 1 AS n,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS s FROM events))"""

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]
#: Suppliers whose prices make one stream: so many that a stream's last, partial block is a small part of it.
SUPPLIERS = 10


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stream, block, k, l, r``: prices of SUPPLIERS suppliers as one stream; the right channel is the discounted price. Last blocks are shorter."""
    c = F.col
    stream = F.floor(c("l_suppkey") / SUPPLIERS)
    n = F.row_number().over(Window.partitionBy("stream").orderBy(*_ORDER)) - 1
    rows = table(spark, sf_dir, "lineitem").select(stream.alias("stream"), *_ORDER).withColumn("n", n)
    rows = rows.select("stream", "n", F.floor(c("l_extendedprice") * 100 + 0.5).alias("l"), F.floor(c("l_extendedprice") * 100 * (1 - c("l_discount")) + 0.5).alias("r"))
    return rows.select("stream", F.floor(c("n") / 576).alias("block"), (c("n") % 576).cast("long").alias("k"), "l", "r")


STEREO = f"""lr0 AS (SELECT l_suppkey // {SUPPLIERS} AS stream, row_number() OVER (PARTITION BY l_suppkey // {SUPPLIERS} ORDER BY {", ".join(_ORDER)}) - 1 AS n,
    CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS l, CAST(floor(l_extendedprice * 100 * (1 - l_discount) + 0.5) AS BIGINT) AS r FROM lineitem),
lr AS (SELECT stream, n // 576 AS block, n % 576 AS k, l, r FROM lr0)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, k, x``: embeddings as spectra of 64 lines."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("k", "x")).select("frame", F.col("k").cast("long").alias("k"), F.col("x").cast("double").alias("x"))


SPECTRA = "spec AS (SELECT vec_id AS frame, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, k, x``: blocks of the left channel as spectra of 576 lines that fall off with frequency; a short block's missing lines are zero."""
    rows = stereo(spark, sf_dir).select((F.col("stream") * 100_000 + F.col("block")).alias("frame"), "stream", "block", "k", (F.col("l") / 1e6 / (1.0 + F.col("k") / 32.0)).alias("x"))
    return _filled(rows)


def _filled(rows: DataFrame) -> DataFrame:
    """Frames of 576 lines, those of a short block with zeros: its last line brings the lines that are missing behind it."""
    rows = rows.withColumn("next", F.lead("k").over(Window.partitionBy("stream", "block").orderBy("k")))  # by the stream's own shuffle
    last = F.col("next").isNull() & (F.col("k") < 575)
    rest = F.when(last, F.transform(F.sequence(F.col("k") + 1, F.lit(575).cast("long")), lambda k: F.struct(k.alias("k"), F.lit(0.0).alias("x")))).otherwise(F.array().cast("array<struct<k:bigint,x:double>>"))
    return rows.select("frame", F.inline(F.concat(F.array(F.struct("k", "x")), rest)))


def _filled_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT * FROM {source} UNION ALL SELECT frame, unnest(range(n, 576)) AS k, 0.0::DOUBLE AS x FROM (SELECT frame, count(*) AS n FROM {source} GROUP BY 1) WHERE n < 576)"


LINES = STEREO + ",\nlines0 AS (SELECT stream * 100000 + block AS frame, k, l / 1e6 / (1.0 + k / 32.0) AS x FROM lr),\n" + _filled_sql("lines", "lines0")


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, k, x``: blocks of the event signal as spectra of 576 lines, with the frame numbers of its analysis frames."""
    block, k = F.floor(F.col("n") / 576), F.col("n") % 576
    rows = samples(spark, sf_dir).select((F.col("stream") * 100_000 + block).alias("frame"), "stream", block.alias("block"), k.alias("k"), (F.col("s") / 1e4 / (1.0 + k / 32.0)).alias("x"))
    return _filled(rows)


SIGNAL_LINES = "slines0 AS (SELECT stream * 100000 + n // 576 AS frame, n % 576 AS k, s / 1e4 / (1.0 + n % 576 / 32.0) AS x FROM sig),\n" + _filled_sql("slines", "slines0")
