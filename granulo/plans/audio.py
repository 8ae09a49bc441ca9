"""Queries of the coding plans over the driver's tables. SQL has no twin of a bit stream; tests hold them against plain round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo.plans import decode, encode
from granulo.plans import views as V
from granulo.sources import coded_audio

OPTIONS = encode.Options(44100, 1, 128)


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, ch, granule, pcm``: the event signal in 16 bits, a stream a file; the last granule is filled up with zeros."""
    rows = V.samples(spark, sf_dir).select(F.col("stream").cast("string").alias("path"), F.floor(F.col("n") / 576).alias("granule"), (F.col("n") % 576).alias("k"), F.floor(F.col("s") / 16 - 1500).alias("s"))
    cells = F.map_from_entries(F.collect_list(F.struct("k", F.greatest(F.least("s", F.lit(32767)), F.lit(-32768)).cast("smallint").alias("s"))))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(575).cast("long")), lambda k: F.coalesce(F.try_element_at("at", k), F.lit(0).cast("smallint")))
    return rows.groupBy("path", "granule").agg(cells.alias("at")).select("path", F.lit(0).alias("ch"), "granule", filled.alias("pcm"))


def encode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the coded event signal: its size, checksum and granules above their mask."""
    frames = encode.encode(pcm(spark, sf_dir), OPTIONS)
    return frames.select("path", "frame", F.length("data").alias("n_bytes"), F.crc32("data").alias("data_crc32"), "over_mask")


def decode_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event signal coded, split into frames again and decoded: energy and checksum of every granule."""
    coded = encode.encode(pcm(spark, sf_dir), OPTIONS)
    back = decode.pcm(coded_audio.frames(encode.files(coded)))
    energy = F.aggregate("pcm", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return back.select("path", "ch", "granule", energy.alias("energy"), F.crc32(F.array_join(F.transform("pcm", lambda x: x.cast("string")), ",").cast("binary")).alias("pcm_crc32"))


QUERIES = {"encode_frames": encode_frames, "decode_pcm": decode_pcm}
