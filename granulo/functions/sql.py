"""SQL functions over frame headers and coded files, for ``spark.sql``.

The header functions are SQL expressions that Catalyst inlines; ``audio_frames`` is a table function over a file's bytes.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from granulo.functions.tables import BITRATES
from granulo.sources.coded_audio import header, split


def _list(values: list[int]) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def _bits(low: int, n: int) -> str:
    return f"(shiftright(h, {low}) & {(1 << n) - 1})"


_GROUP = f"CASE WHEN {_bits(19, 2)} = 3 THEN 1 ELSE 2 END"
_LAYER = f"(4 - {_bits(17, 2)})"
_DIVISOR = f"CASE {_bits(19, 2)} WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END"
_KBPS = " ".join(f"WHEN ({_GROUP}) = {v} AND {_LAYER} = {layer} THEN get({_list(ks)}, CAST({_bits(12, 4)} AS INT))" for (v, layer), ks in BITRATES.items())

#: Name to (type, expression over the header word ``h``). All but the first are null where the word is no header.
HEADER_FUNCTIONS = {
    "audio_reject_reason": ("STRING", f"CASE WHEN (h & 4292870144) <> 4292870144 THEN 'bad sync' WHEN {_bits(19, 2)} = 1 THEN 'reserved version bits' WHEN {_bits(17, 2)} = 0 THEN 'reserved layer bits' WHEN {_bits(10, 2)} = 3 THEN 'reserved sample-rate index' WHEN {_bits(12, 4)} = 15 THEN 'forbidden bitrate index' END"),
    "audio_version": ("STRING", f"CASE {_bits(19, 2)} WHEN 3 THEN '1' WHEN 2 THEN '2' ELSE '2.5' END"),
    "audio_layer": ("INT", f"CAST({_LAYER} AS INT)"),
    "audio_kbps": ("INT", f"CASE {_KBPS} END"),
    "audio_sample_rate": ("INT", f"CAST(get({_list([44100, 48000, 32000])}, CAST({_bits(10, 2)} AS INT)) DIV ({_DIVISOR}) AS INT)"),
    "audio_channels": ("INT", f"CASE WHEN {_bits(6, 2)} = 3 THEN 1 ELSE 2 END"),
    "audio_padding": ("INT", f"CAST({_bits(9, 1)} AS INT)"),
    "audio_samples": ("INT", f"CASE WHEN {_LAYER} = 1 THEN 384 WHEN {_LAYER} = 2 OR ({_GROUP}) = 1 THEN 1152 ELSE 576 END"),
    "audio_side_bytes": ("INT", f"CASE WHEN ({_GROUP}) = 1 THEN CASE WHEN {_bits(6, 2)} = 3 THEN 17 ELSE 32 END ELSE CASE WHEN {_bits(6, 2)} = 3 THEN 9 ELSE 17 END END"),
}


@udtf(returnType="frame int, pts long, at long, skipped int, layer int, kbps int, sample_rate int, channels int, data binary")
class AudioFrames:
    """The frames of a coded file; a null or unreadable one has none."""

    def eval(self, content: bytes):
        for n, (pts, at, skipped, data) in enumerate(split(bytes(content or b""))):
            h = header(data)
            yield n, pts, at, skipped, h.layer, h.kbps, h.rate, 1 if h.mono else 2, data


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (kind, text) in HEADER_FUNCTIONS.items():
        body = text if name == "audio_reject_reason" else f"CASE WHEN audio_reject_reason(h) IS NULL THEN {text} END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(h BIGINT) RETURNS {kind} RETURN {body}")
    frame = "CASE WHEN audio_kbps(h) > 0 THEN CASE WHEN audio_layer(h) = 1 THEN (12000 * audio_kbps(h) DIV audio_sample_rate(h) + audio_padding(h)) * 4 ELSE (CASE WHEN audio_layer(h) = 3 AND audio_version(h) <> '1' THEN 72000 ELSE 144000 END) * audio_kbps(h) DIV audio_sample_rate(h) + audio_padding(h) END END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION audio_frame_bytes(h BIGINT) RETURNS BIGINT RETURN {frame}")
    spark.udtf.register("audio_frames", AudioFrames)
    return [*HEADER_FUNCTIONS, "audio_frame_bytes", "audio_frames"]
