"""Frame headers as native columns over a 32-bit word held in a long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulo.functions.tables import bitrate_dim

#: name -> (lowest bit, number of bits)
FIELDS = {
    "version_bits": (19, 2), "layer_bits": (17, 2), "no_crc": (16, 1), "bitrate_index": (12, 4), "sample_rate_index": (10, 2), "padding": (9, 1),
    "private_bit": (8, 1), "mode_bits": (6, 2), "mode_extension": (4, 2), "copyright": (3, 1), "original": (2, 1), "emphasis": (0, 2),
}


def word(data: Column, at: Column | int = 1) -> Column:
    """The big-endian word at a 1-based place of a binary column."""
    return F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")


def bits(h: Column, name: str) -> Column:
    low, n = FIELDS[name]
    return F.shiftright(h, low).bitwiseAND((1 << n) - 1)


def fields(h: Column) -> dict[str, Column]:
    return {n: bits(h, n) for n in FIELDS}


def reject_reason(h: Column) -> Column:
    """Why a word is no header, the first reason that holds; null for a header."""
    return (
        F.when(h.bitwiseAND(0xFFE00000) != 0xFFE00000, "bad sync")
        .when(bits(h, "version_bits") == 1, "reserved version bits")
        .when(bits(h, "layer_bits") == 0, "reserved layer bits")
        .when(bits(h, "sample_rate_index") == 3, "reserved sample-rate index")
        .when(bits(h, "bitrate_index") == 15, "forbidden bitrate index")
    )


def parsed(rows: DataFrame, h: str = "h") -> DataFrame:
    """Rows whose word is a header, with version, layer, bitrate, sample rate, channel mode and the remaining fields.

    Filters on these columns are pushed below the broadcast of the bitrates. Free format has bitrate 0.
    """
    c = F.col(h)
    valid = rows.where(reject_reason(c).isNull()).withColumns(fields(c))
    v = F.col("version_bits")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("stereo", "joint", "dual", "mono")]), (F.col("mode_bits") + 1).cast("int"))
    base = F.element_at(F.array(F.lit(44100), F.lit(48000), F.lit(32000)), (F.col("sample_rate_index") + 1).cast("int"))
    divisor = F.when(v == 3, 1).when(v == 2, 2).otherwise(4)
    valid = valid.withColumns({
        "version": F.when(v == 3, "1").when(v == 2, "2").otherwise("2.5"), "version_group": F.when(v == 3, 1).otherwise(2),
        "layer": (4 - F.col("layer_bits")).cast("int"), "channel_mode": mode, "channels": F.when(F.col("mode_bits") == 3, 1).otherwise(2),
        "sample_rate": F.floor(base / divisor).cast("int"),
    })
    return valid.join(F.broadcast(bitrate_dim(rows.sparkSession)), ["version_group", "layer", "bitrate_index"])


def samples_per_frame() -> Column:
    return F.when(F.col("layer") == 1, 384).when((F.col("layer") == 2) | (F.col("version_group") == 1), 1152).otherwise(576)


def side_info_bytes() -> Column:
    mono = F.col("channels") == 1
    return F.when(F.col("version_group") == 1, F.when(mono, 17).otherwise(32)).otherwise(F.when(mono, 9).otherwise(17))


def frame_bytes() -> Column:
    """Length of a frame; null for free format."""
    rate, kbps, pad = F.col("sample_rate"), F.col("bitrate_kbps"), F.col("padding")
    div = lambda n: F.floor(n * kbps * 1000 / rate)
    slots = F.when(F.col("layer") == 1, (div(12) + pad) * 4).when((F.col("layer") == 3) & (F.col("version_group") == 2), div(72) + pad).otherwise(div(144) + pad)
    return F.when(kbps > 0, slots.cast("long"))


def geometry(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"samples": samples_per_frame(), "side_bytes": side_info_bytes(), "frame_bytes": frame_bytes(), "codec": F.concat(F.lit("mp"), F.col("layer"))})
