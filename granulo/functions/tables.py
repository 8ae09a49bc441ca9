"""Fixed values of the coding standard, and small dimension tables made of them."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession

# Kilobits a second by bitrate index 0 (free format) to 14, by (version group, layer). Index 15 is forbidden.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = [44100, 48000, 32000]

# Where the long bands begin and end among 576 lines, by sample rate.
LONG_BANDS = {
    44100: [0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 52, 62, 74, 90, 110, 134, 162, 196, 238, 288, 342, 418, 576],
    48000: [0, 4, 8, 12, 16, 20, 24, 30, 36, 42, 50, 60, 72, 88, 106, 128, 156, 190, 230, 276, 330, 384, 576],
    32000: [0, 4, 8, 12, 16, 20, 24, 30, 36, 44, 54, 66, 82, 102, 126, 156, 194, 240, 296, 364, 448, 550, 576],
    22050: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 116, 140, 168, 200, 238, 284, 336, 396, 464, 522, 576],
    24000: [0, 6, 12, 18, 24, 30, 36, 44, 54, 66, 80, 96, 114, 136, 162, 194, 232, 278, 330, 394, 464, 540, 576],
    8000: [0, 12, 24, 36, 48, 60, 72, 88, 108, 132, 160, 192, 232, 280, 336, 400, 476, 566, 568, 570, 572, 574, 576],
}
for _rate in (16000, 11025, 12000):
    LONG_BANDS[_rate] = LONG_BANDS[22050]
# The short bands among the 192 lines of a window.
SHORT_BANDS = {
    44100: [0, 4, 8, 12, 16, 22, 30, 40, 52, 66, 84, 106, 136, 192],
    48000: [0, 4, 8, 12, 16, 22, 28, 38, 50, 64, 80, 100, 126, 192],
    32000: [0, 4, 8, 12, 16, 22, 30, 42, 58, 78, 104, 138, 180, 192],
    22050: [0, 4, 8, 12, 18, 24, 32, 42, 56, 74, 100, 132, 174, 192],
    24000: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 136, 180, 192],
    16000: [0, 4, 8, 12, 18, 26, 36, 48, 62, 80, 104, 134, 174, 192],
    8000: [0, 8, 16, 24, 36, 52, 72, 96, 124, 160, 162, 164, 166, 192],
}
SHORT_BANDS[11025], SHORT_BANDS[12000] = SHORT_BANDS[22050], SHORT_BANDS[24000]
# Extra scalefactor of each long band when preflag is set.
PRETAB = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0]
# The alias reduction's coefficients c, from which cs = 1/sqrt(1+c*c) and ca = c/sqrt(1+c*c) follow.
ALIAS_C = [-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037]
# Scalefactor bit lengths by scalefac_compress.
SLEN = [(0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3)]
# Radices that low-rate scalefac_compress is written in, by range, and band counts by range for long, short and mixed blocks.
LSF_RADIX = [(5, 5, 4, 4), (5, 5, 4, 1), (4, 3, 1, 1), (5, 6, 6, 1), (4, 4, 4, 1), (4, 3, 1, 1)]
LSF_COUNTS = {
    "long": [(6, 5, 5, 5), (6, 5, 7, 3), (11, 10, 0, 0), (7, 7, 7, 0), (6, 6, 6, 3), (8, 8, 5, 0)],
    "short": [(9, 9, 9, 9), (9, 9, 12, 6), (18, 18, 0, 0), (12, 12, 12, 0), (12, 9, 9, 6), (15, 12, 9, 0)],
    "mixed": [(6, 9, 9, 9), (6, 9, 12, 6), (15, 18, 0, 0), (6, 15, 12, 0), (6, 12, 9, 6), (6, 18, 9, 0)],
}
# Upper edges of the critical bands in Hz.
BARK_EDGES = [100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500]
# Fixed values: (code word, length in bits) of the pair tables for x = 0.., y = 0.. row by row.
PAIR_CODES = {
    1: [(1, 1), (1, 3), (1, 2), (0, 3)],
    2: [(1, 1), (2, 3), (1, 6), (3, 3), (1, 3), (1, 5), (3, 5), (2, 5), (0, 6)],
    3: [(3, 2), (2, 2), (1, 6), (1, 3), (1, 2), (1, 5), (3, 5), (2, 5), (0, 6)],
    5: [(1, 1), (2, 3), (6, 6), (5, 7), (3, 3), (1, 3), (4, 6), (4, 7), (7, 6), (5, 6), (7, 7), (1, 8), (6, 7), (1, 6), (1, 7), (0, 8)],
    6: [(7, 3), (3, 3), (5, 5), (1, 7), (6, 3), (2, 2), (3, 4), (2, 5), (5, 4), (4, 4), (4, 5), (1, 6), (3, 6), (3, 5), (2, 6), (0, 7)],
    7: [
        (1, 1), (2, 3), (10, 6), (19, 8), (16, 8), (10, 9),
        (3, 3), (3, 4), (7, 6), (10, 7), (5, 7), (3, 8),
        (11, 6), (4, 5), (13, 7), (17, 8), (8, 8), (4, 9),
        (12, 7), (11, 7), (18, 8), (15, 9), (11, 9), (2, 9),
        (7, 7), (6, 7), (9, 8), (14, 9), (3, 9), (1, 10),
        (6, 8), (4, 8), (5, 9), (3, 10), (2, 10), (0, 10),
    ],
    8: [
        (3, 2), (4, 3), (6, 6), (18, 8), (12, 8), (5, 9),
        (5, 3), (1, 2), (2, 4), (16, 8), (9, 8), (3, 8),
        (7, 6), (3, 4), (5, 6), (14, 8), (7, 8), (3, 9),
        (19, 8), (17, 8), (15, 8), (13, 9), (10, 9), (4, 10),
        (13, 8), (5, 7), (8, 8), (11, 9), (5, 10), (1, 10),
        (12, 9), (4, 8), (4, 9), (1, 9), (1, 11), (0, 11),
    ],
    9: [
        (7, 3), (5, 3), (9, 5), (14, 6), (15, 8), (7, 9),
        (6, 3), (4, 3), (5, 4), (5, 5), (6, 6), (7, 8),
        (7, 4), (6, 4), (8, 5), (8, 6), (8, 7), (5, 8),
        (15, 6), (6, 5), (9, 6), (10, 7), (5, 7), (1, 8),
        (11, 7), (7, 6), (9, 7), (6, 7), (4, 8), (1, 9),
        (14, 8), (4, 7), (6, 8), (2, 8), (6, 9), (0, 9),
    ],
    10: [
        (1, 1), (2, 3), (10, 6), (23, 8), (35, 9), (30, 9), (12, 9), (17, 10),
        (3, 3), (3, 4), (8, 6), (12, 7), (18, 8), (21, 9), (12, 8), (7, 8),
        (11, 6), (9, 6), (15, 7), (21, 8), (32, 9), (40, 10), (19, 9), (6, 9),
        (14, 7), (13, 7), (22, 8), (34, 9), (46, 10), (23, 10), (18, 9), (7, 10),
        (20, 8), (19, 8), (33, 9), (47, 10), (27, 10), (22, 10), (9, 10), (3, 10),
        (31, 9), (22, 9), (41, 10), (26, 10), (21, 11), (20, 11), (5, 10), (3, 11),
        (14, 8), (13, 8), (10, 9), (11, 10), (16, 10), (6, 10), (5, 11), (1, 11),
        (9, 9), (8, 8), (7, 9), (8, 10), (4, 10), (4, 11), (2, 11), (0, 11),
    ],
    11: [
        (3, 2), (4, 3), (10, 5), (24, 7), (34, 8), (33, 9), (21, 8), (15, 9),
        (5, 3), (3, 3), (4, 4), (10, 6), (32, 8), (17, 8), (11, 7), (10, 8),
        (11, 5), (7, 5), (13, 6), (18, 7), (30, 8), (31, 9), (20, 8), (5, 8),
        (25, 7), (11, 6), (19, 7), (59, 9), (27, 8), (18, 10), (12, 8), (5, 9),
        (35, 8), (33, 8), (31, 8), (58, 9), (30, 9), (16, 10), (7, 9), (5, 10),
        (28, 8), (26, 8), (32, 9), (19, 10), (17, 10), (15, 11), (8, 10), (14, 11),
        (14, 8), (12, 7), (9, 7), (13, 8), (14, 9), (9, 10), (4, 10), (1, 10),
        (11, 8), (4, 7), (6, 8), (6, 9), (6, 10), (3, 10), (2, 10), (0, 10),
    ],
    12: [
        (9, 4), (6, 3), (16, 5), (33, 7), (41, 8), (39, 9), (38, 9), (26, 9),
        (7, 3), (5, 3), (6, 4), (9, 5), (23, 7), (16, 7), (26, 8), (11, 8),
        (17, 5), (7, 4), (11, 5), (14, 6), (21, 7), (30, 8), (10, 7), (7, 8),
        (17, 6), (10, 5), (15, 6), (12, 6), (18, 7), (28, 8), (14, 8), (5, 8),
        (32, 7), (13, 6), (22, 7), (19, 7), (18, 8), (16, 8), (9, 8), (5, 9),
        (40, 8), (17, 7), (31, 8), (29, 8), (17, 8), (13, 9), (4, 8), (2, 9),
        (27, 8), (12, 7), (11, 7), (15, 8), (10, 8), (7, 9), (4, 9), (1, 10),
        (27, 9), (12, 8), (8, 8), (12, 9), (6, 9), (3, 9), (1, 9), (0, 10),
    ],
}
# Fixed values: (code word, length in bits) of quadruple table A for (v, w, x, y) counted in binary. Table B is 15 - n in four bits.
QUAD_A = [(1, 1), (5, 4), (4, 4), (5, 5), (6, 4), (5, 6), (4, 5), (4, 6), (7, 4), (3, 5), (6, 5), (0, 6), (7, 5), (2, 6), (3, 6), (1, 6)]


#: Tables 13, 15, 16 and 24 have 256 words each and are a parameter: ``read_pair_tables`` takes them from a file.
LARGE = (13, 15, 16, 24)
# Bits behind a value of 15 by table; tables 16 to 23 share the words of 16, 24 to 31 those of 24.
LINBITS = {**{16 + i: n for i, n in enumerate((1, 2, 3, 4, 6, 8, 10, 13))}, **{24 + i: n for i, n in enumerate((4, 5, 6, 7, 8, 9, 11, 13))}}


def add_pair_table(table: int, words: list[tuple[int, int]]) -> None:
    """Makes a further table known: (code, length) for x = 0.., y = 0.. row by row, a complete prefix code."""
    if round(len(words) ** 0.5) ** 2 != len(words) or sum(2.0**-n for _, n in words) != 1:
        raise ValueError(f"table {table} is no complete square prefix code")
    PAIR_CODES[table] = [tuple(w) for w in words]


def read_pair_tables(path: str) -> list[int]:
    """Makes the tables of a text file known and returns their numbers: lines of table, x, y and code word in zeros and ones; # begins a comment.

    Workers read the file themselves (``plans.decode`` and ``plans.encode`` pass its path on), so all must reach it.
    """
    found: dict[int, dict[tuple[int, int], str]] = {}
    with open(path) as f:
        for line in f:
            if parts := line.split("#")[0].split():
                table, x, y = map(int, parts[:3])
                found.setdefault(table, {})[x, y] = parts[3]
    for table, words in found.items():
        side = round(len(words) ** 0.5)
        add_pair_table(table, [(int(w, 2), len(w)) for x in range(side) for y in range(side) for w in [words[x, y]]])
    return sorted(found)


def pair_rows() -> list[tuple[int, int, int, int, int]]:
    """``(table, code, len, x, y)`` of the known pair tables."""
    out = []
    for t, words in PAIR_CODES.items():
        side = round(len(words) ** 0.5)
        out += [(t, c, n, i // side, i % side) for i, (c, n) in enumerate(words)]
    return out


def quad_rows() -> list[tuple[str, int, int, int]]:
    """``(table, code, len, n)``, n holding v, w, x, y from its highest bit."""
    return [("A", c, n, i) for i, (c, n) in enumerate(QUAD_A)] + [("B", 15 - i, 4, i) for i in range(16)]


def intensity_ratio(position: int) -> tuple[float, float]:
    """Left and right factors of a position from 0 to 6: tan(position * pi / 12) is left to right."""
    from math import pi, tan

    if position == 6:
        return 1.0, 0.0
    t = tan(position * pi / 12)
    return t / (1 + t), 1 / (1 + t)


def long_bands(rate: int) -> list[tuple[int, int, int]]:
    """``(sfb, first, end)``. Rates that are not known take those of 44100."""
    return [(k, a, b) for k, (a, b) in enumerate(pairwise(LONG_BANDS.get(rate, LONG_BANDS[44100])))]


def dimension(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small fixed table."""
    return spark.createDataFrame(rows, schema)


def bitrate_dim(spark: SparkSession) -> DataFrame:
    rows = [(v, layer, i, k) for (v, layer), ks in BITRATES.items() for i, k in enumerate(ks)]
    return dimension(spark, rows, "version_group int, layer int, bitrate_index long, bitrate_kbps int")


def values_sql(rows: list) -> str:
    """Rows as the body of a SQL VALUES list."""
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)
