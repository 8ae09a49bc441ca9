"""Layer III bit streams: side information, scalefactors and code words, read and written frame by frame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granulo.functions.tables import LINBITS, LONG_BANDS, LSF_COUNTS, LSF_RADIX, PAIR_CODES, SLEN, pair_rows, quad_rows, read_pair_tables
from granulo.sources.coded_audio import Header, header


class Bits:
    """A reading place in a string of bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.size, self.at, self.data = 8 * len(data), at, data

    def peek(self, n: int) -> int:
        """The next n (at most 56) bits, zeros standing for what is missing."""
        first = self.at >> 3
        word = self.data[first : first + 8]
        over = 8 * len(word) - (self.at & 7) - n
        value = int.from_bytes(word, "big")
        return (value >> over if over >= 0 else value << -over) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("stream exhausted")
        out = self.peek(n)
        self.at += n
        return out


class Writer:
    """Bits in the order in which they are put."""

    def __init__(self):
        self.parts, self.size = [], 0

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value & ((1 << n) - 1), f"0{n}b"))
            self.size += n

    def extend(self, other: Writer) -> None:
        self.parts += other.parts
        self.size += other.size

    def bytes(self) -> bytes:
        return int("".join(["0", *self.parts]) + "0" * (-self.size % 8), 2).to_bytes(-(-self.size // 8), "big")


@dataclass
class Granule:
    part2_3_length: int = 0
    big_values: int = 0
    global_gain: int = 0
    scalefac_compress: int = 0
    window_switching: int = 0
    block_type: int = 0
    mixed: int = 0
    table_select: list[int] = field(default_factory=lambda: [0, 0, 0])
    subblock_gain: list[int] = field(default_factory=lambda: [0, 0, 0])
    region0_count: int = 0
    region1_count: int = 0
    preflag: int = 0
    scalefac_scale: int = 0
    count1_table: int = 0

    @property
    def short(self) -> bool:
        return bool(self.window_switching) and self.block_type == 2


@dataclass
class SideInfo:
    main_data_begin: int
    scfsi: list[list[int]]
    granules: list[list[Granule]]


def _layout(mpeg1: bool, mono: bool) -> tuple[int, int, int, int]:
    """Bits of main_data_begin, private bits, granules, and scalefac_compress bits."""
    return (9, 5 if mono else 3, 2, 4) if mpeg1 else (8, 1 if mono else 2, 1, 9)


def read_side_info(data: bytes, mpeg1: bool, mono: bool) -> SideInfo:
    bits = Bits(data)
    begin_bits, private, n_granules, compress_bits = _layout(mpeg1, mono)
    channels = 1 if mono else 2
    begin = bits.take(begin_bits)
    bits.take(private)
    scfsi = [[bits.take(1) for _ in range(4)] if mpeg1 else [0] * 4 for _ in range(channels)]
    granules = []
    for _ in range(n_granules):
        row = []
        for _ in range(channels):
            g = Granule(bits.take(12), bits.take(9), bits.take(8), bits.take(compress_bits), bits.take(1))
            if g.window_switching:
                g.block_type, g.mixed = bits.take(2), bits.take(1)
                g.table_select = [bits.take(5), bits.take(5), 0]
                g.subblock_gain = [bits.take(3) for _ in range(3)]
                g.region0_count, g.region1_count = (8 if g.block_type == 2 and not g.mixed else 7), 36
            else:
                g.table_select = [bits.take(5) for _ in range(3)]
                g.region0_count, g.region1_count = bits.take(4), bits.take(3)
            g.preflag = bits.take(1) if mpeg1 else int(g.scalefac_compress >= 500)
            g.scalefac_scale, g.count1_table = bits.take(1), bits.take(1)
            row.append(g)
        granules.append(row)
    return SideInfo(begin, scfsi, granules)


def write_side_info(info: SideInfo, mpeg1: bool, mono: bool) -> bytes:
    out = Writer()
    begin_bits, private, _, compress_bits = _layout(mpeg1, mono)
    out.put(info.main_data_begin, begin_bits)
    out.put(0, private)
    if mpeg1:
        for flags in info.scfsi:
            for f in flags:
                out.put(f, 1)
    for row in info.granules:
        for g in row:
            if g.part2_3_length > 4095:
                raise ValueError("a granule holds 4095 bits at most")
            for value, n in ((g.part2_3_length, 12), (g.big_values, 9), (g.global_gain, 8), (g.scalefac_compress, compress_bits), (g.window_switching, 1)):
                out.put(value, n)
            if g.window_switching:
                tail = [(g.block_type, 2), (g.mixed, 1), *[(t, 5) for t in g.table_select[:2]], *[(s, 3) for s in g.subblock_gain]]
            else:
                tail = [*[(t, 5) for t in g.table_select], (g.region0_count, 4), (g.region1_count, 3)]
            for value, n in [*tail, *([(g.preflag, 1)] if mpeg1 else []), (g.scalefac_scale, 1), (g.count1_table, 1)]:
                out.put(value, n)
    return out.bytes()


@dataclass
class Scalefactors:
    long: list[int] = field(default_factory=lambda: [0] * 22)
    short: list[list[int]] = field(default_factory=lambda: [[0] * 3 for _ in range(13)])


#: Groups of long bands that one flag reuses, and whether the second length holds there.
GROUPS = [(0, 6, 0), (6, 11, 0), (11, 16, 1), (16, 21, 1)]


def read_scalefactors(bits: Bits, g: Granule, scfsi: list[int], gr: int, first: Scalefactors | None) -> Scalefactors:
    """Of MPEG-1; groups that are flagged in the second granule are those of the first."""
    out, slen = Scalefactors(), SLEN[g.scalefac_compress]
    if g.short:
        for b in range(8 if g.mixed else 0):
            out.long[b] = bits.take(slen[0])
        for b in range(3 if g.mixed else 0, 12):
            out.short[b] = [bits.take(slen[b >= 6]) for _ in range(3)]
        return out
    for k, (a, b, which) in enumerate(GROUPS):
        out.long[a:b] = first.long[a:b] if gr and scfsi[k] and first else [bits.take(slen[which]) for _ in range(b - a)]
    return out


def low_rate_lengths(compress: int, intensity: bool) -> tuple[list[int], int]:
    """Four bit lengths and the range of a low-rate scalefac_compress."""
    value, base = (compress >> 1 if intensity else compress), 3 if intensity else 0
    for k in range(base, base + 3):
        size = int(np.prod(LSF_RADIX[k]))
        if value < size:
            out = []
            for radix in reversed(LSF_RADIX[k]):
                out.append(value % radix)
                value //= radix
            return out[::-1], k
        value -= size
    raise ValueError("scalefac_compress out of range")


def read_low_rate_scalefactors(bits: Bits, g: Granule, intensity: bool) -> Scalefactors:
    lengths, k = low_rate_lengths(g.scalefac_compress, intensity)
    shape = "long" if not g.short else "mixed" if g.mixed else "short"
    values = [bits.take(n) for n, count in zip(lengths, LSF_COUNTS[shape][k]) for _ in range(count)]
    values += [0] * (40 - len(values))
    out = Scalefactors()
    n_long = {"long": 22, "mixed": 6, "short": 0}[shape]
    out.long[:n_long] = values[:n_long]
    for j in range({"long": 0, "mixed": 30, "short": 39}[shape]):
        out.short[(3 if g.mixed else 0) + j // 3][j % 3] = values[n_long + j]
    return out


def base_table(table: int) -> int:
    return 16 if 16 <= table < 24 else 24 if table >= 24 else table


_made: dict = {}


def _of_table(kind: str, table: int, make):
    """What ``make`` makes of a pair table's rows, once for as long as the table has these words."""
    base = base_table(table)
    if base not in PAIR_CODES:
        raise ValueError(f"table {table} is reserved" if base in (4, 14) else f"table {table} is not among the stated ones: tables.read_pair_tables takes it from a file")
    held = _made.get((kind, base))
    if held is None or held[0] is not PAIR_CODES[base]:
        held = _made[kind, base] = PAIR_CODES[base], make([r for r in pair_rows() if r[0] == base])
    return held[1]


def pair_words(table: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Code and length by values."""
    return _of_table("words", table, lambda rows: {(x, y): (code, n) for _, code, n, x, y in rows})


def pair_lengths(table: int) -> np.ndarray:
    """Lengths by values, with the sign bits, as a square."""

    def make(rows: list) -> np.ndarray:
        side = round(len(rows) ** 0.5)
        return np.array([n + (x > 0) + (y > 0) for _, _, n, x, y in rows]).reshape(side, side)

    return _of_table("lengths", table, make)


def _pair_lookup(table: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The longest word's length, and for each string of so many bits the word's length and values."""

    def make(rows: list) -> tuple[int, list]:
        most = max(r[2] for r in rows)
        out: list = [None] * (1 << most)
        for _, code, n, x, y in rows:
            out[code << (most - n) : (code + 1) << (most - n)] = [(n, x, y)] * (1 << (most - n))
        return most, out

    return _of_table("lookup", table, make)


@lru_cache(maxsize=2)
def quad_words(table: int) -> list[tuple[int, int]]:
    return [(code, n) for t, code, n, _ in sorted(quad_rows(), key=lambda r: r[3]) if t == "AB"[table]]


@lru_cache(maxsize=2)
def _quad_lookup(table: int) -> list[tuple[int, int]]:
    out: list = [None] * 64
    for t, code, n, v in quad_rows():
        if t == "AB"[table]:
            for i in range(code << (6 - n), (code + 1) << (6 - n)):
                out[i] = (n, v)
    return out


def read_pair(bits: Bits, table: int) -> tuple[int, int]:
    most, found = _pair_lookup(table)
    if bits.at >= bits.size:
        raise ValueError("stream exhausted")
    n, *values = found[bits.peek(most)]
    bits.take(n)
    out = []
    for v in values:
        if v == 15 and table in LINBITS:
            v += bits.take(LINBITS[table])
        out.append(-v if v and bits.take(1) else v)
    return out[0], out[1]


def read_quad(bits: Bits, table: int) -> list[int]:
    if bits.at >= bits.size:
        raise ValueError("stream exhausted")
    n, v = _quad_lookup(table)[bits.peek(6)]
    bits.take(n)
    return [-m if m and bits.take(1) else m for m in ((v >> 3) & 1, (v >> 2) & 1, (v >> 1) & 1, v & 1)]


def region_ends(g: Granule, rate: int) -> tuple[int, int]:
    if g.short:
        return 36, 576
    bands = LONG_BANDS.get(rate, LONG_BANDS[44100])
    return bands[min(g.region0_count + 1, 22)], bands[min(g.region0_count + g.region1_count + 2, 22)]


def read_values(bits: Bits, g: Granule, rate: int, end: int) -> np.ndarray:
    """The 576 quantised lines; ``end`` is the bit at which the granule's part ends."""
    out, k = np.zeros(576, np.int32), 0
    first, second = region_ends(g, rate)
    while k < min(2 * g.big_values, 576):
        table = g.table_select[0 if k < first else 1 if k < second else 2]
        if table:
            out[k : k + 2] = read_pair(bits, table)
        k += 2
    while k + 4 <= 576 and bits.at < end:
        out[k : k + 4] = read_quad(bits, g.count1_table)
        k += 4
    return out


def split_values(q: np.ndarray) -> tuple[int, int]:
    """Where the pairs end and where the quadruples of at most one end, both even."""
    used, large = np.flatnonzero(q), np.flatnonzero(np.abs(q) > 1)
    last = int(used[-1]) + 1 if len(used) else 0
    last += last % 2
    top = int(large[-1]) + 1 if len(large) else 0
    return last - (last - top) // 4 * 4, last


def write_values(q: np.ndarray, tables: int | list[int], ends: tuple[int, int] = (576, 576), quads: int = 0) -> tuple[Writer, int]:
    """The code words of 576 lines, and how many pairs are large: a pair table for each of three regions (or one for all) that end at ``ends``, a table for quadruples."""
    out = Writer()
    big, last = split_values(q)
    tables = [tables] * 3 if isinstance(tables, int) else tables
    edges = (0, min(ends[0], big), min(ends[1], big), big)
    for table, a, b in zip(tables, edges, edges[1:]):
        if a >= b:
            continue
        if table == 0:
            if q[a:b].any():
                raise ValueError("table 0 is for zeros")
            continue
        words, wide = pair_words(table), LINBITS.get(table)
        for x, y in q[a:b].reshape(-1, 2).tolist():
            ax, ay = abs(x), abs(y)
            out.put(*words[(min(ax, 15), min(ay, 15)) if wide else (ax, ay)])
            for v, m in ((x, ax), (y, ay)):
                if wide and m >= 15:
                    out.put(m - 15, wide)
                if v:
                    out.put(v < 0, 1)
    words = quad_words(quads)
    for at in range(big, last, 4):
        four = [*q[at : at + 4].tolist(), 0, 0][:4]
        out.put(*words[sum((v != 0) << (3 - i) for i, v in enumerate(four))])
        for v in four:
            if v:
                out.put(v < 0, 1)
    return out, big // 2


GRANULES = "path string, frame long, pts long, gr int, ch int, version int, sample_rate int, channels int, mode_extension int, joint boolean, q array<int>, global_gain int, block_type int, mixed boolean, subblock_gain array<int>, preflag int, scalefac_scale int, intensity_scale int, long_sf array<int>, short_sf array<int>, error string"
_NAMES = [c.split()[0] for c in GRANULES.split(", ")]


def frame_parts(frame: bytes) -> tuple[Header, SideInfo, bytes]:
    """Header, side information and main data of a Layer III frame; the checksum is skipped."""
    h = header(frame)
    if h is None or h.layer != 3:
        raise ValueError("no Layer III frame")
    at = 4 + (2 if h.protected else 0)
    if len(frame) < at + h.side_bytes:
        raise ValueError("frame too short")
    return h, read_side_info(frame[at : at + h.side_bytes], h.version == 1, h.mono), frame[at + h.side_bytes :]


def read_granules(h: Header, info: SideInfo, main: bytes) -> Iterator[tuple[int, int, Granule, Scalefactors, np.ndarray]]:
    """``(gr, ch, granule, scalefactors, values)``. Where each begins follows from the lengths alone."""
    at, firsts = 0, {}
    for gr, row in enumerate(info.granules):
        for ch, g in enumerate(row):
            if at // 8 >= len(main):
                raise ValueError("ran out of main data")
            bits = Bits(main, at)
            if h.version == 1:
                sf = read_scalefactors(bits, g, info.scfsi[ch], gr, firsts.get(ch))
            else:
                sf = read_low_rate_scalefactors(bits, g, h.joint and bool(h.mode_extension & 1) and ch == 1)
            firsts.setdefault(ch, sf)
            yield gr, ch, g, sf, read_values(bits, g, h.rate, at + g.part2_3_length)
            at += g.part2_3_length


_STATED = dict(PAIR_CODES)


@lru_cache(maxsize=8)
def _tables_of(path: str) -> dict:
    return {t: PAIR_CODES[t] for t in read_pair_tables(path)}


def with_tables(path: str | None) -> None:
    """From now on this process knows the stated pair tables and those of the file, and no others that a task before brought."""
    more = _tables_of(path) if path else {}
    PAIR_CODES.clear()
    PAIR_CODES.update(_STATED | more)


def granules(frames: DataFrame, tables: str | None = None) -> DataFrame:
    """GRANULES of frames (``path, frame, pts, data, view``): ``view`` is the frame's main data after what the reservoir gives, null where it lacks bytes.

    A frame without its reservoir gives silent granules; a frame that cannot be read gives one row with an error and no values.
    ``tables`` is a file of further pair tables (``tables.read_pair_tables``).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_tables(tables)
        for batch in batches:
            rows = []
            for path, frame, pts, data, view in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "pts", "data", "view"))):
                try:
                    h, info, _ = frame_parts(data)
                    shape = (h.version, h.rate, 1 if h.mono else 2, h.mode_extension, h.joint)
                    if view is None:
                        for gr, row in enumerate(info.granules):
                            rows += [(path, frame, pts, gr, ch, *shape, [0] * 576, 0, 0, False, [0] * 3, 0, 0, 0, [0] * 22, [0] * 39, "no reservoir") for ch in range(len(row))]
                        continue
                    got = list(read_granules(h, info, view))
                    rows += [(path, frame, pts, gr, ch, *shape, q.tolist(), g.global_gain, g.block_type if g.window_switching else 0, bool(g.mixed), g.subblock_gain, g.preflag, g.scalefac_scale, g.scalefac_compress & 1, sf.long, [v for w in sf.short for v in w], None) for gr, ch, g, sf, q in got]
                except (ValueError, TypeError) as e:
                    rows.append((path, frame, pts, None, None, *[None] * 15, str(e)))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)

    return frames.select("path", "frame", "pts", "data", "view").mapInArrow(work, GRANULES)
