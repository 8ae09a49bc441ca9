"""Encoding as a DataFrame plan: PCM to block types, sub-band samples, spectra, frames and files.

Everything that needs samples or spectra works on a granule or a frame by itself, in parallel: block types come from the fold of
onsets, spectra see the granule before, a frame decides its stereo mode, gains, tables and regions. Each frame offers its main
data twice, as its mask asks for it and as it fits the frame's own bytes. Only then one pass over a stream's frames, over a few
hundred bytes each, chooses between the two by what the reservoir holds and lays the bytes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions import filterbank
from granulo.functions.tables import BITRATES, LINBITS, LONG_BANDS, LSF_RADIX, PAIR_CODES, SAMPLE_RATES, intensity_ratio
from granulo.operators import blocks, psycho, spectrum
from granulo.operators.bitstream import Granule, SideInfo, Writer, base_table, pair_lengths, quad_words, region_ends, split_values, with_tables, write_side_info, write_values
from granulo.operators.framing import LOOKBACK
from granulo.plans.decode import _LONG, _SHORT, _SIN12, LONG, MIXED, SHORT, SIGN, WINDOWS, _lists, _matrix, butterflies, entries, order_of, window_of_line, with_before

MOST_BITS = 4095
STATE = {name: i for i, name in enumerate(blocks.STATES)}


@dataclass(frozen=True)
class Options:
    """``kbps`` None asks for a variable rate at ``quality`` 0 (best) to 9, masked by ``model`` 0 (bands), 1 or 2 (partitions, by flatness or prediction).

    ``joint`` and ``intensity`` allow the stereo modes, ``short`` short and mixed blocks, ``reservoir`` frames that begin in the bytes of
    earlier ones. ``tables`` is a file of further pair tables: without them values go to 7, and gains are raised until they do.
    """

    sample_rate: int = 44100
    channels: int = 1
    kbps: int | None = None
    quality: int = 4
    model: int = 0
    joint: bool = True
    intensity: bool = False
    short: bool = True
    reservoir: bool = True
    tables: str | None = None

    def __post_init__(self):
        if self.sample_rate not in (*SAMPLE_RATES, *(r // 2 for r in SAMPLE_RATES)):
            raise ValueError(f"sample rate {self.sample_rate} is not supported")
        if self.channels not in (1, 2):
            raise ValueError("one or two channels")
        if self.kbps is not None and self.kbps not in self.rates[1:]:
            raise ValueError(f"{self.kbps} kbps is no bitrate of this sample rate")
        if not 0 <= self.quality <= 9:
            raise ValueError("quality is 0 to 9")
        if self.model not in (0, 1, 2):
            raise ValueError("model is 0, 1 or 2")

    @classmethod
    def of(cls, sample_rate: int, channels: int, options: dict[str, str]) -> Options:
        """From the names and texts of an encoder's options; ``vbr_quality`` wins over ``cbr_bitrate_kbps``, and other names are an error.

        Where they say nothing, both stereo modes, short blocks and model 1 hold.
        """
        flags = {"joint_stereo": "joint", "intensity_stereo": "intensity", "short_blocks": "short"}
        numbers = {"vbr_quality": "quality", "cbr_bitrate_kbps": "kbps", "psy_model": "model"}
        if unknown := options.keys() - flags.keys() - numbers.keys():
            raise ValueError(f"no option {', '.join(sorted(unknown))}")
        given = {flags.get(k) or numbers[k]: int(v) != 0 if k in flags else int(v) for k, v in options.items()}
        if "quality" in given or not given.get("kbps"):
            given.pop("kbps", None)
        return cls(sample_rate, channels, **{"intensity": True, "model": 1} | given)

    @property
    def mpeg1(self) -> bool:
        return self.sample_rate in SAMPLE_RATES

    @property
    def rates(self) -> list[int]:
        return BITRATES[(1 if self.mpeg1 else 2, 3)]

    @property
    def granules(self) -> int:
        return 2 if self.mpeg1 else 1

    @property
    def side_bytes(self) -> int:
        return (17 if self.channels == 1 else 32) if self.mpeg1 else (9 if self.channels == 1 else 17)

    @property
    def most_back(self) -> int:
        """Bytes that main_data_begin can count."""
        return (LOOKBACK if self.mpeg1 else 255) if self.reservoir else 0

    def length(self, kbps: int) -> int:
        return (144 if self.mpeg1 else 72) * kbps * 1000 // self.sample_rate

    def room(self, kbps: int) -> int:
        """Bytes of main data in a frame."""
        return max(self.length(kbps) - 4 - self.side_bytes, 0)

    def padded(self, n: int, kbps: int) -> bool:
        """Whether frame n of a constant rate is padded, as ``decisions.padded`` has it."""
        rest = (144_000 if self.mpeg1 else 72_000) * kbps % self.sample_rate
        return (n + 1) * rest // (8 * self.sample_rate) > n * rest // (8 * self.sample_rate)


# ---------------------------------------------------------------- block types and spectra


def samples_of(pcm: DataFrame) -> DataFrame:
    """``stream, n, s``: the samples of ``path, ch, granule, pcm`` (576 each), a stream being a struct of path and channel."""
    rows = pcm.select(F.struct("path", "ch").alias("stream"), "granule", F.posexplode("pcm").alias("k", "s"))
    return rows.select("stream", (F.col("granule") * 576 + F.col("k")).alias("n"), F.col("s").cast("long").alias("s"))


#: Samples by which sub-bands come after the PCM that they hold.
DELAY = 240


def block_types(pcm: DataFrame) -> DataFrame:
    """``path, granule, block_type, mixed`` of PCM granules, one type for all channels of a stream, so that stereo modes hold everywhere.

    Onsets are looked for DELAY samples later, where the sub-bands have them, in any channel. A transform sees two granules, so the granule after
    one with an onset counts as having one too. A run from start to stop is mixed if all channels of its short granules say so: the
    long windows of its lowest sub-bands must follow one another.
    """
    rows = samples_of(pcm).withColumn("n", F.col("n") + DELAY)
    onset = blocks.onsets(rows).groupBy(F.col("stream.path").alias("stream"), "block").agg(F.max("onset").alias("onset"))
    again = onset.where("onset").select("stream", (F.col("block") + 1).alias("block"), "onset")
    last = onset.groupBy("stream").agg(F.max("block").alias("last"))
    again = again.join(last, "stream").where("block <= last").drop("last")
    onset = onset.unionByName(again).groupBy("stream", "block").agg(F.max("onset").alias("onset"))
    types = blocks.block_types(onset).select(F.col("stream").alias("path"), F.col("block").alias("granule"), "block_type")
    mixed = blocks.mixed_flags(rows).groupBy(F.col("stream.path").alias("path"), F.col("block").alias("granule")).agg(F.min("mixed").alias("mixed"))
    number = F.element_at(F.create_map(*[F.lit(x) for name, i in STATE.items() for x in (name, i)]), F.col("block_type"))
    rows = types.join(mixed, ["path", "granule"]).select("path", "granule", number.alias("block_type"), "mixed")
    w = Window.partitionBy("path").orderBy("granule")
    rows = rows.withColumn("run", F.sum(((F.col("block_type") == 1) | (F.col("block_type") == 0)).cast("int")).over(w))
    all_mixed = F.min(F.when(F.col("block_type") == 2, F.col("mixed"))).over(Window.partitionBy("path", "run"))
    return rows.select("path", "granule", "block_type", ((F.col("block_type") != 0) & F.coalesce(all_mixed, F.lit(False))).alias("mixed"))


def analyze(pcm: DataFrame, window: list[float] | None = None) -> DataFrame:
    """``path, ch, granule, samples`` of ``path, ch, granule, pcm`` (576 samples): polyphase analysis.

    ``window`` is the standard's synthesis window (32 times the analysis window) or the rule-made one of ``filterbank``.
    """
    filterbank.synthesis_window(window)
    values = F.transform("pcm", lambda v: v.cast("double") / 32768)
    rows = with_before(pcm.select("path", "ch", "granule", values.alias("x")), ["x"], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = np.concatenate([_matrix(part.column(c)) for c in ("x_1", "x")], 1)
                out = filterbank.analysis(both, window)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "ch", "granule")), _lists(out.reshape(len(both), 576))], names=["path", "ch", "granule", "samples"])

    return rows.mapInArrow(work, "path string, ch int, granule long, samples array<double>")


def forward(both: np.ndarray, block_type: int, mixed: bool, rate: int) -> np.ndarray:
    """Windowed forward transforms of sub-bands (granules by 32 by 36): 576 lines in stream order, aliases taken out."""
    out = np.zeros((len(both), 32, 18))
    if block_type != 2:
        out = both @ (_LONG * WINDOWS[block_type][:, None]) / 9
    else:
        for w in range(3):
            out[:, :, w::3] = both[:, :, 6 + 6 * w : 18 + 6 * w] @ (_SHORT * _SIN12[:, None]) / 3
    if mixed:
        out[:, :2] = both[:, :2] @ (_LONG * WINDOWS[0][:, None]) / 9
    shape = LONG if block_type != 2 else MIXED if mixed else SHORT
    x = butterflies(out.reshape(-1, 576), {LONG: 31, SHORT: 0, MIXED: 1}[shape], back=True)
    if shape != LONG:
        y = np.empty_like(x)
        y[:, order_of(rate, shape)] = x
        return y
    return x


def lines(subbands: DataFrame, types: DataFrame | None = None, rate: int = 44100) -> DataFrame:
    """``path, ch, granule, block_type, mixed, x``: spectra of ``path, ch, granule, samples`` (32 sub-bands by 18), each with the granule before it.

    ``types`` has ``path, granule, block_type, mixed``; without it all granules are long.
    """
    rows = with_before(subbands.select("path", "ch", "granule", "samples"), ["samples"], 1)
    kind = (F.lit(0).alias("block_type"), F.lit(False).alias("mixed"))
    rows = rows.select("*", *kind) if types is None else rows.join(types, ["path", "granule"], "left").fillna({"block_type": 0, "mixed": False})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = np.concatenate([_matrix(part.column(c)).reshape(-1, 32, 18) * SIGN for c in ("samples_1", "samples")], 2)
                kinds = list(zip(part.column("block_type").to_pylist(), part.column("mixed").to_pylist()))
                x = np.zeros((len(both), 576))
                for k in set(kinds):
                    i = [j for j, other in enumerate(kinds) if other == k]
                    x[i] = forward(both[i], *k, rate)
                names = ["path", "ch", "granule", "block_type", "mixed"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _lists(x)], names=[*names, "x"])

    return rows.select("path", "ch", "granule", "block_type", "mixed", "samples", "samples_1").mapInArrow(work, "path string, ch int, granule long, block_type int, mixed boolean, x array<double>")


# ---------------------------------------------------------------- values, gains and tables


def quantized(x: np.ndarray, gain: int, lift: np.ndarray | float = 0.0) -> np.ndarray:
    """Values at a gain; ``lift`` is each line's window gain, two of which take eight quarter steps."""
    v = np.minimum(np.floor(np.abs(x) ** 0.75 * 2.0 ** (-3 / 16 * (gain - 210) + 1.5 * lift) + 0.4054), 8191).astype(int)
    return np.where(x < 0, -v, v)


def reach(table: int) -> int:
    side = round(len(PAIR_CODES[base_table(table)]) ** 0.5) - 1
    return side + ((1 << LINBITS[table]) - 1 if table in LINBITS else 0)


def known_tables() -> list[int]:
    return sorted([t for t in PAIR_CODES if t < 16] + [t for t in LINBITS if base_table(t) in PAIR_CODES])


def pair_costs(q: np.ndarray) -> np.ndarray:
    """Bits of each pair of lines under every known table (rows); 10**6 where a table does not reach. The first row is table 0."""
    m = np.abs(q.reshape(-1, 2))
    out = [np.where(m.any(1), 10**6, 0)]
    for table in known_tables():
        size = pair_lengths(table)
        side = len(size) - 1
        cut = np.minimum(m, side)
        cost = size[cut[:, 0], cut[:, 1]]
        if table in LINBITS:
            cost = cost + LINBITS[table] * (m >= 15).sum(1)
        out.append(np.where(m.max(1) <= reach(table), cost, 10**6))
    return np.stack(out)


@lru_cache(maxsize=64)
def _edges(rate: int) -> np.ndarray:
    return np.array(LONG_BANDS.get(rate, LONG_BANDS[44100]))


@dataclass
class Plan:
    """How values are coded: total bits, tables and counts of three regions, table of quadruples."""

    bits: int
    tables: list[int]
    region0: int
    region1: int
    quads: int


def plan_values(q: np.ndarray, rate: int, switched: bool, short: bool) -> Plan | None:
    """The cheapest tables, regions and table of quadruples, the first of equal ones; None if no known table reaches a value."""
    big, last = split_values(q)
    numbers = [0, *known_tables()]
    sums = np.concatenate([np.zeros((len(numbers), 1), int), np.cumsum(pair_costs(q[:big]), 1)], 1) if big else np.zeros((len(numbers), 1), int)
    four = (np.abs(np.r_[q[big:last], np.zeros(-(last - big) % 4, int)]).reshape(-1, 4) > 0) @ np.array([8, 4, 2, 1])
    signs = int((q[big:last] != 0).sum())
    quads = [int(sum(quad_words(t)[v][1] for v in four.tolist())) + signs for t in (0, 1)]
    best = lambda a, b: min((int(c), t) for c, t in zip(sums[:, b // 2] - sums[:, a // 2], numbers)) if b > a else (0, 0)
    if switched:
        g = Granule(window_switching=1, block_type=2 if short else 1, region0_count=7, region1_count=36)
        first, second = (min(e, big) for e in region_ends(g, rate))
        cost, tables = zip(best(0, first), best(first, second))
        found = (sum(cost), [*tables, 0], 0, 0)
    else:
        edges = np.minimum(_edges(rate), big)
        n = len(edges)
        parts = sums[:, edges // 2]
        cost = np.full((n, n), 0)
        for a in range(n):
            cost[a, a:] = (parts[:, a:] - parts[:, a : a + 1]).min(0)
        total = np.full((16, 8), 10**9)
        for r0 in range(16):
            for r1 in range(8):
                i, j = min(r0 + 1, 22), min(r0 + r1 + 2, 22)
                total[r0, r1] = cost[0, i] + cost[i, j] + cost[j, 22]
        r0, r1 = divmod(int(total.argmin()), 8)
        i, j = min(r0 + 1, 22), min(r0 + r1 + 2, 22)
        found = (int(total.min()), [best(edges[a], edges[b])[1] for a, b in ((0, i), (i, j), (j, 22))], r0, r1)
    if found[0] >= 10**6:
        return None
    table = int(quads[1] < quads[0])
    return Plan(found[0] + quads[table], found[1], found[2], found[3], table)


def mask_gain(x: np.ndarray, rate: int, quality: int, shape: str = LONG) -> int:
    """The largest gain whose noise stays below every band's mask, from 60 to 255; 210 for silence. Every window has its own bands."""
    edges = np.array([a for a, *_ in entries(rate, shape)] + ([_edges(rate)[21]] if shape == LONG else []))
    e = np.add.reduceat(x * x, edges)
    if e.max() <= 1e-20:
        return 210
    threshold = np.maximum(e / 10 ** ((30 - quality / 9 * 24) / 10), e.max() * 1e-7 + 1e-12)
    room = (12 * threshold / np.diff(np.append(edges, 576)))[e > 1e-20].min()
    return int(np.clip(np.floor(210 + 2 * np.log2(room) + 1e-9), 60, 255))


def model_gains(spectra: DataFrame, pcm: DataFrame | None, o: Options) -> DataFrame:
    """``path, ch, granule, gain`` of long, short and mixed granules under the partition models, as masks over rows.

    ``pcm`` (``path, ch, granule, pcm``) brings the analysis frames of 1024 samples; model 2 needs them, model 1 is sharper with them.
    """
    key = F.struct("path", "ch", "granule").alias("frame")
    gain = 10 ** ((30 - min(o.quality, 9) / 9 * 30) / 10)
    rows = spectra.select(key, "block_type", "mixed", F.posexplode("x").alias("k", "x")).withColumn("k", F.col("k").cast("long"))
    power = bins = None
    if pcm is not None:
        values = with_before(pcm.select("path", "ch", "granule", F.transform("pcm", lambda v: v.cast("double") / 32768).alias("x")), ["x"], 1)
        history = F.coalesce("x_1", F.array_repeat(F.lit(0.0), 576))
        frames = values.select(key, F.posexplode(F.concat(F.slice(history, 129, 448), "x")).alias("k", "x"))
        bins = spectrum.dft(frames, 1024)
        power = spectrum.power(bins)
    long = rows.where("block_type <> 2").select("frame", "k", "x")
    if o.model == 2 and bins is not None:
        masks = [psycho.mask_by_prediction(long, spectrum.unpredictability(bins), gain, o.sample_rate)]
    elif power is not None:
        masks = [psycho.mask_with_bins(long, power, gain, o.sample_rate)]
    else:
        masks = [psycho.mask_long(long, gain, o.sample_rate)]
    masks.append(psycho.mask_short(rows.where("block_type = 2 AND NOT mixed").select("frame", "k", "x"), gain, o.sample_rate))
    masks.append(psycho.mask_mixed(rows.where("block_type = 2 AND mixed").select("frame", "k", "x"), gain, o.sample_rate))
    gains = [psycho.largest_gain(m.select("frame", "width", "energy", "threshold")) for m in masks]
    every = gains[0].unionByName(gains[1]).unionByName(gains[2])
    return spectra.select("path", "ch", "granule", key).join(every, "frame").select("path", "ch", "granule", "gain")


# ---------------------------------------------------------------- stereo


def mid_side(xs: list[np.ndarray]) -> bool:
    """Whether a frame's spectra (pairs of left and right) have a side energy below 0.30 of the mid energy."""
    mid = sum(((a + b) ** 2).sum() for a, b in xs)
    return bool(mid > 1e-12 and sum(((a - b) ** 2).sum() for a, b in xs) / mid < 0.30)


@lru_cache(maxsize=2)
def _shares(mpeg1: bool) -> np.ndarray:
    """The right channel's share of energy at every position."""
    if mpeg1:
        ratios = [intensity_ratio(p) for p in range(7)]
    else:
        ratios = [(1.0, 1.0) if p == 0 else (0.5 ** ((p + 1) // 2), 1.0) if p % 2 else (1.0, 0.5 ** ((p + 1) // 2)) for p in range(31)]
    return np.array([r * r / (l * l + r * r) for l, r in ratios])  # noqa: E741


def intensity_choice(left: np.ndarray, right: np.ndarray, rate: int, mpeg1: bool, lowest: int = 7) -> tuple[int, list[int]]:
    """The lowest band of the unbroken run from the top of bands that are silent, panned or coherent (21: none), and all bands' positions."""
    edges = _edges(rate)[:21]
    el, er, c = (np.add.reduceat(v, edges)[:21] for v in (left * left, right * right, left * right))
    # the last of the 21 bands ends where the band without a scalefactor begins
    end = _edges(rate)[21]
    el[20], er[20], c[20] = ((v[edges[20] : end]).sum() for v in (left * left, right * right, left * right))
    e, root = el + er, np.sqrt(el * er)
    silent = e < max(e.max(), 1e-12) * 1e-4
    good = silent | (np.abs(el - er) >= 0.85 * e) | ((root > 1e-12) & (np.abs(c) >= 0.85 * root))
    bound = 21
    while bound > lowest and good[bound - 1]:
        bound -= 1
    none = 7 if mpeg1 else 31
    out = [none] * 22
    for b in range(bound, 21):
        out[b] = (7 if mpeg1 else 0) if silent[b] else int(np.abs(_shares(mpeg1) - min(max(er[b] / e[b], 0.0), 1.0)).argmin())
    return bound, out


def intensity_rewrite(left: np.ndarray, right: np.ndarray, bound: int, positions: list[int], rate: int, mpeg1: bool) -> tuple[np.ndarray, np.ndarray]:
    """Left as what both channels are rebuilt from, right as zero, in bands from ``bound`` on."""
    left, right = left.copy(), right.copy()
    edges = _edges(rate)
    for b in range(bound, 21):
        part = slice(edges[b], edges[b + 1])
        a, c, pos = left[part].copy(), right[part].copy(), positions[b]
        if mpeg1 and pos < 7:
            left[part] = np.where((a < 0) | ((a == 0) & (c < 0)), -1.0, 1.0) * np.hypot(a, c)
        elif not mpeg1 and pos == 0:
            left[part] = 0.5 * (a + c)
        elif not mpeg1 and pos < 31 and pos % 2:
            left[part] = c
        right[part] = 0.0
    return left, right


# ---------------------------------------------------------------- frames


@dataclass
class Unit:
    """One granule of one channel: its spectrum, its shape and, in intensity stereo, its positions."""

    x: np.ndarray
    block_type: int = 0
    mixed: bool = False
    gain: int | None = None
    positions: list[int] | None = None

    @property
    def shape(self) -> str:
        return LONG if self.block_type != 2 else MIXED if self.mixed else SHORT


def window_gains(u: Unit, rate: int) -> list[int]:
    """Gains of the three windows as ``decisions.subblock_gains`` has them."""
    if u.block_type != 2:
        return [0, 0, 0]
    of = window_of_line(rate, u.shape)
    e = np.array([(u.x[of == w] ** 2).sum() for w in range(3)])
    low = max(e.min(), 1e-30)
    if e.max() <= 1e-12 or e.max() / low < 2.0:
        return [0, 0, 0]
    return [int(np.clip(np.floor(0.25 * max(math.log2(max(v, 1e-300) / low), 0.0) + 0.5), 0, 7)) for v in e]


def scalefactor_bits(u: Unit, q: np.ndarray, o: Options) -> tuple[Writer, int]:
    """The positions of an intensity granule as its scalefactors, and scalefac_compress; nothing for other granules.

    Below the last band with a value the scalefactor is 0. At low rates the first seven bands hold four bits, so that where they are
    empty they take position 14, which leaves the left channel as it is and the right one at a 128th of it.
    """
    out = Writer()
    if u.positions is None:
        return out, 0
    edges = _edges(o.sample_rate)
    used = np.flatnonzero(q)
    bound = int(np.searchsorted(edges, used[-1], "right")) if len(used) else 0
    lengths = (3, 3, 3) if o.mpeg1 else (4, 5, 5)
    for b in range(21):
        n = lengths[b // 7]
        p = 0 if b < bound else u.positions[b]
        out.put(p if p < 1 << n else 14, n)
    if o.mpeg1:
        return out, 13  # three bits in all bands
    value = 0
    for n, radix in zip((*lengths, 0), LSF_RADIX[3]):
        value = value * radix + n
    return out, value << 1


def coded(u: Unit, o: Options, most_bits: int, start: int) -> tuple[Granule, Writer]:
    """The granule at the first gain from ``start`` on at which known tables reach all values in at most so many bits."""
    head = 0 if u.positions is None else 63 if o.mpeg1 else 98  # bits of the scalefactors, whatever their values
    gains = window_gains(u, o.sample_rate)
    lift = np.array([*gains, 0])[window_of_line(o.sample_rate, u.shape)] if any(gains) else 0.0
    switched = u.block_type != 0

    def attempt(gain: int) -> tuple[np.ndarray, Plan] | None:
        q = quantized(u.x, gain, lift)
        if np.abs(q).max() >= 8191:  # cut off
            return None
        plan = plan_values(q, o.sample_rate, switched, u.block_type == 2)
        return (q, plan) if plan and plan.bits + head <= most_bits else None

    low, high = start, 255
    while low < high:  # larger gains give smaller values
        middle = (low + high) // 2
        if attempt(middle):
            high = middle
        else:
            low = middle + 1
    found = attempt(low)
    if found is None:
        raise ValueError(f"a granule of peak {np.abs(u.x).max():g} cannot be coded in {most_bits} bits")
    q, plan = found
    out, compress = scalefactor_bits(u, q, o)
    g = Granule(0, 0, low, compress, int(switched), u.block_type, int(u.mixed), plan.tables, gains, plan.region0, plan.region1, count1_table=plan.quads)
    if switched:
        g.region0_count, g.region1_count = (8 if u.block_type == 2 and not u.mixed else 7), 36
    body, g.big_values = write_values(q, plan.tables, region_ends(g, o.sample_rate), plan.quads)
    out.extend(body)
    g.part2_3_length = out.size
    return g, out


@dataclass
class Frame:
    """A frame's side information and main data; ``mode`` is its mode extension, None outside joint stereo, ``over`` its granules above their mask."""

    info: SideInfo
    main: bytes
    mode: int | None
    over: int


def units_of(rows: dict[tuple[int, int], Unit], o: Options) -> tuple[list[list[Unit]], int | None]:
    """All granules and channels of a frame, those that are missing being silent, after its stereo decisions; and its mode extension.

    A frame takes one of the stereo modes: intensity if all its granules are long and have a band for it, else mid and side.
    """
    units = [[rows.get((gr, ch)) or Unit(np.zeros(576)) for ch in range(o.channels)] for gr in range(o.granules)]
    if o.channels == 1 or any(a.shape != b.shape or a.block_type != b.block_type for a, b in units):
        return units, None
    roomy = 8 * o.room(o.kbps or o.rates[-1]) // (2 * o.granules) > 200
    if o.intensity and roomy and all(u.block_type == 0 for row in units for u in row):
        found = [intensity_choice(a.x, b.x, o.sample_rate, o.mpeg1) for a, b in units]
        if any(bound < 21 for bound, _ in found):
            for (a, b), (bound, positions) in zip(units, found):
                b.positions, a.gain, b.gain = positions, None, None
                a.x, b.x = intensity_rewrite(a.x, b.x, bound, positions, o.sample_rate, o.mpeg1)
            return units, 1
    if o.joint and mid_side([(a.x, b.x) for a, b in units]):
        for a, b in units:  # noise of either goes to both channels, so it is theirs that masks it
            a.gain = b.gain = min(u.gain if u.gain is not None else mask_gain(u.x, o.sample_rate, o.quality, u.shape) for u in (a, b))
            a.x, b.x = (a.x + b.x) / math.sqrt(2), (a.x - b.x) / math.sqrt(2)
        return units, 2
    return units, None


def pack(units: list[list[Unit]], mode: int | None, o: Options, most: int, masked: bool) -> Frame:
    """A frame of at most ``most`` bytes of main data; ``masked`` granules begin at the gain that their mask allows, others take all bits."""
    left, n, over = 8 * most, o.granules * o.channels, 0
    main, info = Writer(), []
    for row in units:
        out = []
        for u in row:
            allowed = u.gain if u.gain is not None else mask_gain(u.x, o.sample_rate, o.quality, u.shape)
            g, bits = coded(u, o, min(MOST_BITS, left // n), allowed if masked else 0)
            main.extend(bits)
            left, n = left - bits.size, n - 1
            over += g.global_gain > allowed
            out.append(g)
        info.append(out)
    return Frame(SideInfo(0, [[0] * 4] * o.channels, info), main.bytes(), mode, over)


def header_word(o: Options, kbps: int, padding: bool, mode: int | None) -> bytes:
    rate = (SAMPLE_RATES if o.mpeg1 else [r // 2 for r in SAMPLE_RATES]).index(o.sample_rate)
    channels = 3 if o.channels == 1 else 0 if mode is None else 1
    return (0xFFE00000 | (3 if o.mpeg1 else 2) << 19 | 1 << 17 | 1 << 16 | o.rates.index(kbps) << 12 | rate << 10 | padding << 9 | channels << 6 | (mode or 0) << 4).to_bytes(4, "big")


def offers(rows: dict[tuple[int, int], Unit], o: Options) -> list[Frame]:
    """A frame as its masks ask for it; at a constant rate that may take bytes of the reservoir, and a second offer fills the frame's own bytes."""
    units, mode = units_of(rows, o)
    own = o.room(o.kbps or o.rates[-1])
    if o.kbps is None:
        return [pack(units, mode, o, own, True)]
    return [pack(units, mode, o, own + o.most_back, True), pack(units, mode, o, own, False)]


class Layout:
    """Chooses among the offers of a stream's frames in order and lays main data out; what waits for later bytes is bounded."""

    def __init__(self, o: Options):
        self.o, self.n, self.spare = o, 0, 0  # spare: bytes of earlier frames that are still free
        self.slots: list[tuple[int, bytes, int, bytearray, int]] = []  # frames that are not full yet: number, lead, room, bytes, granules above their mask

    def add(self, number: int, found: list[Frame]) -> Iterator[tuple[int, bytes, int]]:
        o = self.o
        pad = o.kbps is not None and o.padded(number, o.kbps)
        back = min(self.spare, o.most_back)
        self._stuff(self.spare - back)  # bytes that no later frame can reach
        kbps, choice = o.kbps, found[0]
        if kbps is None:
            kbps = next((k for k in o.rates[1:] if o.room(k) + back >= len(choice.main)), o.rates[-1])
        own = o.room(kbps) + pad
        if o.kbps is not None and not 0 <= back + own - len(choice.main) <= o.most_back:
            choice = found[1]  # too much for what there is, or so little that bytes were lost
        lead = header_word(o, kbps, pad, choice.mode) + write_side_info(SideInfo(back, choice.info.scfsi, choice.info.granules), o.mpeg1, o.channels == 1)
        self.slots.append((number, lead, own, bytearray(), choice.over))
        self.spare = back + own
        self._fill(choice.main)
        yield from self._ready()

    def _fill(self, data: bytes) -> None:
        self.spare -= len(data)
        for _, _, room, body, _ in self.slots:
            take = min(room - len(body), len(data))
            body += data[:take]
            data = data[take:]

    def _stuff(self, n: int) -> None:
        if n > 0:
            self._fill(bytes(n))

    def _ready(self) -> Iterator[tuple[int, bytes, int]]:
        while self.slots and len(self.slots[0][3]) == self.slots[0][2]:
            number, lead, _, body, over = self.slots.pop(0)
            yield number, lead + bytes(body), over

    def close(self) -> Iterator[tuple[int, bytes, int]]:
        self._stuff(self.spare)
        yield from self._ready()


def frame(rows: dict[tuple[int, int], np.ndarray], o: Options) -> bytes:
    """One frame by itself of long spectra by (granule, channel)."""
    alone = Options(**{**o.__dict__, "reservoir": False})
    layout = Layout(alone)
    out = list(layout.add(0, offers({k: Unit(np.asarray(v, float)) for k, v in rows.items()}, alone)))
    return (out + list(layout.close()))[0][1]


def _offered(rows: list, o: Options) -> bytes:
    from pickle import dumps

    units = {(int(r["granule"]) % o.granules, int(r["ch"])): Unit(np.asarray(r["x"], float), r["block_type"] or 0, bool(r["mixed"]), r["gain"]) for r in rows}
    return dumps(offers(units, o))


def frames(spectra: DataFrame, options: Options, gains: DataFrame | None = None) -> DataFrame:
    """``path, frame, data, over_mask`` of ``path, ch, granule, x`` and, if given, ``block_type, mixed``; ``gains`` are those of ``model_gains``.

    ``over_mask`` counts the frame's granules whose gain had to go above what their mask allows, for bits or for tables. Granules that are missing within a frame are silent. One shuffle brings a frame's granules together, one a stream's offers in order.
    """
    o = options
    rows = spectra
    for name, value in (("block_type", F.lit(0)), ("mixed", F.lit(False))):
        rows = rows if name in rows.columns else rows.withColumn(name, value)
    rows = rows.join(gains, ["path", "ch", "granule"], "left") if gains is not None else rows.withColumn("gain", F.lit(None).cast("int"))
    unit = F.struct("granule", "ch", "block_type", "mixed", "gain", "x")
    grouped = rows.groupBy("path", F.floor(F.col("granule") / o.granules).alias("frame")).agg(F.collect_list(unit).alias("units"))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_tables(o.tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("frame"), pa.array([_offered(u, o) for u in part.column("units").to_pylist()], pa.binary())], names=["path", "frame", "offers"])

    offered = grouped.mapInArrow(offer, "path string, frame long, offers binary")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pickle import loads

        path, layout = None, None
        out: list[tuple[str, int, bytes, int]] = []
        for batch in batches:
            for p, n, found in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offers"))):
                if layout is None or p != path:
                    out += [(path, *f) for f in layout.close()] if layout else []
                    path, layout = p, Layout(o)
                out += [(path, *f) for f in layout.add(n, loads(found))]
            if out:
                yield _frame_rows(out)
                out = []
        if layout and (out := [(path, *f) for f in layout.close()]):
            yield _frame_rows(out)

    return offered.repartition("path").sortWithinPartitions("path", "frame").mapInArrow(lay, "path string, frame long, data binary, over_mask int")


def _frame_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "frame", "data", "over_mask"])


def encode(pcm: DataFrame, options: Options, window: list[float] | None = None) -> DataFrame:
    """``path, frame, data, over_mask`` of ``path, ch, granule, pcm`` (576 samples each, 16 bits): the whole plan."""
    types = block_types(pcm) if options.short else None
    spectra = lines(analyze(pcm, window), types, options.sample_rate)
    gains = model_gains(spectra, pcm, options) if options.model else None
    return frames(spectra, options, gains)


def granules_of(pcm: DataFrame, channels: int = 1, samples: Column | None = None) -> DataFrame:
    """``path, ch, granule, pcm`` of ``path, pcm`` with interleaved samples, the last granule filled up with zeros."""
    values = samples if samples is not None else F.col("pcm")
    n = F.ceil(F.size(values) / (576 * channels)).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1)).alias("granule")
    rows = pcm.where(F.size(values) > 0).select("path", values.alias("all"), at).select("path", "all", "granule", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch"))
    pick = F.transform(F.sequence(F.lit(0), F.lit(575)), lambda i: F.coalesce(F.get("all", (F.col("granule") * 576 + i) * channels + F.col("ch")), F.lit(0)).cast("smallint"))
    return rows.select("path", F.col("ch").cast("int").alias("ch"), F.col("granule").cast("long").alias("granule"), pick.alias("pcm"))


def files(coded: DataFrame) -> DataFrame:
    """``path, content``: a stream's frames in order as one binary value. For streams that fit into a row; ``sinks.write_streams`` is for others."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.hex("data").alias("h"))))
    return coded.groupBy("path").agg(F.unhex(F.array_join(F.transform(ordered, lambda s: s["h"]), "")).alias("content"))
