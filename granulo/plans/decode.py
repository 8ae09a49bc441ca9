"""Decoding as a DataFrame plan: files to frames, granules, spectra, sub-band samples and PCM.

What the reference carries from frame to frame is a bounded look-back here: at most 511 bytes of reservoir, one granule of
overlap and one of filter history. A frame's granules are read and transformed in one pass over the frames, without a shuffle
and as matrices over all granules of a batch; look-back is a window over (stream, channel), a long stream being cut into
segments that bring the last rows of the one before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from granulo.functions import filterbank
from granulo.functions.tables import ALIAS_C, LONG_BANDS, PRETAB, SHORT_BANDS, intensity_ratio
from granulo.operators.bitstream import Granule, Scalefactors, frame_parts, read_granules, with_tables
from granulo.operators.framing import bytes_before
from granulo.operators.spectrum import mdct_basis, short_order
from granulo.sources.coded_audio import Header

_CS = np.array([1 / math.sqrt(1 + c * c) for c in ALIAS_C])
_CA = np.array([c / math.sqrt(1 + c * c) for c in ALIAS_C])
LONG, SHORT, MIXED = "long", "short", "mixed"
#: Granules of a stream that one window sorts.
SEGMENT = 4096


def with_reservoir(frames: DataFrame) -> DataFrame:
    """FRAMES with ``view``: the bytes that main_data_begin reaches back to, then the frame's own main data."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, main = [], []
            for data in batch.column("data").to_pylist():
                try:
                    _, info, rest = frame_parts(data)
                    begin.append(info.main_data_begin), main.append(rest)
                except (ValueError, TypeError):
                    begin.append(None), main.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin, pa.int32()), pa.array(main, pa.binary())], names=[*batch.schema.names, "back", "main"])

    schema = StructType([*frames.schema.fields, StructField("back", IntegerType()), StructField("main", BinaryType())])
    rows = frames.mapInArrow(parts, schema)
    rows = bytes_before(rows, "path", "frame", "main").withColumnRenamed("__before", "before")
    have = F.length("before") >= 2 * F.col("back")
    view = F.when(have, F.unhex(F.concat(F.expr("right(before, 2 * back)"), F.hex("main"))))
    return rows.withColumn("view", view).drop("before", "back", "main")


def shape_of(g: Granule) -> str:
    return (MIXED if g.mixed else SHORT) if g.short else LONG


def bands_of(rate: int) -> tuple[list[int], list[int]]:
    return LONG_BANDS.get(rate, LONG_BANDS[44100]), SHORT_BANDS.get(rate, SHORT_BANDS[44100])


@lru_cache(maxsize=64)
def entries(rate: int, shape: str) -> list[tuple[int, int, int, int]]:
    """A granule's scalefactor entries in stream order: first line, end, band, window (-1 in long bands). The last band of long granules has none."""
    long, short = bands_of(rate)
    out = [(long[b], long[b + 1], b, -1) for b in range({LONG: 21, SHORT: 0, MIXED: 8}[shape])]
    at = out[-1][1] if out else 0
    if shape != LONG:
        for b in range(3 if shape == MIXED else 0, 13):
            for w in range(3):
                end = min(at + short[b + 1] - short[b], 576)
                out += [(at, end, b, w)] if at < end else []
                at = end
    return out


@lru_cache(maxsize=64)
def entry_of_line(rate: int, shape: str) -> np.ndarray:
    """Which entry each line belongs to; one past the last for lines without one."""
    found = entries(rate, shape)
    out = np.full(576, len(found))
    for i, (a, b, _, _) in enumerate(found):
        out[a:b] = i
    return out


@lru_cache(maxsize=64)
def window_of_line(rate: int, shape: str) -> np.ndarray:
    """The window of each line of a short or mixed granule in stream order; -1 for long lines."""
    windows = np.array([w for *_, w in entries(rate, shape)] + [-1])
    return windows[entry_of_line(rate, shape)]


@lru_cache(maxsize=64)
def order_of(rate: int, shape: str) -> np.ndarray:
    """Where each line of a short or mixed granule in frequency order comes from in stream order."""
    out = np.arange(576)
    for a, b in short_order(rate, shape == MIXED):
        out[b] = a
    return out


def scales(rate: int, g: Granule, sf: Scalefactors) -> np.ndarray:
    """The exponents of two, without the global gain, of a granule's entries; lines without an entry have none."""
    shift = 1.0 if g.scalefac_scale else 0.5
    out = []
    for _, _, b, w in entries(rate, shape_of(g)):
        out.append(-shift * (sf.long[b] + (PRETAB[b] if g.preflag else 0)) if w < 0 else -shift * sf.short[b][w] - 2.0 * g.subblock_gain[w])
    return np.array([*out, -np.inf])


def positions(rate: int, g: Granule, sf: Scalefactors) -> list[int]:
    """The intensity position of every entry."""
    return [sf.long[b] if w < 0 else sf.short[b][w] for _, _, b, w in entries(rate, shape_of(g))]


def intensity_bound(q: np.ndarray, rate: int, shape: str) -> int:
    """The first band from which the right channel's lines are all zero, over all windows; in mixed granules long bands count first."""
    bound = 0
    for a, b, band, w in entries(rate, shape):
        if q[a:b].any():
            bound = (max(band, 8) if shape == MIXED and w >= 0 else band) + 1
    return min(bound, 21 if shape == LONG else 13)


def intensity(left: np.ndarray, right: np.ndarray, h: Header, g: Granule, sf: Scalefactors, bound: int) -> int:
    """Intensity stereo in place, in entries of bands from ``bound`` on; returns the first line where it holds."""
    start = 576
    for (a, b, band, _), pos in zip(entries(h.rate, shape_of(g)), positions(h.rate, g, sf)):
        if band < bound:
            continue
        start = min(start, a)
        if pos >= (7 if h.version == 1 else 31):
            right[a:b] = 0.0
            continue
        if h.version == 1:
            kl, kr = intensity_ratio(pos)
        else:
            ratio = (0.25 if g.scalefac_compress & 1 else 0.5) ** ((pos + 1) // 2)
            kl, kr = (1.0, 1.0) if pos == 0 else (ratio, 1.0) if pos % 2 else (1.0, ratio)
        right[a:b] = left[a:b] * kr
        left[a:b] = left[a:b] * kl
    return start


def butterflies(x: np.ndarray, borders: int, back: bool = False) -> np.ndarray:
    """Alias reduction over the first ``borders`` borders of sub-bands, of one spectrum or of many; ``back`` undoes it."""
    y = np.array(x, float).reshape(-1, 32, 18)
    up, down = y[:, :borders, :9:-1].copy(), y[:, 1 : borders + 1, :8].copy()
    ca = -_CA if back else _CA
    y[:, :borders, :9:-1], y[:, 1 : borders + 1, :8] = up * _CS - down * ca, down * _CS + up * ca
    return y.reshape(np.shape(x))


_LONG, _SHORT = mdct_basis(36), mdct_basis(12)
_SIN36, _SIN12 = np.sin(np.pi / 36 * (np.arange(36) + 0.5)), np.sin(np.pi / 12 * (np.arange(12) + 0.5))
WINDOWS = {
    0: _SIN36,
    1: np.r_[_SIN36[:18], np.ones(6), _SIN12[6:], np.zeros(6)],
    3: np.r_[np.zeros(6), _SIN12[:6], np.ones(6), _SIN36[18:]],
}
#: Odd samples of odd sub-bands change sign.
SIGN = np.ones((32, 18))
SIGN[1::2, 1::2] = -1


def raw_blocks(x: np.ndarray, block_type: int, mixed: bool = False) -> np.ndarray:
    """Windowed inverse transforms of spectra (rows of 576): rows by 32 sub-bands by 36 samples. Two sub-bands of ``mixed`` granules are long ones'."""
    lines = x.reshape(-1, 32, 18)
    out = np.zeros((len(lines), 32, 36))
    if block_type != 2:
        out[:] = lines @ _LONG.T * WINDOWS[block_type]
    else:
        for w in range(3):
            out[:, :, 6 + 6 * w : 18 + 6 * w] += lines[:, :, w::3] @ _SHORT.T * _SIN12
    if mixed:
        out[:, :2] = lines[:, :2] @ _LONG.T * WINDOWS[0]
    return out


def stereo(xs: list[np.ndarray], qs: list[np.ndarray], h: Header, gs: list[Granule], sfs: list[Scalefactors]) -> None:
    """Intensity and mid-side stereo of one granule's channels in place."""
    end = 576
    if h.mode_extension & 1:
        end = intensity(xs[0], xs[1], h, gs[1], sfs[1], intensity_bound(qs[1], h.rate, shape_of(gs[1])))
    if h.mode_extension & 2:
        m, s = xs[0][:end].copy(), xs[1][:end].copy()
        xs[0][:end], xs[1][:end] = (m + s) / math.sqrt(2), (m - s) / math.sqrt(2)


SPECTRA = "path string, frame long, pts long, gr int, ch int, granule long, sample_rate int, channels int, x array<double>, head array<double>, tail array<double>, error string"
_NAMES = [c.split()[0] for c in SPECTRA.split(", ")]


def _lists(values: np.ndarray) -> pa.ListArray:
    n, wide = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * wide + 1, wide, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def spectra(frames: DataFrame, tables: str | None = None) -> DataFrame:
    """SPECTRA of frames (``path, frame, pts, data, view``), a row a granule and channel.

    ``x`` holds the lines after requantisation, stereo, reordering and alias reduction, ``head`` and ``tail`` the halves of their
    windowed inverse transforms, sub-band by sub-band. A frame that lacks its reservoir, or that cannot be decoded, is silent in as many
    granules as it has, with ``error``; one without a readable header gives one row without values. ``tables`` is a file of further
    pair tables.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_tables(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _spectra_of(batch.slice(at, 256))

    return frames.select("path", "frame", "pts", "data", "view").mapInArrow(work, SPECTRA)


def _spectra_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, qs, kinds, powers, joint = [], [], [], [], []
    for path, frame, pts, data, view in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "pts", "data", "view"))):
        try:
            h, info, _ = frame_parts(data)
        except (ValueError, TypeError) as e:
            rows.append((path, frame, pts, *[None] * 5, str(e)))
            continue
        error, got = ("no reservoir", None) if view is None else (None, None)
        if view is not None:
            try:
                got = list(read_granules(h, info, view))
            except ValueError as e:
                error = str(e)
        channels, per = (1 if h.mono else 2), len(info.granules)
        if got is None:
            got = [(gr, ch, Granule(), Scalefactors(), np.zeros(576, np.int32)) for gr in range(per) for ch in range(channels)]
        for gr, ch, g, sf, q in got:
            if ch == 1 and h.joint and h.mode_extension and not error:
                joint.append((len(qs) - 1, h, [got[2 * gr][2], g], [got[2 * gr][3], sf]))
            rows.append((path, frame, pts, gr, ch, frame * per + gr, h.rate, channels, error))
            qs.append(q), kinds.append((h.rate, shape_of(g), g.block_type if g.window_switching else 0, bool(g.window_switching and g.mixed))), powers.append((g.global_gain - 210) / 4.0 + scales(h.rate, g, sf))
    n = len(qs)
    q = np.array(qs, float).reshape(n, 576)
    x, out = np.zeros((n, 576)), np.zeros((n, 32, 36))
    at: dict = {}
    for i, kind in enumerate(kinds):
        at.setdefault(kind, []).append(i)
    for (rate, shape, *_), i in at.items():
        x[i] = np.sign(q[i]) * np.abs(q[i]) ** (4 / 3) * np.exp2(np.stack([powers[j] for j in i])[:, entry_of_line(rate, shape)])
    for i, h, gs, sfs in joint:
        stereo([x[i], x[i + 1]], [qs[i], qs[i + 1]], h, gs, sfs)
    for (rate, shape, block_type, mixed), i in at.items():
        lines = x[i][:, order_of(rate, shape)] if shape != LONG else x[i]
        x[i] = butterflies(lines, {LONG: 31, SHORT: 0, MIXED: 1}[shape])
        out[i] = raw_blocks(x[i], block_type, mixed)
    full = [i for i, r in enumerate(rows) if r[3] is not None]
    where = pa.array([None if r[3] is None else k for r, k in zip(rows, np.cumsum([r[3] is not None for r in rows]) - 1)], pa.int64()) if len(full) < len(rows) else None
    arrays = [_lists(v.reshape(n, -1)) for v in (x, out[:, :, :18] * SIGN, out[:, :, 18:] * SIGN)]
    arrays = [a.take(where) for a in arrays] if where is not None else arrays
    kinds_ = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    cols = list(zip(*rows)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds_)), *arrays, pa.array(cols[8], pa.string())], names=_NAMES)


def with_before(rows: DataFrame, columns: list[str], steps: int, by: tuple[str, ...] = ("path", "ch"), order: str = "granule") -> DataFrame:
    """With ``<column>_1`` to ``<column>_<steps>``: the values so many places before, null where no row has just that place.

    A long stream is cut into segments of SEGMENT places, which bring the last rows of the one before.
    """
    segment = F.floor(F.col(order) / SEGMENT)
    both = F.array_compact(F.array(segment, F.when(F.col(order) % SEGMENT >= SEGMENT - steps, segment + 1)))
    rows = rows.withColumn("__segment", F.explode(both))
    w = Window.partitionBy(*by, "__segment").orderBy(order)
    at = lambda c, i: F.coalesce(*[F.when(F.lag(order, j).over(w) == F.col(order) - i, F.lag(c, j).over(w)) for j in range(1, i + 1)])
    more = {f"{c}_{i}": at(c, i) for c in columns for i in range(1, steps + 1)}
    return rows.withColumns(more).where(F.col("__segment") == segment).drop("__segment")


def subband_samples(spec: DataFrame) -> DataFrame:
    """``path, ch, granule, samples``: overlap-added sub-band samples, sub-band by sub-band, odd samples of odd sub-bands inverted."""
    rows = with_before(spec.where("x IS NOT NULL").select("path", "ch", "granule", "head", "tail"), ["tail"], 1)
    both = F.when(F.col("tail_1").isNull(), F.col("head")).otherwise(F.zip_with("head", "tail_1", lambda a, b: a + b))
    return rows.select("path", "ch", "granule", both.alias("samples"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of 576 as rows; nulls are zeros."""
    out = np.zeros((len(column), 576))
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    out[some] = column.drop_null().flatten().to_numpy().reshape(-1, 576)
    return out


def to_pcm(x: np.ndarray) -> np.ndarray:
    """Clamped to one, scaled by 32767 and cut towards zero."""
    return np.trunc(np.clip(x, -1, 1) * 32767).astype(np.int16)


def _pcm(x: np.ndarray) -> pa.ListArray:
    return _lists(to_pcm(x))


def granule_halves(frame: int, data: bytes, view: bytes | None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(ch, granule, head, tail)`` of one frame's granules in order, as ``spectra`` has them."""
    batch = pa.RecordBatch.from_pydict({"path": pa.array([""]), "frame": pa.array([frame]), "pts": pa.array([0]), "data": pa.array([data], pa.binary()), "view": pa.array([view], pa.binary())})
    out = _spectra_of(batch)
    head, tail = _matrix(out.column("head")), _matrix(out.column("tail"))
    return list(zip(out.column("ch").to_pylist(), out.column("granule").to_pylist(), head, tail))


def synthesize(subbands: DataFrame, window: list[float] | None = None) -> DataFrame:
    """``path, ch, granule, pcm``: polyphase synthesis. ``window`` is the standard's, or the rule-made one of ``filterbank``.

    The filter's history is sixteen steps, so a granule needs the one before it and nothing else.
    """
    filterbank.synthesis_window(window)
    rows = with_before(subbands.select("path", "ch", "granule", "samples"), ["samples"], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = [_matrix(part.column(c)).reshape(-1, 32, 18) for c in ("samples_1", "samples")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("path", "ch", "granule")), _pcm(filterbank.synthesis(np.concatenate(both, 2), window))], names=["path", "ch", "granule", "pcm"])

    return rows.mapInArrow(work, "path string, ch int, granule long, pcm array<smallint>")


def pcm(frames: DataFrame, window: list[float] | None = None, tables: str | None = None) -> DataFrame:
    """``path, ch, granule, sample_rate, channels, pcm`` of frames: one window over (stream, channel), in which every granule sees the two before it."""
    rows = spectra(with_reservoir(frames), tables).where("x IS NOT NULL").select("path", "ch", "granule", "sample_rate", "channels", "head", "tail")
    rows = with_before(rows, ["head", "tail"], 2).drop("head_2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                now = _matrix(part.column("head")) + _matrix(part.column("tail_1"))
                before = _matrix(part.column("head_1")) + np.where(part.column("head_1").is_valid().to_numpy(zero_copy_only=False)[:, None], _matrix(part.column("tail_2")), 0.0)
                both = np.concatenate([before.reshape(-1, 32, 18), now.reshape(-1, 32, 18)], 2)
                names = ["path", "ch", "granule", "sample_rate", "channels"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _pcm(filterbank.synthesis(both, window))], names=[*names, "pcm"])

    return rows.mapInArrow(work, "path string, ch int, granule long, sample_rate int, channels int, pcm array<smallint>")


def decode(frames: DataFrame, tables: str | None = None) -> DataFrame:
    """Frames of coded files to sub-band samples."""
    return subband_samples(spectra(with_reservoir(frames), tables))
