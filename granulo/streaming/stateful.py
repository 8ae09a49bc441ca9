"""Streaming twins of the operators that carry state along a stream.

State a stream: one smoothed energy and one block type, or at most 511 bytes of reservoir. Blocks of a stream must arrive in
order, as its frames do; a block that was seen before is dropped, so a source that sends a batch again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granulo.functions import filterbank
from granulo.operators.bitstream import frame_parts, with_tables
from granulo.operators.blocks import ALPHA, FLOOR, RATIO, STATES
from granulo.operators.framing import LOOKBACK
from granulo.plans.decode import granule_halves, to_pcm

TYPES = "stream long, block long, onset boolean, block_type string"


def next_state(state: int, now: bool, soon: bool) -> int:
    if state == 1:
        return 2
    if state == 2:
        return 2 if now else 3
    return 1 if now or soon else 0


class BlockTypes(StatefulProcessor):
    """Rows ``stream, block, e0, e1, e2`` (mean sub-frame energies) to TYPES, one block late: a type waits for the next block's onset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "smoothed double, state int, block long, onset boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        smoothed, state, block, onset = self.state.get() if self.state.exists() else (0.0, 0, -1, False)
        out = []
        for part in rows:
            for r in part.sort_values("block").itertuples():
                if r.block <= block:
                    continue
                hit = False
                for e in (r.e0, r.e1, r.e2):
                    hit |= bool(e > FLOOR and smoothed > 0 and e > smoothed * RATIO)
                    smoothed = ALPHA * e + (1 - ALPHA) * smoothed
                if block >= 0:
                    state = next_state(state, onset, hit)
                    out.append((key[0], block, onset, STATES[state]))
                block, onset = int(r.block), hit
        self.state.update((float(smoothed), int(state), int(block), bool(onset)))
        yield pd.DataFrame(out, columns=["stream", "block", "onset", "block_type"])

    def close(self) -> None:
        pass


def block_types(energies: DataFrame) -> DataFrame:
    """The machine over a stream of ``stream, block, e0, e1, e2``. The last block of a stream stays open."""
    return energies.groupBy("stream").transformWithStateInPandas(statefulProcessor=BlockTypes(), outputStructType=TYPES, outputMode="append", timeMode="None")


class Reservoir(StatefulProcessor):
    """Rows ``path, frame, back, main`` with ``view``: the reservoir's last ``back`` bytes and the frame's own, null where they lack."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "tail binary, frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, last = self.state.get() if self.state.exists() else (b"", -1)
        tail, out = bytes(tail), []
        for part in rows:
            for r in part.sort_values("frame").itertuples():
                if r.frame <= last:
                    continue
                ok = r.back <= min(len(tail), LOOKBACK)
                out.append((key[0], r.frame, tail[len(tail) - r.back :] + bytes(r.main) if ok else None))
                tail, last = (tail + bytes(r.main))[-LOOKBACK:], int(r.frame)
        self.state.update((tail, last))
        yield pd.DataFrame(out, columns=["path", "frame", "view"])

    def close(self) -> None:
        pass


def reservoir(frames: DataFrame) -> DataFrame:
    return frames.groupBy("path").transformWithStateInPandas(statefulProcessor=Reservoir(), outputStructType="path string, frame long, view binary", outputMode="append", timeMode="None")


class Pcm(StatefulProcessor):
    """Rows ``path, frame, data`` of coded frames to PCM granules ``path, ch, granule, pcm``, as ``plans.decode.pcm`` has them.

    State a stream: the reservoir's tail, the last frame, and of every channel the last sub-band samples and overlap (9 KB). A frame that
    was seen is dropped; over a gap nothing is carried; a frame without its reservoir is silent; one without a header gives nothing.
    """

    def __init__(self, window: list[float] | None, tables: str | None):
        self.window, self.tables = window, tables

    def init(self, handle: StatefulProcessorHandle) -> None:
        with_tables(self.tables)
        self.state = handle.getValueState("pcm", "tail binary, frame long, before binary, overlap binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, last, before, overlap = self.state.get() if self.state.exists() else (b"", -1, b"", b"")
        tail, carried = bytes(tail), [np.frombuffer(bytes(x) or bytes(2 * 576 * 8)).reshape(2, 576).copy() for x in (before, overlap)]
        out = []
        for part in rows:
            for r in part.sort_values("frame").itertuples():
                if r.frame <= last:
                    continue
                if r.frame != last + 1:
                    tail, carried = b"", [np.zeros((2, 576)) for _ in carried]
                last = int(r.frame)
                try:
                    _, info, main = frame_parts(bytes(r.data))
                except ValueError:
                    carried = [np.zeros((2, 576)) for _ in carried]
                    continue
                view = tail[len(tail) - info.main_data_begin :] + main if info.main_data_begin <= len(tail) else None
                tail = (tail + main)[-LOOKBACK:]
                for ch, granule, head, rest in granule_halves(last, bytes(r.data), view):
                    now = head + carried[1][ch]
                    both = np.concatenate([carried[0][ch].reshape(1, 32, 18), now.reshape(1, 32, 18)], 2)
                    out.append((key[0], ch, granule, to_pcm(filterbank.synthesis(both, self.window)[0]).tolist()))
                    carried[0][ch], carried[1][ch] = now, rest
        self.state.update((tail, last, carried[0].tobytes(), carried[1].tobytes()))
        yield pd.DataFrame(out, columns=["path", "ch", "granule", "pcm"])

    def close(self) -> None:
        pass


def pcm(frames: DataFrame, window: list[float] | None = None, tables: str | None = None) -> DataFrame:
    """Coded frames ``path, frame, data``, which must arrive in order, to PCM."""
    filterbank.synthesis_window(window)
    return frames.select("path", "frame", "data").groupBy("path").transformWithStateInPandas(statefulProcessor=Pcm(window, tables), outputStructType="path string, ch int, granule long, pcm array<smallint>", outputMode="append", timeMode="None")


def windowed_levels(events: DataFrame, length: str = "10 minutes", hop: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and energies of events ``ts, value`` in sliding windows, with late data dropped after the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length, hop)).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy")).select("window.start", "window.end", "n", "energy")


def coded_files(spark, path: str) -> DataFrame:
    """A stream of new files, ``path, content``, for the frame splitter."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")
