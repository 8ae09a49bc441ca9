"""Writers of PCM and coded streams, a file a stream.

A task holds one batch of a stream at a time and writes under a name of its own attempt, which is then moved to the final one: a task that
runs again leaves the same files. Folders may be any place that all executors reach and pyarrow's file systems open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITTEN = "path string, file string, bytes long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path there, of a path with or without a scheme."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def file_name(path: str, suffix: str) -> str:
    """A stream's file name: its own without extension, and a checksum that tells streams of one name apart."""
    return f"{PurePosixPath(path).stem}-{zlib.crc32(path.encode()):08x}{suffix}"


class Files:
    """Writes streams that come one after another."""

    def __init__(self, folder: str, suffix: str):
        self.system, self.base = opened(folder)
        self.system.create_dir(self.base, recursive=True)
        self.suffix, self.path, self.out = suffix, None, None

    def to(self, path: str, lead: bytes = b"") -> None:
        """Goes on to a stream, whose file begins with ``lead``."""
        self.path, self.size = path, 0
        self.attempt = f"{self.base}/_attempt-{TaskContext.get().taskAttemptId()}{self.suffix}"
        self.out = self.system.open_output_stream(self.attempt)
        self.add(lead)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def done(self) -> Iterator[tuple[str, str, int]]:
        if self.out is not None:
            self.out.close()
            name = f"{self.base}/{file_name(self.path, self.suffix)}"
            self.system.move(self.attempt, name)
            yield self.path, name, self.size
        self.path = self.out = None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, file, size = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(file), pa.array(size, pa.int64())], names=["path", "file", "bytes"])


def write_streams(coded: DataFrame, folder: str) -> DataFrame:
    """WRITTEN of coded streams ``path, frame, data`` written to ``folder`` in the order of their frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, rows = Files(folder, ".mp3"), []
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist()):
                if path != files.path:
                    rows += files.done()
                    files.to(path)
                files.add(data)
        rows += files.done()
        if rows:
            yield _batch(rows)

    return coded.select("path", "frame", "data").repartition("path").sortWithinPartitions("path", "frame").select("path", "data").mapInArrow(work, WRITTEN)


def wav_header(sample_rate: int, channels: int, samples: int) -> bytes:
    """The 44 bytes before 16-bit samples; sizes beyond 32 bits are written as the largest there are."""
    size = min(2 * channels * samples, 0xFFFFFFFF - 36)
    low = lambda v, n: v.to_bytes(n, "little")
    form = low(16, 4) + low(1, 2) + low(channels, 2) + low(sample_rate, 4) + low(2 * channels * sample_rate, 4) + low(2 * channels, 2) + low(16, 2)
    return b"RIFF" + low(size + 36, 4) + b"WAVEfmt " + form + b"data" + low(size, 4)


def write_wav(pcm: DataFrame, folder: str) -> DataFrame:
    """WRITTEN of PCM streams ``path, ch, granule, sample_rate, channels, pcm`` written to ``folder``, channels interleaved; a granule that a channel lacks is silent there."""
    sizes = pcm.groupBy("path").agg((F.max("granule") + 1).alias("granules"))
    values = F.array_sort(F.collect_list(F.struct("ch", "pcm"))).alias("parts")
    rows = pcm.groupBy("path", "granule").agg(F.max("sample_rate").alias("rate"), F.max("channels").alias("channels"), values).join(sizes, "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at = Files(folder, ".wav"), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != files.path:
                    out += files.done()
                    files.to(r["path"], wav_header(r["rate"], r["channels"], 576 * r["granules"]))
                    at = 0
                files.add(bytes(2 * 576 * r["channels"] * (r["granule"] - at)))  # granules that are missing
                at = r["granule"] + 1
                block = np.zeros((576, r["channels"]), "<i2")
                for p in r["parts"]:
                    block[:, p["ch"]] = p["pcm"]
                files.add(block.tobytes())
        out += files.done()
        if out:
            yield _batch(out)

    return rows.repartition("path").sortWithinPartitions("path", "granule").mapInArrow(work, WRITTEN)
