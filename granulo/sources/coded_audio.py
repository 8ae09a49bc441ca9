"""Coded audio files as tables of streams and frames.

Files come through Spark's binary reader, so any store that Spark reads will do and files spread over tasks; one file's
frames are split by one task, batch by batch. Headers are parsed again as native columns, so filters on them are Spark's.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from granulo.functions.header import reject_reason
from granulo.functions.tables import BITRATES, SAMPLE_RATES
from granulo.sources.sinks import opened

SCAN, RESYNC, ROWS = 256 * 1024, 64 * 1024, 2048
FRAMES = "path string, frame long, pts long, duration int, at long, skipped long, data binary"
STREAMS = "path string, codec string, sample_rate int, channels int, first_at long, tags array<struct<key:string,value:string>>, pictures array<struct<mime:string,picture_type:int,description:string,data:binary>>, error string"
_STREAMS = pa.schema([
    ("path", pa.string()), ("codec", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("first_at", pa.int64()),
    ("tags", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
    ("pictures", pa.list_(pa.struct([("mime", pa.string()), ("picture_type", pa.int32()), ("description", pa.string()), ("data", pa.binary())]))),
    ("error", pa.string()),
])


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    kbps: int
    rate: int
    mono: bool
    padding: int
    protected: bool
    mode_extension: int
    joint: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def side_bytes(self) -> int:
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def length(self) -> int | None:
        if not self.kbps:
            return None
        if self.layer == 1:
            return (12 * self.kbps * 1000 // self.rate + self.padding) * 4
        return (72 if self.layer == 3 and self.version != 1 else 144) * self.kbps * 1000 // self.rate + self.padding


def header(data: bytes, at: int = 0) -> Header | None:
    """The header at a place, or None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    _, b, c, d = data[at : at + 4]
    version, layer, index, rate = (b >> 3) & 3, 4 - ((b >> 1) & 3), c >> 4, (c >> 2) & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3:
        return None
    divisor = {3: 1, 2: 2, 0: 4}[version]
    return Header({3: 1, 2: 2, 0: 25}[version], layer, BITRATES[(1 if version == 3 else 2, layer)][index], SAMPLE_RATES[rate] // divisor, d >> 6 == 3, (c >> 1) & 1, not b & 1, (d >> 4) & 3, d >> 6 == 1)


def find_header(data: bytes, at: int, most: int) -> int | None:
    """The first place from ``at`` on, at most ``most`` bytes further, where a header is."""
    end = at + most
    while 0 <= (at := data.find(b"\xff", at, end + 1)):
        if header(data, at):
            return at
        at += 1
    return None


@dataclass
class Tags:
    pairs: list[tuple[str, str]] = field(default_factory=list)
    pictures: list[tuple[str, int, str, bytes]] = field(default_factory=list)
    end: int = 0


_NAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TRCK": "track", "TCON": "genre", "TYER": "date", "TDRC": "date", "COMM": "comment"}


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(encoding: int, data: bytes) -> str:
    return data.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(encoding, "latin-1"), "replace").strip("\0")


def _split_text(encoding: int, data: bytes) -> tuple[str, bytes]:
    """A terminated string and what follows it."""
    wide = encoding in (1, 2)
    step, stop = (2, b"\0\0") if wide else (1, b"\0")
    at = 0
    while at < len(data) and data[at : at + step] != stop:
        at += step
    return _text(encoding, data[:at]), data[at + step :]


def leading_tags(data: bytes) -> Tags:
    """Tags before the first frame. A tag that is cut off gives none, and reading goes on after what is there."""
    if len(data) < 10 or data[:3] != b"ID3":
        return Tags()
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    out = Tags(end=min(10 + size + (10 if flags & 0x10 else 0), len(data)))
    if 10 + size > len(data):
        return out
    body, at = data[10 : 10 + size], 0
    while at + 10 <= len(body) and body[at]:
        name = body[at : at + 4].decode("latin-1")
        n = _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        content, at = body[at + 10 : at + 10 + n], at + 10 + n
        if not content:
            continue
        if name == "APIC":
            mime, rest = _split_text(0, content[1:])
            description, picture = _split_text(content[0], rest[1:])
            out.pictures.append((mime, rest[0] if rest else 0, description, picture))
        elif name == "COMM":
            out.pairs.append(("comment", _text(content[0], _split_text(content[0], content[4:])[1])))
        elif name.startswith("T"):
            out.pairs.append((_NAMES.get(name, name), _text(content[0], content[1:])))
    return out


def trailing_tags(data: bytes) -> list[tuple[str, str]]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return []
    tag = data[-128:]
    parts = (("title", tag[3:33]), ("artist", tag[33:63]), ("album", tag[63:93]), ("date", tag[93:97]), ("comment", tag[97:127]))
    return [(k, t) for k, v in parts if (t := v.split(b"\0")[0].decode("latin-1").strip())]


def split(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """``(pts, place, bytes skipped before, frame)`` of each whole frame. The clock's step is the first frame's.

    Garbage of up to RESYNC bytes between frames is skipped; a free-format frame, more garbage or the end stops.
    """
    at = find_header(data, leading_tags(data).end, SCAN)
    pts, step = 0, None
    while at is not None and at + 4 <= len(data):
        found = find_header(data, at, RESYNC)
        if found is None:
            return
        h = header(data, found)
        if h.length is None or found + h.length > len(data):
            return
        step = step or h.samples
        yield pts, found, found - at, data[found : found + h.length]
        pts, at = pts + step, found + h.length


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def frames(files: DataFrame) -> DataFrame:
    """FRAMES of ``path, content``; a null or empty file has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                yield from frame_batches(path, content.as_py() or b"")

    return files.mapInArrow(work, FRAMES)


def frame_batches(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """FRAMES of one file, ROWS at a time."""
    names = [c.split()[0] for c in FRAMES.split(", ")]
    rows, first = [], None
    for n, (pts, at, skipped, frame) in enumerate(split(data)):
        first = first or header(frame)
        rows.append((path, n, pts, first.samples, at, skipped, frame))
        if len(rows) == ROWS:
            yield _batch(rows, names)
            rows = []
    if rows:
        yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def stream_row(path: str, data: bytes) -> tuple:
    tags = leading_tags(data)
    at = find_header(data, tags.end, SCAN)
    keys = {k for k, _ in tags.pairs}
    pairs = tags.pairs + [(k, v) for k, v in trailing_tags(data) if k not in keys and (at is None or at <= len(data) - 128)]
    if at is None:
        return path, None, None, None, None, pairs, tags.pictures, "no sync in the first 256 KB"
    h = header(data, at)
    return path, f"mp{h.layer}", h.rate, 1 if h.mono else 2, at, pairs, tags.pictures, None


def streams(files: DataFrame) -> DataFrame:
    """STREAMS of ``path, content``, one row a file; ``error`` where no frame is found."""

    def work(rows):
        for batch in rows:
            yield _stream_batch([stream_row(p, c or b"") for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())])

    return files.mapInArrow(work, STREAMS)


def _stream_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _STREAMS
    cols = list(zip(*rows)) if rows else [[]] * 8
    tags = pa.array([[{"key": k, "value": v} for k, v in t] for t in cols[5]], schema.field("tags").type)
    names = ("mime", "picture_type", "description", "data")
    pictures = pa.array([[dict(zip(names, p)) for p in t] for t in cols[6]], schema.field("pictures").type)
    plain = [pa.array(c, schema.field(i).type) for i, c in enumerate(cols[:5])]
    return pa.RecordBatch.from_arrays([*plain, tags, pictures, pa.array(cols[7], pa.string())], schema=schema)


def probe_score(content: Column, extension: Column) -> Column:
    """How sure a file is coded audio: a leading tag 100, a header at the start 75, one in the first 256 bytes 50, its name 25, else 0."""
    head = F.hex(F.substring(content, 1, 260))
    word = lambda i: F.conv(F.substring(head, 2 * i + 1, 8), 16, 10).cast("long")
    ok = lambda i: (F.length(head) >= 2 * i + 8) & reject_reason(word(i)).isNull()
    some = F.exists(F.sequence(F.lit(1), F.lit(251)), lambda i: (F.substring(head, 2 * i + 1, 2) == "FF") & ok(i))
    return (
        F.when((F.length(head) >= 20) & (F.substring(head, 1, 6) == "494433"), 100)
        .when(ok(F.lit(0)), 75)
        .when(some, 50)
        .when(F.lower(extension).isin(*EXTENSIONS), 25)
        .otherwise(0)
    )


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


#: Bytes that a stream's row needs beside what its leading tag holds: the scan for a header, and a trailing tag.
TAIL = 128


def _ends(system: fs.FileSystem, path: str, size: int) -> bytes:
    """What ``stream_row`` reads of a file: its leading tag and the scan behind it, then its last bytes."""
    with system.open_input_file(path) as f:
        head = f.read_at(min(SCAN + 10, size), 0)
        if head[:3] == b"ID3" and len(head) >= 10:
            head = f.read_at(min(_syncsafe(head[6:10]) + 20 + SCAN, size), 0)
        rest = max(size - TAIL, len(head))
        return head + (f.read_at(size - rest, rest) if rest < size else b"")


class _Reader(DataSourceReader):
    """Files in the order of their names, FILES a partition at most. ``pattern`` keeps files whose name matches a glob."""

    FILES = 16

    def __init__(self, options: dict):
        self.path, self.what, self.pattern = options.get("path", ""), options.get("table", "frames"), options.get("pattern", "*")
        if self.what not in ("frames", "streams"):
            raise ValueError("option table is frames or streams")

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.path)
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        return [_Files(paths[i : i + self.FILES]) for i in range(0, len(paths), self.FILES)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        if self.what == "streams":
            yield _stream_batch([stream_row(p, _ends(system, p, system.get_file_info(p).size)) for p in partition.paths])
            return
        for path in partition.paths:
            with system.open_input_file(path) as f:
                data = f.read()
            yield from frame_batches(path, data)


class CodedAudio(DataSource):
    """``spark.read.format("coded_audio").option("table", "frames" or "streams").load(path)``.

    ``path`` is a file or folder in any store that pyarrow's file systems open (local, hdfs, s3, gs); ``binary_files`` serves all that Spark
    itself reads. ``streams`` reads the two ends of each file only; rows go to Spark in record batches.
    """

    @classmethod
    def name(cls) -> str:
        return "coded_audio"

    def schema(self) -> str:
        return STREAMS if self.options.get("table") == "streams" else FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


#: What the formats are and can: file extensions and codec ids, the container tag, and the encoder's limits.
EXTENSIONS, CODECS, CONTAINER_TAG = ("mp1", "mp2", "mp3"), ("mp1", "mp2", "mp3"), 0x0055
CAPABILITIES = {"lossy": True, "intra_only": False, "max_channels": 2, "max_sample_rate": 48_000}


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """``binary_files`` whose name has a known extension; the names are filtered before anything is read."""
    pattern = "*.{" + ",".join(x for e in EXTENSIONS for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def register(spark: SparkSession) -> list[str]:
    """Makes the source and the SQL functions known by name; returns the names."""
    from granulo.functions import sql

    spark.dataSource.register(CodedAudio)
    return [CodedAudio.name(), *sql.register(spark)]
