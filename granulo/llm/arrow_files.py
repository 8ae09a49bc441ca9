"""Token ids in Arrow files of equal-length sequences.

A file is in Arrow's random-access format. Its batches hold two fixed-size-list columns, ``ids`` and ``mask``, so that a
reader maps the file into memory and finds sequence n by division, without copying or decoding. A second Arrow file beside
it says where each document begins and how many ids it has. Documents stand in the order of their ids; ids run on across
sequences, and only a file's last sequence is padded (mask false).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulo.llm.common import in_arrow, parts, shared_path, slices, stable
from granulo.llm.pieces import encoder as shared_encoder
from granulo.llm.pieces import library

#: Ids a sequence, and sequences a batch.
LENGTH, BATCH = 2048, 64
#: Bytes in each half of a worker's two piece caches.
PIECE_BYTES = 96 << 20
MANIFEST = "path string, first_id long, n_docs long, n_tokens long"
SUFFIX = ".docs"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path there, of a path with or without a scheme."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _type(tokenizer: str) -> pa.DataType:
    return pa.uint16() if library(tokenizer).get_vocab_size() <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Writes ids as they come, in batches of whole sequences."""

    def __init__(self, sink, kind: pa.DataType, length: int = LENGTH, batch: int = BATCH):
        self.kind, self.length, self.room = kind, length, length * batch
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= 4 * self.room:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.room * self.room
        for at in range(0, whole, self.room):
            self._batch(ids[at : min(at + self.room, whole)])
        self.waiting, self.n = [ids[whole:]], len(ids) - whole

    def _batch(self, ids: np.ndarray) -> None:
        mask = np.ones(-(-len(ids) // self.length) * self.length, bool)
        mask[len(ids) :] = False
        padded = np.zeros(len(mask), self.kind.to_pandas_dtype())
        padded[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(padded, self.kind), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.file.close()


class SequenceFile:
    """Random access to a file's ids. ``source`` is a memory map or any random-access file."""

    def __init__(self, source, batch: int = BATCH):
        self.file = ipc.open_file(source)
        self.length, self.per = self.file.schema.field("ids").type.list_size, batch
        self.last = (-1, None, None)

    def _batch(self, k: int) -> tuple[np.ndarray, pa.RecordBatch]:
        if self.last[0] != k:
            b = self.file.get_batch(k)
            self.last = (k, b.column("ids").values.to_numpy(zero_copy_only=True), b)
        return self.last[1:]

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence n."""
        k, i = divmod(n, self.per)
        ids, b = self._batch(k)
        mask = b.column("mask").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
        return ids[i * self.length : (i + 1) * self.length], mask

    def read(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from ``start``, as views of consecutive batches."""
        size = self.per * self.length
        while n:
            k, i = divmod(start, size)
            part = self._batch(k)[0][i : i + n]
            yield part
            start, n = start + len(part), n - len(part)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending order of id into ``folder``, which all executors must reach; returns the manifest.

    One file a range of ids; nulls first, equal ids by their texts' hash. A null text is an empty document with the end id
    alone. Repeated rows are written again each; other columns are not read. A file is written under a name of its own
    attempt and then moved to its final name, so a task that runs again leaves the same files. No documents give no files.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    ordered = thin.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = opened(folder)
        name = f"{base}/part-{task.partitionId():06d}.arrow"
        attempt = f"{base}/_attempt-{task.taskAttemptId()}.arrow"
        encoder, writer, sinks, begun, n_docs = shared_encoder(tokenizer, end_id, PIECE_BYTES), None, [], 0, 0
        for batch in batches:
            for part in slices(batch):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    sinks = [system.open_output_stream(attempt), system.open_output_stream(attempt + SUFFIX)]
                    writer = SequenceWriter(sinks[0], _type(tokenizer))
                    index = ipc.new_file(sinks[1], INDEX)
                ids = encoder(part.column("text").to_pylist())
                n = np.array([len(x) // 4 for x in ids], np.int64)
                writer.add(np.frombuffer(b"".join(ids), "<u4"))
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(begun + np.cumsum(n) - n), pa.array(n)], schema=INDEX))
                begun, n_docs = begun + int(n.sum()), n_docs + part.num_rows
        if writer is not None:
            writer.close(), index.close()
            for sink, suffix in zip(sinks, ("", SUFFIX)):
                sink.close()
                system.move(attempt + suffix, name + suffix)
            yield pa.RecordBatch.from_pydict({"path": [name], "first_id": pa.array([task.partitionId()], pa.int64()), "n_docs": [n_docs], "n_tokens": [begun]})

    return stable(in_arrow(ordered, work, MANIFEST))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document from the files of a manifest: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``."""
    spark = manifest.sparkSession
    # One row a file, and files are as many as ranges.
    before = F.sum("n_tokens").over(Window.orderBy("first_id")) - F.col("n_tokens")
    files = stable(manifest.select("path", "first_id", before.alias("base"))).repartition(max(2, min(parts(spark), 4096)), "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                source = [pa.memory_map(p) if local else system.open_input_file(p) for p in (path, path + SUFFIX)]
                data, index = SequenceFile(source[0]), ipc.open_file(source[1])
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n").to_pylist()):
                        crc = 0
                        for ids in data.read(start, n):
                            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes(), crc)
                        sums.append(crc)
                    start = docs.column("start").to_numpy() + base
                    yield pa.RecordBatch.from_pydict({"doc_id": docs.column("doc_id"), "start": start, "n_tokens": docs.column("n"), "ids_crc32": pa.array(sums, pa.int64())})
                for s in source:
                    s.close()

    return in_arrow(files, work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All documents written to a new folder in the shared one, and read back from there."""
    folder = shared_path(docs.sparkSession, "token-ids")
    return read(write(docs, tokenizer, folder), folder)
