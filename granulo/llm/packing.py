"""Packing in space-filling-curve order.

A document's words are hashed to random vectors and averaged, which projects its hashed word counts to a few dimensions.
The coordinates' Hilbert key puts documents with like words near each other on a line. Documents are range-sorted along it
and laid end to end, cut wherever a sequence is full. A range's last tokens go to sequences whose lengths are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm import hashing
from granulo.llm.common import chunks, in_arrow, parts, slices
from granulo.llm.pieces import encoder as shared_encoder

DIMS, BITS = 4, 8
#: Bytes of text that a range aims at, and documents from whose places ranges are set: so many for each, within bounds.
RANGE_BYTES, EACH, LEAST, MOST = 64 << 20, 20, 20_000, 2_000_000
#: Bytes in each half of a worker's piece cache.
PIECE_BYTES = 48 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    By Skilling's transposition: undo the excess work from the top bit down, Gray-encode, then interleave bits.
    """
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def project(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Integer coordinates of texts: means of their words' random directions, on a fixed scale. A text without words is at 0."""
    h, at = hashing.words(data, offsets)
    out = np.zeros((len(offsets) - 1, dims), np.int64)
    n = np.diff(at)
    some = n > 0
    for d in range(dims):
        value = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32768 - 1
        sums = np.r_[0.0, np.cumsum(value)]
        mean = (sums[at[1:]] - sums[at[:-1]])[some] / n[some]
        out[some, d] = np.clip(np.floor((np.tanh(4 * mean) + 1) / 2 * (1 << bits)), 0, (1 << bits) - 1).astype(np.int64)
    return out


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: np.ndarray | None = None) -> DataFrame:
    """``doc_id, text, place, part``: the Hilbert key over a hash of id and text that breaks ties, and the range it falls in."""
    edges = np.empty(0, np.int64) if bounds is None else bounds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                rows = batch.slice(at, len(offsets) - 1)
                place = hilbert_key(project(data, offsets), BITS) << 31 | rows.column("tie").to_numpy()
                part = np.searchsorted(edges, place, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(place), pa.array(part)], names=["doc_id", "text", "place", "part"])

    text = F.col(text_col).cast("string")
    tie = F.xxhash64(F.col(id_col).cast("long"), F.crc32(text)).bitwiseAND(0x7FFFFFFF)
    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), tie.alias("tie")), work, "doc_id long, text string, place long, part int")


def curve_ranges(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Bounds that cut the curve into ranges of about as many documents: ``least`` at least, and one for each RANGE_BYTES of text.

    They are set by EACH documents a range, chosen by hash, LEAST at least and MOST at most, which bounds what the driver receives (eight
    bytes a document). They decide balance and where ranges end, never which documents are packed.
    """
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    n = max(least, -(-size // RANGE_BYTES))
    want = min(max(LEAST, EACH * n), MOST)
    few = docs if total <= want else docs.where(F.pmod(F.xxhash64(F.lit(17), F.monotonically_increasing_id()), F.lit(1 << 30)) < int((1 << 30) * want / total))
    places = np.sort(placed(few, id_col, text_col).select("place").toArrow()["place"].to_numpy())
    return np.unique(places[(np.arange(1, n) * len(places)) // n]) if len(places) else np.empty(0, np.int64)


class Layout:
    """Deals documents' ids to sequences one after another; only the last, open run of ids waits for its place."""

    def __init__(self, base: int, size: int):
        self.base, self.size, self.at, self.open = base, size, 0, []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while start < n:
            take = min(n - start, self.size - self.at % self.size)
            self.open.append((doc_id, start, take, n, ids[4 * start : 4 * (start + take)]))
            start += take
            self.at += take
            if self.at % self.size == 0:
                self._place(self.open, self.at // self.size - 1)
                self.open = []

    def _place(self, pieces: list[tuple], sequence: int) -> None:
        at = 0
        for doc_id, start, take, n, ids in pieces:
            self.rows.append((doc_id, start, take, n, self.base + sequence, at, ids))
            at += take

    def close(self) -> None:
        """The rest goes to sequences of falling powers of two, which need no padding."""
        sequence, left = self.at // self.size, self.at % self.size
        pieces = self.open
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now, later = [], []
            for doc_id, start, take, n, ids in pieces:
                cut = min(take, room)
                room -= cut
                if cut:
                    now.append((doc_id, start, cut, n, ids[: 4 * cut]))
                if cut < take:
                    later.append((doc_id, start + cut, take - cut, n, ids[4 * cut :]))
            self._place(now, sequence)
            sequence, pieces = sequence + 1, later
        self.open = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, length, n, sequence, offset, ids = zip(*rows)
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([long(doc_id), long(start), long(length), long(n), long(sequence), long(offset), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces (PIECE_SCHEMA) of all documents; ``ids`` are little-endian unsigned 32-bit integers.

    A sequence holds ``size`` ids, but for a few in each range, whose lengths are smaller powers of two: none has padding.
    Documents meet their curve neighbours: one shuffle by range of (Hilbert key, hash of id and text), so that a third of all rows with
    one text still spread over ranges. A null text is empty and holds the end id alone, as an
    empty one does. Repeated rows are packed again each, null ids are kept, other columns are not read. No rows give none.
    """
    spark = docs.sparkSession
    bounds = curve_ranges(docs, parts(spark), id_col, text_col)
    rows = placed(docs, id_col, text_col, bounds)
    ordered = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("place", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, end_id, PIECE_BYTES)
        layout = Layout(TaskContext.get().partitionId() << 40, size)
        for batch in batches:
            for part in slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(part.column("text").to_pylist())):
                    layout.add(doc_id, ids)
                if rows := layout.taken():
                    yield _batch(rows)
        layout.close()
        if rows := layout.taken():
            yield _batch(rows)

    return in_arrow(ordered.select("doc_id", "text"), work, PIECE_SCHEMA)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
