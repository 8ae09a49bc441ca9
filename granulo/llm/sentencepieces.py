"""SentencePiece models on the tokenizers library.

The model file is parsed as a protocol buffer; its normaliser, space marker, piece scores and byte fallback are rebuilt
there, and its ids are the result. Every piece of text that a worker meets for the first time is also encoded by the sentencepiece
library: ``parity`` tells whether both agreed on all pieces of a document.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import held, in_arrow, slices
from granulo.llm.pieces import PieceCache, split_marked

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes in each half of a worker's piece cache.
PIECE_BYTES = 128 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None:
                raise ValueError(f"wire type {kind} is not known")
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def splits(self) -> bool:
        """Whether texts may be cut before runs of spaces: nothing is normalised away and no piece spans such a place."""
        plain = not (self.charsmap or self.squeeze or self.suffix_mark) and self.dummy_prefix and self.escape and self.kind == BPE
        return plain and not any(MARK in p.lstrip(MARK) or p[2:] and p.startswith(MARK * 2) and p.strip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER))


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _message(data):
        if number == 1:
            piece = dict(_message(value))
            m.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            told = dict(_message(value))
            m.kind, m.byte_fallback, m.suffix_mark = told.get(3, UNIGRAM), bool(told.get(35, 0)), bool(told.get(24, 0))
        elif number == 3:
            told = dict(_message(value))
            m.charsmap = told.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = bool(told.get(3, 1)), bool(told.get(4, 1)), bool(told.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return m


def build(m: Model, whole: bool):
    """The model as a tokenizer, for whole texts or for pieces that bring their leading spaces."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
    else:
        ids = {p: i for i, (p, _, k) in enumerate(m.pieces)}
        usable = {p for p, _, k in m.pieces if k in (NORMAL, USER)}
        merges = []
        for p, score, kind in m.pieces:
            if kind == NORMAL and len(p) > 1:
                ways = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
                merges += [(-score, -len(p), ids[a], ids[b], a, b) for a, b in ways]
        merges.sort(key=lambda x: x[:4])  # runs of the marker have one score: the leftmost grows first
        core = models.BPE(ids, [x[4:] for x in merges], unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and whole:
        steps.append(normalizers.Prepend(MARK))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix and whole else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


def _loaded(path: str):
    import sentencepiece

    with open(path, "rb") as f:
        m = parse(f.read())
    return m, build(m, True), build(m, False), sentencepiece.SentencePieceProcessor(model_file=path)


def threaded(threads: int) -> None:
    """Lets the library encode batches on several threads. It reads the switch at every batch, the number when its pool starts.

    Nothing else in this package starts the pool, so the first number that a worker gives holds there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))


class Codec:
    """Encodes and decodes texts; ``threads`` encode each batch of new pieces."""

    def __init__(self, path: str, threads: int = 2):
        self.model, self.whole, self.part, self.judge = _loaded(path)
        self.cut, self.threads, self.cache = self.model.splits, threads, PieceCache(self._make, PIECE_BYTES)

    def _make(self, pieces: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        cut = self.cut
        engine = self.part if cut else self.whole
        out = []
        threaded(self.threads)
        for i in range(0, len(pieces), 4096):
            texts = [x.decode() for x in pieces[i : i + 4096]]
            ours = [e.ids for e in engine.encode_batch_fast(texts, add_special_tokens=False)]
            bare = [x[1:] for x in texts] if cut else texts
            theirs = self.judge.encode(bare, num_threads=1)
            for x, a, b, back in zip(bare, ours, theirs, engine.decode_batch(ours, skip_special_tokens=False)):
                out.append((array("I", a).tobytes(), back.encode(), a == b or not x))  # it gives an empty text no marker
        return out

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes], list[bool]]:
        """For each text its ids as little-endian unsigned 32-bit integers, what they decode to, and parity."""
        cut = self.cut
        split = [] if cut else [[t.encode()] if t else [] for t in texts]
        if cut:
            mark = MARK.encode()
            for t in texts:
                data = b" " + t.encode() if t else b""
                split.append(split_marked(data.replace(mark, b" ")))
        known = self.cache([x for s in split for x in s])
        ids, back, same = [], [], []
        for s in split:
            if s:
                a, b, c = zip(*map(known.__getitem__, s))
                ids.append(b"".join(a)), same.append(all(c))
                back.append(b"".join(b)[1:] if cut else b[0])
            else:
                ids.append(b""), back.append(b""), same.append(True)
        return ids, back, same


def shared_codec(path: str, threads: int) -> Codec:
    """The codec that a worker's tasks of one stage share."""
    return held(("codec", path, threads), lambda: Codec(path, threads))


SCHEMA = "doc_id long, ids binary, decoded string, round_trip boolean, parity boolean"


def encode_and_decode(docs: DataFrame, model: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Whole texts encoded, and decoded again (SCHEMA; without ``keep`` the checksums stand for ids and decoded text).

    ``round_trip``: the decoded text is the text. ``parity``: the sentencepiece library gives the same ids, text for text; its
    ids are never returned. Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded again
    each; null ids are kept; other columns are not read. No shuffle.
    """
    schema = SCHEMA if keep else "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model, threads)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                ids, back, same = codec(texts)
                trip = [(t or "").encode() == b for t, b in zip(texts, back)]
                if keep:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([b.decode() for b in back]), pa.array(trip), pa.array(same)], names=["doc_id", "ids", "decoded", "round_trip", "parity"])
                else:
                    sums = [pa.array([f(x) for x in xs], pa.int64()) for f, xs in ((lambda x: len(x) // 4, ids), (zlib.crc32, ids), (zlib.crc32, back))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *sums, pa.array(trip), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip", "parity"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` (``doc_id, ids``) decoded: ``doc_id, decoded``. A null or empty list of ids decodes to the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = held(("loaded", model), lambda: _loaded(model))[1]
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(engine.decode_batch(ids, skip_special_tokens=False), pa.string())], names=["doc_id", "decoded"])

    return in_arrow(rows.select("doc_id", "ids"), work, "doc_id long, decoded string")
