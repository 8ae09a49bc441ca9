"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases whose borders depend on a few neighbours only: runs of one symbol are joined, then
deterministic coin tossing (the lowest bit in which a symbol differs from the one before it, and that bit's value) shrinks
labels to six values, whose local maxima begin phrases. Phrases are named by hashes of what they hold, and the names are
parsed again, level by level. So equal substrings have equal names inside, wherever they stand. A fingerprint keeps the
name of the whole and, in SLOTS slots, 16 bits of a hash of the least hash of the phrase names of two middle levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import in_arrow, parts, slices
from granulo.llm.hashing import mix

SLOTS = 64
#: Levels whose phrase names the slots hold; phrases there have about 20 and 55 bytes.
LEVELS = (3, 4)
MOST_LEVELS = 40
PARSED_BYTES = 1 << 20
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_LOWEST = np.zeros(64, np.uint8)
_LOWEST[[(0x03F79D71B4CB0A89 << i & (1 << 64) - 1) >> 58 for i in range(64)]] = np.arange(64)
_ODD = np.random.Generator(np.random.PCG64(91)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
EMPTY, NONE = np.uint16(0xFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)


def _toss(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    x = x.astype(np.uint64)
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[heads] = ~x[heads]  # nothing stands to the left: the lowest bit decides
    low = x ^ left
    low &= ~low + np.uint64(1)
    place = _LOWEST[((low * _DEBRUIJN) >> np.uint64(58)).astype(np.int64)]
    return (place << 1) + ((x >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


_TOSS8 = np.zeros((256, 256), np.uint8)
for _x in range(256):
    _d = np.arange(256) ^ _x
    _p = np.where(_d == 0, 0, np.log2(np.maximum(_d & -_d, 1))).astype(np.uint8)
    _TOSS8[:, _x] = (_p << 1) + ((_x >> _p) & 1)


def _toss_small(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The same for labels of eight bits."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[heads] = ~x[heads]
    return _TOSS8[left, x]


def parse_level(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of one more level, and where each text's begin (one more entry). No text is without a name."""
    n = len(names)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[at[:-1]] = True
    first = np.flatnonzero(new)
    if len(first) < n:  # runs of a name count as one
        length = np.diff(np.append(first, n)).astype(np.uint64)
        single = length == 1
        names = np.where(single, names[first], mix(names[first] * _ODD[0] + length))
        at = np.searchsorted(first, at)
        n = len(names)
    heads = at[:-1]
    label = _toss_small(_toss_small(_toss(names, heads), heads), heads)
    peak = np.zeros(n, bool)
    if n > 2:
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    inner = heads[1:]
    peak[inner - 1] = False  # a text's last name has no right neighbour
    peak[heads] = True
    begin = np.flatnonzero(peak)
    of = np.cumsum(peak) - 1
    place = (np.arange(n) - begin[of]) & 63
    size = np.diff(np.append(begin, n)).astype(np.uint64)
    return mix(np.add.reduceat(names * _ODD[place], begin) + size), np.searchsorted(begin, at)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the name of the whole, and SLOTS least hashes (EMPTY where a slot has none). An empty text's name is 0."""
    count = len(offsets) - 1
    roots, slots = np.zeros(count, np.uint64), np.full((count, SLOTS), EMPTY, np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return roots, slots
    at = np.append(offsets[full], len(data))
    names = _BYTE[data]
    least = np.full(count * SLOTS, NONE, np.uint64)
    live = full
    for level in range(1, MOST_LEVELS):
        names, at = parse_level(names, at)
        if level in LEVELS:
            h = mix(names + np.uint64(level))
            owner = np.repeat(live, np.diff(at))
            np.minimum.at(least, owner * SLOTS + (h & np.uint64(SLOTS - 1)).astype(np.int64), h)
        size = np.diff(at)
        if level >= max(LEVELS):
            done = size == 1
            if done.any():
                roots[live[done]] = names[at[:-1][done]]
                stay = np.repeat(~done, size)
                names, live = names[stay], live[~done]
                at = np.r_[0, np.cumsum(size[~done])]
            if not len(live):
                break
    for i, a, b in zip(live.tolist(), at[:-1].tolist(), at[1:].tolist()):
        roots[i] = mix((names[a:b] * _ODD[np.arange(b - a) & 63]).sum(keepdims=True, dtype=np.uint64))[0]
    # Minima of long texts crowd towards 0: they are hashed again before they are cut to 16 bits.
    slots = np.where(least == NONE, EMPTY, np.minimum(mix(least) >> np.uint64(48), np.uint64(0xFFFE)).astype(np.uint16)).reshape(count, SLOTS)
    return mix(roots + np.diff(offsets).astype(np.uint64)), slots


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """About the share of phrases in common, from 0 to 1, of sketches row by row: two empty texts are alike.

    With J of the filled slots equal, 2 J / (1 + J).
    """
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    j = np.where(filled > 0, same / np.maximum(filled, 1), 1.0)
    return 2 * j / (1 + j)


def as_text(root: int, slots: np.ndarray) -> str:
    """The whole's name and the slots in hexadecimal."""
    return f"{root:016x}{slots.astype('>u2').tobytes().hex()}"


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u2").astype(np.uint16)


def _sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts, about PARSED_BYTES at a time."""
    encoded = [t.encode() for t in texts]
    roots, slots, at = [], [], 0
    while at < len(encoded):
        end, size = at, 0
        while end < len(encoded) and (end == at or size + len(encoded[end]) <= PARSED_BYTES):
            size += len(encoded[end])
            end += 1
        offsets = np.r_[0, np.cumsum([len(x) for x in encoded[at:end]])]
        r, s = fingerprints(np.frombuffer(b"".join(encoded[at:end]), np.uint8), offsets)
        roots.append(r), slots.append(s)
        at = end
    return (np.concatenate(roots), np.concatenate(slots)) if roots else (np.empty(0, np.uint64), np.empty((0, SLOTS), np.uint16))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every text, without a shuffle. Null texts count as empty ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                roots, slots = _sketch(texts)
                marks = [as_text(r, s) for r, s in zip(roots.tolist(), slots)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(marks, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, n_chars long, fingerprint string")


#: Rows from whose keys the partitions' bounds are set.
SAMPLE = 20_000


def in_order(rows: DataFrame, key: Column, tie: Column, n: int) -> DataFrame:
    """``rows`` in descending order of (key, tie) over ``n`` partitions, each followed by the row that comes next (``look`` 1).

    The last partition is followed by the very first row. Bounds are quantiles of (key, tie) among about SAMPLE rows, so that rows of one
    key spread by their ties; the driver receives those and each partition's first (key, tie), some numbers a partition.
    """
    rows = rows.withColumns({"k": key, "t": tie})
    total = rows.count() if n > 1 else 0
    cuts = []
    if total:
        seen = sorted(map(tuple, rows.select("k", "t").sample(False, min(1.0, SAMPLE / total), 17).collect()))
        cuts = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []
    pair = "array<struct<k:bigint,t:bigint>>"
    bounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in cuts]).cast(pair) if cuts else F.array().cast(pair)
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda b: b > F.struct("k", "t"))))
    heads = sorted(rows.groupBy("part").agg(F.max(F.struct("k", "t")).alias("h")).select("part", "h.k", "h.t").collect())
    if not heads:
        return rows.withColumn("look", F.lit(0))
    follows = {h["part"]: heads[i - 1]["part"] for i, h in enumerate(heads)}  # whose last row each head follows
    table = rows.sparkSession.createDataFrame([(h["part"], h["k"], h["t"], follows[h["part"]]) for h in heads], "part int, hk long, ht long, before int")
    rows = rows.join(F.broadcast(table), "part")
    copies = F.when((F.col("k") == F.col("hk")) & (F.col("t") == F.col("ht")), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("look")), F.struct(F.col("before").alias("p"), F.lit(1).alias("look"))))
    rows = rows.withColumn("go", F.explode(F.coalesce(copies, F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("look"))))))
    rows = rows.drop("part", "hk", "ht", "before").withColumn("look", F.col("go.look")).withColumn("p", F.col("go.p")).drop("go")
    return rows.repartitionById(n, "p").sortWithinPartitions("look", F.desc("k"), F.desc("t"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by the beginning of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def against_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every text: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The next document is that of the next lower id, and of the highest after the lowest; null ids come last, equal ids in
    the order of their texts' hash. A single document is its own next one. Null texts count as empty ones. One shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ordered = in_order(rows, F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"), parts(docs.sparkSession))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the document that waits for its next one: id, text, name, slots
        for batch in batches:
            for part in slices(batch):
                look = part.column("look").to_pylist()
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                if 1 in look:
                    end = look.index(1) + 1
                    ids, texts, look = ids[:end], texts[:end], look[:end]
                    if end == 1 and last is None:
                        continue
                roots, slots = _sketch(texts)
                held = [last] if last is not None else []
                held += list(zip(ids, texts, roots.tolist(), slots))
                last = held[-1] if not look[-1] else None
                mine, after = held[:-1], held[1:]
                if not mine:
                    continue
                new = [edited(a[1], b[1]) for a, b in zip(mine, after)]
                new_roots, new_slots = _sketch(new)
                own, next_ = np.stack([a[3] for a in mine]), np.stack([b[3] for b in after])
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[0] for a in mine], pa.int64()), pa.array([len(a[1]) for a in mine], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array([as_text(a[2], a[3]) for a in mine]), pa.array([as_text(r, s) for r, s in zip(new_roots.tolist(), new_slots)]),
                    pa.array(likeness(own, new_slots)), pa.array(likeness(own, next_)),
                ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return in_arrow(ordered.select("doc_id", "text", "look"), work, SCHEMA)
