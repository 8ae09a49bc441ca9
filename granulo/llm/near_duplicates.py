"""N-gram Jaccard join with grouped prefixes.

Every document's distinct word shingles are put in one order for all, shingles that are frequent last. Two documents with
enough in common share a shingle among the first of both (their prefixes). Documents with identical prefix and size form
one group; groups that share a prefix shingle, and whose sizes and places allow the threshold, are candidate pairs; these
are expanded to members and verified on whole sets.

Only links between different sets, and only as many as components need, are verified, and sets move only for pairs that a
filter lets through: each set has a parity bitmap, in which every shingle turns one bit, and two sets differ in at least as many
shingles as their bitmaps do in bits.

A shingle that up to three groups share gives all their pairs. In a longer list, sorted by size, each group is paired with the
two before it and with the first one, and the list is kept aside. A pair of groups stands for its two heads and, where it
must be complete, for either head with the other's members; a pair of two large groups is kept aside as a list as well, and so is
every large group. Of all pairs each set's most promising is verified first; then those between sets that are still in different
components. Then come the lists that still span components: a short list gives the pairs between them that sizes, places and bitmaps
allow; in a long one the sets outside its largest component are compared with all of it in blocks, first bitmaps, then the sets
whose bitmaps allow a link. So nothing is lost and no rows are made for all pairs of a group. What grows faster than a list is the
number of bitmaps that pass its blocks, and only where many of its sets stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.llm.common import Scratch, chunks, in_arrow, shared_path, slices, written
from granulo.llm.components import components
from granulo.llm.hashing import shingle_sets

WORDS, PERCENT = 5, 80
#: Size of the frequency sketch and of the filter of wanted texts: fixed, whatever the input.
SKETCH_BITS, WANTED_BITS = 22, 20
#: Shingles whose local counts are taken together, and the least local count that tells.
BUFFER, OFTEN = 3_000_000, 2
#: Partners of one set that are verified in one run of rows; sets that others are compared with at a time; and how many
#: pairs a shingle's list may stand for before its sets are compared in blocks.
PARTNERS, BLOCK, LISTED = 256, 256, 20_000
ENTRY = "doc_id long, n int, node binary, gid long, prefix array<long>, bits array<long>"
FOUND = "a long, b long, whole boolean, token long, gid long, np long"


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        for at, data, offsets in chunks(batch.column("text")):
            yield batch, at, shingle_sets(data, offsets, words)


def frequency_levels(texts: DataFrame, words: int) -> np.ndarray:
    """For each bucket of shingle hashes, how frequent its most frequent shingle looks: 0, or the bit length of a count.

    A shingle's count is the greatest that a task's buffer has of it. Any levels give right joins; these keep what many
    documents share out of prefixes. The driver receives at most 2**SKETCH_BITS small numbers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(1 << SKETCH_BITS, np.int32)
        buffer, n = [], 0

        def flush() -> None:
            h = np.sort(np.concatenate(buffer))
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.append(first, len(h)))
            often = count >= OFTEN
            np.maximum.at(most, (h[first[often]] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), count[often].astype(np.int32))

        for _, _, sets in _sets(batches, words):
            buffer += sets
            n += sum(map(len, sets))
            if n >= BUFFER:
                flush()
                buffer, n = [], 0
        if n:
            flush()
        some = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(most[some])], names=["bucket", "c"])

    got = in_arrow(texts.select("text"), work, "bucket int, c int").groupBy("bucket").agg(F.max("c").alias("c")).toArrow()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    levels[got["bucket"].to_numpy()] = np.minimum(np.ceil(np.log2(got["c"].to_numpy() + 1)), 63).astype(np.uint8)
    return levels


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap in words of 64 bits: one to two bits a shingle, a power of two of them, 64 at least."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def differ_at_most(n1, n2, percent: int):
    """100 + percent times the most shingles that may differ between linked sets of these sizes. For numbers, arrays and columns."""
    return (n1 + n2) * (100 - percent)


def may_link(bits1: Column, n1: Column, bits2: Column, n2: Column, percent: int) -> Column:
    """Whether sizes and bitmaps allow a link. A bitmap folds to half its size, its halves added bit by bit."""
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    fitted = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
    apart = F.aggregate(F.zip_with(fitted(bits1, bits2), fitted(bits2, bits1), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, x: a + x)
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)  # then one bitmap is at most twice as long as the other
    return F.when(sizes, apart * (100 + percent) <= differ_at_most(n1, n2, percent)).otherwise(False)


def prefix_of(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, as sorted keys: level above hash."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    level = levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    key = (level << np.uint64(57)) | (shingles >> np.uint64(7))
    if size < n:
        key = np.partition(key, size - 1)[:size]
    return np.sort(key)


_NONE = np.empty(0, np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    starts = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([_NONE, *values])))


def entries(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """ENTRY of every row of ``doc_id, text``: set size, set digest, group (hash of size and prefix), prefix and bitmap; no node without words.

    Further columns of ``rows`` are kept.
    """
    further = [f for f in rows.schema.fields if f.name not in ("doc_id", "text")]
    names = [f.name for f in further]
    levels = rows.sparkSession.sparkContext.broadcast(frequency_levels(rows, words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, sets in _sets(batches, words):
            node, gid, prefix, bits = [], [], [], []
            for s in sets:
                if len(s):
                    p = prefix_of(s, levels.value, percent)
                    node.append(node_of(s))
                    gid.append(int.from_bytes(hashlib.blake2b(len(s).to_bytes(8, "little") + p.tobytes(), digest_size=8).digest(), "little", signed=True))
                    prefix.append(p.view(np.int64)), bits.append(bitmap_of(s))
                else:
                    node.append(None), gid.append(None), prefix.append(_NONE), bits.append(_NONE)
            n = pa.array([len(s) for s in sets], pa.int32())
            kept = [batch.column(c).slice(at, len(sets)) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(sets)), n, pa.array(node, pa.binary()), pa.array(gid, pa.int64()), _lists(prefix), _lists(bits), *kept], names=["doc_id", "n", "node", "gid", "prefix", "bits", *names])

    return in_arrow(rows, work, ", ".join([ENTRY, *(f"{f.name} {f.dataType.simpleString()}" for f in further)]))


def _allowed(n1, p1, n2, p2, percent: int):
    """Whether sizes n1 <= n2 and places of a first common shingle allow the threshold. For arrays and for columns."""
    need = percent * (n1 + n2)
    return (100 * n1 >= percent * n2) & ((100 + percent) * (n1 - p1) >= need) & ((100 + percent) * (n2 - p2) >= need)


def _candidates(percent: int):
    """Over postings sorted by token and np (size above place): pairs ``a, b``, and all postings of tokens in four groups or more.

    ``whole`` pairs may be those of a list of three at most, and nothing else stands for them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, gid, np_ = (np.empty(0, np.int64) for _ in range(3))  # at most three last postings of the open run
        head, count = None, 0  # the open run's first posting and its length so far
        for batch in batches:
            kept = len(token)
            token, gid, np_ = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((token, "token"), (gid, "gid"), (np_, "np")))
            if len(token) == kept:
                continue
            new = np.r_[True, token[1:] != token[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            rank = np.arange(len(token)) - start
            head_gid, head_np = gid[start], np_[start]
            if head is not None:
                same = start == 0
                rank = rank + np.where(same, count - kept, 0)
                head_gid, head_np = np.where(same, head[0], head_gid), np.where(same, head[1], head_np)
            fresh = np.arange(len(token)) >= kept
            n, p = np_ >> 32, np_ & 0xFFFFFFFF
            a, b, whole = [], [], []
            for d in (1, 2):
                i = np.flatnonzero(fresh & (rank >= d))
                i = i[_allowed(n[i - d], p[i - d], n[i], p[i], percent)]
                a.append(gid[i - d]), b.append(gid[i]), whole.append(rank[i] < 3)
            i = np.flatnonzero(fresh & (rank >= 3))
            hn, hp = head_np[i] >> 32, head_np[i] & 0xFFFFFFFF
            ok = i[_allowed(hn, hp, n[i], p[i], percent)]
            a.append(head_gid[ok]), b.append(gid[ok]), whole.append(np.zeros(len(ok), bool))
            turned = np.flatnonzero(fresh & (rank == 3))
            hot = np.unique(np.concatenate([i, turned - 1, turned - 2, turned - 3]))
            a, b, whole = np.concatenate(a), np.concatenate(b), np.concatenate(whole)
            differ = a != b
            a, b, whole = a[differ], b[differ], whole[differ]
            none = lambda k: pa.nulls(k, pa.int64())
            names = ["a", "b", "whole", "token", "gid", "np"]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(whole), none(len(a)), none(len(a)), none(len(a))], names=names)
            if len(hot):
                yield pa.RecordBatch.from_arrays([none(len(hot)), none(len(hot)), pa.nulls(len(hot), pa.bool_()), pa.array(token[hot]), pa.array(gid[hot]), pa.array(np_[hot])], names=names)
            head, count = (head_gid[-1], head_np[-1]), int(rank[-1]) + 1
            keep = max(int(start[-1]), len(token) - 3)
            token, gid, np_ = token[keep:], gid[keep:], np_[keep:]

    return work


def hit_by(keys: DataFrame, *columns: str) -> Column:
    """A filter on ``columns``: whether a fixed bitmap has their hash, as it has that of every row of ``keys`` and some others'.

    With many keys it lets more and more through and costs nothing but time: what it guards is joined exactly afterwards.
    """
    bucket = F.shiftrightunsigned(F.xxhash64(*columns), 64 - WANTED_BITS).cast("int")
    bits = np.zeros(1 << WANTED_BITS, bool)
    bits[keys.select(bucket.alias("k")).distinct().toArrow()["k"].to_numpy()] = True
    bitmap = keys.sparkSession.createDataFrame([(bytearray(np.packbits(bits).tobytes()),)], "bits binary").scalar()  # no literal: plans stay small
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bucket, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), 7 - bucket % 8)) % 2 == 1


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def texts_of(rows: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of each wanted node: the text whose hashes ``h, g`` stand for it among ``sets``.

    Other texts stay where they are, but for those that the fixed bitmap lets through; copies are dropped before the shuffle where a
    task meets them.
    """
    keys = sets.select("node", "h", "g").where(hit_by(nodes, "node")).join(nodes.distinct(), "node", "left_semi")
    found = rows.select("h", "g", "text").where(hit_by(keys, "h", "g")).groupBy("h", "g").agg(F.first("text").alias("text"))
    return found.join(keys, ["h", "g"]).select("node", "text")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bitmaps allow a link."""
    some = sets.select("node", "n", "bits").where(hit_by(ends_of(pairs), "node"))
    one, two = (some.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").where(may_link(F.col("bitsa"), F.col("na"), F.col("bitsb"), F.col("nb"), percent)).select(*pairs.columns)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` whose whole sets have the wanted likeness: ``u, v``.

    Partners ``b`` come in a stream behind the set ``a`` that they are compared with, so its set is sent once; one with many partners
    is sent along with each PARTNERS of them or so.
    """
    many = scratch.keep(pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > PARTNERS).select("a", F.ceil(F.col("c") / PARTNERS).cast("int").alias("salts")), "partners")
    salts = F.coalesce("salts", F.lit(1))
    partner = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    partner = partner.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "salt", F.lit(1).alias("late"), F.col("b").alias("node"), "text")
    own = pairs.select("a").distinct().join(many, "a", "left").join(texts.select(F.col("node").alias("a"), "text"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("late"), F.col("a").alias("node"), "text")
    dealt = own.unionByName(partner).repartition("a", "salt").sortWithinPartitions("a", "salt", "late")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                late, node, a = part.column("late").to_pylist(), part.column("node").to_pylist(), part.column("a").to_pylist()
                u, v = [], []
                sets = [s for _, data, offsets in chunks(part.column("text")) for s in shingle_sets(data, offsets, words)]
                for i, s in enumerate(sets):
                    if not late[i]:
                        mine = s
                        continue
                    at = np.searchsorted(mine, s)
                    at[at == len(mine)] = 0
                    both = int((mine[at] == s).sum())
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        u.append(a[i]), v.append(node[i])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return in_arrow(dealt, work, "u binary, v binary")


def linked(rows: DataFrame, known: DataFrame, sets: DataFrame, words: int, percent: int, path: str) -> DataFrame | None:
    """``node, root`` of nodes that verified links join, at ``path``, or None where there is no candidate.

    ``rows`` has ``h, g, text``, ``known`` the entries of all rows, ``sets`` one row a node.
    """
    with Scratch(rows.sparkSession) as scratch:
        groups = known.where("n > 0").groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        postings = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).select("token", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("np"), "gid")
        found = scratch.keep(in_arrow(postings.repartition("token").sortWithinPartitions("token", "np", "gid"), _candidates(percent), FOUND), "candidates")
        heads = scratch.keep(sets.groupBy("gid").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.count("*").alias("k")), "heads")
        large = scratch.keep(heads.where("k > 1"), "large")
        members = sets.select("gid", "node").where(hit_by(large, "gid")).join(large.select("gid", F.col("node").alias("head")), "gid")
        members = scratch.keep(members, "members")
        wide = scratch.keep(_between_groups(found, heads), "group-pairs")
        pairs = scratch.keep(likely(scratch.keep(_pairs(wide, members), "all-pairs"), sets, percent), "pairs")
        lists = _lists_of(found, wide, large)
        if pairs.isEmpty() and lists.isEmpty():
            return None
        roots = _paired(rows, sets, pairs, words, percent, scratch)
        rest = _spanning(lists, heads, members, roots, percent, scratch)
        if rest.isEmpty():
            return written(roots, path)
        listed = scratch.keep(_listed(rest.where(F.col("cross") <= LISTED), percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "listed")
        listed = scratch.keep(likely(listed, sets, percent), "listed")
        blocks = rest.where(F.col("cross") > LISTED)
        blocks = scratch.keep(bitmap_blocks(blocks.join(sets.select("node", "bits").where(hit_by(blocks, "node")), "node"), percent), "blocks")
        texts = scratch.keep(texts_of(rows, sets, ends_of(listed).union(blocks.select("node"))), "texts")
        more = verified(listed, texts, words, percent, scratch).unionByName(verified_blocks(blocks, texts, words, percent).distinct())
        return written(_joined(roots, more, scratch), path)


def _between_groups(found: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of groups with their heads: ``a, b, shared, whole`` and, with 1 or 2 behind, node, n and k."""
    pairs = found.where("token IS NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.max("whole").alias("whole"))
    some = heads.where(hit_by(found.where("token IS NULL").select(F.explode(F.array("a", "b")).alias("gid")), "gid"))
    one, two = (some.select(F.col("gid").alias(g), *[F.col(c).alias(f"{c}{i}") for c in ("node", "n", "k")]) for g, i in (("a", 1), ("b", 2)))
    return pairs.join(one, "a").join(two, "b")


def _pairs(wide: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b, shared`` of nodes: the heads of paired groups, heads with members, members with their own head."""
    every = wide.select(F.col("node1").alias("a"), F.col("node2").alias("b"), "shared")
    every = every.unionByName(members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"), F.lit(1 << 40).alias("shared")))
    for g, head, other in (("a", 2, 1), ("b", 1, 2)):  # the other group's head with this one's members
        some = wide.where(F.col("whole") & (F.col(f"k{other}") > 1)).select(F.col(g).alias("gid"), F.col(f"node{head}").alias("a"), "shared")
        every = every.unionByName(some.join(members.select("gid", F.col("node").alias("b")), "gid").select("a", "b", "shared"))
    return every.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))


def _lists_of(found: DataFrame, wide: DataFrame, large: DataFrame) -> DataFrame:
    """``token, gid, np`` of everything whose pairs were not all made: long lists, pairs of large groups, groups of three sets or more."""
    size = lambda n: F.shiftleft(F.col(n).cast("long"), 32)
    two = wide.where(F.col("whole") & (F.col("k1") > 1) & (F.col("k2") > 1))
    two = two.select(F.xxhash64("a", "b").alias("token"), F.inline(F.array(F.struct(F.col("a").alias("gid"), size("n1").alias("np")), F.struct(F.col("b").alias("gid"), size("n2").alias("np")))))
    own = large.where("k > 2").select(F.col("gid").alias("token"), "gid", size("n").alias("np"))
    return found.where("token IS NOT NULL").select("token", "gid", "np").unionByName(two).unionByName(own)


def _paired(rows: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Components by ``pairs``: first each set's most promising partner is verified, then what is still apart."""
    texts = scratch.keep(texts_of(rows, sets, ends_of(pairs)), "texts")
    ends = pairs.select("shared", F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
    best = ends.groupBy("node").agg(F.max(F.struct("shared", "other")).alias("m")).select(F.col("m.other").alias("a"), F.col("node").alias("b"))
    best = scratch.keep(best.groupBy(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b", "l", "g"), "best")
    roots = components(verified(best.select("a", "b"), texts, words, percent, scratch), scratch_path(scratch, "roots"))
    apart = pairs.join(best.select(F.col("l").alias("a"), F.col("g").alias("b")), ["a", "b"], "left_anti").select("a", "b")
    apart = scratch.keep(_across(apart, roots), "apart")
    return roots if apart.isEmpty() else _joined(roots, verified(apart, texts, words, percent, scratch), scratch)


def scratch_path(scratch: Scratch, name: str) -> str:
    scratch.paths.append(shared_path(scratch.spark, name))
    return scratch.paths[-1]


def _joined(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links; the same ones where there are none."""
    more = scratch.keep(more, "links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch_path(scratch, "roots"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    root = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
    rows = pairs.join(root["a"], "a", "left").join(root["b"], "b", "left")
    return rows.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _spanning(lists: DataFrame, heads: DataFrame, members: DataFrame, roots: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``token, node, root, n, p, main, asked, cross`` of the lists that span components.

    A list is looked at by its groups first. Of two sets that link, the smaller has their first common shingle at a place that leaves
    it partners of its own size, so a list needs such a posting, and one posting goes if no size from the least such one up allows it a partner.
    ``main`` is a list's largest component, ``asked`` counts the others' nodes and ``cross`` bounds the pairs that they stand for.
    Sums by list are made before their shuffle; joins by list are stages of their own, in which a list of very many rows is dealt out.
    """
    nodes = heads.where("k = 1").select("gid", "node").unionByName(members.select("gid", "node"))
    nodes = scratch.keep(nodes.where(hit_by(lists, "gid")).join(roots, "node", "left").select("gid", "node", F.coalesce("root", "node").alias("root")), "nodes")
    group = scratch.keep(nodes.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")), "group-roots")
    lists = scratch.keep(lists.join(group, "gid"), "lists")
    n, p = F.shiftright("np", 32), F.col("np").bitwiseAND(0xFFFFFFFF)
    same = (100 + percent) * (n - p) >= 2 * percent * n
    spans = lists.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(same, n)).alias("least"))
    spans = scratch.keep(spans.where("low <> high AND least IS NOT NULL").select("token", "least"), "spans")
    rows = lists.select("token", "gid", "np").where(hit_by(spans, "token")).join(spans, "token")
    other = F.greatest(F.col("least"), F.ceil(n * percent / 100))  # the smallest set that this one may link with
    rows = scratch.keep(rows.where((100 + percent) * (n - p) >= percent * (other + n)).select("token", "gid", n.alias("n"), p.alias("p")), "postings")
    rows = scratch.keep(rows.join(nodes.where(hit_by(rows, "gid")), "gid").select("token", "node", "root", "n", "p"), "rows")
    sizes = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("main"), (F.sum("k") - F.max("k")).alias("asked"), F.sum("k").alias("all"))
    sizes = scratch.keep(sizes.where("asked > 0").select("token", "main", "asked", (F.col("asked") * F.col("all")).alias("cross")), "sizes")
    return scratch.keep(rows.join(sizes, "token"), "rest")


def _listed(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of one list in different components that sizes and places allow."""
    one, two = (rest.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("node", "root", "n", "p")]) for k in (1, 2))
    order = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    allowed = _allowed(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), percent)
    pairs = one.join(two, "token").where((F.col("root1") != F.col("root2")) & order & allowed)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _dealt(rest: DataFrame) -> DataFrame:
    """Rows ``token, block, late, node, root, n, bits``: all but a list's largest component are asked about, BLOCK of them or so in a block, and all pass every block."""
    rows = rest.withColumn("blocks", F.ceil(F.col("asked") / BLOCK).cast("int"))
    asked = rows.where("root <> main").select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("late"), "node", "root", "n", "bits")
    passing = rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("late"), "node", "root", "n", "bits")
    return asked.unionByName(passing).repartition("token", "block").sortWithinPartitions("token", "block", "late")


class Bitmaps:
    """The bitmaps of sets asked about, by length; those of double length are there folded as well."""

    def __init__(self, percent: int):
        self.percent, self.own, self.folded = percent, {}, {}

    def add(self, i: int, n: int, root: bytes, bits: np.ndarray) -> None:
        self.own.setdefault(len(bits), []).append((i, n, root, bits))
        if len(bits) > 1:
            self.folded.setdefault(len(bits) // 2, []).append((i, n, root, bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]))

    def close(self) -> None:
        for rows in (self.own, self.folded):
            for size, found in rows.items():
                i, n, root, bits = zip(*found)
                rows[size] = np.array(i), np.array(n, np.int64), np.array([*root, None], object)[:-1], np.stack(bits)

    def near(self, n: int, root: bytes, bits: np.ndarray) -> np.ndarray:
        """Sets in other components that may link with this one."""
        half = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        out = []
        for rows, mine in ((self.own.get(len(bits)), bits), (self.folded.get(len(bits)), bits), (self.own.get(len(bits) // 2), half)):
            if rows is not None and len(mine):
                i, size, roots, held = rows
                apart = np.bitwise_count(held ^ mine).sum(1, dtype=np.int64)
                ok = (apart * (100 + self.percent) <= differ_at_most(size, n, self.percent)) & (roots != root)
                ok &= 100 * np.minimum(size, n) >= self.percent * np.maximum(size, n)
                out.append(i[ok])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def bitmap_blocks(rest: DataFrame, percent: int) -> DataFrame:
    """Of all comparisons in blocks, the rows ``token, block, late, node, root`` that some other row's bitmap allows a link with."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hit, index = None, [], set(), None
        for batch in batches:
            out = []
            token, block, late, node, root, n = (batch.column(c).to_pylist() for c in ("token", "block", "late", "node", "root", "n"))
            lists = batch.column("bits")
            flat, bounds = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for i in range(batch.num_rows):
                if (token[i], block[i]) != key:
                    out += [(*key, 0, *held[j]) for j in hit]
                    key, held, hit, index = (token[i], block[i]), [], set(), Bitmaps(percent)
                bits = flat[bounds[i] : bounds[i + 1]]
                if not late[i]:
                    index.add(len(held), n[i], root[i], bits.copy())
                    held.append((node[i], root[i]))
                    continue
                if isinstance(next(iter(index.own.values()), None), list):
                    index.close()
                found = index.near(n[i], root[i], bits)
                if len(found):
                    hit.update(found.tolist())
                    out.append((*key, 1, node[i], root[i]))
            if out:
                yield _block_rows(out)
        if key is not None and hit:
            yield _block_rows([(*key, 0, *held[j]) for j in hit])

    return in_arrow(_dealt(rest), work, "token long, block int, late int, node binary, root binary")


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["token", "block", "late", "node", "root"])


def verified_blocks(blocks: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``u, v`` between nodes of one list and different components, over the rows of ``bitmap_blocks``.

    An index of the shingles of a block's sets asked about is held while the others pass by. One row is made for each set asked about
    and component that it links with there.
    """
    dealt = blocks.join(texts, "node").repartition("token", "block").sortWithinPartitions("token", "block", "late")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the open block's sets: node, root, shingles
        index, joined = None, set()
        for batch in batches:
            for part in slices(batch):
                token, block, late, node, root = (part.column(c).to_pylist() for c in ("token", "block", "late", "node", "root"))
                sets = [s for _, data, offsets in chunks(part.column("text")) for s in shingle_sets(data, offsets, words)]
                u, v = [], []
                for i, s in enumerate(sets):
                    if (token[i], block[i]) != key:
                        key, held, index, joined = (token[i], block[i]), [], None, set()
                    if not late[i]:
                        held.append((node[i], root[i], s))
                        continue
                    if not held:
                        continue
                    if index is None:
                        flat = np.concatenate([h[2] for h in held])
                        order = np.argsort(flat, kind="stable")
                        size = np.array([len(h[2]) for h in held])
                        index = flat[order], np.repeat(np.arange(len(held)), size)[order], size
                    first, last = np.searchsorted(index[0], s, "left"), np.searchsorted(index[0], s, "right")
                    width = last - first
                    at = np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())
                    both = np.bincount(index[1][at], minlength=len(held))
                    for j in np.flatnonzero(100 * both >= percent * (index[2] + len(s) - both)).tolist():
                        if held[j][1] != root[i] and (j, root[i]) not in joined:  # one link to each component will do
                            joined.add((j, root[i]))
                            u.append(held[j][0]), v.append(node[i])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return in_arrow(dealt, work, "u binary, v binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are runs of characters other than space and tab to carriage return, with A-Z lower-cased. A text's set holds its
    distinct shingles of ``words`` words; with fewer words, the whole sequence. Texts link when 100 * common >= percent *
    union. ``component_id`` is the least id that links reach. Null, empty and wordless texts have no shingles, link with
    nothing and are their own component. Repeated rows and equal texts share a component. Null ids take part and are never
    a component's id, unless it has no other. Other columns are not read. Shingles are 64-bit hashes, texts' sets 128-bit ones.
    """
    rows = _rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        known = written(entries(rows, words, percent), shared_path(spark, "shingle-prefixes"))
        sets = scratch.keep(_one_a_set(known), "sets")
        roots = linked(rows, known, sets, words, percent, scratch_path(scratch, "roots"))
        per_node = sets.select("node", "least")
        if roots is not None:
            per_node = per_node.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
            least = per_node.groupBy("root").agg(F.min("least").alias("component_id"))
            ids = per_node.join(least, "root").select("node", "component_id")
        else:
            ids = per_node.select("node", F.col("least").alias("component_id"))
        ids = written(ids, shared_path(spark, "component-ids"))
    out = known.select("doc_id", "n", "node").join(ids, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _rows(rows: DataFrame) -> DataFrame:
    """With ``h, g``: 128 bits of hashes that know a text again."""
    return rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(91), "text")})


def _one_a_set(known: DataFrame) -> DataFrame:
    """``node, gid, n, bits, h, g, least``: one row for each distinct set, with the hashes of one of its texts and its least id."""
    one = known.where("n > 0").groupBy("node").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("h", "g")).alias("key"), F.min("doc_id").alias("least"))
    return one.select("node", "gid", "n", "bits", "key.h", "key.g", "least")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, whatever its ids: the one with the least id, a null id being the last.

    Rows are known by 128-bit hashes of all their columns, which no repeated reading changes; of rows that are equal in all
    columns one is kept. Rows without words link with nothing: those of one id are one component, each with a null id is its own.
    """
    values = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    spark = docs.sparkSession
    marked = docs.withColumns({"__h": F.xxhash64(*values), "__g": F.xxhash64(F.lit(91), *values)})
    rows = _rows(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("__h").alias("r1"), F.col("__g").alias("r2")))
    with Scratch(spark) as scratch:
        known = scratch.keep(entries(rows, words, percent), "shingle-prefixes")
        sets = scratch.keep(_one_a_set(known), "sets")
        roots = linked(rows, known, sets, words, percent, scratch_path(scratch, "roots"))
        found = known.select("doc_id", "node", F.col("r1").alias("h"), F.col("r2").alias("g")).where("node IS NOT NULL OR doc_id IS NOT NULL")
        if roots is not None:
            found = found.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
        keep = written(_first_of_each(found), shared_path(spark, "kept-rows"))
    # Rows without words and without id are not among those found: they stay as they are.
    free = docs.where(F.col("doc_id").isNull()).where(~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]"))
    kept = marked.join(keep, ["__h", "__g"], "left_semi")
    same = Window.partitionBy("__h", "__g").orderBy("__h")
    return kept.withColumn("__k", F.row_number().over(same)).where("__k = 1").select(*docs.columns).unionByName(free)


def _first_of_each(found: DataFrame) -> DataFrame:
    """``__h, __g`` of the first row of each component: the least id, nulls last, then the least hashes."""
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "g")).alias("m")
    return found.groupBy("node", alone.alias("alone")).agg(first).select(F.col("m.h").alias("__h"), F.col("m.g").alias("__g"))
