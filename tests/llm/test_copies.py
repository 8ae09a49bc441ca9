"""Near duplicates, fingerprints and components against brute force, and their behaviour on hot groups."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from granulo.llm import fingerprints, hashing, near_duplicates
from granulo.llm.components import components


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """Set sizes and component ids by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    seen = set()
    for members in where.values():
        for k, a in enumerate(members):
            for b in members[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(df).collect()), key=str)


def test_against_brute_force(docs, rows):
    assert found(docs) == brute(rows)


def crowd(n, seed, drift):
    """Near copies of one text, each a few words further from the one before or from the first; and pieces shared by unlike texts."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    shared = " ".join(f"s{i}" for i in range(60))
    out, last = [], words
    for i in range(n):
        now = list(last if drift else words)
        for _ in range(rng.randint(0, 2)):
            now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
        last = now
        out.append((i, " ".join(now)))
    for i in range(n):
        mine = " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(5, 80)))
        out.append((n + i, f"{shared} {mine}" if i % 2 else f"{mine} {shared}"))
    return out


@pytest.mark.parametrize("drift", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hot_groups(spark, seed, drift):
    rows = crowd(60, seed, drift)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("listed, block", [(0, 4), (10**9, 256)])
def test_lists_and_blocks_agree(spark, monkeypatch, listed, block):
    monkeypatch.setattr(near_duplicates, "LISTED", listed)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = crowd(50, 5, True) + [(1000 + i, t) for i, t in crowd(50, 6, False)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_small_vocabulary(spark):
    """Texts over few words share frequent shingles everywhere."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))) for i in range(150)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_only_long_lists_hold_a_link(spark):
    """One shingle in five groups, whose neighbours and head do not go together: the only link is between the second and the last."""
    vocabulary = [f"v{i}" for i in range(400)]
    data = np.frombuffer("".join(vocabulary).encode(), np.uint8)
    sets = hashing.shingle_sets(data, np.r_[0, np.cumsum([len(w) for w in vocabulary])], 1)
    ordered = [w for _, w in sorted((int(s[0]) >> 7, w) for s, w in zip(sets, vocabulary))]
    early, token, late = iter(ordered[:100]), ordered[100], iter(ordered[101:])
    take = lambda words, n: [next(words) for _ in range(n)]
    common = take(late, 18)
    texts = [take(late, 9), take(early, 1) + common, take(early, 4) + take(late, 16), take(early, 4) + take(late, 16), take(early, 3) + common]
    rows = [(i, " ".join([token, *words])) for i, words in enumerate(texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")  # no task sees a shingle twice
    got = near_duplicates.near_duplicates(df, words=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {0: 10, 1: 20, 2: 21, 3: 21, 4: 22}


def test_at_the_threshold(spark):
    base = [f"w{i}" for i in range(94)]  # 90 shingles; ten shingles less at the end give 80 of 90
    rows = [(1, " ".join(base)), (2, " ".join(base[:76])), (3, " ".join(base[:75]))]  # 72/90 = 0.8 and 71/90
    assert [c for _, _, c in found(spark.createDataFrame(rows[:2], "doc_id long, text string"))] == [1, 1]
    assert [c for _, _, c in found(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string"))] == [1, 3]


def test_without_rows(empty):
    assert found(empty) == []


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 5, 1 << near_duplicates.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(near_duplicates.prefix_of(a, levels, 80), near_duplicates.prefix_of(b, levels, 80)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (3, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_hashes_are_of_words_alone():
    texts = ["A b  c\nd e f", "a B c d e f", "x", "", "a b c d e", "é É", "long" * 400_000 + " b c d e"]
    encoded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, encoded)])
    sets = hashing.shingle_sets(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    alone = hashing.shingle_sets(np.frombuffer(encoded[6], np.uint8), np.array([0, len(encoded[6])]))
    assert (alone[0] == sets[6]).all() and np.isin(sets[4], sets[0]).all()


def test_fingerprints(docs, rows):
    got = fingerprints.against_neighbours(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    at = {}
    for k, (i, _) in enumerate(order):
        at.setdefault(i, []).append(k)
    marks = defaultdict(set)
    for r in got:
        options = [order[k][1] or "" for k in at[r["doc_id"]]]
        nexts = [order[(k + 1) % len(order)][1] or "" for k in at[r["doc_id"]]] + options
        edits = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest(): t for t in options for u in nexts}
        assert r["edited_sha256"] in edits and r["n_chars"] in {len(t) for t in options}
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        marks[r["fingerprint"]].add(edits[r["edited_sha256"]])
    assert len(got) == len(rows) and all(len(t) == 1 for t in marks.values())
    long = [r for r in got if r["n_chars"] > 500 and r["doc_id"] and r["doc_id"] < 900_000]
    assert np.mean([r["near_edited"] for r in long]) > 0.55 and np.mean([r["near_next"] for r in long]) < 0.1


def test_fingerprints_of_one_and_none(spark, empty):
    one = fingerprints.against_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.against_neighbours(empty).count() == 0


def test_equal_substrings_share_phrases():
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300))
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300))
    _, s = fingerprints._sketch([text, "zz" * 5 + text, text[7:], other, text + other])
    like = fingerprints.likeness(np.repeat(s[:1], 4, 0), s[1:])
    assert like[0] > 0.85 and like[1] > 0.85 and like[2] < 0.1 and like[3] > 0.5


def test_parsing_does_not_depend_on_the_batch():
    texts = ["", "a", "aaaa", "abababab", "the same text " * 30, "é" * 50, "x" * 3000]
    roots, slots = fingerprints._sketch(texts)
    for i, t in enumerate(texts):
        r, s = fingerprints._sketch([t])
        assert r[0] == roots[i] and (s[0] == slots[i]).all()
    assert len(set(roots.tolist())) == len(texts)


def test_likeness_survives_text_form():
    _, s = fingerprints._sketch(["some text that is long enough to have phrases " * 3])
    assert (fingerprints.from_text(fingerprints.as_text(5, s[0])) == s[0]).all()


def test_long_unlike_texts_stay_unlike():
    data = np.random.default_rng(8).integers(32, 127, 24_000_000).astype(np.uint8)
    _, slots = fingerprints.fingerprints(data, np.array([0, 12_000_000, 24_000_000]))
    assert (slots[0] != fingerprints.EMPTY).all() and (slots[0] == slots[1]).sum() <= 1


def test_bitmaps_never_hide_a_link(spark):
    """Bitmaps of sets that link pass the filter, in columns as in arrays, and those of unlike sets do not."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.choice([0.8, 0.9, 0.97])], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)])
        rows += [(a, b), (a, np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)))]
    rows = [(a, b) for a, b in rows if len(a) and len(b)]
    df = spark.createDataFrame([(i, len(a), near_duplicates.bitmap_of(a).tolist(), len(b), near_duplicates.bitmap_of(b).tolist()) for i, (a, b) in enumerate(rows)], "i int, n1 int, b1 array<long>, n2 int, b2 array<long>")
    c = lambda x: df[x]
    got = {r["i"]: r["ok"] for r in df.select("i", near_duplicates.may_link(c("b1"), c("n1"), c("b2"), c("n2"), 80).alias("ok")).collect()}
    kept = 0
    for i, (a, b) in enumerate(rows):
        both = len(np.intersect1d(a, b))
        maps = near_duplicates.Bitmaps(80)
        maps.add(0, len(a), b"r", near_duplicates.bitmap_of(a).view(np.uint64))
        maps.close()
        near = len(maps.near(len(b), b"s", near_duplicates.bitmap_of(b).view(np.uint64))) == 1
        assert near == got[i]
        assert got[i] or 100 * both < 80 * (len(a) + len(b) - both)
        kept += got[i] and both < 0.3 * len(a)
    assert kept < 10


def test_two_large_groups_and_a_hub(spark):
    """Two groups of 2,000 sets that differ late, sharing prefixes, and a hub whose copies all differ: one component each, no more rows than sets."""
    rng = random.Random(11)
    base = [[f"{g}{rng.randrange(10**6)}" for _ in range(200)] for g in "abc"]
    rows = []
    for g, words in enumerate(base):
        for i in range(2000 if g < 2 else 500):
            now = list(words)
            if g < 2:
                now[199 - i % 3] = f"y{i}"
            else:
                now[rng.randrange(200)] = f"z{i}"
            rows.append((g * 10_000 + i, " ".join(now)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"] // 10_000, r["component_id"]) for r in got} == {(0, 0), (1, 10_000), (2, 20_000)}


def test_nothing_stays_in_the_shared_folder(spark, docs):
    import os

    from granulo.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if "-" in x}
    near_duplicates.near_duplicates(docs).count()
    left = {x.rsplit("-", 1)[0] for x in os.listdir(folder) if x not in before and "-" in x and os.path.isdir(f"{folder}/{x}")}
    assert left <= {"shingle-prefixes", "component-ids"}
