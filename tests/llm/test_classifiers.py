"""Held-out accuracy and edge cases of the two classifiers, and their parts against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulo.llm import boosting, crf_quality, toxicity

MEDIUM = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def medium(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")


@pytest.mark.parametrize("module, label, folds, out, least", [(crf_quality, "quality", 3, 1, 0.98), (toxicity, "toxic", 5, 0, 0.97)])
def test_held_out(medium, module, label, folds, out, least):
    docs, labels = medium
    got = module.digest(docs, labels).join(labels, "doc_id").toPandas()
    import zlib

    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == out for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held[label]).mean() > least
    pos, neg = held[held[label] == 1]["score"].to_numpy(), held[held[label] == 0]["score"].to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert auc > 0.93


@pytest.mark.parametrize("module", [crf_quality, toxicity])
def test_labels_of_held_out_rows_do_not_matter(spark, sf, module):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    folds, out = (3, 1) if module is crf_quality else (5, 0)
    turned = labels.select("doc_id", *[F.when(F.crc32(F.col("doc_id").cast("string")) % folds == out, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    a, b = ({r["doc_id"]: r["score"] for r in module.digest(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [crf_quality, toxicity])
def test_edges(docs, rows, empty, labels, module):
    got = module.digest(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert module.digest(empty, labels).count() == 0
    assert len(module.digest(docs, labels.where("1 = 0")).collect()) == len(rows)
    one = labels.where("quality = 1 AND toxic = 0")
    assert len(module.digest(docs, one).collect()) == len(rows)
    odd = labels.unionByName(labels).unionByName(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality", "CAST(NULL AS INT) AS toxic"))
    assert module.digest(docs, odd).count() == len(rows)


def test_lexicons_count_all_texts_whatever_the_batches(spark):
    """A word of every clean text is no entry, also where its toxic texts come in other batches."""
    rows = [(f"nasty w{i} common word", 1, i % 2) for i in range(40)] + [(f"nice common v{i} word", 0, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, y long, half long")
    a, b = ([(x.hashes.tolist(), x.weights.round(9).tolist()) for x in toxicity.learn_lexicons(d)] for d in (df.coalesce(1), df.repartition(23)))
    assert a == b
    from granulo.llm import hashing

    assert all(hashing.one("nasty") in h and hashing.one("common") not in h for h, _ in a)


def test_scores_do_not_depend_on_batches(docs, labels):
    for module in (crf_quality, toxicity):
        model = module.train(docs, labels)
        a, b = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in module.score(d, model).collect()) for d in (docs, docs.repartition(7)))
        assert a == b


TEXTS = ["", "A,", "ab a.", "you idiot!! st*pid m0ron", "x y z", "Ünder ÀÉ you", "aaa bbbb", "a", "#", "1a2 b", "i d i o t", "end a", ",b", "idi ot\n\nYOU trash", "é", " you", "tra$h!", "wort worte wörter", "a" * 40 + " you"]


def plain_features(text, lexicon):
    """What each feature says, word by word and byte by byte."""
    import re

    data = text.encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", data)]
    general, address = ({w.encode() for w in x} for x in (toxicity.GENERAL, toxicity.ADDRESS))
    learned = [lexicon.get(w, 0.0) for w in words]
    stem = [max([lexicon.get((w[:k], k), 0.0) for k in toxicity.STEMS if len(w) >= k] + [0.0]) for w in words]
    hit = [w in general or a > 0 or b > 0 for w, a, b in zip(words, learned, stem)]
    near = sum(h and any(x in address for x in words[max(0, i - 5) : i + 6]) for i, h in enumerate(hit))
    n, size = max(len(words), 1), max(len(data), 1)
    letter = lambda i: 0 <= i < len(data) and (chr(data[i]).isascii() and chr(data[i]).isalpha() or data[i] > 127)
    digit, symbol, mark = (sum(c in cs for c in data) for cs in (b"0123456789", b"#*$%&|<>@^~_=+\\", b".,;:!?'\"()-"))
    odd = b"0123456789#*$%&|<>@^~_=+\\"
    upper = sum(65 <= c <= 90 for c in data) + sum(c == 0xC3 and 0x80 <= data[i + 1] <= 0x9E for i, c in enumerate(data[:-1]))
    between = sum(letter(i - 1) and data[i] in odd and letter(i + 1) for i in range(len(data)))
    spaced = sum(letter(i) and data[i] < 128 and not letter(i - 1) and not letter(i + 1) and (letter(i - 2) or letter(i + 2)) for i in range(len(data)))
    runs = sum(i >= 2 and letter(i) and data[i] == data[i - 1] == data[i - 2] for i in range(len(data)))
    g, k, s, h = sum(w in general for w in words), sum(x > 0 for x in learned), sum(x > 0 for x in stem), sum(hit)
    top = max([max(a, b) for a, b, x in zip(learned, stem, hit) if x] + [0.0])
    return [
        g, g / n, k, sum(learned) / n, s, sum(stem) / n, h, h / n, top, near, near / n, sum(w in address for w in words) / n,
        upper / max(sum(letter(i) for i in range(len(data))), 1), (symbol + mark) / size, data.count(b"!") / size, digit / size,
        between / n, spaced / n, runs / n, np.log1p(len(words)),
    ]


def packed(texts):
    encoded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])


@pytest.mark.parametrize("segment", [1 << 20, 7])
def test_features_against_a_plain_version(sf, spark, segment, monkeypatch):
    from granulo.llm import bytestats, hashing

    monkeypatch.setattr(bytestats, "SEGMENT", segment)

    texts = TEXTS + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][: 200 if segment > 7 else 3]
    told = {b"worte": 2.5, b"trash": 3.0, (b"wort", 4): 2.75, (b"tras", 4): 2.4, (b"idiots", 6): 2.6}
    h = {hashing.one(k.decode()) if isinstance(k, bytes) else int(hashing.mix(np.array([hashing.one(k[0].decode())], np.uint64) + np.uint64(k[1]))[0]): w for k, w in told.items()}
    keys = np.array(sorted(h), np.uint64)
    lexicon = toxicity.Lexicon(keys, np.array([h[int(k)] for k in keys]))
    want = np.array([plain_features(t, told) for t in texts])
    assert toxicity.features(*packed(texts), [lexicon]) == pytest.approx(want)
    for t, row in zip(texts, want):  # alone as in a batch
        assert toxicity.features(*packed([t]), [lexicon])[0] == pytest.approx(row), t


def plain_line(line):
    import re

    data = line.encode()
    words = re.findall(rb"[^ \t-\r]+", data)
    n, solid = max(len(words), 1), max(sum(map(len, words)), 1)
    has = lambda chosen: sum(c in chosen for c in data)
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c > 127 for c in data)
    upper = sum(65 <= c <= 90 for c in data) + sum(c == 0xC3 and 0x80 <= data[i + 1] <= 0x9E for i, c in enumerate(data[:-1]))
    fold = [w.lower() for w in words]
    return [
        np.log1p(len(words)), upper / max(letters, 1), has(b"0123456789") / solid, min(has(b"#*$%&|<>@^~_=+\\") / n, 5), min(has(b"|") / n, 2), min(has(b"!") / n, 3),
        min(has(b".,;:!?'\"()-") / n, 3), min(sum(map(len, words)) / n, 30) / 10, sum(a == b for a, b in itertools.pairwise(fold)) / n, sum(len(w) <= 3 for w in words) / n,
        float(bool(words) and words[-1][-1] in b".!?:;\"')"), letters / solid, float(not words),
    ]


def test_line_features_against_a_plain_version(sf, spark):
    texts = TEXTS + ["\n", "a\n\nb.", "the the The\n| 1 | 2 |\n"] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    x, size, at = crf_quality.line_features(*packed(texts))
    lines = [line for t in texts for line in t.split("\n")]
    assert size.tolist() == [len(line.encode()) for line in lines]
    assert at.tolist() == np.cumsum([0, *(t.count("\n") + 1 for t in texts)]).tolist()
    assert x == pytest.approx(np.array([plain_line(line) for line in lines]))


def test_training_rows_are_bounded(spark, monkeypatch):
    from granulo.llm import labels as L

    docs = spark.createDataFrame([(i % 50, f"line {i}\n" * (i % 7 + 1)) for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    rows = L.training_rows(docs, known, "toxic", F.lit(True), 1000)
    assert rows.count() == 50 == rows.select("doc_id").distinct().count()
    size = F.length("text")
    assert L.within(rows, size, 10**9).count() == 50
    assert L.within(rows, size, 1000).agg(F.max(size)).first()[0] <= 10
    assert L.within(rows, F.lit(5), 600).count() < 200 // 5 * 4
    monkeypatch.setattr(crf_quality, "MAX_LINES", 100)
    assert crf_quality.train(docs, known) is not None


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    node, step = rng.normal(size=9), rng.normal(size=(2, 2))
    at = np.array([0, 4, 5, 9])
    got, pairs = crf_quality.marginals(node, step, at, True)
    expected = np.zeros((2, 2))
    for a, b in itertools.pairwise(at):
        total, good = 0.0, np.zeros(b - a)
        moves = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(node[a + i] * s for i, s in enumerate(path)) + sum(step[s, t] for s, t in itertools.pairwise(path)))
            total += w
            good += w * np.array(path)
            for s, t in itertools.pairwise(path):
                moves[s, t] += w
        assert got[a:b] == pytest.approx(good / total)
        expected += moves / total
    assert pairs == pytest.approx(expected)


def test_lines():
    texts = ["ab cd\nEF!!\n", "", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, size, at = crf_quality.line_features(data, np.cumsum([0, *map(len, texts)]))
    assert at.tolist() == [0, 3, 4, 5] and size.tolist() == [5, 4, 0, 0, 1]
    assert np.expm1(x[:, 0]).round().tolist() == [2, 1, 0, 0, 1]


def test_length_weights():
    assert crf_quality.by_length(np.array([1.0, 0.0, 0.5]), np.array([30, 10, 0]), np.array([0, 2, 3])) == pytest.approx([0.75, 0.5], abs=1e-3)


def test_isotonic_is_monotone_and_pools():
    rng = np.random.default_rng(1)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    f = boosting.fit_isotonic(m, y)
    at = np.linspace(-4, 4, 200)
    assert (np.diff(f(at)) >= 0).all() and 0 < f(at).min() and f(at).max() < 1
    assert abs(f(m).mean() - y.mean()) < 0.03
    assert boosting.fit_isotonic(np.zeros(4), np.array([0, 1, 1, 1.0]))(np.zeros(1))[0] == pytest.approx(3.5 / 5)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    t = boosting.fit_trees(x, y)
    fresh = rng.random((500, 3))
    assert ((t.margin(fresh) > 0) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.9


def test_lexicon_words_near_address_count():
    texts = ["you are an idiot", "idiot one two three four five six seven you", "nothing here"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    f = toxicity.features(data, np.cumsum([0, *map(len, texts)]), [toxicity.NO_LEXICON])
    assert f[:, 0].tolist() == [1, 1, 0] and f[:, 9].tolist() == [1, 0, 0]
