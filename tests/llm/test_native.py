"""Sharding and quality rules."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granulo.llm import quality_rules, sharding


def no_python(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_are_exact(docs, rows, shards):
    df = sharding.digest(docs, shards)
    assert no_python(df)
    got = df.collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(text(t)) + 8, zlib.crc32(text(t))) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert Counter((r["shard"], r["slot"]) for r in got) == Counter((s, k) for s, n in sizes.items() for k in range(n))


def test_same_seed_same_shards(docs):
    a, b = ({(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.digest(docs).collect()} for _ in range(2))
    assert a == b


def test_shards_are_mixed(spark):
    rows = sharding.shuffle_into_shards(spark.range(20_000), 10, block_rows=100)
    stats = rows.groupBy("shard").agg(F.avg("id").alias("a"), F.corr("id", "slot").alias("c")).collect()
    assert all(abs(r["a"] - 10_000) < 5 * 5774 / 2000**0.5 and abs(r["c"]) < 0.12 for r in stats)


def test_no_rows_and_clashes(empty, docs):
    assert sharding.digest(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, 3)  # it has columns shard and slot


def test_matrix_margins_and_spread(spark):
    """Margins hold exactly, and a cell's mean and variance are those of the hypergeometric law."""
    sizes = [37, 0, 5, 100, 64, 1, 9, 40]
    blocks = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block long, n long")
    cells = []
    for seed in range(60):
        found = {r["block"]: r["bounds"] for r in sharding.communication_matrix(blocks, 3, 4, seed).collect()} if seed < 12 else None
        if found is None:
            break
        counts = [[b - a for a, b in zip([0, *found[i]], found[i])] for i in range(8)]
        assert [sum(r) for r in counts] == sizes and [sum(c) for c in zip(*counts)] == [64] * 4
        assert all(x >= 0 for r in counts for x in r)
        cells += counts[3]
    assert abs(sum(cells) / len(cells) - 25) < 1e-9
    spread = sum((x - 25) ** 2 for x in cells) / len(cells)
    assert 3 < spread < 30  # 100 * 1/4 * 3/4 * 156/255 = 11.5


def test_one_draw_follows_the_law(spark):
    import math

    n = 4000
    x = sharding._hypergeometric(F.lit(40).cast("long"), F.lit(15).cast("long"), F.lit(12).cast("long"), (F.col("id") + 0.5) / n)
    got = Counter(r[0] for r in spark.range(n).select(x).collect())
    for k in range(13):
        p = math.comb(15, k) * math.comb(25, 12 - k) / math.comb(40, 12)
        assert abs(got[k] / n - p) < 2 / n


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(docs, rows):
    df = quality_rules.digest(docs)
    assert no_python(df)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect())
    want = Counter()
    for i, t in rows:
        b = brute(t)
        want[(i, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want


def test_ledger_equals_sql(spark, sf, same):
    same(quality_rules.digest(spark.read.parquet(f"{sf}/documents.parquet")), quality_rules.ORACLE_SQL)


def test_policies_and_ablations(docs):
    entries = quality_rules.ledger(docs).cache()
    kept = {p: quality_rules.apply_policy(entries, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["base"] >= kept["v1"] >= kept["v2"]
    for r in quality_rules.ablations(entries, "v2").collect():
        without = tuple(n for n in quality_rules.RULE_NAMES if n != r["rule"])
        mask = quality_rules.mask(without)
        assert r["kept_without"] == entries.where(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0).count()
    assert quality_rules.digest(docs.where("1 = 0")).count() == 0
    assert quality_rules.ablations(entries.where("1 = 0")).first()["documents"] == 0
