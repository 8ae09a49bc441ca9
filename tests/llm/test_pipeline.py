"""The pipeline's stages, each against a plain version on its own input."""

import pytest

import numpy as np

import corpus_pipeline
from granulo.llm import crf_quality, toxicity
from tests.llm.test_copies import brute
from tests.llm.test_tokens import crc, reference

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    for name in ("quality", "toxicity", "near_duplicates"):
        before, after = stages[name]
        assert after.columns == COLUMNS == before.columns
        assert after.exceptAll(before).count() == 0


@pytest.mark.parametrize("name, module, keep", [("quality", crf_quality, True), ("toxicity", toxicity, False)])
def test_filters(stages, labels, name, module, keep):
    """Every text scored by itself, outside Spark, with the model of the stage's input."""
    before, after = stages[name]
    model = module.train(before, labels)
    want = []
    for r in before.collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        if (model.score(data, np.array([0, len(data)]))[0] >= 0.5) == keep:
            want.append(r["doc_id"])
    assert ids(after) == sorted(want) and 0 < len(want) <= before.count()


def test_one_of_each_component_stays(stages):
    before, after = stages["near_duplicates"]
    found = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted({c for _, _, c in found})


def test_one_row_of_each_component_stays_whatever_its_id(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(50))
    near = a.replace("a119", "z")
    rows = [(1, a), (1, a), (1, near), (None, a), (2, near), (1, b), (7, b), (None, "no id one"), (None, "no id one"), (None, "no id two"), (5, ""), (5, None), (6, " "), (None, None), (None, "\t")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", k // 20) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf).collect()]
    assert sum((t or "").startswith("a0") for _, t in out) == 1
    assert sorted((i, t) for i, t in out if (t or "").startswith("b")) == [(1, b)]
    assert sorted(t for _, t in out if (t or "").startswith("no id")) == ["no id one", "no id two"]
    wordless = [i for i, t in out if not (t or "").strip()]
    assert sorted(i for i in wordless if i) == [5, 6] and wordless.count(None) == 2 and len(out) == 8


def test_everything_is_packed(stages, vocabulary):
    """Pieces of every document, in order, are the ids that the library gives its whole text."""
    before, after = stages["packing"]
    rows = before.collect()
    want = {r["doc_id"]: e.ids + [2] for r, e in zip(rows, reference(vocabulary("word_bpe_49k.json"), [r["text"] for r in rows]))}
    got = {}
    for r in after.orderBy("doc_id", "start").collect():
        at = got.setdefault(r["doc_id"], 0)
        part = want[r["doc_id"]][at : at + r["length"]]
        assert r["start"] == at and r["ids_crc32"] == crc(part) and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(x) for i, x in want.items()}


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.select("doc_id", "ids_crc32").exceptAll(stages["packing"][1].select("doc_id", "ids_crc32")).count() == 0


def test_nulls_pass_through(spark, docs, sf):
    odd = docs.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert stage(spark, odd.where("1 = 0"), sf).count() == 0
        if name != "packing":
            assert out.columns == COLUMNS and 0 < out.count() <= odd.count()
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}


CONTRACT = {
    "op2_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op5_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op6_token_id_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op9_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op10_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


def test_registered_queries_cover_every_document(spark, sf):
    import __spark_entry__

    every = __spark_entry__.queries()
    want = ids(spark.read.parquet(f"{sf}/documents.parquet"))
    names = sorted(n for n in every if n.startswith("op") and n[2].isdigit())
    assert len(names) == 10 and "pipeline" in every
    for name in names:
        got = every[name](spark, sf)
        assert CONTRACT.get(name, {"doc_id"}) <= set(got.columns)
        found = ids(got)
        assert sorted(set(found)) == want and (name in ("op1_token_counts", "op5_packing") or found == want), name
