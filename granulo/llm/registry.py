"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granulo.llm import arrow_files, crf_quality, fingerprints, near_duplicates, packing, quality_rules, sentencepieces, sharding, token_counts, toxicity
from granulo.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_token_counts": lambda s, d: token_counts.count_tokens(docs(s, d), vocabulary("byte_bpe_50k.json")),
        "op2_sharding": lambda s, d: sharding.digest(docs(s, d)),
        "op3_toxicity": lambda s, d: toxicity.digest(docs(s, d), table(s, d, "labels")),
        "op4_quality_classifier": lambda s, d: crf_quality.digest(docs(s, d), table(s, d, "labels")),
        "op5_packing": lambda s, d: packing.digest(docs(s, d), vocabulary("word_bpe_49k.json")),
        "op6_token_id_files": lambda s, d: arrow_files.digest(docs(s, d), vocabulary("byte_bpe_50k.json")),
        "op7_sentencepiece": lambda s, d: sentencepieces.encode_and_decode(docs(s, d), vocabulary("piece_bpe_32k.model"), keep=False),
        "op8_ngram_jaccard_join": lambda s, d: near_duplicates.near_duplicates(docs(s, d)),
        "op9_quality_rules": lambda s, d: quality_rules.digest(docs(s, d)),
        "op10_fingerprints": lambda s, d: fingerprints.against_neighbours(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": quality_rules.ORACLE_SQL}
