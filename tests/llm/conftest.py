import pytest

NASTY = [
    (900_000, None), (900_001, ""), (900_002, " "), (900_003, "\n\n \t"), (900_004, "one"), (900_005, "One two\nthree  four\n\nOne two"),
    (900_006, "a" * 30_000), (900_007, "word " * 6000), (900_008, "日本語 テキスト です。 é ́x 😀 <|endoftext|> it's\x1c!b x  y  z  q"),
    (900_009, "same text in two rows " * 4), (900_010, "same text in two rows " * 4), (900_010, "same text in two rows " * 4), (None, "a row without an id is here too"), (None, None),
    (900_011, "  leading and trailing  "), (900_012, "You idiot, you st*pid m0ron! " * 5), (900_013, "x\r\ny\x0bz\x0cw"),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Some documents, then edge cases, with further columns whose names clash with what operators use."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame(NASTY, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'odd' AS source", "CAST(NULL AS LONG) AS n_chars")
    clash = {n: F.lit(7) for n in ("score", "predicted", "node", "size", "shard", "slot", "n", "m", "row", "part", "k", "p", "ids", "look", "tie", "place")}
    return real.unionByName(extra).withColumns(clash).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
