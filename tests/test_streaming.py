import pytest

from granulo.operators import blocks
from granulo.plans import views
from granulo.sources import coded_audio as S
from granulo.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_block_types_as_in_batch(spark, sf, tmp_path, rocks):
    samples = views.samples(spark, sf)
    e = blocks.subframes(samples).selectExpr("stream", "sub div 3 AS block", "sub % 3 AS i", "energy / 192.0D AS e")
    wide = e.groupBy("stream", "block").pivot("i", [0, 1, 2]).sum("e").toDF("stream", "block", "e0", "e1", "e2").fillna(0.0)
    rows = wide.orderBy("block").collect()
    schema = wide.schema
    for i in range(0, len(rows), 1):
        spark.createDataFrame(rows[i : i + 1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    got = {(r["stream"], r["block"]): r["block_type"] for r in run(spark, stateful.block_types(stream), "types", tmp_path).collect()}
    want = {(r["stream"], r["block"]): r["block_type"] for r in blocks.block_types(blocks.onsets(samples)).collect()}
    last = {}
    for s, b in want:
        last[s] = max(last.get(s, -1), b)
    assert got == {k: v for k, v in want.items() if k[1] != last[k[0]]}


def test_reservoir_as_in_batch(spark, tmp_path, rocks):
    rows = [("x", i, [0, 3, 200, 0][i % 4], bytes([i]) * 100) for i in range(8)]
    spark.createDataFrame(rows, "path string, frame long, back int, main binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, frame long, back int, main binary").parquet(str(tmp_path / "in"))
    got = {r["frame"]: r["view"] for r in run(spark, stateful.reservoir(stream), "views", tmp_path).collect()}
    data = b"".join(r[3] for r in rows)
    assert got == {i: bytearray(data[100 * i - back : 100 * i + 100]) if back <= min(100 * i, 511) else None for _, i, back, _ in rows}


def test_pcm_as_in_batch(spark, tmp_path, rocks):
    import numpy as np
    from pyspark.sql import functions as F

    from granulo.plans import decode as D
    from granulo.plans import encode as E

    rng = np.random.default_rng(3)
    rows = [(p, c, g, rng.integers(-3000, 3000, 576).tolist()) for p in "ab" for c in range(2) for g in range(8)]
    coded = E.encode(spark.createDataFrame(rows, "path string, ch int, granule long, pcm array<smallint>"), E.Options(44100, 2, 96)).select("path", "frame", "data").orderBy("frame").collect()
    schema = "path string, frame long, data binary"
    for i in range(0, len(coded), 3):
        spark.createDataFrame(coded[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {(r["path"], r["ch"], r["granule"]): r["pcm"] for r in run(spark, stateful.pcm(stream), "pcm", tmp_path).collect()}
    whole = spark.createDataFrame(coded, schema).withColumn("pts", F.lit(0).cast("long"))
    want = {(r["path"], r["ch"], r["granule"]): r["pcm"] for r in D.pcm(whole).collect()}
    assert len(want) == 32 and got == want and any(any(x) for x in want.values())


def test_file_stream(spark, tmp_path):
    from tests.test_audio import SILENT_MONO, frame

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp3").write_bytes(frame(SILENT_MONO) * 3)
    assert run(spark, S.frames(stateful.coded_files(spark, str(tmp_path / "in"))), "frames", tmp_path).count() == 3


def test_windowed_levels(spark, sf, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    q = stateful.windowed_levels(events).writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.table("levels").agg({"n": "sum"}).first()[0] == 2 * n
