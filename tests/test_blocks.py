import random

import pytest

from granulo.operators import blocks


def plain(flags):
    state, out = 0, []
    for now, soon in zip(flags, [*flags[1:], False]):
        state = 2 if state == 1 else (2 if now else 3) if state == 2 else (1 if now or soon else 0)
        out.append(blocks.STATES[state])
    return out


@pytest.mark.parametrize("segment", [1, 3, 7, 1000])
def test_block_types_do_not_depend_on_segments(spark, segment):
    rng = random.Random(4)
    streams = {s: [rng.random() < 0.2 for _ in range(25)] for s in range(3)}
    rows = spark.createDataFrame([(s, b, f) for s, fs in streams.items() for b, f in enumerate(fs)], "stream long, block long, onset boolean")
    got = {(r["stream"], r["block"]): r["block_type"] for r in blocks.block_types(rows, segment).collect()}
    assert got == {(s, b): t for s, fs in streams.items() for b, t in enumerate(plain(fs))}


@pytest.mark.parametrize("segment", [1, 4, 1000])
def test_smoothed_energy_does_not_depend_on_segments(spark, segment):
    es = [float(i * i % 17) for i in range(30)]
    rows = spark.createDataFrame([(0, i, e) for i, e in enumerate(es)], "stream long, sub long, e double")
    got = {r["sub"]: (r["before"], r["after"]) for r in blocks.smoothed(rows, segment=segment).collect()}
    avg = 0.0
    for i, e in enumerate(es):
        after = 0.25 * e + 0.75 * avg
        assert got[i] == pytest.approx((avg, after))
        avg = after


def test_known_sequence(spark):
    rows = spark.createDataFrame([(0, 0, False), (0, 1, True), (0, 2, False), (0, 3, False)], "stream long, block long, onset boolean")
    got = [r["block_type"] for r in blocks.block_types(rows).orderBy("block").collect()]
    assert got == ["start", "short", "stop", "long"]


def test_first_sound_after_silence_is_no_onset(spark):
    rows = spark.createDataFrame([(0, n, 0 if n < 576 else 100) for n in range(1152)], "stream long, n long, s long")
    assert not any(r["onset"] for r in blocks.onsets(rows).collect())


def test_empty(spark):
    none = spark.createDataFrame([], "stream long, n long, s long")
    assert blocks.block_types(blocks.onsets(none)).count() == 0
    assert blocks.mixed_flags(none).count() == 0
