import numpy as np
import pytest
from pyspark.sql import functions as F

from granulo.operators import bitstream as B
from granulo.plans import decode as D
from granulo.plans import encode as E
from granulo.sources import coded_audio as S
from granulo.sources import sinks

LAG = 481 + 576  # samples by which the filter bank and the transforms come late


def tone(hz, rate, n, amp):
    return amp * np.sin(2 * np.pi * hz / rate * np.arange(576 * n))


def pcm_rows(spark, channels, path="a"):
    rows = [(path, ch, g, x[576 * g : 576 * (g + 1)].astype(int).tolist()) for ch, x in enumerate(channels) for g in range(len(x) // 576)]
    return spark.createDataFrame(rows, "path string, ch int, granule long, pcm array<smallint>")


def round_trip(spark, channels, o):
    """Frames' data, and what the channels decode to, shifted back."""
    coded = E.encode(pcm_rows(spark, [np.round(x * 32767) for x in channels]), o)
    data = [bytes(r["data"]) for r in coded.orderBy("frame").collect()]
    assert all(S.header(f).length == len(f) for f in data)
    rows = D.pcm(S.frames(spark.createDataFrame([("a", b"".join(data))], "path string, content binary")), tables=o.tables).orderBy("ch", "granule").collect()
    out = [np.concatenate([r["pcm"] for r in rows if r["ch"] == c])[LAG:] / 32767 for c in range(o.channels)]
    return data, [y[: len(x) - LAG] for x, y in zip(channels, out)]


def gain_db(x, y, skip=3000):
    x, y = x[skip : len(y)], y[skip : len(x)]
    return 20 * np.log10((x @ y) / (x @ x))


def snr_db(x, y, skip=3000):
    x, y = x[skip : len(y)], y[skip : len(x)]
    return 10 * np.log10((x @ x) / ((x - y) @ (x - y)))


def code_by_rule(slope):
    """A complete prefix code over 16 by 16 values by Huffman's rule over weights that fall off with both."""
    import heapq

    heap = [(np.exp(-slope * (x + y)), i, [(x, y)]) for i, (x, y) in enumerate(np.ndindex(16, 16))]
    size = dict.fromkeys(np.ndindex(16, 16), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for v in a[2] + b[2]:
            size[v] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    words, code, last = {}, 0, 0
    for n, v in sorted((n, v) for v, n in size.items()):
        code <<= n - last
        words[v], code, last = format(code, f"0{n}b"), code + 1, n
    return words


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A file of the four large tables, by a rule: good for whoever reads with the same file."""
    path = tmp_path_factory.mktemp("tables") / "tables.txt"
    path.write_text("".join(f"{t} {x} {y} {w}\n" for t, slope in ((13, 0.3), (15, 0.2), (16, 0.25), (24, 0.15)) for (x, y), w in code_by_rule(slope).items()))
    return str(path)


@pytest.mark.parametrize("o", [E.Options(), E.Options(quality=0), E.Options(kbps=128), E.Options(22050, 1, 64), E.Options(48000, 2, 192), E.Options(model=1), E.Options(model=2, quality=2)])
def test_tones_come_back(spark, o, large):
    """Coarsely with values up to 7, and within 0.1 dB with the large tables."""
    x = tone(440, o.sample_rate, 24, 0.4) + tone(1000, o.sample_rate, 24, 0.1)
    for tables, off, least in ((None, 0.4, 15), (large, 0.1, 20)):
        data, ys = round_trip(spark, [x] * o.channels, E.Options(**{**o.__dict__, "tables": tables}))
        for y in ys:
            assert abs(gain_db(x, y)) < off and snr_db(x, y) > least
    if o.kbps:
        assert {S.header(f).kbps for f in data} == {o.kbps}


def infos(data):
    return [B.frame_parts(f) for f in data]


def test_frames_begin_in_the_reservoir(spark):
    x = tone(440, 44100, 40, 0.2)
    x[576 * 20 : 576 * 22] += np.random.default_rng(1).uniform(-0.5, 0.5, 1152)
    for o in (E.Options(kbps=64), E.Options()):
        data, (y,) = round_trip(spark, [x], o)
        back = [info.main_data_begin for _, info, _ in infos(data)]
        assert max(back) > 100 and snr_db(x, y) > 8
        alone, _ = round_trip(spark, [x], E.Options(kbps=o.kbps, reservoir=False))
        assert {info.main_data_begin for _, info, _ in infos(alone)} == {0}
    padded = [S.header(f).padding for f in round_trip(spark, [x], E.Options(kbps=128))[0]]
    assert padded == [int(o.padded(n, 128)) for o in [E.Options(kbps=128)] for n in range(len(padded))]


def test_mid_side_saves_and_is_taken(spark, large):
    n = 40
    side = tone(1000, 44100, n, 0.02)
    left, right = tone(440, 44100, n, 0.5) + side, tone(440, 44100, n, 0.5) - side
    joint, ys = round_trip(spark, [left, right], E.Options(channels=2, quality=0, tables=large))
    apart, _ = round_trip(spark, [left, right], E.Options(channels=2, quality=0, tables=large, joint=False))
    modes = [h.mode_extension & 2 for h, _, _ in infos(joint)]
    assert np.mean([m == 2 for m in modes]) >= 0.8 and not any(h.joint for h, _, _ in infos(apart))
    assert sum(map(len, joint)) <= 0.95 * sum(map(len, apart))
    for x, y in zip((left, right), ys):
        assert snr_db(x, y) > 15
    # opposed channels keep left and right
    opposed, _ = round_trip(spark, [left, -left], E.Options(channels=2))
    assert not any(h.joint and h.mode_extension & 2 for h, _, _ in infos(opposed))


@pytest.mark.parametrize("rate, high, share", [(44100, (5000, 6500, 8000, 10000, 12500, 14000), 0.5), (22050, (4000, 5000, 6000, 7000, 8000, 9000), 0.5)])
def test_intensity_saves_and_is_taken(spark, rate, high, share, large):
    n = 40
    top = sum(tone(f, rate, n, 0.05) for f in high)
    left, right = tone(220, rate, n, 0.25) + top, tone(277, rate, n, 0.25) + top
    coded, ys = round_trip(spark, [left, right], E.Options(rate, 2, quality=2, intensity=True, joint=False, tables=large))
    plain, _ = round_trip(spark, [left, right], E.Options(rate, 2, quality=2, joint=False, tables=large))
    assert np.mean([bool(h.joint and h.mode_extension & 1) for h, _, _ in infos(coded)]) >= share
    assert sum(map(len, coded)) <= 0.95 * sum(map(len, plain))
    for x, y, hz in zip((left, right), ys, (220, 277)):
        wave = tone(hz, rate, n, 1.0)[: len(y)]
        assert (y[3000:] @ wave[3000:]) / (wave[3000:] @ wave[3000:]) == pytest.approx(0.25, rel=0.1)


def burst(rate):
    x = np.zeros(576 * 60)
    t = np.arange(2205) / 44100
    at = 576 * 30 + 300
    x[at : at + 2205] = 0.7 * np.exp(-3 * t) * np.sin(2 * np.pi * 1500 * t)
    return x + 1e-3 * np.sin(2 * np.pi * 300 / rate * np.arange(len(x))), at


def test_short_blocks_hold_a_burst_back(spark, large):
    x, at = burst(44100)
    short, (y,) = round_trip(spark, [x], E.Options(kbps=96, tables=large))
    long, (z,) = round_trip(spark, [x], E.Options(kbps=96, tables=large, short=False))
    types = {g.block_type for _, info, _ in infos(short) for row in info.granules for g in row if g.window_switching}
    assert types == {1, 2, 3} and not any(g.window_switching for _, info, _ in infos(long) for row in info.granules for g in row)
    before = slice(at - 900, at - 420)  # out of a short window's reach, within a long one's
    assert ((y - x[: len(y)])[before] ** 2).sum() < 0.9 * ((z - x[: len(z)])[before] ** 2).sum()
    energy = lambda v: (v[at : at + 2205] ** 2).sum()
    assert 0.5 < energy(y) / energy(x) < 1.5


def test_mixed_blocks_decode(spark):
    rng = np.random.default_rng(4)
    x = 0.15 * np.sin(2 * np.pi * 80 / 44100 * np.arange(576 * 48))
    for at in range(576 * 12 + 200, len(x), 11025):
        m = len(x[at : at + 147])
        x[at : at + 147] += (0.8 * np.exp(-2 * np.arange(147) / 44100) * rng.uniform(-1, 1, 147))[:m]
    data, (y,) = round_trip(spark, [x], E.Options(kbps=192))
    assert any(g.mixed for _, info, _ in infos(data) for row in info.granules for g in row)
    assert 0.5 < (y[3000:] ** 2).sum() / (x[3000 : len(y)] ** 2).sum() < 2


def test_values_survive_exactly():
    o = E.Options()
    rng = np.random.default_rng(3)
    spectra = {(g, 0): rng.normal(size=576) * np.exp(-np.arange(576) / 60) for g in (0, 1)}
    f = E.frame(spectra, o)
    h, info, main = B.frame_parts(f)
    for gr, _, g, _, q in B.read_granules(h, info, main):
        assert (q == E.quantized(spectra[gr, 0], g.global_gain)).all()
        assert g.part2_3_length <= E.MOST_BITS


def test_plans_cost_what_is_written():
    rng = np.random.default_rng(8)
    for _ in range(30):
        q = np.zeros(576, int)
        used = int(rng.integers(0, 500))
        q[:used] = rng.integers(-7, 8, used) * (rng.random(used) < np.linspace(1, 0.05, used or 1)[:used])
        for switched, short in ((False, False), (True, False), (True, True)):
            plan = E.plan_values(q, 44100, switched, short)
            g = B.Granule(0, 0, 0, 0, int(switched), 2 if short else int(switched), 0, plan.tables, [0] * 3, (8 if short else 7) if switched else plan.region0, 36 if switched else plan.region1, count1_table=plan.quads)
            body, g.big_values = B.write_values(q, plan.tables, B.region_ends(g, 44100), plan.quads)
            assert body.size == plan.bits and (B.read_values(B.Bits(body.bytes()), g, 44100, body.size) == q).all()
        one = min(B.write_values(q, t)[0].size for t in E.known_tables() if E.reach(t) >= np.abs(q).max())
        assert E.plan_values(q, 44100, False, False).bits <= one
    q[0] = 9
    assert E.plan_values(q, 44100, False, False) is None


def test_better_quality_takes_more():
    spectra = {(g, 0): np.random.default_rng(g).normal(size=576) for g in (0, 1)}
    sizes = [len(E.offers({k: E.Unit(v.copy()) for k, v in spectra.items()}, E.Options(quality=q))[0].main) for q in (0, 9)]
    assert sizes[0] > sizes[1]


def test_silence_is_small_and_silent():
    f = E.frame({}, E.Options())
    h, info, main = B.frame_parts(f)
    assert h.kbps == 32 and all(not q.any() for *_, q in B.read_granules(h, info, main))


def test_intensity_choice_agrees_with_the_rows(spark):
    from granulo.operators import decisions

    rng = np.random.default_rng(6)
    left = rng.normal(size=576)
    right = np.where(np.arange(576) < 120, rng.normal(size=576), 0.5 * left)
    rows = spark.createDataFrame([(0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(left, right))], "frame long, k long, l double, r double")
    for low in (False, True):
        bound, positions = E.intensity_choice(left, right, 44100, not low)
        sums = decisions.band_sums(rows, ["frame"])
        assert decisions.intensity_bound(sums, ["frame"]).first()["bound"] == bound
        got = {r["sfb"]: r["is_pos"] for r in decisions.intensity_position(sums, low).collect()}
        assert all(positions[b] == got[b] for b in range(bound, 21))
        a, b = E.intensity_rewrite(left, right, bound, positions, 44100, not low)
        new = {r["k"]: (r["l"], r["r"]) for r in decisions.intensity_rewrite(rows, ["frame"], low).collect()}
        assert np.allclose([new[k] for k in range(576)], np.stack([a, b], 1))


@pytest.mark.parametrize("bad", [{"sample_rate": 11025}, {"channels": 3}, {"kbps": 100}, {"kbps": 320, "sample_rate": 22050}, {"quality": 10}, {"model": 3}])
def test_options(bad):
    with pytest.raises(ValueError):
        E.Options(**bad)


def test_options_by_name():
    o = E.Options.of(44100, 2, {"cbr_bitrate_kbps": "128", "intensity_stereo": "1", "short_blocks": "0", "psy_model": "1"})
    assert (o.kbps, o.intensity, o.short, o.joint, o.model) == (128, True, False, True, 1)
    assert E.Options.of(44100, 1, {"vbr_quality": "2", "cbr_bitrate_kbps": "128"}) == E.Options(quality=2, intensity=True, model=1)
    assert E.Options.of(44100, 1, {"cbr_bitrate_kbps": "0"}).kbps is None
    for bad in ({"vbr_quality": "10"}, {"speed": "1"}, {"psy_model": "3"}):
        with pytest.raises(ValueError):
            E.Options.of(44100, 1, bad)


def test_analysis_shape(spark):
    pcm = spark.createDataFrame([("a", 0, g, [int(3000 * np.sin(0.15 * (576 * g + i))) for i in range(576)]) for g in range(3)], "path string, ch int, granule long, pcm array<smallint>")
    rows = E.analyze(pcm).orderBy("granule").collect()
    assert len(rows) == 3 and len(rows[0]["samples"]) == 576
    energy = (np.reshape(rows[2]["samples"], (32, 18)) ** 2).sum(1)
    assert energy.argmax() == int(0.15 / (np.pi / 32))
    with pytest.raises(ValueError):
        E.analyze(pcm, [0.0])


def test_files_on_disk(spark, tmp_path):
    import wave

    n, rate = 30, 44100
    left, right = tone(440, rate, n, 0.3), tone(660, rate, n, 0.3)
    whole = np.round(np.stack([left, right], 1) * 32767).astype(int).ravel().tolist()
    pcm = E.granules_of(spark.createDataFrame([("x/one.wav", whole), ("y/one.wav", whole[: 576 * 10])], "path string, pcm array<int>"), 2)
    assert {r["path"]: r["n"] for r in pcm.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"x/one.wav": 60, "y/one.wav": 10}
    done = {r["path"]: r["file"] for r in sinks.write_streams(E.encode(pcm, E.Options(channels=2)), str(tmp_path / "coded")).collect()}
    assert set(done) == {"x/one.wav", "y/one.wav"} and len(set(done.values())) == 2
    back = D.pcm(S.frames(S.binary_files(spark, str(tmp_path / "coded"))))
    out = sinks.write_wav(back, str(tmp_path / "pcm")).collect()
    assert len(out) == 2 and not list(tmp_path.glob("*/_attempt*"))
    long = max(out, key=lambda r: r["bytes"])
    with wave.open(long["file"]) as f:
        assert (f.getnchannels(), f.getframerate(), f.getsampwidth()) == (2, rate, 2)
        samples = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, 2) / 32767
    assert len(samples) == 576 * n and abs(gain_db(left[: len(samples) - LAG], samples[LAG:, 0])) < 0.4


def test_registered_round_trip(spark, sf):
    """The registered queries against the plain arrays of the same signal, whole stream by whole stream."""
    from granulo.plans import audio

    signal = {r["path"]: {} for r in audio.pcm(spark, sf).collect()}
    for r in audio.pcm(spark, sf).collect():
        signal[r["path"]][r["granule"]] = np.array(r["pcm"], float)
    frames = audio.encode_frames(spark, sf).collect()
    assert {(r["path"], r["frame"]) for r in frames} == {(p, g // 2) for p, gs in signal.items() for g in gs}
    assert all(r["n_bytes"] in (417, 418) for r in frames)
    back = {(r["path"], r["granule"]): r["energy"] for r in audio.decode_pcm(spark, sf).collect()}
    for path, gs in signal.items():
        n = max(gs) + 1
        assert {g for p, g in back if p == path} == set(range(n + n % 2))
        x = np.concatenate([gs.get(g, np.zeros(576)) for g in range(n)])
        whole = [sum(x[max(0, 576 * g - LAG) : max(0, 576 * (g + 1) - LAG)] ** 2) for g in range(n)]
        assert sum(back[path, g] for g in range(n)) == pytest.approx(sum(whole), rel=0.25)
