import numpy as np
import pytest
from pyspark.sql import functions as F

from granulo.functions import header as H
from granulo.functions.tables import pair_rows, quad_rows
from granulo.operators import bitstream as B
from granulo.operators import spectrum
from granulo.plans import decode as D
from granulo.sources import coded_audio as S


def word(h):
    return h.to_bytes(4, "big")


def frame(h, body=b""):
    data = word(h) + body
    return data + bytes(S.header(data).length - len(data))


SILENT_MONO = 0xFFFB94C0  # MPEG-1, 48 kHz, 128 kbps, mono


@pytest.mark.parametrize(
    "h, kbps, rate, samples, side, length",
    [(0xFFFB9000, 128, 44100, 1152, 32, 417), (0xFFF390C0, 80, 22050, 576, 9, 261), (0xFFF38400, 64, 24000, 576, 17, 192), (0xFFFB94C0, 128, 48000, 1152, 17, 384)],
)
def test_headers(spark, h, kbps, rate, samples, side, length):
    p = S.header(word(h))
    assert (p.kbps, p.rate, p.samples, p.side_bytes, p.length) == (kbps, rate, samples, side, length)
    row = H.geometry(H.parsed(spark.createDataFrame([(h,)], "h long"))).first()
    assert (row["bitrate_kbps"], row["sample_rate"], row["samples"], row["side_bytes"], row["frame_bytes"]) == (kbps, rate, samples, side, length)


@pytest.mark.parametrize("h, reason", [(0xFEFB9000, "bad sync"), (0xFFFBF000, "forbidden bitrate index"), (0xFFFB9C00, "reserved sample-rate index"), (0xFFEB9000, "reserved version bits"), (0xFFF99000, "reserved layer bits")])
def test_rejects(spark, h, reason):
    assert S.header(word(h)) is None
    assert spark.createDataFrame([(h,)], "h long").select(H.reject_reason(F.col("h"))).first()[0] == reason


@pytest.mark.parametrize("garbage, n", [(0, 3), (1, 3), (65_535, 3), (65_536, 3), (65_537, 1)])
def test_resync(garbage, n):
    f = frame(SILENT_MONO)
    got = list(S.split(f + bytes(garbage) + f + f))
    assert len(got) == n and [g[0] for g in got] == [1152 * i for i in range(n)]
    if n == 3:
        assert got[1][2] == garbage


def tag(frames, version=3):
    body = b"".join(n + len(c).to_bytes(4, "big") + b"\0\0" + c for n, c in frames)
    size = bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127])
    return b"ID3" + bytes([version, 0, 0]) + size + body


def test_tags_and_streams(spark):
    picture = b"\0image/png\0\x03cover\0PNGDATA"
    lead = tag([(b"TIT2", b"\0Song"), (b"TPE1", b"\x01" + "Artist".encode("utf-16")), (b"APIC", picture)])
    tail = b"TAG" + b"Other".ljust(30, b"\0") + b"X".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + bytes(31)
    files = spark.createDataFrame([("a.mp3", lead + frame(SILENT_MONO) * 2 + tail), ("b", b"nothing"), ("c", None)], "path string, content binary")
    rows = {r["path"]: r for r in S.streams(files).collect()}
    a = rows["a.mp3"]
    assert (a["codec"], a["sample_rate"], a["channels"], a["first_at"]) == ("mp3", 48000, 1, len(lead))
    assert [tuple(t) for t in a["tags"]] == [("title", "Song"), ("artist", "Artist"), ("album", "Album"), ("date", "1999")]
    assert tuple(a["pictures"][0]) == ("image/png", 3, "cover", bytearray(b"PNGDATA"))
    assert rows["b"]["error"] and rows["c"]["error"]
    assert [(r["frame"], r["pts"]) for r in S.frames(files).orderBy("frame").collect()] == [(0, 0), (1, 1152)]
    score = files.select("path", S.probe_score(F.col("content"), F.element_at(F.split("path", "[.]"), -1)).alias("s"))
    assert {r["path"]: r["s"] for r in score.collect()}["a.mp3"] == 100


def test_truncated_tag_gives_none():
    assert S.leading_tags(b"ID3\x03\0\0\0\0\x7f\x7f" + b"xx").pairs == []


def test_data_source(spark, tmp_path):
    (tmp_path / "x.mp3").write_bytes(frame(SILENT_MONO) * 3)
    assert {"coded_audio", "audio_frames", "audio_kbps"} <= set(S.register(spark))
    (tmp_path / "notes.txt").write_text("no audio")
    assert [r["path"].split("/")[-1] for r in S.audio_files(spark, str(tmp_path)).collect()] == ["x.mp3"]
    (tmp_path / "notes.txt").unlink()
    assert spark.read.format("coded_audio").load(str(tmp_path)).count() == 3
    streams = spark.read.format("coded_audio").option("table", "streams")
    assert streams.load(str(tmp_path)).first()["codec"] == "mp3"
    lead, tail = tag([(b"TIT2", b"\0" + b"T" * 300_000)]), b"TAG" + b"Other".ljust(30, b"\0") + b"X".ljust(30, b"\0") + bytes(65)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "long.mp3").write_bytes(lead + frame(SILENT_MONO) * 900 + tail)
    whole = {r["path"].split("/")[-1]: r for r in S.streams(S.binary_files(spark, str(tmp_path))).collect()}
    ends = {r["path"].split("/")[-1]: r for r in streams.load(f"file://{tmp_path}").collect()}
    assert {k: v[1:] for k, v in ends.items()} == {k: v[1:] for k, v in whole.items()} and len(ends) == 2
    assert spark.read.format("coded_audio").option("pattern", "l*").load(str(tmp_path)).count() == 900
    assert S.frames(S.binary_files(spark, str(tmp_path / "x.mp3"))).count() == 3


def test_sql_functions(spark):
    from granulo.functions import sql

    sql.register(spark)
    words = [0xFFFB9000, 0xFFF390C0, 0xFFF38400, 0xFFFB94C0, 0xFEFB9000, 0xFFFBF000, 0xFFE384C0, 0xFFFD9000, 0xFFFF9200]
    df = spark.createDataFrame([(h,) for h in words], "h long")
    df.createOrReplaceTempView("words")
    names = {"version": "audio_version", "layer": "audio_layer", "bitrate_kbps": "audio_kbps", "sample_rate": "audio_sample_rate", "channels": "audio_channels", "samples": "audio_samples", "side_bytes": "audio_side_bytes", "frame_bytes": "audio_frame_bytes"}
    got = spark.sql("SELECT h, " + ", ".join(f"{f}(h) AS {n}" for n, f in names.items()) + " FROM words WHERE audio_reject_reason(h) IS NULL")
    want = H.geometry(H.parsed(df)).select("h", *names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7
    spark.createDataFrame([("a", frame(SILENT_MONO) * 3), ("b", None)], "path string, content binary").createOrReplaceTempView("coded")
    rows = spark.sql("SELECT path, frame, pts, kbps, length(data) AS n FROM coded, LATERAL audio_frames(content)").collect()
    assert sorted(map(tuple, rows)) == [("a", i, 1152 * i, 128, 384) for i in range(3)]


@pytest.mark.parametrize("table", sorted({r[0] for r in pair_rows()}))
def test_pair_tables_are_complete_prefix_codes(table):
    rows = [r for r in pair_rows() if r[0] == table]
    assert sum(2.0 ** -r[2] for r in rows) == 1
    words = sorted(format(r[1], f"0{r[2]}b") for r in rows)
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


def test_quad_tables_are_complete():
    for t in "AB":
        assert sum(2.0 ** -r[2] for r in quad_rows() if r[0] == t) == 1


def test_symbols():
    assert B.read_pair(B.Bits(b"\x80"), 1) == (0, 0)
    assert B.read_pair(B.Bits(bytes([0b01100000])), 1) == (-1, 0)
    assert B.read_quad(B.Bits(b"\xf0"), 1) == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        B.read_pair(B.Bits(b""), 1)
    with pytest.raises(ValueError):
        B.read_pair(B.Bits(b"\xff"), 4)


def coded(q, gain=180, table=12):
    body, pairs = B.write_values(q, table)
    g = B.Granule(body.size, pairs, gain, table_select=[table] * 3, region0_count=7, region1_count=7)
    return g, body


def one_frame(qs, h=0xFFFBE4C0):
    """A mono MPEG-1 frame of two granules."""
    main, row = B.Writer(), []
    for q in qs:
        g, body = coded(q)
        main.extend(body)
        row.append([g])
    side = B.write_side_info(B.SideInfo(0, [[0] * 4], row), True, True)
    return frame(h, side + main.bytes())


def random_lines(seed, top=7, used=300):
    rng = np.random.default_rng(seed)
    q = np.zeros(576, np.int32)
    q[:used] = rng.integers(-top, top + 1, used)
    q[used : used + 40] = rng.integers(-1, 2, 40)
    return q


def test_values_round_trip():
    for seed in range(5):
        q = random_lines(seed)
        g, body = coded(q)
        assert (B.read_values(B.Bits(body.bytes()), g, 48000, body.size) == q).all()


def test_side_info_round_trip():
    g = B.Granule(100, 20, 150, 7, 1, 2, 0, [3, 5, 0], [1, 2, 3], 8, 36, 0, 1, 1)
    info = B.SideInfo(77, [[1, 0, 1, 0], [0, 0, 0, 1]], [[g, B.Granule(9, 1, 1, 2, table_select=[1, 2, 3], region0_count=4, region1_count=5)]] * 2)
    data = B.write_side_info(info, True, False)
    assert len(data) == 32 and B.read_side_info(data, True, False) == info
    with pytest.raises(ValueError):
        B.write_side_info(B.SideInfo(0, [[0] * 4], [[B.Granule(5000)]]), False, True)


def test_scalefactor_reuse():
    first = B.Scalefactors(list(range(22)))
    out = B.read_scalefactors(B.Bits(b""), B.Granule(), [1] * 4, 1, first)
    assert out.long[:21] == list(range(21))


def test_granules_and_spectra_round_trip(spark):
    qs = [random_lines(9), random_lines(10)]
    files = spark.createDataFrame([("x", one_frame(qs) + one_frame(qs[::-1]))], "path string, content binary")
    views = D.with_reservoir(S.frames(files))
    rows = B.granules(views).orderBy("frame", "gr").collect()
    assert [r["error"] for r in rows] == [None] * 4
    assert [r["q"] for r in rows] == [q.tolist() for q in (*qs, *qs[::-1])]
    spec = {(r["frame"], r["gr"]): np.array(r["x"]) for r in D.spectra(views).collect()}
    want = np.sign(qs[0]) * np.abs(qs[0]) ** (4 / 3) * 2.0 ** ((180 - 210) / 4)
    want[384:] = 0
    assert np.allclose(spec[0, 0], D.butterflies(want, 31))


def test_silent_frames_are_silent(spark):
    files = spark.createDataFrame([("m1", frame(SILENT_MONO) * 3), ("lsf", frame(0xFFF38400) * 2), ("low", frame(0xFFE384C0) * 2)], "path string, content binary")
    rows = D.decode(S.frames(files)).collect()
    assert {p: sum(r["path"] == p for r in rows) for p in ("m1", "lsf", "low")} == {"m1": 6, "lsf": 4, "low": 2}
    assert all(not any(r["samples"]) for r in rows)
    pcm = D.pcm(S.frames(files)).collect()
    assert len(pcm) == 12 and not any(any(r["pcm"]) for r in pcm)


def test_missing_reservoir_is_silent(spark):
    side = B.write_side_info(B.SideInfo(400, [[0] * 4], [[B.Granule()], [B.Granule()]]), True, True)
    f = frame(SILENT_MONO, side)
    files = spark.createDataFrame([("x", f * 4)], "path string, content binary")
    views = D.with_reservoir(S.frames(files))
    errors = [r["error"] for r in B.granules(views).orderBy("frame", "gr").collect()]
    assert errors == ["no reservoir"] * 4 + [None] * 4  # each frame brings 363 bytes
    assert [r["granule"] for r in D.pcm(S.frames(files)).orderBy("granule").collect()] == list(range(8))  # silent ones stay


def test_a_frame_that_cannot_be_decoded_is_silent_and_nothing_is_added_over_a_gap(spark):
    good = one_frame([random_lines(9), random_lines(10)])
    g = B.Granule(800, 20, 180, table_select=[13] * 3, region0_count=7, region1_count=7)
    bad = frame(0xFFFBE4C0, B.write_side_info(B.SideInfo(0, [[0] * 4], [[g], [g]]), True, True))
    files = spark.createDataFrame([("x", good + bad + good)], "path string, content binary")
    rows = D.spectra(D.with_reservoir(S.frames(files))).orderBy("granule").collect()
    assert [bool(r["error"]) for r in rows] == [False, False, True, True, False, False] and "table 13" in rows[2]["error"]
    assert not any(rows[2]["x"]) and len(D.pcm(S.frames(files)).collect()) == 6
    holes = spark.createDataFrame([("x", 0, g, [float(g)] * 576, [100.0] * 576) for g in (0, 1, 4)], "path string, ch int, granule long, head array<double>, tail array<double>").withColumn("x", F.col("head"))
    got = {r["granule"]: r["samples"][0] for r in D.subband_samples(holes).collect()}
    assert got == {0: 0.0, 1: 101.0, 4: 4.0}


def test_look_back_over_segments(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 3)
    rows = spark.createDataFrame([("a", 0, g, g * g) for g in range(20) if g != 11], "path string, ch int, granule long, v long")
    got = {r["granule"]: (r["v_1"], r["v_2"]) for r in D.with_before(rows, ["v"], 2).collect()}
    there = lambda g: g * g if 0 <= g != 11 else None
    assert got == {g: (there(g - 1), there(g - 2)) for g in range(20) if g != 11}


def test_short_intensity_stereo():
    """Above the bound the right channel is the left one by each window's position; below it nothing changes."""
    h = S.header(word(0xFFFB9050))
    g = B.Granule(window_switching=1, block_type=2)
    sf = B.Scalefactors(short=[[b % 7, 7, 3] for b in range(13)])
    left, q = np.arange(1.0, 577), np.zeros(576, int)
    q[20] = 1  # band 1 of the short bands: the bound is 2
    right = np.where(q, 5.0, 0.0)
    bound = D.intensity_bound(q, h.rate, D.SHORT)
    assert bound == 2 and D.intensity(left, right, h, g, sf, bound) == 24
    assert (left[:24] == np.arange(1, 25)).all() and right[20] == 5
    for a, b, band, w in D.entries(h.rate, D.SHORT):
        pos, was = sf.short[band][w], np.arange(a + 1.0, b + 1)
        if band >= 2:
            kl, kr = (1.0, 0.0) if pos == 7 else D.intensity_ratio(pos)
            assert np.allclose(left[a:b], was * kl) and np.allclose(right[a:b], was * kr)


def test_low_rate_intensity_scale_is_the_compress_bit():
    h = S.header(word(0xFFF39050))
    for scale, step in ((0, 0.5), (1, 0.25)):
        g, sf = B.Granule(scalefac_compress=10 + scale), B.Scalefactors([2] * 22)
        left, right = np.ones(576), np.zeros(576)
        D.intensity(left, right, h, g, sf, 0)
        assert left[0] == 1 and right[0] == step


def test_filter_bank_reconstructs():
    from granulo.functions import filterbank as FB

    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 576))
    both = lambda v: np.concatenate([np.concatenate([np.zeros_like(v[:1]), v[:-1]]), v], -1)
    y = FB.synthesis(both(FB.analysis(both(x)))).ravel()
    x, y = x.ravel()[1000:6000], y[1481:6481]
    assert abs(x @ y / (x @ x) - 1) < 1e-3 and 10 * np.log10((x @ x) / ((x - y) @ (x - y))) > 55
    assert FB.synthesis_window()[256] == pytest.approx(1.14, abs=0.01) and FB.synthesis_window()[0] == 0
    with pytest.raises(ValueError):
        FB.synthesis_window([0.0])


def large_table(bits=8):
    """A complete code over 16 by 16 values by a rule: as long as it is for all."""
    return [f"{{t}} {x} {y} {16 * x + y:0{bits}b}" for x in range(16) for y in range(16)]


def test_large_tables_come_from_a_file(tmp_path, monkeypatch):
    from granulo.functions import tables as T

    monkeypatch.setattr(T, "PAIR_CODES", dict(T.PAIR_CODES))
    monkeypatch.setattr(B, "PAIR_CODES", T.PAIR_CODES)
    path = tmp_path / "tables.txt"
    path.write_text("# further tables\n" + "\n".join(line.replace("{t}", str(t)) for t in (13, 16, 24) for line in large_table()))
    with pytest.raises(ValueError, match="table 16"):
        B.write_values(random_lines(1), 16)
    assert T.read_pair_tables(str(path)) == [13, 16, 24]
    for table, top in ((13, 15), (16, 16), (20, 78), (23, 8191), (24, 30), (31, 8191)):
        q = random_lines(table, top)
        q[3], q[8] = -top, top
        body, pairs = B.write_values(q, table)
        g = B.Granule(body.size, pairs, table_select=[table] * 3, region0_count=7, region1_count=7)
        assert (B.read_values(B.Bits(body.bytes()), g, 44100, body.size) == q).all()
    (tmp_path / "bad.txt").write_text("15 0 0 1\n")
    with pytest.raises(ValueError):
        T.add_pair_table(15, [(1, 1), (0, 2)])


def test_broken_frame_is_an_error_row(spark):
    rows = spark.createDataFrame([("x", 0, 0, b"junk", b"")], "path string, frame long, pts long, data binary, view binary")
    assert B.granules(rows).first()["error"]


def test_transform_pair_cancels_aliasing():
    """Windowed forward and backward transforms give the signal back, 9 times for long blocks as written."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=18 * 6)
    w = D.WINDOWS[0]
    out = np.zeros(len(x))
    for b in range(5):
        lines = D._LONG.T @ (x[18 * b : 18 * b + 36] * w)
        out[18 * b : 18 * b + 36] += D._LONG @ lines * w
    assert np.allclose(out[18:-18], 9 * x[18:-18])


def test_mid_side_twice_is_identity(spark):
    rows = spark.createDataFrame([(3.0, -1.5)], "l double, r double")
    once = spectrum.mid_side(rows).select(F.col("m").alias("l"), F.col("s").alias("r"))
    r = spectrum.mid_side(once).first()
    assert (r["m"], r["s"]) == pytest.approx((3.0, -1.5))


def test_reorder_and_back(spark):
    rows = spark.range(576).select(F.lit(0).alias("frame"), F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    back = spectrum.reorder_short(spectrum.reorder_short(rows), back=True)
    assert back.where("k <> x").count() == 0 and back.count() == 576


def test_row_and_array_forms_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=576)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "frame long, k long, x double")
    got = {r["k"]: r["y"] for r in spectrum.antialias(rows).collect()}
    assert np.allclose([got[i] for i in range(576)], D.butterflies(x, 31))


def test_low_rate_intensity_factors(spark):
    from granulo.operators.decisions import low_rate_factors

    rows = spark.createDataFrame([(2, 0), (3, 0), (2, 1), (0, 1)], "p int, s int")
    got = [tuple(r) for r in rows.select(*low_rate_factors(F.col("p"), F.col("s"))).collect()]
    assert got == [(1.0, 0.5), (0.25, 1.0), (1.0, 0.25), (1.0, 1.0)]


def test_reservoir_of_many_small_frames(spark):
    from granulo.operators import framing

    main = [bytes([i % 256, i // 256, 7][: i % 4]) for i in range(500)]  # 0 to 3 bytes a frame
    df = spark.createDataFrame([("s", i, bytearray(m)) for i, m in enumerate(main)], "stream string, frame long, data binary")
    for back in (511, 40, 0):
        got = {r["frame"]: r["view"] for r in framing.reservoir(df, F.lit(back)).collect()}
        for i, m in enumerate(main):
            tail = b"".join(main[:i])
            assert got[i] == (tail[len(tail) - back :] + m if len(tail) >= back else None)
