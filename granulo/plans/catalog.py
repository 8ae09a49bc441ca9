"""Queries over the driver's tables, one an operator or more, each with the same query as DuckDB text."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo.functions import acoustics as A
from granulo.functions import header as H
from granulo.functions.tables import ALIAS_C, BARK_EDGES, BITRATES, LSF_RADIX, PRETAB, intensity_ratio, long_bands, pair_rows, values_sql
from granulo.operators import blocks, coding, decisions, framing, psycho, spectrum
from granulo.plans import views as V


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


CATALOG: dict[str, Query] = {}


def query(sql: str, ctes: list[str] | None = None, recursive: bool = False):
    def keep(run):
        head = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n") if ctes else ""
        CATALOG[run.__name__] = Query(run, head + sql)
        return run

    return keep


def six(c, n: int = 6):
    return F.round(c, n)


c = F.col

# ---------------------------------------------------------------- headers and frames

_REASON = """CASE WHEN (h & 4292870144) <> 4292870144 THEN 'bad sync' WHEN (h >> 19) & 3 = 1 THEN 'reserved version bits'
  WHEN (h >> 17) & 3 = 0 THEN 'reserved layer bits' WHEN (h >> 10) & 3 = 3 THEN 'reserved sample-rate index'
  WHEN (h >> 12) & 15 = 15 THEN 'forbidden bitrate index' END"""
_DIM = "bitrates(version_group, layer, bitrate_index, bitrate_kbps) AS (VALUES " + values_sql([(v, y, i, k) for (v, y), ks in BITRATES.items() for i, k in enumerate(ks)]) + ")"
_PARSED = f"""ok0 AS (SELECT event_id, h, (h >> 19) & 3 AS v, 4 - ((h >> 17) & 3) AS layer, (h >> 12) & 15 AS bitrate_index, (h >> 9) & 1 AS padding,
    CASE WHEN (h >> 6) & 3 = 3 THEN 1 ELSE 2 END AS channels, ['stereo', 'joint', 'dual', 'mono'][((h >> 6) & 3) + 1] AS channel_mode,
    [44100, 48000, 32000][((h >> 10) & 3) + 1] AS base FROM hdr WHERE {_REASON} IS NULL),
ok AS (SELECT event_id, h, CASE v WHEN 3 THEN '1' WHEN 2 THEN '2' ELSE '2.5' END AS version, CASE WHEN v = 3 THEN 1 ELSE 2 END AS version_group, o.layer, o.bitrate_index,
    padding, channels, channel_mode, base // (CASE v WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END) AS sample_rate, bitrate_kbps
  FROM ok0 o JOIN bitrates b ON b.version_group = CASE WHEN v = 3 THEN 1 ELSE 2 END AND b.layer = o.layer AND b.bitrate_index = o.bitrate_index),
geo AS (SELECT *, CASE WHEN layer = 1 THEN 384 WHEN layer = 2 OR version_group = 1 THEN 1152 ELSE 576 END AS samples,
    CASE WHEN version_group = 1 THEN (CASE WHEN channels = 1 THEN 17 ELSE 32 END) ELSE (CASE WHEN channels = 1 THEN 9 ELSE 17 END) END AS side_bytes,
    CASE WHEN bitrate_kbps > 0 THEN CAST(CASE WHEN layer = 1 THEN (12 * bitrate_kbps * 1000 // sample_rate + padding) * 4
      WHEN layer = 3 AND version_group = 2 THEN 72 * bitrate_kbps * 1000 // sample_rate + padding ELSE 144 * bitrate_kbps * 1000 // sample_rate + padding END AS BIGINT) END AS frame_bytes,
    'mp' || layer AS codec FROM ok)"""
_HDR = [V.HEADERS, _DIM, _PARSED]


@query("SELECT event_id, " + ", ".join(f"((h >> {low}) & {(1 << n) - 1})::BIGINT AS {name}" for name, (low, n) in H.FIELDS.items()) + " FROM hdr", [V.HEADERS])
def hdr_fields(spark, d):
    return V.headers(spark, d).select("event_id", *[f.alias(n) for n, f in H.fields(c("h")).items()])


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM hdr GROUP BY 1", [V.HEADERS])
def hdr_reject_reason(spark, d):
    return V.headers(spark, d).groupBy(H.reject_reason(c("h")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id, version, layer::INT AS layer, channel_mode, sample_rate::INT AS sample_rate, bitrate_kbps::INT AS bitrate_kbps FROM ok", _HDR)
def hdr_bitrate_lookup(spark, d):
    return H.parsed(V.headers(spark, d)).select("event_id", "version", "layer", "channel_mode", c("sample_rate").cast("int").alias("sample_rate"), "bitrate_kbps")


@query("SELECT event_id, samples::INT AS samples, side_bytes::INT AS side_bytes, codec FROM geo", _HDR)
def hdr_geometry(spark, d):
    return H.geometry(H.parsed(V.headers(spark, d))).select("event_id", "samples", "side_bytes", "codec")


@query("SELECT event_id, frame_bytes FROM geo", _HDR)
def hdr_frame_bytes(spark, d):
    return H.geometry(H.parsed(V.headers(spark, d))).select("event_id", "frame_bytes")


@query("SELECT version, bitrate_kbps::INT AS bitrate_kbps, count(*) AS frames, sum(frame_bytes)::BIGINT AS bytes FROM geo WHERE layer = 3 GROUP BY ALL", _HDR)
def bitrate_histogram(spark, d):
    return H.geometry(H.parsed(V.headers(spark, d))).where("layer = 3").groupBy("version", "bitrate_kbps").agg(F.count("*").alias("frames"), F.sum("frame_bytes").alias("bytes"))


@query("SELECT version, channel_mode, count(*) AS frames FROM geo GROUP BY CUBE (version, channel_mode)", _HDR)
def header_cube(spark, d):
    return H.geometry(H.parsed(V.headers(spark, d))).cube("version", "channel_mode").agg(F.count("*").alias("frames"))


def _frames(spark, d):
    return H.geometry(H.parsed(V.headers(spark, d))).where("layer = 3 AND frame_bytes IS NOT NULL").withColumn("stream", F.floor(c("event_id") / 500))


_L3 = "l3 AS (SELECT *, event_id // 500 AS stream FROM geo WHERE layer = 3 AND frame_bytes IS NOT NULL)"


@query("SELECT event_id, stream, coalesce(sum(frame_bytes) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM l3", [*_HDR, _L3])
def frame_offsets(spark, d):
    return framing.offsets(_frames(spark, d)).select("event_id", "stream", "at")


@query("SELECT event_id, stream, ((row_number() OVER w - 1) * first_value(samples) OVER w)::BIGINT AS pts FROM l3 WINDOW w AS (PARTITION BY stream ORDER BY event_id)", [*_HDR, _L3])
def pts_clock(spark, d):
    return framing.clock(_frames(spark, d)).select("event_id", "stream", c("pts").cast("long").alias("pts"))


@query(
    "SELECT id, key, value FROM newer UNION ALL SELECT id, key, value FROM older o WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.id = o.id AND n.key = o.key)",
    ["newer AS (SELECT doc_id AS id, 'source' AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE doc_id % 3 <> 0)", "older AS (SELECT doc_id AS id, 'lang' AS key, upper(lang) AS value FROM documents UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels)"],
)
def tag_merge(spark, d):
    docs, labels = V.table(spark, d, "documents"), V.table(spark, d, "labels")
    tag = lambda rows, key, value: rows.select(c("doc_id").alias("id"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    newer = tag(docs, "source", c("source")).unionByName(tag(docs.where("doc_id % 3 <> 0"), "lang", c("lang")))
    older = tag(docs, "lang", F.upper("lang")).unionByName(tag(labels, "quality", c("quality")))
    return framing.merged_tags(newer, older)


@query("SELECT n::BIGINT AS n, ((n + 1) * r) // (8 * 44100) > (n * r) // (8 * 44100) AS pad FROM (SELECT event_id AS n, 144000 * 128 % 44100 AS r FROM events)")
def padding_closed_form(spark, d):
    return decisions.padded(V.table(spark, d, "events").select(c("event_id").alias("n")), 128, 44100)


@query(
    "SELECT event_id, CAST(coalesce(" + ", ".join(f"CASE WHEN greatest(144 * {k} * 1000 // rate - 4 - side, 0) >= need THEN {k} END" for k in BITRATES[(1, 3)][1:]) + ", 320) AS INT) AS kbps FROM (SELECT event_id, (event_id * 37) % 1500 AS need, [17, 32][event_id % 2 + 1] AS side, [44100, 48000, 32000][event_id % 3 + 1] AS rate FROM events)"
)
def slot_pick(spark, d):
    e = c("event_id")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (e % by).cast("int"))
    needs = V.table(spark, d, "events").select("event_id", (e * 37 % 1500).alias("need"), pick([17, 32], 2).alias("side_bytes"), pick([44100, 48000, 32000], 3).alias("sample_rate"))
    return decisions.slot(needs).select("event_id", "kbps")


def _slen_sql(ist: bool) -> str:
    out, low = "CASE", 0
    for k in range(3):
        a, b, x, y = LSF_RADIX[k + 3 * ist]
        size = a * b * x * y
        out += f" WHEN v < {low + size} THEN [(v - {low}) // {b * x * y}, (v - {low}) // {x * y} % {b}, (v - {low}) // {y} % {x}, (v - {low}) % {y}, {k}]"
        low += size
    return out + " END"


@query(
    f"SELECT sfc, ist, l[1]::INT AS s0, l[2]::INT AS s1, l[3]::INT AS s2, l[4]::INT AS s3, l[5]::INT AS part FROM (SELECT sfc, 0 AS ist, {_slen_sql(False)} AS l FROM (SELECT event_id AS sfc, event_id AS v FROM events WHERE event_id < 512) UNION ALL SELECT sfc, 1, {_slen_sql(True)} FROM (SELECT event_id AS sfc, event_id // 2 AS v FROM events WHERE event_id < 512))"
)
def lsf_slen(spark, d):
    codes = V.table(spark, d, "events").where("event_id < 512").select(c("event_id").alias("sfc"))
    both = [codes.select("sfc", F.lit(i).alias("ist"), coding.low_rate_slen(c("sfc"), bool(i)).alias("l")) for i in (0, 1)]
    return both[0].unionByName(both[1]).select("sfc", "ist", "l.s0", "l.s1", "l.s2", "l.s3", c("l.range").alias("part"))


@query(
    "SELECT frame, ch, gr, grp, CASE WHEN gr > 0 AND scfsi THEN first_value(own) OVER (PARTITION BY frame, ch, grp ORDER BY gr) ELSE own END AS sf FROM g",
    ["g AS (SELECT event_id // 16 AS frame, event_id // 8 % 2 AS ch, event_id // 4 % 2 AS gr, event_id % 4 AS grp, CAST(floor(value) AS BIGINT) % 16 AS own, (event_id // 16 + event_id) % 3 = 0 AS scfsi FROM events)"],
)
def scfsi_reuse(spark, d):
    e = c("event_id")
    div = lambda n: F.floor(e / n)
    g = V.table(spark, d, "events").select(div(16).alias("frame"), (div(8) % 2).alias("ch"), (div(4) % 2).alias("gr"), (e % 4).alias("grp"), (F.floor("value") % 16).alias("own"), ((div(16) + e) % 3 == 0).alias("scfsi"))
    return coding.reuse(g).select("frame", "ch", "gr", "grp", "sf")


@query(
    "SELECT stream, frame, CASE WHEN back <= 511 AND length(coalesce(before, '')) >= 2 * back THEN lower(right(coalesce(before, ''), CAST(2 * back AS INT)) || data) END AS view_hex FROM b",
    [
        "b0 AS (SELECT doc_id % 10 AS stream, doc_id // 10 AS frame, (doc_id * 37) % 600 AS back, hex(encode(CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') ELSE lang || ':' || source END)) AS data FROM documents)",
        "b AS (SELECT *, string_agg(right(data, 1022), '') OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b0)",
    ],
)
def reservoir_view(spark, d):
    data = F.when(c("doc_id") % 4 == 0, F.coalesce("text", F.lit(""))).otherwise(F.concat("lang", F.lit(":"), "source"))
    rows = V.table(spark, d, "documents").select((c("doc_id") % 10).alias("stream"), F.floor(c("doc_id") / 10).alias("frame"), (c("doc_id") * 37 % 600).alias("back"), F.encode(data, "UTF-8").alias("data"))
    return framing.reservoir(rows, c("back")).select("stream", "frame", F.lower(F.hex("view")).alias("view_hex"))


@query("SELECT stream, frame, gr, ch, coalesce(sum(part2_3_length) OVER (PARTITION BY stream, frame ORDER BY gr, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bit_at FROM (SELECT event_id // 400 AS stream, event_id // 4 AS frame, event_id // 2 % 2 AS gr, event_id % 2 AS ch, (event_id * 131) % 4096 AS part2_3_length FROM events)")
def granule_cursor(spark, d):
    e = c("event_id")
    g = V.table(spark, d, "events").select(F.floor(e / 400).alias("stream"), F.floor(e / 4).alias("frame"), (F.floor(e / 2) % 2).alias("gr"), (e % 2).alias("ch"), (e * 131 % 4096).alias("part2_3_length"))
    return framing.cursor(g).select("stream", "frame", "gr", "ch", "bit_at")


# ---------------------------------------------------------------- blocks


@query("SELECT stream, n // 576 AS block, count(*) AS n, sum(s)::BIGINT AS total, sum(s * s)::BIGINT AS energy FROM sig GROUP BY 1, 2", [V.SAMPLES])
def block_tumble(spark, d):
    return blocks.blocks(V.samples(spark, d))


@query("SELECT stream, n // 192 AS sub, sum(s * s)::BIGINT AS energy FROM sig GROUP BY 1, 2", [V.SAMPLES])
def subframe_energy(spark, d):
    return blocks.subframes(V.samples(spark, d))


_EMA = [
    V.SAMPLES,
    "se AS (SELECT stream, n // 192 AS sub, sum(s * s)::BIGINT / 192.0::DOUBLE AS e FROM sig GROUP BY 1, 2)",
    "ema AS (SELECT stream, sub, e, 0.0::DOUBLE AS before, 0.25 * e AS after FROM se WHERE sub = 0 UNION ALL SELECT n.stream, n.sub, n.e, p.after, 0.25 * n.e + 0.75 * p.after FROM ema p JOIN se n ON n.stream = p.stream AND n.sub = p.sub + 1)",
    "onset AS (SELECT stream, sub // 3 AS block, bool_or(e > 1e-6 AND before > 0 AND e > before * 4) AS onset FROM ema GROUP BY 1, 2)",
]
_FSM = [
    *_EMA,
    "ol AS (SELECT *, coalesce(lead(onset) OVER (PARTITION BY stream ORDER BY block), false) AS soon FROM onset)",
    "fsm AS (SELECT stream, block, CASE WHEN onset OR soon THEN 1 ELSE 0 END AS state FROM ol WHERE block = 0 UNION ALL SELECT o.stream, o.block, CASE WHEN f.state = 1 THEN 2 WHEN f.state = 2 THEN (CASE WHEN o.onset THEN 2 ELSE 3 END) ELSE (CASE WHEN o.onset OR o.soon THEN 1 ELSE 0 END) END FROM fsm f JOIN ol o ON o.stream = f.stream AND o.block = f.block + 1)",
    "types AS (SELECT stream, block, ['long', 'start', 'short', 'stop'][state + 1] AS block_type FROM fsm)",
]


@query("SELECT stream, sub, round(after / 1e6, 6) AS smoothed FROM ema", _EMA, True)
def transient_ema(spark, d):
    e = blocks.subframes(V.samples(spark, d)).select("stream", "sub", (c("energy") / 192.0).alias("e"))
    return blocks.smoothed(e).select("stream", "sub", six(c("after") / 1e6).alias("smoothed"))


@query("SELECT stream, block, onset FROM onset", _EMA, True)
def transient_flag(spark, d):
    return blocks.onsets(V.samples(spark, d))


@query("SELECT stream, block, block_type FROM types", _FSM, True)
def block_type_fsm(spark, d):
    return blocks.block_types(blocks.onsets(V.samples(spark, d)))


@query("SELECT stream, block_type, min(block) AS first_block, count(*) AS blocks FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> block_type THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY block) AS run FROM (SELECT *, lag(block_type) OVER (PARTITION BY stream ORDER BY block) AS p FROM types)) GROUP BY stream, run, block_type", _FSM, True)
def block_type_runs(spark, d):
    return blocks.type_runs(blocks.block_types(blocks.onsets(V.samples(spark, d))))


@query(
    "SELECT stream, block, (sum(lo) > 0 AND max(hi) > 6 * (CASE WHEN count(*) < 3 THEN 0 ELSE min(hi) END) AND 3 * max(lo) < 2 * sum(lo)) AS mixed FROM (SELECT stream, block, sub, sum(lp * lp) AS lo, sum(hp * hp) AS hi FROM f GROUP BY ALL) GROUP BY 1, 2",
    [V.SAMPLES, "f AS (SELECT stream, n // 576 AS block, n % 576 // 192 AS sub, 2 * s + coalesce(lag(s) OVER w, 0) + coalesce(lead(s) OVER w, 0) AS lp, 2 * s - coalesce(lag(s) OVER w, 0) - coalesce(lead(s) OVER w, 0) AS hp FROM sig WINDOW w AS (PARTITION BY stream, n // 576 ORDER BY n))"],
)
def mixed_flag(spark, d):
    return blocks.mixed_flags(V.samples(spark, d))


@query(
    "SELECT stream, frame, count(*) AS n, sum(s)::BIGINT AS total, sum(s * (i + 1))::BIGINT AS moment FROM fr GROUP BY 1, 2",
    [V.SAMPLES, "fr AS (SELECT a.stream, a.frame, s.n - (a.frame * 576 - 448) AS i, s.s FROM (SELECT DISTINCT stream, n // 576 AS frame FROM sig) a JOIN sig s ON s.stream = a.stream AND s.n >= a.frame * 576 - 448 AND s.n < a.frame * 576 + 576)"],
)
def fft_frames(spark, d):
    return blocks.overlapped(V.samples(spark, d)).groupBy("stream", "frame").agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.sum(c("s") * (c("i") + 1)).alias("moment"))


@query(f"SELECT stream, block, round(log10((re * re + im * im) / 331776.0 + 1), 6) AS level FROM (SELECT stream, n // 576 AS block, count(*) AS c, sum(s * cos(n % 576 * {2 * math.pi * 9 / 576!r})) AS re, sum(s * sin(n % 576 * {2 * math.pi * 9 / 576!r})) AS im FROM sig GROUP BY 1, 2) WHERE c = 576", [V.SAMPLES])
def goertzel(spark, d):
    return blocks.goertzel(V.samples(spark, d), 9).select("stream", "block", six(F.log10(c("power") + 1)).alias("level"))


# ---------------------------------------------------------------- spectra


@query("SELECT event_id AS n, round(0.5 * (1 - cos(2 * pi() * event_id / 1023.0)), 9) AS w FROM events WHERE event_id < 1024")
def hann(spark, d):
    return V.table(spark, d, "events").where("event_id < 1024").select(c("event_id").alias("n"), six(A.hann(c("event_id"), 1024), 9).alias("w"))


_DFT = [V.SPECTRA, "dft AS (SELECT frame, j, sum(x * w * cos(2 * pi() * k * j / 64.0)) AS re, -sum(x * w * sin(2 * pi() * k * j / 64.0)) AS im FROM (SELECT *, 0.5 * (1 - cos(2 * pi() * k / 63.0)) AS w FROM spec) CROSS JOIN (SELECT unnest(range(33)) AS j) GROUP BY frame, j)"]


@query("SELECT frame, j::INT AS j, round(re * re + im * im, 6) AS p FROM dft", _DFT)
def dft_power(spark, d):
    return spectrum.power(spectrum.dft(V.spectra(spark, d), 64)).select("frame", "j", six(c("p")).alias("p"))


@query("SELECT frame, j::INT AS j, round(re, 6) AS re, round(im, 6) AS im FROM dft", _DFT)
def complex_spectrum(spark, d):
    return spectrum.dft(V.spectra(spark, d), 64).select("frame", "j", six(c("re")).alias("re"), six(c("im")).alias("im"))


@query("SELECT frame, round(sum((re * re + im * im) * CASE WHEN j IN (0, 32) THEN 1 ELSE 2 END) / 64, 6) AS spectral, round(any_value(e), 6) AS direct FROM dft JOIN (SELECT frame, sum(x * x * pow(0.5 * (1 - cos(2 * pi() * k / 63.0)), 2)) AS e FROM spec GROUP BY 1) USING (frame) GROUP BY frame", _DFT)
def parseval(spark, d):
    rows = V.spectra(spark, d)
    p = spectrum.power(spectrum.dft(rows, 64)).groupBy("frame").agg((F.sum(c("p") * F.when(c("j").isin(0, 32), 1).otherwise(2)) / 64).alias("s"))
    e = rows.groupBy("frame").agg(F.sum(F.pow(c("x") * A.hann(c("k"), 64), F.lit(2))).alias("e"))
    return p.join(e, "frame").select("frame", six(c("s")).alias("spectral"), six(c("e")).alias("direct"))


@query("SELECT frame, j::INT AS j, round(CASE WHEN j < 2 THEN 0.5 ELSE least(greatest(sqrt(pow(re - hr, 2) + pow(im - hi, 2)) / (sqrt(re * re + im * im) + sqrt(hr * hr + hi * hi) + 1e-20), 0), 1) END, 6) AS c FROM (SELECT *, 2 * lag(re, 1) OVER w - lag(re, 2) OVER w AS hr, 2 * lag(im, 1) OVER w - lag(im, 2) OVER w AS hi FROM dft WINDOW w AS (PARTITION BY frame ORDER BY j))", _DFT)
def unpredictability(spark, d):
    return spectrum.unpredictability(spectrum.dft(V.spectra(spark, d), 64)).select("frame", "j", six(c("c")).alias("c"))


_FRAMES = ["sig0 AS (SELECT stream * 100000 + n // 576 AS frame, n % 576 + 448 AS k, s FROM sig)", "fr AS (SELECT frame, k, s::DOUBLE AS x FROM sig0 UNION ALL SELECT frame + 1, k - 576, s FROM sig0 WHERE k >= 576 AND frame + 1 IN (SELECT frame FROM sig0))"]
_FFT = [V.SAMPLES, *_FRAMES, "fft AS (SELECT frame, j, sum(x * w * cos(2 * pi() * (k * j % 1024) / 1024.0)) AS re, -sum(x * w * sin(2 * pi() * (k * j % 1024) / 1024.0)) AS im FROM (SELECT *, 0.5 * (1 - cos(2 * pi() * k / 1023.0)) AS w FROM fr) CROSS JOIN (SELECT unnest(range(513)) AS j) GROUP BY frame, j)"]


def analysis_frames(spark, d):
    """``frame, k, x``: frames of 1024 samples, each a block with the 448 samples before it."""
    rows = blocks.overlapped(V.samples(spark, d))
    return rows.select((c("stream") * 100_000 + c("frame")).alias("frame"), c("i").alias("k"), c("s").cast("double").alias("x"))


@query("SELECT frame, j::INT AS j, round(log10(re * re + im * im + 1), 6) AS level FROM fft", _FFT)
def fft_power(spark, d):
    return spectrum.power(spectrum.dft(analysis_frames(spark, d), 1024)).select("frame", "j", six(F.log10(c("p") + 1)).alias("level"))


def _mdct_sql(n: int) -> str:
    cut = f"(SELECT frame * {576 // n} + k // {n} AS frame, k % {n} AS k, x FROM lines)"
    return f"SELECT frame, j, sum(x * cos(pi() / {2 * n} * (2 * k + 1 + {n // 2}) * (2 * j + 1))) AS y FROM {cut} CROSS JOIN (SELECT unnest(range({n // 2})) AS j) GROUP BY frame, j"


@query(f"SELECT frame, j::INT AS j, round(y, 6) AS y FROM ({_mdct_sql(36)})", [V.LINES])
def mdct36(spark, d):
    return spectrum.mdct(spectrum.cut(V.lines(spark, d), 36), 36).select("frame", "j", six(c("y")).alias("y"))


@query(f"SELECT frame, j::INT AS j, round(y, 6) AS y FROM ({_mdct_sql(12)})", [V.LINES])
def mdct12(spark, d):
    return spectrum.mdct(spectrum.cut(V.lines(spark, d), 12), 12).select("frame", "j", six(c("y")).alias("y"))


@query(
    "SELECT a.frame, a.sub, a.j::INT AS i, round((a.y + coalesce(b.y, 0)) * CASE WHEN a.sub % 2 = 1 AND a.j % 2 = 1 THEN -1 ELSE 1 END, 6) AS y FROM raw a LEFT JOIN raw b ON b.frame = a.frame - 1 AND b.sub = a.sub AND b.j = a.j + 18 WHERE a.j < 18",
    [V.LINES, "raw AS (SELECT frame, k // 18 AS sub, j, sum(x * cos(pi() / 72 * (2 * j + 19) * (2 * (k % 18) + 1))) AS y FROM lines CROSS JOIN (SELECT unnest(range(36)) AS j) GROUP BY ALL)"],
)
def imdct_ola(spark, d):
    added = spectrum.overlap_add(spectrum.imdct(spectrum.cut(V.lines(spark, d), 18), 36), step=32)
    added = added.withColumns({"sub": c("frame") % 32, "frame": F.floor(c("frame") / 32)})
    return spectrum.invert_odd(added, c("sub")).select("frame", "sub", "i", six(c("y")).alias("y"))


@query("SELECT stream, block, k, round((l + r) / sqrt(2.0), 4) AS m, round((l - r) / sqrt(2.0), 4) AS s FROM lr", [V.STEREO])
def ms_rotate(spark, d):
    return spectrum.mid_side(V.stereo(spark, d)).select("stream", "block", "k", six(c("m"), 4).alias("m"), six(c("s"), 4).alias("s"))


_LOSS = ", ".join(f"[{1 / math.sqrt(1 + x * x)!r}, {x / math.sqrt(1 + x * x)!r}]" for x in ALIAS_C)


@query(
    f"SELECT a.frame, a.k, round(CASE WHEN b.k IS NULL THEN a.x WHEN a.up THEN a.x * [{_LOSS}][a.i + 1][1] + b.x * [{_LOSS}][a.i + 1][2] ELSE a.x * [{_LOSS}][a.i + 1][1] - b.x * [{_LOSS}][a.i + 1][2] END, 6) AS y FROM p a LEFT JOIN p b ON b.frame = a.frame AND b.k = 2 * a.at - 1 - a.k AND a.at > 0",
    [V.LINES, "p AS (SELECT *, CASE WHEN (k + 8) % 18 < 16 AND (k + 8) // 18 BETWEEN 1 AND 31 THEN (k + 8) // 18 * 18 ELSE 0 END AS at, (k + 8) % 18 >= 8 AS up, CASE WHEN (k + 8) % 18 >= 8 THEN (k + 8) % 18 - 8 ELSE 7 - (k + 8) % 18 END AS i FROM lines)"],
)
def antialias(spark, d):
    return spectrum.antialias(V.lines(spark, d)).select("frame", "k", six(c("y")).alias("y"))


@query("SELECT frame, t::BIGINT AS k, x FROM lines JOIN perm ON perm.f = lines.k", [V.LINES, "perm(f, t) AS (VALUES " + values_sql(spectrum.short_order(44100)) + ")"])
def reorder_short(spark, d):
    return spectrum.reorder_short(V.lines(spark, d)).select("frame", "k", "x")


@query(
    "SELECT frame, q.k, round(CASE WHEN b.sfb IS NULL THEN 0 ELSE sign(q) * pow(abs(q), 4.0 / 3) * pow(2.0, (gain - 210) / 4.0 - 0.5 * (sf + CASE WHEN preflag THEN pretab ELSE 0 END)) END, 6) AS x FROM q LEFT JOIN bands b ON q.k >= b.first AND q.k < b.stop",
    [V.LINES, "bands(first, stop, sfb, pretab) AS (VALUES " + values_sql([(a, b, s, PRETAB[s]) for s, a, b in long_bands(44100)[:21]]) + ")", "q AS (SELECT frame, k, CAST(floor(x * 100) AS BIGINT) % 32 - 16 AS q, 205 AS gain, frame % 16 AS sf, frame % 2 = 0 AS preflag FROM lines)"],
)
def requantize(spark, d):
    q = (F.floor(c("x") * 100) % 32 - 16).alias("q")
    rows = V.lines(spark, d).select("frame", "k", q, F.lit(205).alias("gain"), F.lit(0.5).alias("scale_shift"), (c("frame") % 2 == 0).alias("preflag"), (c("frame") % 16).alias("sf"))
    return spectrum.requantize(rows).select("frame", "k", six(c("x")).alias("x"))


@query("SELECT event_id, CAST(trunc(least(greatest(value / 250.0 - 1, -1), 1) * 32767.0) AS SMALLINT) AS pcm FROM events")
def pcm_convert(spark, d):
    return V.table(spark, d, "events").select("event_id", spectrum.to_pcm(c("value") / 250.0 - 1).alias("pcm"))


# ---------------------------------------------------------------- masking

_BANDS = "bands(sfb, first, stop) AS (VALUES " + values_sql(long_bands(44100)) + ")"
_BE = "be AS (SELECT frame, sfb, any_value(stop - first) AS width, sum(x * x) AS energy FROM lines JOIN bands ON k >= first AND k < stop GROUP BY 1, 2)"
_RATIO = 10 ** ((30 - 4 / 9 * 24) / 10)
_BT = f"bt AS (SELECT *, greatest(energy / {_RATIO!r}, max(energy) OVER (PARTITION BY frame) * 1e-7 + 1e-12) AS threshold FROM be)"
_PSY = [V.LINES, _BANDS, _BE, _BT]


def _bands(spark, d):
    return psycho.band_threshold(psycho.band_energy(V.lines(spark, d)), _RATIO)


@query("SELECT frame, sfb::INT AS sfb, width::BIGINT AS width, round(energy, 6) AS energy FROM be", _PSY[:3])
def band_energy(spark, d):
    return psycho.band_energy(V.lines(spark, d)).select("frame", "sfb", "width", six(c("energy")).alias("energy"))


@query("SELECT frame, sfb::INT AS sfb, round(threshold, 9) AS threshold FROM bt", _PSY)
def band_threshold(spark, d):
    return _bands(spark, d).select("frame", "sfb", six(c("threshold"), 9).alias("threshold"))


@query("SELECT frame, round(max(CASE WHEN energy > 1e-20 THEN 10 * log10(greatest(0.01 * 0.01 / 12 * width / threshold, 1e-30)) END), 6) AS nmr_db FROM bt GROUP BY 1", _PSY)
def nmr_worst(spark, d):
    return psycho.worst_nmr(_bands(spark, d), 0.01).select("frame", six(c("nmr_db")).alias("nmr_db"))


@query("SELECT frame, sfb::INT AS sfb, round(10 * log10(energy / threshold), 6) AS smr_db FROM bt WHERE energy > 1e-20", _PSY)
def smr(spark, d):
    return psycho.smr(_bands(spark, d)).select("frame", "sfb", six(c("smr_db")).alias("smr_db"))


@query("SELECT frame, CAST(coalesce(max(CASE WHEN nmr <= 1e-9 THEN gain END), 60) AS INT) AS gain FROM (SELECT frame, gain, max(10 * log10(greatest(pow(2.0, (gain - 210) / 2.0) / 12 * width / threshold, 1e-30))) AS nmr FROM bt CROSS JOIN (SELECT unnest(range(60, 256)) AS gain) WHERE energy > 1e-20 GROUP BY 1, 2) GROUP BY 1", _PSY)
def gain_search(spark, d):
    return psycho.largest_gain(_bands(spark, d))


@query("SELECT event_id AS quality, round(pow(10.0, (30 - least(event_id, 9) / 9.0 * 24) / 10), 6) AS ratio, round(pow(10.0, (30 - least(event_id, 9) / 9.0 * 30) / 10), 6) AS gain, round(pow(2.0, (event_id * 20 - 210) / 4.0), 9) AS step FROM events WHERE event_id < 12")
def quality_knob(spark, d):
    q = c("event_id")
    return V.table(spark, d, "events").where("event_id < 12").select(q.alias("quality"), six(A.mask_ratio(q)).alias("ratio"), six(A.model_gain(q)).alias("gain"), six(A.gain_step(q * 20), 9).alias("step"))


_EDGES = "[" + ", ".join(f"{float(e)}" for e in BARK_EDGES) + "]"
_PART = f"least(len(list_filter({_EDGES}, lambda e: e < (k + 0.5) * 44100.0 / 1152.0)), 23)"


@query("SELECT event_id AS k, round(13 * atan(0.00076 * event_id * 10) + 3.5 * atan(pow(event_id * 10 / 7500.0, 2)), 6) AS bark FROM events WHERE event_id < 2205")
def bark_axis(spark, d):
    return V.table(spark, d, "events").where("event_id < 2205").select(c("event_id").alias("k"), six(A.bark(c("event_id") * 10)).alias("bark"))


@query(f"SELECT k, {_PART}::INT AS p FROM (SELECT event_id AS k FROM events WHERE event_id < 576)")
def bark_partition(spark, d):
    return psycho.line_partitions(V.table(spark, d, "events").where("event_id < 576").select(c("event_id").alias("k")))


_SPREAD = ["z AS (SELECT p, 13 * atan(0.00076 * hz) + 3.5 * atan(pow(hz / 7500.0, 2)) AS z FROM (VALUES " + values_sql(psycho.centres(44100)) + ") t(p, hz))", "sp AS (SELECT a.p AS maskee, b.p AS masker, 15.81 + 7.5 * (a.z - b.z + 0.474) - 17.5 * sqrt(1 + pow(a.z - b.z + 0.474, 2)) AS db FROM z a CROSS JOIN z b)"]


@query("SELECT maskee::INT AS maskee, masker::INT AS masker, round(db, 6) AS db FROM sp", _SPREAD)
def spread_matrix(spark, d):
    return psycho.spread_matrix(spark).select("maskee", "masker", six(c("db")).alias("db"))


_STATS = [
    V.LINES,
    f"pe AS (SELECT frame, k, {_PART} AS p, x * x AS e, lag(x * x) OVER w AS lo, lead(x * x) OVER w AS hi FROM lines WINDOW w AS (PARTITION BY frame ORDER BY k))",
    "ps AS (SELECT frame, p, sum(e) AS energy, sum(ln(greatest(e, 1e-20))) AS ln_sum, count(*) AS n, coalesce(max(CASE WHEN e > coalesce(lo, 0) AND e > coalesce(hi, 0) THEN e END), 0) AS peak FROM pe GROUP BY 1, 2)",
    "pt AS (SELECT *, CASE WHEN energy > 1e-20 THEN least(greatest(-10 * log10(least(greatest(exp(ln_sum / n) / greatest(energy / n, 1e-20), 1e-20), 1)) / 60, 0), 1) ELSE 0 END AS t_sfm, CASE WHEN energy > 1e-20 THEN least(greatest(10 * log10(greatest(peak / (energy / n), 1)) / 20, 0), 1) ELSE 0 END AS t_peak FROM ps)",
]


def _tones(spark, d):
    return psycho.tonality(psycho.partition_stats(psycho.line_partitions(V.lines(spark, d))))


@query("SELECT frame, p::INT AS p, n, round(peak, 6) AS peak, round(energy, 6) AS energy FROM ps", _STATS)
def local_peaks(spark, d):
    return _tones(spark, d).select("frame", "p", "n", six(c("peak")).alias("peak"), six(c("energy")).alias("energy"))


@query("SELECT frame, p::INT AS p, round(t_sfm, 6) AS t_sfm, round(t_peak, 6) AS t_peak, round(greatest(t_sfm, t_peak), 6) AS tonality FROM pt", _STATS)
def tonality(spark, d):
    return _tones(spark, d).select("frame", "p", *[six(c(t)).alias(t) for t in ("t_sfm", "t_peak", "tonality")])


@query(
    "SELECT frame, s.p::INT AS p, round(log10(spread * pow(10.0, -(14.5 * t + 5.5 * (1 - t)) / 10) / 4 + 1e-12), 6) AS level FROM (SELECT frame, maskee AS p, sum(CASE WHEN e_db + db >= -150 THEN pow(10.0, (e_db + db) / 10) ELSE 0 END) AS spread FROM (SELECT frame, p, CASE WHEN energy > 1e-30 THEN 10 * log10(energy) ELSE -200 END AS e_db FROM pt) JOIN sp ON masker = p GROUP BY 1, 2) s LEFT JOIN (SELECT frame AS f, p, greatest(t_sfm, t_peak) AS t0 FROM pt) q ON q.f = s.frame AND q.p = s.p CROSS JOIN LATERAL (SELECT coalesce(t0, 0) AS t)",
    [*_STATS, *_SPREAD],
)
def spread_threshold(spark, d):
    return psycho.spread_threshold(_tones(spark, d), 4.0).select("frame", "p", six(F.log10(c("threshold") + 1e-12)).alias("level"))


@query(f"SELECT frame, sfb::INT AS sfb, p::INT AS p FROM (SELECT frame, sfb, {_PART} AS p, count(*) AS c FROM lines JOIN bands ON k >= first AND k < stop GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY frame, sfb ORDER BY c DESC, p DESC) = 1", [V.LINES, _BANDS])
def dominant_partition(spark, d):
    return psycho.dominant_partition(V.lines(spark, d))


_GAIN = 4.0
_BIN = f"least(len(list_filter({_EDGES}, lambda e: e < j * 44100 / 1024.0)), 23)"


def _pstats(name: str, rows: str) -> list[str]:
    """CTEs ``name`` (frame, p, energy, t_sfm, t0) of rows (frame, k, p, e)."""
    return [
        f"{name}_e AS (SELECT *, lag(e) OVER w AS lo, lead(e) OVER w AS hi FROM ({rows}) WINDOW w AS (PARTITION BY frame ORDER BY k))",
        f"{name}_s AS (SELECT frame, p, sum(e) AS energy, sum(ln(greatest(e, 1e-20))) AS ln_sum, count(*) AS n, coalesce(max(CASE WHEN e > coalesce(lo, 0) AND e > coalesce(hi, 0) THEN e END), 0) AS peak FROM {name}_e GROUP BY 1, 2)",
        f"{name} AS (SELECT *, greatest(t_sfm, t_peak) AS t0 FROM (SELECT *, CASE WHEN energy > 1e-20 THEN least(greatest(-10 * log10(least(greatest(exp(ln_sum / n) / greatest(energy / n, 1e-20), 1e-20), 1)) / 60, 0), 1) ELSE 0 END AS t_sfm, CASE WHEN energy > 1e-20 THEN least(greatest(10 * log10(greatest(peak / (energy / n), 1)) / 20, 0), 1) ELSE 0 END AS t_peak FROM {name}_s))",
    ]


def _spread_sql(name: str, tones: str, silent: float = 0.0) -> str:
    """CTE ``name`` (frame, p, threshold) of ``tones`` (frame, p, energy, t0)."""
    spread = f"SELECT frame, maskee AS p, sum(CASE WHEN e_db + db >= -150 THEN pow(10.0, (e_db + db) / 10) ELSE 0 END) AS spread FROM (SELECT frame, p, CASE WHEN energy > 1e-30 THEN 10 * log10(energy) ELSE -200 END AS e_db FROM {tones}) JOIN sp ON masker = p GROUP BY 1, 2"
    return f"{name} AS (SELECT s.frame, s.p, spread * pow(10.0, -(14.5 * coalesce(t0, {silent}) + 5.5 * (1 - coalesce(t0, {silent}))) / 10) / {_GAIN} AS threshold FROM ({spread}) s LEFT JOIN {tones} q ON q.frame = s.frame AND q.p = s.p)"


def _weights_sql(name: str, weights: list) -> str:
    return f"{name}(p, sfb, weight) AS (VALUES " + values_sql(weights) + ")"


def _mask_sql(entries: str) -> str:
    """Final rows of ``entries`` (frame, entry, width, energy, threshold)."""
    return f"SELECT frame, entry::INT AS entry, width::BIGINT AS width, round(log10(energy + 1e-12), 6) AS level, round(log10(greatest(threshold, max(energy) OVER (PARTITION BY frame) * 1e-7 + 1e-12)), 6) AS mask FROM ({entries})"


def _mask(rows):
    return rows.select("frame", c("entry").cast("int").alias("entry"), c("width").cast("long").alias("width"), six(F.log10(c("energy") + 1e-12)).alias("level"), six(F.log10("threshold")).alias("mask"))


_BW = "(SELECT frame, sfb, stop - first AS width, sum(x * x) AS energy FROM slines JOIN bands ON k >= first AND k < stop GROUP BY ALL)"
_LONG_ENTRIES = f"SELECT b.frame, b.sfb AS entry, width, energy, threshold FROM {_BW} b JOIN (SELECT frame, sfb, sum(threshold * weight) AS threshold FROM th JOIN bw USING (p) GROUP BY 1, 2) t ON t.frame = b.frame AND t.sfb = b.sfb"
_SIGNAL = [V.SAMPLES, V.SIGNAL_LINES, _BANDS, _weights_sql("bw", psycho.band_weights(long_bands(44100), 44100, 576)), *_SPREAD]
_SLINES = f"SELECT frame, k, {_PART} AS p, x * x AS e FROM slines"
_BINS = [*_FFT[1:], f"bins AS (SELECT frame, j AS k, {_BIN} AS p, re * re + im * im AS e FROM fft)"]


def _power(spark, d):
    return spectrum.power(spectrum.dft(analysis_frames(spark, d), 1024))


@query(_mask_sql(_LONG_ENTRIES), [*_SIGNAL, *_pstats("tn", _SLINES), _spread_sql("th", "tn")])
def psy1_long(spark, d):
    return _mask(psycho.mask_long(V.signal_lines(spark, d), _GAIN).withColumnRenamed("sfb", "entry"))


@query(_mask_sql(_LONG_ENTRIES), [*_SIGNAL, *_BINS, *_pstats("tl", _SLINES), *_pstats("tb", "SELECT * FROM bins"), "tn AS (SELECT tl.frame, tl.p, tl.energy, greatest(tl.t0, coalesce(tb.t0, 0)) AS t0 FROM tl LEFT JOIN tb USING (frame, p))", _spread_sql("th", "tn")])
def psy1_fft(spark, d):
    return _mask(psycho.mask_with_bins(V.signal_lines(spark, d), _power(spark, d), _GAIN).withColumnRenamed("sfb", "entry"))


def _short_sql(mixed: bool) -> list[str]:
    """CTEs up to ``sh`` (frame, sfb, w, width, energy, threshold) of the short bands."""
    bands = psycho.short_bands(44100)[3 if mixed else 0 :]
    part = _PART.replace("1152.0", "384.0")
    low = f" UNION ALL SELECT frame, k, 0.0 FROM (SELECT DISTINCT frame FROM wr) CROSS JOIN (SELECT unnest(range({bands[0][1]})) AS k)" if mixed else ""
    return [
        "places(k, w, f, sfb) AS (VALUES " + values_sql(psycho.window_places(44100, mixed)) + ")",
        "wr AS (SELECT frame * 3 + w AS frame, f AS k, x, sfb FROM slines JOIN places USING (k))",
        *_pstats("ts", f"SELECT frame, k, {part} AS p, x * x AS e FROM (SELECT frame, k, x FROM wr{low})"),
        _spread_sql("ths", "ts"),
        _weights_sql("bws", psycho.band_weights(bands, 44100, 192)),
        "wide(sfb, width) AS (VALUES " + values_sql([(b, e - a) for b, a, e in bands]) + ")",
        "sh AS (SELECT b.frame // 3 AS frame, b.sfb, b.frame % 3 AS w, width, energy, threshold FROM (SELECT frame, sfb, sum(x * x) AS energy FROM wr GROUP BY 1, 2) b JOIN (SELECT frame, sfb, sum(threshold * weight) AS threshold FROM ths JOIN bws USING (p) GROUP BY 1, 2) t ON t.frame = b.frame AND t.sfb = b.sfb JOIN wide ON wide.sfb = b.sfb)",
    ]


@query(_mask_sql("SELECT frame, sfb * 3 + w AS entry, width, energy, threshold FROM sh"), [V.SAMPLES, V.SIGNAL_LINES, *_SPREAD, *_short_sql(False)])
def psy1_short(spark, d):
    return _mask(psycho.mask_short(V.signal_lines(spark, d), _GAIN))


@query(
    _mask_sql(f"SELECT * FROM ({_LONG_ENTRIES}) WHERE entry < 8 UNION ALL SELECT frame, 8 + (sfb - 3) * 3 + w, width, energy, threshold FROM sh"),
    [*_SIGNAL, *_pstats("tn", _SLINES), _spread_sql("th", "tn"), *_short_sql(True)],
)
def psy1_mixed(spark, d):
    return _mask(psycho.mask_mixed(V.signal_lines(spark, d), _GAIN))


@query(
    _mask_sql(_LONG_ENTRIES),
    [
        *_SIGNAL,
        *_FFT[1:],
        "un AS (SELECT frame, j, CASE WHEN j < 2 THEN 0.5 ELSE least(greatest(sqrt(pow(re - hr, 2) + pow(im - hi, 2)) / (sqrt(re * re + im * im) + sqrt(hr * hr + hi * hi) + 1e-20), 0), 1) END AS c FROM (SELECT *, 2 * lag(re, 1) OVER w - lag(re, 2) OVER w AS hr, 2 * lag(im, 1) OVER w - lag(im, 2) OVER w AS hi FROM fft WINDOW w AS (PARTITION BY frame ORDER BY j)))",
        f"tc AS (SELECT frame, p, CASE WHEN count(*) < 2 THEN 0.5 ELSE 1 - avg(c) END AS t0 FROM (SELECT frame, c, {_BIN} AS p FROM un) GROUP BY 1, 2)",
        f"tn AS (SELECT e.frame, e.p, energy, t0 FROM (SELECT frame, p, sum(e) AS energy FROM ({_SLINES}) GROUP BY 1, 2) e LEFT JOIN tc ON tc.frame = e.frame AND tc.p = e.p)",
        _spread_sql("th", "tn", 0.5),
    ],
)
def psy2_mask(spark, d):
    return _mask(psycho.mask_by_prediction(V.signal_lines(spark, d), spectrum.unpredictability(spectrum.dft(analysis_frames(spark, d), 1024)), _GAIN).withColumnRenamed("sfb", "entry"))


@query(
    f"SELECT frame, b.sfb::INT AS sfb, round(log10(threshold * pow(10.0, -0.3 * coalesce(t_sfm, 0))), 6) AS mask FROM (SELECT frame, sfb, greatest(energy / {_RATIO!r}, max(energy) OVER (PARTITION BY frame) * 1e-7 + 1e-12) AS threshold FROM {_BW}) b JOIN bob ON bob.sfb = b.sfb LEFT JOIN (SELECT frame AS f, p AS q, t_sfm FROM tb) ON f = frame AND q = bob.p",
    [V.SAMPLES, V.SIGNAL_LINES, _BANDS, *_BINS, *_pstats("tb", "SELECT * FROM bins"), "bob(sfb, p) AS (VALUES " + values_sql(psycho.bin_of_band()) + ")"],
)
def mask_lift(spark, d):
    bands = psycho.band_threshold(psycho.band_energy(V.signal_lines(spark, d)), _RATIO)
    return psycho.lifted(bands, _power(spark, d)).select("frame", "sfb", six(F.log10("threshold")).alias("mask"))


# ---------------------------------------------------------------- decisions and coding


@query("SELECT stream, block, sum((l + r) * (l + r)) > 0 AND sum((l - r) * (l - r)) / sum((l + r) * (l + r)) < 0.30 AS correlated, sum((l - l2) * (l - l2)) > 0 AND sum((l + l2) * (l + l2)) / sum((l - l2) * (l - l2)) < 0.30 AS opposed FROM (SELECT *, l AS l2 FROM lr) GROUP BY 1, 2", [V.STEREO])
def ms_decision(spark, d):
    rows = V.stereo(spark, d)
    near = decisions.mid_side_choice(rows, ["stream", "block"]).withColumnRenamed("use_ms", "correlated")
    far = decisions.mid_side_choice(rows.withColumn("r", -c("l")), ["stream", "block"]).withColumnRenamed("use_ms", "opposed")
    return near.join(far, ["stream", "block"])


_IS = [V.STEREO, _BANDS, "ib AS (SELECT stream, block, sfb, sum(l::DOUBLE * l) AS el, sum(x * x) AS er, sum(l * x) AS c FROM (SELECT *, CASE WHEN k % 7 = 0 THEN -r::DOUBLE * (stream % 5) ELSE r::DOUBLE END AS x FROM lr) JOIN bands ON k >= first AND k < stop AND sfb < 21 GROUP BY ALL)"]


def _intensity(spark, d):
    x = F.when(c("k") % 7 == 0, -c("r") * (c("stream") % 5)).otherwise(c("r"))
    return decisions.band_sums(V.stereo(spark, d).withColumn("r", x.cast("double")), ["stream", "block"])


@query(
    "SELECT stream, block, coalesce(min(CASE WHEN run THEN sfb END), 21)::INT AS bound FROM (SELECT *, bool_and(good) OVER (PARTITION BY stream, block ORDER BY sfb DESC ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, (el + er < greatest(max(el + er) OVER (PARTITION BY stream, block), 1e-12) * 1e-4) OR abs(el - er) >= 0.85 * (el + er) OR (sqrt(el * er) > 1e-12 AND abs(c) >= 0.85 * sqrt(el * er)) AS good FROM ib) WHERE sfb >= 7) GROUP BY 1, 2",
    _IS,
)
def is_walk(spark, d):
    return decisions.intensity_bound(_intensity(spark, d), ["stream", "block"])


@query(
    "SELECT stream, block, sfb::INT AS sfb, CAST(CASE WHEN el + er <= 0 THEN 7 ELSE pos END AS INT) AS is_pos FROM ib CROSS JOIN LATERAL (SELECT arg_min(p, abs(share - er / (el + er))) AS pos FROM (VALUES " + values_sql([(p, b * b / (a * a + b * b)) for p in range(7) for a, b in [intensity_ratio(p)]]) + ") v(p, share))",
    _IS,
)
def is_position(spark, d):
    return decisions.intensity_position(_intensity(spark, d)).select("stream", "block", "sfb", "is_pos")


_LOW = values_sql([(p, b * b / (a * a + b * b)) for p, (a, b) in enumerate(decisions.low_rate_ratios())])
_HIGH = values_sql([(p, b * b / (a * a + b * b)) for p in range(7) for a, b in [intensity_ratio(p)]])


@query(
    f"SELECT stream, block, sfb::INT AS sfb, CAST(CASE WHEN el + er <= 0 THEN 0 ELSE pos END AS INT) AS is_pos FROM ib CROSS JOIN LATERAL (SELECT arg_min(p, abs(share - er / (el + er))) AS pos FROM (VALUES {_LOW}) v(p, share))",
    _IS,
)
def is_position_lsf(spark, d):
    return decisions.intensity_position(_intensity(spark, d), True).select("stream", "block", "sfb", "is_pos")


def _rewrite_sql(low: bool) -> str:
    new = "CASE WHEN pos = 0 THEN (l + x) / 2 WHEN pos % 2 = 1 THEN x ELSE l END" if low else "CASE WHEN pos = 7 THEN l ELSE CASE WHEN l < 0 OR (l = 0 AND x < 0) THEN -1 ELSE 1 END * sqrt(l * l + x * x) END"
    return f"SELECT stream, block, k, round(CASE WHEN pos IS NULL THEN l ELSE {new} END, 3) AS l, round(CASE WHEN pos IS NULL THEN x ELSE 0 END, 3) AS r FROM lx LEFT JOIN bands ON k >= first AND k < stop AND sfb < 21 LEFT JOIN cd USING (stream, block, sfb)"


def _rewrite_ctes(low: bool) -> list[str]:
    return [
        *_IS,
        "lx AS (SELECT stream, block, k, l::DOUBLE AS l, CASE WHEN k % 7 = 0 THEN -r::DOUBLE * (stream % 5) ELSE r::DOUBLE END AS x FROM lr)",
        "sl AS (SELECT *, el + er < greatest(max(el + er) OVER (PARTITION BY stream, block), 1e-12) * 1e-4 AS silent FROM ib)",
        "bd AS (SELECT stream, block, coalesce(min(CASE WHEN run THEN sfb END), 21) AS bound FROM (SELECT *, bool_and(silent OR abs(el - er) >= 0.85 * (el + er) OR (sqrt(el * er) > 1e-12 AND abs(c) >= 0.85 * sqrt(el * er))) OVER (PARTITION BY stream, block ORDER BY sfb DESC ROWS UNBOUNDED PRECEDING) AS run FROM sl WHERE sfb >= 7) GROUP BY 1, 2)",
        f"cd AS (SELECT stream, block, sfb, CASE WHEN silent OR el + er <= 0 THEN {0 if low else 7} ELSE p0 END AS pos FROM sl JOIN bd USING (stream, block) CROSS JOIN LATERAL (SELECT arg_min(p, abs(share - er / (el + er))) AS p0 FROM (VALUES {_LOW if low else _HIGH}) v(p, share)) WHERE sfb >= bound)",
    ]


@query(_rewrite_sql(False), _rewrite_ctes(False))
def is_rewrite(spark, d):
    return _rewritten(spark, d, False)


@query(_rewrite_sql(True), _rewrite_ctes(True))
def is_rewrite_lsf(spark, d):
    return _rewritten(spark, d, True)


def _rewritten(spark, d, low: bool):
    x = F.when(c("k") % 7 == 0, -c("r") * (c("stream") % 5)).otherwise(c("r"))
    out = decisions.intensity_rewrite(V.stereo(spark, d).withColumn("r", x.cast("double")), ["stream", "block"], low)
    return out.select("stream", "block", "k", six(c("l"), 3).alias("l"), six(c("r"), 3).alias("r"))


@query("SELECT frame, w::INT AS window, count(*) AS n, round(sum(x * x), 6) AS energy, round(sum(f * x), 6) AS moment FROM lines JOIN pl USING (k) GROUP BY 1, 2", [V.LINES, "pl(k, w, f, sfb) AS (VALUES " + values_sql(psycho.window_places(44100)) + ")"])
def short_windows(spark, d):
    return _windows(spark, d, False)


@query("SELECT frame, w::INT AS window, count(*) AS n, round(sum(x * x), 6) AS energy, round(sum(f * x), 6) AS moment FROM lines JOIN pl USING (k) GROUP BY 1, 2", [V.LINES, "pl(k, w, f, sfb) AS (VALUES " + values_sql(psycho.window_places(44100, True)) + ")"])
def mixed_windows(spark, d):
    return _windows(spark, d, True)


def _windows(spark, d, mixed: bool):
    rows = psycho.windows(V.lines(spark, d), mixed=mixed)
    return rows.groupBy("frame", "window").agg(F.count("*").alias("n"), six(F.sum(c("x") * c("x"))).alias("energy"), six(F.sum(c("f") * c("x"))).alias("moment")).withColumn("window", c("window").cast("int"))


@query("SELECT pos, scale, CASE WHEN pos % 2 = 1 THEN pow(st, (pos + 1) // 2) ELSE 1.0 END AS kl, CASE WHEN pos = 0 OR pos % 2 = 1 THEN 1.0 ELSE pow(st, (pos + 1) // 2) END AS kr FROM (SELECT event_id % 32 AS pos, event_id // 32 AS scale, CASE WHEN event_id // 32 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS st FROM events WHERE event_id < 64)")
def is_factors_lsf(spark, d):
    rows = V.table(spark, d, "events").where("event_id < 64").select((c("event_id") % 32).alias("pos"), F.floor(c("event_id") / 32).alias("scale"))
    left, right = decisions.low_rate_factors(c("pos"), c("scale"))
    return rows.select("pos", "scale", left.alias("kl"), right.alias("kr"))


@query("SELECT frame, w::INT AS window, CAST(CASE WHEN hi <= 1e-12 OR hi / greatest(lo, 1e-30) < 2 THEN 0 ELSE least(greatest(floor(0.25 * greatest(log2(e / greatest(lo, 1e-30)), 0) + 0.5), 0), 7) END AS INT) AS gain FROM (SELECT *, min(e) OVER (PARTITION BY frame) AS lo, max(e) OVER (PARTITION BY frame) AS hi FROM (SELECT stream * 100000 + n // 576 AS frame, n % 576 // 192 AS w, sum(s * s)::DOUBLE AS e FROM sig GROUP BY ALL))", [V.SAMPLES])
def subblock_gain(spark, d):
    e = V.samples(spark, d).groupBy((c("stream") * 100000 + F.floor(c("n") / 576)).alias("frame"), F.floor(c("n") % 576 / 192).cast("int").alias("window")).agg(F.sum(c("s") * c("s")).cast("double").alias("energy"))
    return decisions.subblock_gains(e)


_Q = "q AS (SELECT frame, k, CAST(floor(pow(x, 0.75) * (0.4 + frame % 4 * 0.5) * exp(-k / 60.0) + 0.4054) * CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END AS INT) AS q FROM lines)"


def _quantized(spark, d):
    v = F.floor(F.pow(c("x"), F.lit(0.75)) * (0.4 + c("frame") % 4 * 0.5) * F.exp(-c("k") / 60.0) + 0.4054)
    return V.lines(spark, d).select("frame", "k", F.when(c("k") % 3 == 0, -v).otherwise(v).cast("int").alias("q"))


@query("SELECT frame, k, CAST(CASE WHEN x < 0 THEN -v ELSE v END AS INT) AS q FROM (SELECT *, least(floor(pow(abs(x), 0.75) * pow(2.0, -20 * -3 / 16.0) + 0.4054), 8191) AS v FROM lines)", [V.LINES])
def quantize(spark, d):
    return coding.quantize(V.lines(spark, d), F.lit(190))


@query(
    "SELECT frame, last_nonzero::BIGINT AS last_nonzero, (SELECT min(b) FROM (SELECT even - 4 * u AS b FROM (SELECT unnest(range(0, even // 4 + 1)) AS u) WHERE even - 4 * u >= last_big))::BIGINT AS big_end FROM (SELECT *, last_nonzero + last_nonzero % 2 AS even FROM (SELECT frame, coalesce(max(CASE WHEN q <> 0 THEN k + 1 END), 0) AS last_nonzero, coalesce(max(CASE WHEN abs(q) > 1 THEN k + 1 END), 0) AS last_big FROM q GROUP BY 1))",
    [V.LINES, _Q],
)
def region_split(spark, d):
    return coding.regions(_quantized(spark, d)).select("frame", c("last_nonzero").cast("long").alias("last_nonzero"), "big_end")


_HUFF = [V.LINES, _Q, "pr AS (SELECT frame, k // 2 AS i, max(CASE WHEN k % 2 = 0 THEN abs(q) END) AS x, max(CASE WHEN k % 2 = 1 THEN abs(q) END) AS y FROM q GROUP BY 1, 2)", "hd(tab, code, len, x, y) AS (VALUES " + values_sql(pair_rows()) + ")", "hc AS (SELECT frame, tab, sum(len + (pr.x > 0)::INT + (pr.y > 0)::INT)::BIGINT AS bits, count(*) AS c FROM pr JOIN hd ON hd.x = pr.x AND hd.y = pr.y GROUP BY 1, 2 HAVING count(*) = 288)"]  # a table that does not reach every value has no cost


@query("SELECT frame, tab::INT AS tab, bits FROM hc", _HUFF)
def huff_cost(spark, d):
    return coding.pair_costs(coding.pairs(_quantized(spark, d)))


@query("SELECT frame, tab::INT AS tab, bits FROM hc QUALIFY row_number() OVER (PARTITION BY frame ORDER BY bits, tab) = 1", _HUFF)
def huff_best(spark, d):
    return coding.cheapest(coding.pair_costs(coding.pairs(_quantized(spark, d))))


@query("SELECT id, peek, len::INT AS len, x::INT AS x, y::INT AS y FROM (SELECT event_id AS id, (event_id * 2654435761) % 256 AS peek FROM events) JOIN hd ON tab = 5 AND peek >= code << (8 - len) AND peek < (code + 1) << (8 - len)", ["hd(tab, code, len, x, y) AS (VALUES " + values_sql(pair_rows()) + ")"])
def huff_prefix(spark, d):
    return coding.match_prefix(V.table(spark, d, "events").select(c("event_id").alias("id"), (c("event_id") * 2654435761 % 256).alias("peek")), 5)


@query("SELECT stream, block, round(sqrt(mse), 4) AS rms, CASE WHEN mse > 0 THEN round(20 * log10(peak / sqrt(mse)), 6) END AS psnr_db, max_err FROM (SELECT stream, block, avg((l - r)::DOUBLE * (l - r)) AS mse, max(abs(r)) AS peak, max(abs(l - r))::DOUBLE AS max_err FROM lr GROUP BY 1, 2)", [V.STEREO])
def psnr_rms(spark, d):
    return framing.error_measures(V.stereo(spark, d), ["stream", "block"]).select("stream", "block", six(c("rms"), 4).alias("rms"), six(c("psnr_db")).alias("psnr_db"), "max_err")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: signal to block types, through blocks, sub-frame energies, the onset fold and the block-type machine."""
    return block_type_fsm(spark, sf_dir)
