"""Registered queries: time axis, statistics, filters, wavelets, events, scores and decoded signals over the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as K
from pulsegrid.functions import naming, timeaxis, viewport
from pulsegrid.operators import evaluation, events, signals
from pulsegrid.plans.registry import ORACLES, QUERIES, long_of, query, r6, values
from pulsegrid.plans.views import RATE_HZ, ann_user, duck, read, sig_embed, sig_embed_long, sig_supp, sig_user
from pulsegrid.sources import documents, edf, synthetic, wfdb

__all__ = ["ORACLES", "QUERIES"]


# --- time axis, calibration, viewports -------------------------------------------------------------------------


@query("""SELECT event_id, round((event_id % 5000) / 360.0::DOUBLE + 0.5, 6) + 0.0 AS time_sec,
  CAST(floor((value - 0.5) * 360.0::DOUBLE) AS BIGINT) AS i_floor, CAST(ceil((value - 0.5) * 360.0::DOUBLE) AS BIGINT) AS i_ceil,
  CAST(floor((value - 0.5) * 360.0::DOUBLE + 0.5) AS BIGINT) AS i_round, round((event_id % 5000) / 360.0::DOUBLE, 6) + 0.0 AS duration_sec FROM events""")
def time_of_sample(spark, sf_dir):
    t = lambda p: timeaxis.sample_of_time(F.col("value"), 360.0, 0.5, p)
    n = F.col("event_id") % 5000
    return read(spark, sf_dir, "events").select("event_id", r6(timeaxis.time_of_sample(n, 360.0, 0.5)).alias("time_sec"), t("floor").alias("i_floor"), t("ceil").alias("i_ceil"), t("round").alias("i_round"), r6(timeaxis.duration_sec(n, 360.0)).alias("duration_sec"))


@query("""WITH w AS (SELECT event_id, value, 3600 AS n, (event_id % 7 - 3) * 0.1::DOUBLE AS d FROM events),
c AS (SELECT event_id, d, greatest(0, least(n, CAST(floor(value / 10 * 360.0::DOUBLE) AS BIGINT))) AS s, greatest(0, least(n, CAST(ceil((value / 10 + d) * 360.0::DOUBLE) AS BIGINT))) AS e FROM w)
SELECT event_id, CASE WHEN d > 0 THEN s ELSE 0 END AS win_start, CASE WHEN d > 0 THEN greatest(s, e) ELSE 0 END AS win_end FROM c""")
def sample_window(spark, sf_dir):
    w = timeaxis.sample_window(F.col("value") / 10, (F.col("event_id") % 7 - 3) * F.lit(0.1), 360.0, 0.0, 3600)
    return read(spark, sf_dir, "events").select("event_id", w["start"].alias("win_start"), w["end"].alias("win_end"))


@query("""SELECT p_partkey, round((CAST(p_size AS DOUBLE) - 24) / 200.0::DOUBLE, 6) + 0.0 AS mv, round(p_retailprice * 200.0::DOUBLE + 24, 6) + 0.0 AS adc,
  round(((p_size - 24) / 200.0::DOUBLE) * 200.0::DOUBLE + 24, 6) + 0.0 AS back FROM part""")
def adc_calibration(spark, sf_dir):
    mv = timeaxis.adc_to_millivolt(F.col("p_size"), 200.0, 24.0)
    return read(spark, sf_dir, "part").select("p_partkey", r6(mv).alias("mv"), r6(timeaxis.millivolt_to_adc(F.col("p_retailprice"), 200.0, 24.0)).alias("adc"), r6(timeaxis.millivolt_to_adc(mv, 200.0, 24.0)).alias("back"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
k AS (SELECT user_id, n / 64.0::DOUBLE AS d, unnest(range(0, 5)) AS k FROM n),
s AS (SELECT user_id, k, d, 2.0 + (k - 1) * (d / 4) AS a FROM k)
SELECT user_id, k::INT AS position, CASE WHEN k = 0 THEN 'Full record' ELSE printf('%.2f–%.2f s', floor(a * 100 + 0.5) / 100, floor((a + d / 4) * 100 + 0.5) / 100) END AS label,
  round(CASE WHEN k = 0 THEN 2.0 ELSE a END, 6) + 0.0 AS start_sec, round(CASE WHEN k = 0 THEN d ELSE d / 4 END, 6) + 0.0 AS duration_sec FROM s""")
def viewport_presets(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = n.select("user_id", F.posexplode(viewport.presets(RATE_HZ, 2.0, F.col("n"))).alias("position", "p"))
    return rows.select("user_id", "position", "p.label", r6("p.start_sec").alias("start_sec"), r6("p.duration_sec").alias("duration_sec"))


_CLAMP = "CASE WHEN {x} < {a} THEN {a} WHEN {x} > {b} THEN {b} ELSE {x} END"


@query(f"""WITH v AS (SELECT event_id, value / 20 AS s0, 0.02 + (event_id % 90) / 10.0::DOUBLE AS d0, (event_id % 11) / 10.0::DOUBLE AS f, 10.0::DOUBLE AS bd, 2 / 64.0::DOUBLE AS l FROM events),
c AS (SELECT *, {_CLAMP.format(x='d0', a='least(l, bd)', b='bd')} AS d FROM v),
d AS (SELECT *, {_CLAMP.format(x='s0', a='0.0', b='(bd - d)')} AS s FROM c),
z AS (SELECT *, {_CLAMP.format(x='(d * 0.5)', a='least(l, bd)', b='bd')} AS zd FROM d),
p AS (SELECT *, s + f * d AS held, least(d, bd) AS pd FROM z)
SELECT event_id, round(s, 6) + 0.0 AS clamp_start, round(d, 6) + 0.0 AS clamp_sec,
  round({_CLAMP.format(x='(held - f * zd)', a='0.0', b='(bd - zd)')}, 6) + 0.0 AS zoom_start, round(zd, 6) + 0.0 AS zoom_sec,
  round({_CLAMP.format(x='(s + 0.25 * pd)', a='0.0', b='(bd - pd)')}, 9) + 0.0 AS pan_start,
  round(s + f * d, 6) + 0.0 AS cursor_sec, greatest(0, CAST(floor((s + f * d) * 64.0::DOUBLE + 0.5) AS BIGINT)) AS cursor_sample FROM p""")
def zoom_pan(spark, sf_dir):
    bounds, least = viewport.viewport(0.0, 10.0), viewport.least_duration(RATE_HZ)
    f = (F.col("event_id") % 11) / F.lit(10.0)
    rows = read(spark, sf_dir, "events").select("event_id", f.alias("f"), viewport.viewport(F.col("value") / 20, F.lit(0.02) + (F.col("event_id") % 90) / F.lit(10.0)).alias("v"))
    rows = rows.withColumn("c", viewport.clamp_viewport(F.col("v"), bounds, least))
    z = viewport.zoom(F.col("c"), bounds, viewport.ZOOM_STEP, F.col("f"), least)
    at = viewport.readout(F.col("f"), F.col("c"), RATE_HZ, 0.0)
    return rows.select("event_id", r6("c.start_sec").alias("clamp_start"), r6("c.duration_sec").alias("clamp_sec"), r6(z["start_sec"]).alias("zoom_start"), r6(z["duration_sec"]).alias("zoom_sec"), (F.round(viewport.pan(F.col("c"), bounds, viewport.PAN_STEP)["start_sec"], 9) + 0.0).alias("pan_start"), r6(at["time_sec"]).alias("cursor_sec"), at["sample"].alias("cursor_sample"))


# --- segmentation, statistics, envelopes, normalisation -----------------------------------------------------------


def _segment(spark, sf_dir, width, stride, policy):
    arrays = signals.to_arrays(sig_user(spark, sf_dir), ["user_id"])
    rows = signals.segment(arrays, ["user_id"], width, stride, policy)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return rows.select("user_id", F.col("start").alias("start_sample"), "is_partial", "source_samples", r6(total).alias("total"), r6(F.array_max("data")).alias("top"))


def _segment_sql(width, stride, policy):
    partial = "" if policy == "drop" else f" UNION ALL SELECT user_id, n, f * {stride} AS s FROM g WHERE f * {stride} < n"
    return duck(f"""+n AS (SELECT user_id, count(*) AS n FROM sig_user GROUP BY user_id),
g AS (SELECT user_id, n, CASE WHEN n >= {width} THEN (n - {width}) // {stride} + 1 ELSE 0 END AS f FROM n),
s AS (SELECT user_id, n, k * {stride} AS s FROM (SELECT *, unnest(range(0, f)) AS k FROM g){partial})
SELECT s.user_id, s.s::BIGINT AS start_sample, n - s.s < {width} AS is_partial, least({width}, n - s.s)::BIGINT AS source_samples,
  round(sum(x ORDER BY i), 6) + 0.0 AS total, round(greatest(max(x), CASE WHEN n - s.s < {width} THEN 0.0 ELSE max(x) END), 6) + 0.0 AS top
FROM s JOIN sig_user u ON u.user_id = s.user_id AND u.i >= s.s AND u.i < s.s + {width} GROUP BY s.user_id, s.s, n""", "sig_user")


@query(_segment_sql(16, 16, "drop"))
def segment_drop(spark, sf_dir):
    return _segment(spark, sf_dir, 16, 16, "drop")


@query(_segment_sql(16, 16, "pad-zero"))
def segment_pad_zero(spark, sf_dir):
    return _segment(spark, sf_dir, 16, 16, "pad-zero")


@query(_segment_sql(20, 5, "pad-zero"))
def segment_overlap(spark, sf_dir):
    return _segment(spark, sf_dir, 20, 5, "pad-zero")


@query(duck("""+g AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 20 THEN (count(*) - 20) // 5 + 1 ELSE 0 END AS f FROM sig_user GROUP BY user_id)
SELECT sum(f)::BIGINT AS full_windows, 0::BIGINT AS padded_windows, sum(greatest(0, n - f * 5))::BIGINT AS dropped_samples FROM g""", "sig_user"))
def segment_counts(spark, sf_dir):
    return signals.segment_summary(signals.to_arrays(sig_user(spark, sf_dir), ["user_id"]), 20, 5, "drop")


@query(duck("""SELECT l_suppkey, count(x) AS n, min(x) AS min, max(x) AS max, round(avg(x), 4) + 0.0 AS mean, round(sqrt(avg(x * x)), 4) + 0.0 AS rms,
  arg_min(i, {'a': -abs(x), 'i': i}) AS peak_index, max(abs(x)) AS peak_value FROM sig_supp GROUP BY l_suppkey""", "sig_supp"))
def basic_stats(spark, sf_dir):
    s = signals.basic_stats(sig_supp(spark, sf_dir), ["l_suppkey"])
    return s.select("l_suppkey", "n", "min", "max", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("rms", 4) + 0.0).alias("rms"), "peak_index", F.abs("peak_value").alias("peak_value"))


_ENVELOPE = """+b AS (SELECT l_suppkey, max(i) + 1 AS span FROM sig_supp GROUP BY l_suppkey),
k AS (SELECT l_suppkey, span, unnest(range(0, 48)) AS j FROM b),
e AS (SELECT k.l_suppkey, j::INT AS bucket, min(x) AS lo, max(x) AS hi FROM k LEFT JOIN sig_supp s ON s.l_suppkey = k.l_suppkey AND s.i >= (j * span) // 48 AND s.i < ((j + 1) * span) // 48 GROUP BY k.l_suppkey, j)
"""


@query(duck(_ENVELOPE + "SELECT l_suppkey, bucket, coalesce(lo, 0.0) AS min, coalesce(hi, 0.0) AS max, lo IS NOT NULL AS populated FROM e", "sig_supp"))
def envelope_columns(spark, sf_dir):
    return signals.envelope(sig_supp(spark, sf_dir), ["l_suppkey"], 48)


@query(duck(_ENVELOPE + "SELECT l_suppkey, coalesce(min(lo), 0.0) AS min, coalesce(max(hi), 0.0) AS max FROM e GROUP BY l_suppkey", "sig_supp"))
def amplitude_bounds(spark, sf_dir):
    return signals.amplitude_bounds(envelope_columns(spark, sf_dir), ["l_suppkey"])


@query("""WITH b AS (SELECT l_suppkey, min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CASE WHEN z > a THEN round(a - (z - a) * 0.08, 6) ELSE round(a - coalesce(nullif(abs(z) * 0.5, 0), 0.5), 6) END + 0.0 AS low,
  CASE WHEN z > a THEN round(z + (z - a) * 0.08, 6) ELSE round(z + coalesce(nullif(abs(z) * 0.5, 0), 0.5), 6) END + 0.0 AS high FROM b""")
def padded_domain(spark, sf_dir):
    b = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("z"))
    d = viewport.padded_domain(F.col("a"), F.col("z"))
    return b.select("l_suppkey", r6(d["min"]).alias("low"), r6(d["max"]).alias("high"))


@query(duck("+f AS (SELECT user_id, min(x) AS a, max(x) - min(x) AS b FROM sig_user GROUP BY user_id) SELECT u.user_id, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_user u JOIN f USING (user_id)", "sig_user"))
def minmax_fit_apply(spark, sf_dir):
    s = sig_user(spark, sf_dir)
    return signals.apply_normalisation(s, signals.fit_normalisation(s, [], ["user_id"], "min-max"), ["user_id"]).select("user_id", "i", r6("x").alias("y"))


_Z = "avg(x) AS a, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) AS b"


@query(duck(f"+f AS (SELECT rid, {_Z} FROM sig_embed_long GROUP BY rid) SELECT s.rid, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_embed_long s JOIN f USING (rid)", "sig_embed_long"))
def zscore_per_channel(spark, sf_dir):
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.normalise_column(F.col("data"), "z-score"))


@query(duck(f"+f AS (SELECT label, {_Z} FROM sig_embed_long GROUP BY label) SELECT s.label, s.rid, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_embed_long s JOIN f USING (label)", "sig_embed_long"))
def zscore_global(spark, sf_dir):
    s = sig_embed(spark, sf_dir).select("label", "rid", F.posexplode("data").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    fit = signals.fit_normalisation(s, ["label"], ["rid"], "z-score", "global")
    return signals.apply_normalisation(s, fit, ["label", "rid"]).select("label", "rid", "i", r6("x").alias("y"))


_ROLES = """r AS (SELECT s, (row_number() OVER (ORDER BY s) - 1) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT {s} AS s FROM {t})),
roles AS (SELECT s, CASE WHEN p = n - 1 THEN 'test' WHEN p / greatest(1, n - 1) < 0.7 THEN 'train' WHEN p / greatest(1, n - 1) < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS role FROM r)"""


@query(duck("+" + _ROLES.format(s="rid", t="sig_embed_long") + f""", f AS (SELECT {_Z} FROM sig_embed_long JOIN roles ON s = rid WHERE role = 'train')
SELECT rid, role, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_embed_long JOIN roles ON s = rid, f WHERE role <> 'train'""", "sig_embed_long"))
def leakage_safe_normalize(spark, sf_dir):
    """The fit of the training records only, applied to the others."""
    s = sig_embed(spark, sf_dir).select("rid", F.posexplode("data").alias("i", "x")).withColumn("i", F.col("i").cast("long")).withColumn("pool", F.lit(1))
    s = s.join(evaluation.split_subjects(s, "rid"), "rid")
    fit = signals.fit_normalisation(s.where("role = 'train'"), ["pool"], [], "z-score", described="train")
    return signals.apply_normalisation(s.where("role <> 'train'"), fit, ["pool"]).select("rid", "role", "i", r6("x").alias("y"))


# --- filters, wavelets, resampling --------------------------------------------------------------------------------

_LOW = {"type": "lowpass", "cutoff_hz": 10.0, "taps": 15, "phase": "forward"}
_HIGH = {"type": "highpass", "cutoff_hz": 6.0, "taps": 15, "phase": "forward"}
_BAND = {"type": "bandpass", "cutoff_hz": [4.0, 12.0], "taps": 15, "phase": "forward"}
_ZERO = {**_LOW, "phase": "zero"}


def _fir_sql(spec):
    return duck("+" + values("taps", K.design_fir(spec, RATE_HZ)) + " SELECT a.rid, a.i, round(sum(h * b.x), 6) + 0.0 AS y FROM sig_embed_long a, taps JOIN sig_embed_long b ON b.rid = a.rid AND b.i = a.i - k GROUP BY a.rid, a.i", "sig_embed_long")


def _fir(spark, sf_dir, spec):
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.filter_column(F.col("data"), spec, RATE_HZ))


@query(_fir_sql(_LOW))
def fir_lowpass_forward(spark, sf_dir):
    return _fir(spark, sf_dir, _LOW)


@query(_fir_sql(_BAND))
def fir_bandpass_forward(spark, sf_dir):
    return _fir(spark, sf_dir, _BAND)


@query(_fir_sql(_HIGH))
def fir_highpass_forward(spark, sf_dir):
    return _fir(spark, sf_dir, _HIGH)


@query(_fir_sql(_LOW))
def fir_lowpass_sql(spark, sf_dir):
    """The same filter in SQL functions alone, over the stored array."""
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.fir_sql(F.col("data"), K.design_fir(_LOW, RATE_HZ)))


@query(duck("+" + values("taps", K.design_fir(_LOW, RATE_HZ)) + """, w AS (SELECT e.rid, e.j, x FROM (SELECT rid, j, CASE WHEN j - 7 < 0 THEN 6 - j WHEN j - 7 >= 64 THEN 134 - j ELSE j - 7 END AS src FROM (SELECT rid, unnest(range(0, 78)) AS j FROM (SELECT DISTINCT rid FROM sig_embed_long))) e JOIN sig_embed_long s ON s.rid = e.rid AND s.i = e.src),
p AS (SELECT a.rid, 77 - a.j AS j, sum(h * b.x) AS x FROM w a, taps JOIN w b ON b.rid = a.rid AND b.j = a.j - k GROUP BY a.rid, a.j),
q AS (SELECT a.rid, 77 - a.j AS j, sum(h * b.x) AS x FROM p a, taps JOIN p b ON b.rid = a.rid AND b.j = a.j - k GROUP BY a.rid, a.j)
SELECT rid, (j - 7)::BIGINT AS i, round(x, 6) + 0.0 AS y FROM q WHERE j >= 7 AND j < 71""", "sig_embed_long"))
def fir_zero_phase(spark, sf_dir):
    return _fir(spark, sf_dir, _ZERO)


_BANK = values("lo", K.wavelet("db4")["dec_lo"]) + ", " + values("hi", K.wavelet("db4")["dec_hi"])


def _dwt_levels(levels: int) -> str:
    """CTEs a0 (the samples) to aL and d1 to dL, as (rid, i, x)."""
    parts = [_BANK, "a0 AS (SELECT rid, i, x FROM sig_embed_long)"]
    for j in range(1, levels + 1):
        n = 64 >> (j - 1)
        for name, bank in (("a", "lo"), ("d", "hi")):
            parts.append(f"{name}{j} AS (SELECT o.rid, o.m AS i, sum(h * s.x) AS x FROM (SELECT rid, unnest(range(0, {n // 2})) AS m FROM (SELECT DISTINCT rid FROM a0)) o, {bank} JOIN a{j - 1} s ON s.rid = o.rid AND s.i = (2 * o.m + 4 - k + {n}) % {n} GROUP BY o.rid, o.m)")
    return "+" + ", ".join(parts)


@query(duck(_dwt_levels(1) + " SELECT a1.rid, a1.i::BIGINT AS i, round(a1.x, 6) + 0.0 AS a, round(d1.x, 6) + 0.0 AS d FROM a1 JOIN d1 USING (rid, i)", "sig_embed_long"))
def dwt_level1(spark, sf_dir):
    """One level in SQL functions alone."""
    pairs = F.zip_with(K.analyse_sql(F.col("data"), False), K.analyse_sql(F.col("data"), True), lambda a, d: F.struct(a.alias("a"), d.alias("d")))
    rows = sig_embed(spark, sf_dir).select("rid", F.posexplode(pairs).alias("i", "p"))
    return rows.select("rid", F.col("i").cast("long").alias("i"), r6("p.a").alias("a"), r6("p.d").alias("d"))


@query(duck(_dwt_levels(4) + " " + " UNION ALL ".join(f"SELECT rid, {b} AS band, i::BIGINT AS i, round(x, 6) + 0.0 AS y FROM {t}" for b, t in ((1, "d1"), (2, "d2"), (3, "d3"), (4, "d4"), (5, "a4"))), "sig_embed_long"))
def dwt_multilevel(spark, sf_dir):
    """Details 1 to 4 and the approximation as band 5."""
    bands = sig_embed(spark, sf_dir).select("rid", F.posexplode(K.decompose_column(F.col("data"), 4)).alias("band", "data"))
    return long_of(bands.withColumn("band", F.col("band") + 1), ["rid", "band"], F.col("data"))


@query(duck(_dwt_levels(4) + " " + " UNION ALL ".join(f"SELECT rid, {b} AS band, round(sum(x * x), 6) + 0.0 AS energy FROM {t} GROUP BY rid" for b, t in ((0, "a0"), (1, "d1"), (2, "d2"), (3, "d3"), (4, "d4"), (5, "a4"))), "sig_embed_long"))
def dwt_energy(spark, sf_dir):
    """Energy of the signal (band 0) and of each band; the bands' add up to the signal's."""
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    s = sig_embed(spark, sf_dir)
    every = F.concat(F.array(F.col("data")), K.decompose_column(F.col("data"), 4))
    return s.select("rid", F.posexplode(every).alias("band", "b")).select("rid", "band", r6(energy(F.col("b"))).alias("energy"))


@query(duck("SELECT rid, i, round(x, 6) + 0.0 AS y FROM sig_embed_long", "sig_embed_long"))
def idwt_roundtrip(spark, sf_dir):
    """Reconstruction of four levels: the signal again."""
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.reconstruct_column(K.decompose_column(F.col("data"), 4)))


def _resample_sql(edge: str, target: float) -> str:
    ratio = target / RATE_HZ
    cut = 0.5 * min(1.0, ratio)
    out = int(np.ceil(64 * ratio - 1e-9))
    src = "q" if edge == "zero" else "CASE WHEN q < 0 THEN -q - 1 WHEN q >= 64 THEN 127 - q ELSE q END"
    return duck(f"""+o AS (SELECT m, m / {ratio!r}::DOUBLE AS tau FROM (SELECT unnest(range(0, {out})) AS m)),
q AS (SELECT m, tau, floor(tau)::BIGINT + unnest(range(-8, 9)) AS q FROM o),
w AS (SELECT m, {src} AS src, CASE WHEN abs(tau - q) > 8 THEN 0 ELSE (0.54 + 0.46 * cos(pi() * (tau - q) / 8)) * {2 * cut!r}::DOUBLE * CASE WHEN tau = q THEN 1 ELSE sin(pi() * {2 * cut!r}::DOUBLE * (tau - q)) / (pi() * {2 * cut!r}::DOUBLE * (tau - q)) END END AS w FROM q),
t AS (SELECT m, sum(w) AS total FROM w GROUP BY m),
v AS (SELECT s.rid, w.m, sum(w.w * s.x) AS x FROM w JOIN sig_embed_long s ON s.i = w.src GROUP BY s.rid, w.m)
SELECT rid, m::BIGINT AS i, round(x / total, 6) + 0.0 AS y FROM v JOIN t USING (m)""", "sig_embed_long")


@query(_resample_sql("reflect", 50.0))
def resample_reflect(spark, sf_dir):
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.resample_column(F.col("data"), RATE_HZ, 50.0))


@query(_resample_sql("zero", 96.0))
def resample_zero(spark, sf_dir):
    return long_of(sig_embed(spark, sf_dir), ["rid"], K.resample_column(F.col("data"), RATE_HZ, 96.0, edge="zero"))


@query("""SELECT p_partkey, (p_size % 6 + 1)::INT AS level, round(p_size / 2.0 ** (p_size % 6 + 2), 6) + 0.0 AS low_hz, round(p_size / 2.0 ** (p_size % 6 + 1), 6) + 0.0 AS high_hz,
  round(p_size / 2.0 ** (p_size % 6 + 2), 6) + 0.0 AS rest_hz, (2 ** (p_size % 6 + 1))::BIGINT AS stride, round(2 ** (p_size % 6 + 1) / p_size::DOUBLE, 6) + 0.0 AS stride_sec FROM part""")
def band_frequencies(spark, sf_dir):
    level, rate = (F.col("p_size") % 6 + 1).cast("int"), F.col("p_size").cast("double")
    band = K.detail_band_hz(level, rate)
    return read(spark, sf_dir, "part").select("p_partkey", level.alias("level"), r6(band["low_hz"]).alias("low_hz"), r6(band["high_hz"]).alias("high_hz"), r6(K.approximation_band_hz(level, rate)["high_hz"]).alias("rest_hz"), K.stride_samples(level).alias("stride"), r6(K.stride_sec(level, rate)).alias("stride_sec"))


@query("""WITH w AS (SELECT event_id, CAST(floor(abs(value)) AS BIGINT) % 900 AS s, event_id % 400 AS d, (event_id % 4 + 1)::INT AS l FROM events),
c AS (SELECT *, s + d AS e, (1000 // (2 ** l))::BIGINT AS n, (2 ** l)::BIGINT AS t FROM w)
SELECT event_id, CASE WHEN e > s THEN least(n, s // t) ELSE 0 END AS c_start, CASE WHEN e > s THEN greatest(least(n, s // t), least(n, (e + t - 1) // t)) ELSE 0 END AS c_end FROM c""")
def coeff_range(spark, sf_dir):
    s, level = F.floor(F.abs("value")).cast("long") % 900, (F.col("event_id") % 4 + 1).cast("int")
    w = F.struct(s.alias("start"), (s + F.col("event_id") % 400).alias("end"))
    c = K.coefficient_range(w, level, F.floor(1000 / K.stride_samples(level)))
    return read(spark, sf_dir, "events").select("event_id", c["start"].alias("c_start"), c["end"].alias("c_end"))


@query(duck("""+u AS (SELECT rid, i, x, lag(x) OVER (PARTITION BY rid ORDER BY i) AS b FROM sig_embed_long), c AS (SELECT rid, count(*) FILTER (b < 0 AND x >= 0) AS n, max(i) FILTER (b < 0 AND x >= 0) AS z, min(i) FILTER (b < 0 AND x >= 0) AS a FROM u GROUP BY rid)
SELECT rid, n AS crossings, CASE WHEN n >= 2 THEN round(64.0::DOUBLE / ((z - a) / (n - 1)), 6) + 0.0 END AS frequency_hz FROM c""", "sig_embed_long"))
def zero_crossing_freq(spark, sf_dir):
    return signals.zero_crossing_hz(sig_embed_long(spark, sf_dir).drop("label"), ["rid"], RATE_HZ).withColumn("frequency_hz", r6("frequency_hz"))


@query(duck("""+p AS (SELECT a.rid, sum(a.x * b.x) AS y FROM sig_embed_long a JOIN sig_embed_long b ON b.rid = a.rid AND b.i = a.i - 3 GROUP BY a.rid), q AS (SELECT rid, sum(x * x) AS e FROM sig_embed_long GROUP BY rid)
SELECT rid, round(y, 6) + 0.0 AS shifted, round(e, 6) + 0.0 AS energy FROM p JOIN q USING (rid)""", "sig_embed_long"))
def cross_correlation(spark, sf_dir):
    d = F.col("data")
    return sig_embed(spark, sf_dir).select("rid", r6(signals.cross_correlation(d, d, 3)).alias("shifted"), r6(signals.inner_product(d, d)).alias("energy"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 0 THEN 0 ELSE log2(p_size & -p_size)::INT END AS halvings,
  list_max(list_transform(list_filter(range(0, log2(8 * p_size & -(8 * p_size))::BIGINT + 1), lambda j: j = 0 OR 8 * p_size / 2 ** (j - 1) >= 8), lambda j: j))::INT AS levels FROM part""")
def level_limits(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", timeaxis.max_periodic_level(F.col("p_size")).alias("halvings"), timeaxis.max_orthogonal_level(8 * F.col("p_size")).cast("int").alias("levels"))


# --- events --------------------------------------------------------------------------------------------------------

_VIEW = dict(start_sec=0.5, duration=2.0, rate_hz=RATE_HZ, record_start=0.0, n=180)
_SEEN = "v AS (SELECT *, least(1.0, greatest(0.0, (sample_index / 64.0::DOUBLE + 0.0 - 0.5) / 2.0)) AS x FROM ann_user WHERE sample_index >= 32 AND sample_index < 160)"


@query(duck(f"""+{_SEEN}, c AS (SELECT *, least(15, floor(x * 16)::INT) AS col FROM v)
SELECT user_id, col AS "column", arg_min(sample_index, (sample_index, ordinal)) AS sample_index, arg_min(symbol, (sample_index, ordinal)) AS symbol, round(arg_min(x, (sample_index, ordinal)), 6) + 0.0 AS x, count(*) AS merged FROM c GROUP BY user_id, col""", "ann_user"))
def annotation_markers(spark, sf_dir):
    return events.markers(ann_user(spark, sf_dir), ["user_id"], columns=16, **_VIEW).withColumn("x", r6("x"))


@query(duck(f"""+{_SEEN}, c AS (SELECT *, least(15, floor(x * 16)::INT) AS col FROM v)
SELECT user_id, count(*) AS visible, count(*) - count(DISTINCT col) AS merged, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols FROM c GROUP BY user_id""", "ann_user"))
def marker_summary(spark, sf_dir):
    return events.marker_summary(ann_user(spark, sf_dir), ["user_id"], columns=16, **_VIEW).withColumn("symbols", F.array_join("symbols", ","))


@query(duck(f"""+{_SEEN}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sample_index, symbol, ordinal) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM v)
SELECT user_id, sample_index, symbol, p::INT AS position, n AS visible, n > 20 AS truncated FROM o WHERE p <= 20""", "ann_user"))
def annotation_list_topk(spark, sf_dir):
    return events.event_list(ann_user(spark, sf_dir), ["user_id"], limit=20, **_VIEW).select("user_id", "sample_index", "symbol", "position", "visible", "truncated")


@query(duck(f"""+{_SEEN}, c AS (SELECT user_id, k, k / 10.0::DOUBLE AS f FROM (SELECT user_id, unnest(range(0, 11)) AS k FROM (SELECT DISTINCT user_id FROM ann_user))),
d AS (SELECT user_id, k, sample_index, symbol, ordinal, abs(x - f) AS d FROM c JOIN v USING (user_id) WHERE abs(x - f) <= 0.02::DOUBLE)
SELECT user_id, k AS cursor, sample_index, symbol, round(d, 6) + 0.0 AS distance FROM d QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY d, sample_index, symbol, ordinal) = 1""", "ann_user"))
def nearest_annotation(spark, sf_dir):
    a = ann_user(spark, sf_dir)
    cursors = a.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("cursor")).withColumn("fraction", F.col("cursor") / F.lit(10.0))
    return events.nearest(a, cursors, ["user_id"], "cursor", **_VIEW).select("user_id", "cursor", "sample_index", "symbol", r6("distance").alias("distance"))


@query(duck("""+w AS (SELECT user_id, k, (k * 40)::BIGINT AS s, (k * 40 + 50)::BIGINT AS e FROM (SELECT user_id, unnest(range(0, max(sample_index) // 40 + 1)) AS k FROM ann_user GROUP BY user_id))
SELECT w.user_id, k AS win, count(*) AS n, min(sample_index) AS first_sample FROM w JOIN ann_user a ON a.user_id = w.user_id AND a.sample_index >= s AND a.sample_index < e GROUP BY w.user_id, k""", "ann_user"))
def window_interval_join(spark, sf_dir):
    a = ann_user(spark, sf_dir)
    w = a.groupBy("user_id").agg(F.max("sample_index").alias("last")).select("user_id", F.explode(F.expr("sequence(0L, last div 40)")).alias("win")).selectExpr("user_id", "win", "win * 40 win_start", "win * 40 + 50 win_end")
    return events.in_windows(a, w, ["user_id"], 50).groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), F.min("sample_index").alias("first_sample"))


@query(duck("SELECT user_id, sample_index, symbol FROM ann_user WHERE symbol IN (SELECT event_type FROM events GROUP BY event_type ORDER BY event_type LIMIT 2)", "ann_user"))
def symbol_filter_semi(spark, sf_dir):
    a = ann_user(spark, sf_dir)
    two = a.select("symbol").distinct().orderBy("symbol").limit(2)  # the feature: two of the five event types
    return events.with_symbols(a, two).select("user_id", "sample_index", "symbol")


@query("""WITH s(code, symbol) AS (VALUES """ + ", ".join("({}, '{}')".format(c, s) for c, s in events.STANDARD_SYMBOLS.items()) + """),
e AS (SELECT p_partkey, (p_size % 64)::INT AS code FROM part)
SELECT p_partkey, e.code, CASE WHEN e.code = 3 THEN 'R3' WHEN e.code = 45 THEN 'own' ELSE coalesce(s.symbol, '') END AS symbol FROM e LEFT JOIN s USING (code)""")
def symbol_code_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 64).cast("int").alias("code"))
    return events.symbols_of_codes(rows, spark.createDataFrame([(3, "R3"), (45, "own")], "code int, symbol string")).select("p_partkey", "code", "symbol")


# --- subjects, scores, metrics --------------------------------------------------------------------------------------


@query("WITH " + _ROLES.format(s="c_nationkey", t="customer") + " SELECT c_custkey, c_nationkey, role FROM customer JOIN roles ON s = c_nationkey")
def subject_partition(spark, sf_dir):
    return evaluation.split_records(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", "c_nationkey", "role")


@query("""WITH r AS (SELECT c_nationkey AS subject, CASE WHEN c_custkey % 3 = 0 AND c_nationkey < 5 THEN 'test' ELSE 'train' END AS role FROM customer),
d AS (SELECT DISTINCT subject, role FROM r UNION ALL SELECT 9, 'train')
SELECT subject, CASE WHEN count(DISTINCT role) > 1 THEN 'in more than one role' ELSE 'repeated within a role' END AS problem FROM d GROUP BY subject HAVING count(DISTINCT role) > 1 OR count(*) > count(DISTINCT role)""")
def partition_leakage(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    role = F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_nationkey") < 5), "test").otherwise("train")
    rows = c.select(F.col("c_nationkey").alias("subject"), role.alias("role")).distinct().unionByName(spark.range(1).select(F.lit(9).alias("subject"), F.lit("train").alias("role")))
    return evaluation.leakage(rows, "subject")


def _outcomes(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("true_label"), F.when(F.col("n_chars") > 800, "good").when(F.col("n_chars") > 100, "bad").otherwise("good").alias("predicted_label"))


_OUT = "o AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS t, CASE WHEN n_chars > 800 THEN 'good' WHEN n_chars > 100 THEN 'bad' ELSE 'good' END AS p FROM labels JOIN documents USING (doc_id)), l(label) AS (VALUES ('good'), ('bad'), ('never'))"


@query(f"WITH {_OUT} SELECT a.label AS true_label, b.label AS predicted_label, count(o.t) AS n FROM l a CROSS JOIN l b LEFT JOIN o ON o.t = a.label AND o.p = b.label GROUP BY a.label, b.label")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_outcomes(spark, sf_dir), ["good", "bad", "never"])


@query(f"""WITH {_OUT}, c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label AND p <> label) AS fn, count(*) FILTER (t <> label AND p = label) AS fp,
  count(*) FILTER (t <> label AND p <> label) AS tn, count(*) AS total, count(*) FILTER (t = p) AS hit FROM l, o GROUP BY label)
SELECT label, tp, fn, fp, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(hit / nullif(total, 0), 6) AS accuracy, total FROM c""")
def classification_metrics(spark, sf_dir):
    m = evaluation.classification_metrics(_outcomes(spark, sf_dir), ["good", "bad", "never"])
    return m.select("label", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "specificity", "f1", "accuracy")], "total")


@query(duck("""+l AS (SELECT rid, sum(x) FILTER (i < 16) AS a, sum(x) FILTER (i >= 16 AND i < 32) AS b, sum(x) FILTER (i >= 32) AS c FROM sig_embed_long GROUP BY rid),
e AS (SELECT rid, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM l),
s AS (SELECT rid, unnest([0, 1, 2]) AS k, unnest([a, b, c]) / (a + b + c) AS s FROM e)
SELECT rid, ['first', 'second', 'third'][k + 1] AS label, round(s, 6) + 0.0 AS score, row_number() OVER (PARTITION BY rid ORDER BY s DESC, k)::INT AS rank FROM s""", "sig_embed_long"))
def softmax_argmax(spark, sf_dir):
    part = lambda a, n: F.aggregate(F.slice("data", a, n), F.lit(0.0), lambda s, x: s + x)
    top = evaluation.interpret(F.array(part(1, 16), part(17, 16), part(33, 32)), ["first", "second", "third"])
    rows = sig_embed(spark, sf_dir).select("rid", F.posexplode(top).alias("k", "p"))
    return rows.select("rid", "p.label", r6("p.score").alias("score"), (F.col("k") + 1).alias("rank"))


@query(duck("""+s AS (SELECT rid, avg(x) AS m, sqrt(avg(x * x)) AS r FROM sig_embed_long GROUP BY rid)
SELECT rid, round(0.5 + m * 0.1 + r * 0.05 * 3, 6) + 0.0 AS l0, round(m * 0.2 + r * 0.05 * 2, 6) + 0.0 AS l1, round(m * 0.1 * 3 + r * 0.05, 6) + 0.0 AS l2 FROM s""", "sig_embed_long"))
def stub_engine_score(spark, sf_dir):
    s = evaluation.stub_scores(F.col("data"), 3, [0.5])
    return sig_embed(spark, sf_dir).select("rid", *[r6(s[c]).alias(f"l{c}") for c in range(3)])


_PROBE = """+w AS (SELECT rid, i // 16 AS k, sum(x) AS s FROM sig_embed_long GROUP BY rid, i // 16),
o AS (SELECT CASE WHEN label % 2 = 0 THEN 'positive-mean' ELSE 'nonpositive-mean' END AS t, CASE WHEN s >= 0 THEN 'positive-mean' ELSE 'nonpositive-mean' END AS p FROM w JOIN (SELECT DISTINCT rid, label FROM sig_embed_long) USING (rid)),
l(label) AS (VALUES ('positive-mean'), ('nonpositive-mean')),
c AS (SELECT l.label, count(*) FILTER (t = l.label AND p = l.label) AS tp, count(*) FILTER (t = l.label AND p <> l.label) AS fn, count(*) FILTER (t <> l.label AND p = l.label) AS fp, count(*) FILTER (t = p) AS hit, count(*) AS total FROM l, o GROUP BY l.label)
SELECT label, tp, fn, fp, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(hit / total, 6) AS accuracy, total FROM c"""


@query(duck(_PROBE, "sig_embed_long"))
def probe_experiment(spark, sf_dir):
    """Tumbling windows of 16, the probe's score, softmax, first label, confusion, metrics; the label's parity is the truth."""
    windows = signals.segment(sig_embed(spark, sf_dir), ["rid", "label"], 16, 16)
    top = F.get(evaluation.interpret(evaluation.probe_scores(F.col("data")), documents.PROBE["output"]["classLabels"]), F.lit(0))
    truth = F.when(F.col("label") % 2 == 0, "positive-mean").otherwise("nonpositive-mean")
    m = evaluation.classification_metrics(windows.select(truth.alias("true_label"), top["label"].alias("predicted_label")), documents.PROBE["output"]["classLabels"])
    return m.select("label", "tp", "fn", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")], "total")


# --- quality, requests, hashes, generated and decoded signals ---------------------------------------------------------


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN trim(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END) = '' THEN 'id must not be empty' END,
  CASE WHEN c_acctbal <= 0 THEN 'sample rate must be positive' END, CASE WHEN c_custkey % 7 = 0 THEN 'unit must be adc, mV or normalized' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'samples must be finite' END, CASE WHEN c_custkey % 4 = 0 THEN 'channel names must be unique' END,
  CASE WHEN c_custkey % 6 = 0 THEN 'channels must be of one length' END], lambda x: x IS NOT NULL), '; ') AS problems FROM customer""")
def signal_quality_problems(spark, sf_dir):
    k = F.col("c_custkey")
    second = F.when(k % 6 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    first = F.array(F.lit(0.5), F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)))
    channel = lambda name, unit, data: F.struct(name.alias("name"), unit.alias("unit"), data.alias("data"))
    chans = F.array(channel(F.lit("a"), F.when(k % 7 == 0, "volts").otherwise("mV"), first), channel(F.when(k % 4 == 0, "a").otherwise("b"), F.lit("mV"), second))
    p = signals.signal_problems(F.when(k % 5 == 0, " ").otherwise(F.col("c_name")), F.col("c_acctbal"), F.lit(0.0), chans)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(p, "; ").alias("problems"))


@query("SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, count(*) - 1 AS superseded FROM events GROUP BY user_id")
def latest_request(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type")
    old = evaluation.request_status(e, ["user_id"]).groupBy("user_id").agg(F.count_if(F.col("status") == "request-superseded").alias("superseded"))
    return evaluation.latest_requests(e, ["user_id"]).join(old, "user_id").select("user_id", "seq", "event_type", "superseded")


@query("""SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296::UBIGINT))), 8, '0') AS hash FROM part""")
def fnv1a_ascii(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", naming.fnv1a_column(F.col("p_name")).alias("hash"))


#: A record of two leads for each supplier: its nation gives rate and length, its balance the amplitude.
_LEADS = """l AS (SELECT 's' || s_suppkey AS record_id, c AS channel_index, 'lead-' || c AS channel_name, 100 + s_nationkey AS n, 120.0::DOUBLE + s_nationkey AS rate, 1.0::DOUBLE + c / 5.0::DOUBLE AS hz, s_acctbal / 10000 AS amplitude, s_nationkey / 4.0::DOUBLE AS phase
  FROM (SELECT *, unnest([0, 1]) AS c FROM supplier)), s AS (SELECT *, unnest(range(0, n)) AS i FROM l),
v AS (SELECT *, amplitude * (0.6 * sin(2 * pi() * hz * (i / rate) + phase) + 0.4 * 0.5 * sin(2 * (2 * pi() * hz) * (i / rate) + 2 * phase)) AS x FROM s)"""


def _leads(spark, sf_dir):
    nation = F.col("s_nationkey")
    rows = read(spark, sf_dir, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel_index"))
    return rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("record_id"), "channel_index", F.concat(F.lit("lead-"), F.col("channel_index").cast("string")).alias("channel_name"), (nation + 100).alias("n"), (nation + F.lit(120.0)).alias("rate_hz"), (F.lit(1.0) + F.col("channel_index") / 5.0).alias("frequency_hz"), (F.col("s_acctbal") / 10000).alias("amplitude"), (nation / 4.0).alias("phase"), F.lit(200.0).alias("gain"), F.lit(1024.0).alias("baseline"))


@query(f"WITH {_LEADS} SELECT record_id, channel_index, channel_name, i::BIGINT AS i, floor(x * 200.0 + 1024.0 + 0.5)::INT AS adc, round((floor(x * 200.0 + 1024.0 + 0.5) - 1024.0) / 200.0, 6) + 0.0 AS mv FROM v")
def synthetic_record(spark, sf_dir):
    return synthetic.synthetic_records(_leads(spark, sf_dir)).withColumn("mv", r6("mv"))


@query(duck("SELECT a.rid, a.i, floor(a.x * 100 + 0.5)::INT AS first, floor(b.x * 100 + 0.5)::INT AS second FROM sig_embed_long a JOIN sig_embed_long b ON b.rid = a.rid AND b.i = 63 - a.i", "sig_embed_long"))
def wfdb212_decode(spark, sf_dir):
    """Each embedding, in hundredths, and its reverse packed as format 212 and decoded again."""

    @F.arrow_udf("array<struct<first:int,second:int>>")
    def run(data: pa.Array) -> pa.Array:
        out = []
        for v in data.to_pylist():
            raw = np.floor(np.array(v) * 100 + 0.5).astype(np.int64)
            a, b = wfdb.decode_212(wfdb.encode_212(raw, raw[::-1]), len(raw))
            out.append([{"first": int(x), "second": int(y)} for x, y in zip(a, b, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("second", pa.int32())])))

    rows = sig_embed(spark, sf_dir).select("rid", F.posexplode(run("data")).alias("i", "p"))
    return rows.select("rid", F.col("i").cast("long").alias("i"), "p.first", "p.second")


@query(duck("SELECT user_id, sample_index, (ascii(symbol) % 18 + 1)::INT AS code, symbol AS aux_note FROM ann_user", "ann_user"))
def atr_decode(spark, sf_dir):
    """Each user's events written as an annotation stream and parsed again."""
    rows = ann_user(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("sample_index", "ordinal", "symbol"))).alias("e"))

    @F.udf("array<struct<sample_index:long,code:int,aux_note:string>>")
    def run(e):
        data = wfdb.encode_annotations([(x["sample_index"], ord(x["symbol"][0]) % 18 + 1, x["symbol"]) for x in e])
        return [(x["sample_index"], x["code"], x["aux_note"]) for x in wfdb.parse_annotations(data)[0]]

    return rows.select("user_id", F.explode(run("e")).alias("x")).select("user_id", "x.*")


@query(duck("SELECT rid::VARCHAR AS record_id, i, floor(x * 100 + 0.5)::INT AS adc, round(floor(x * 100 + 0.5) / 1000, 6) + 0.0 AS mv FROM sig_embed_long", "sig_embed_long"))
def edf_read(spark, sf_dir):
    """Each embedding, in hundredths, as an EDF file that is read and calibrated again."""
    shape = edf.EdfSignal("ECG", "", "mV", -1.0, 1.0, -1000, 1000, "", 16)

    @F.udf("binary")
    def write(data):
        return edf.encode([(shape, np.floor(np.array(data) * 100 + 0.5).astype(np.int64))])

    files = sig_embed(spark, sf_dir).select(F.concat(F.col("rid").cast("string"), F.lit(".edf")).alias("name"), write("data").alias("content"))
    rows = edf.read_channels(files)
    mv = timeaxis.samples_to_millivolt(F.col("samples"), F.col("gain"), F.col("baseline"))
    out = rows.withColumn("m", mv).select("record_id", F.posexplode(F.arrays_zip("samples", "m")).alias("i", "p"))
    return out.select("record_id", F.col("i").cast("long").alias("i"), F.col("p.samples").cast("int").alias("adc"), r6("p.m").alias("mv"))
