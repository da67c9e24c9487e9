"""Time axis, viewports, names, and the numeric kernels' invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.errors import ERROR_CODES, SignalError, error_envelope, is_error_code
from pulsegrid.functions import kernels as K
from pulsegrid.functions import naming, timeaxis, viewport


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rounding_is_half_up(spark):
    r = one(spark, a=timeaxis.sample_of_time(-2.5, 1.0), b=timeaxis.sample_of_time(2.5, 1.0), c=timeaxis.sample_of_time(2.4, 1.0, 0.0, "ceil"))
    assert tuple(r) == (-2, 3, 3)
    with pytest.raises(SignalError):
        timeaxis.sample_of_time(1.0, 1.0, 0.0, "nearest")


def test_sample_window_is_half_open_and_clamped(spark):
    w = lambda s, d: timeaxis.sample_window(s, d, 10.0, 0.0, 20)
    r = one(spark, a=w(-1.0, 1.55), b=w(1.95, 9.0), c=w(0.5, 0.0), d=w(0.5, -1.0), e=w(5.0, 1.0))
    assert [tuple(x) for x in r] == [(0, 6), (19, 20), (0, 0), (0, 0), (20, 20)]


def test_calibration_refuses_bad_numbers(spark):
    assert one(spark, x=timeaxis.adc_to_millivolt(1224, 200.0, 1024.0)).x == 1.0
    for gain in (0.0, -1.0, math.nan, math.inf):
        with pytest.raises(Exception, match="invalid-input"):
            one(spark, x=timeaxis.adc_to_millivolt(1, gain, 0.0))


def test_fraction_clamps_nan(spark):
    assert tuple(one(spark, a=timeaxis.clamp_fraction(math.nan), b=timeaxis.clamp_fraction(2.0), c=timeaxis.clamp_fraction(0.25))) == (0.0, 1.0, 0.25)


def test_presets_and_captions(spark):
    p = one(spark, p=viewport.presets(10.0, 0.0, 100)).p
    assert [x.label for x in p] == ["Full record", "0.00–2.50 s", "2.50–5.00 s", "5.00–7.50 s", "7.50–10.00 s"]
    assert one(spark, p=viewport.presets(10.0, 0.0, 0)).p == []
    with pytest.raises(SignalError):
        viewport.presets(10.0, 0.0, 1, 0)
    r = one(spark, a=viewport.format_cursor(F.lit(1.5), F.lit(540), F.lit("N")), b=viewport.format_cursor(F.lit(None).cast("double"), F.lit(0)), c=viewport.format_amplitude(F.lit(123.4)), d=viewport.format_amplitude(F.lit(1.0)), e=viewport.format_frequency(F.lit(90.0)), f=viewport.format_list_caption(F.lit(200), F.lit(340), F.lit(True)), g=viewport.format_annotation(F.lit("V"), F.lit(7), F.lit("x")))
    assert tuple(r) == ("Cursor: 1.50 s · sample 540 · nearest N", "Cursor: —", "123", "1.00", "90", "Showing first 200 of 340 in view", "Annotation: V · sample 7 · x")


def test_viewport_stays_in_bounds(spark):
    b, v = viewport.viewport(0.0, 10.0), viewport.viewport(8.0, 4.0)
    r = one(spark, c=viewport.clamp_viewport(v, b, 0.1), z=viewport.zoom(v, b, 0.5, 0.5, 0.1), p=viewport.pan(v, b, 9.0), f=viewport.from_fractions(b, 0.6, 0.2, 0.1))
    assert [tuple(round(y, 9) for y in x) for x in r] == [(6.0, 4.0), (7.0, 2.0), (6.0, 4.0), (2.0, 4.0)]


def test_names_and_hashes(spark):
    assert naming.filter_name({"type": "bandpass", "cutoff_hz": [0.5, 40.0], "phase": "zero"}) == "filter-bandpass-0.5-40hz-zero"
    assert naming.split_name(".hidden") == (".hidden", "") and naming.split_name("a.B.HEA") == ("a.B", "hea")
    assert naming.bare_name("a\\b/c.dat") == "c.dat"
    assert [naming.fnv1a(x) for x in ("", "a", "foobar")] == ["811c9dc5", "e40c292c", "bf9cf968"]
    assert one(spark, h=naming.fnv1a_column(F.lit("foobar"))).h == "bf9cf968"
    assert naming.canonical_json({"b": [1.0, math.nan, None], "a": {"z": True, "y": "é"}}) == '{"a":{"y":"é","z":true},"b":[1,null,null]}'


def test_errors_have_codes():
    assert len(ERROR_CODES) == 14 and is_error_code("dsp-failure") and not is_error_code(3)
    assert error_envelope(SignalError("invalid-input", "x"), "dsp-failure")["code"] == "invalid-input"
    assert error_envelope(KeyError("x"), "inference-failure")["code"] == "inference-failure"
    with pytest.raises(ValueError):
        SignalError("no-such-code", "x")


def test_filter_gains():
    t = np.arange(3600) / 360
    low = {"type": "lowpass", "cutoff_hz": 40.0, "taps": 65, "phase": "zero"}
    taps = K.design_fir(low, 360.0)
    assert abs(taps.sum() - 1) < 1e-12 and np.allclose(taps, taps[::-1])
    kept, gone = (np.abs(K.fir_zero_phase(np.sin(2 * np.pi * f * t), taps)[500:-500]).max() for f in (5, 90))
    assert abs(kept - 1) < 0.01 and gone < 0.01
    assert abs(K.design_fir({**low, "type": "highpass"}, 360.0).sum()) < 1e-12
    assert abs(K.design_fir({**low, "type": "bandpass", "cutoff_hz": [5.0, 40.0]}, 360.0).sum()) < 1e-12
    for bad in ({"taps": 64}, {"taps": 3}, {"cutoff_hz": 180.0}, {"cutoff_hz": 0.0}, {"type": "bandpass"}, {"type": "notch"}, {"cutoff_hz": [1.0, 2.0]}):
        with pytest.raises(SignalError):
            K.design_fir({**low, **bad}, 360.0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=8, max_size=8).map(np.array), st.integers(0, 4), st.integers(0, 99))
def test_wavelet_reconstructs_and_keeps_energy(head, doublings, seed):
    x = np.concatenate([head, np.random.default_rng(seed).normal(size=8 * (2**doublings - 1)) * 100])
    level = K.most_levels(len(x))
    bands = K.decompose(x, level)
    assert np.abs(K.reconstruct(bands) - x).max() <= 1e-9 * max(1, np.abs(x).max())
    assert abs(sum((b * b).sum() for b in bands) - (x * x).sum()) <= 1e-8 * max(1, (x * x).sum())


def test_wavelet_limits():
    assert [K.most_levels(n) for n in (3600, 36000, 360000, 650000, 7, 0)] == [4, 5, 6, 4, 0, 0]
    assert np.abs(K.decompose(np.full(64, 3.0), 3)[0]).max() < 1e-9
    for level in (0, 5, 1.5, True):
        with pytest.raises(SignalError):
            K.decompose(np.ones(64), level)
    with pytest.raises(SignalError):
        K.wavelet("haar")


def test_resampling_keeps_constants_and_tones():
    assert np.allclose(K.resample(np.full(100, 2.5), 360.0, 128.0), 2.5)
    t = np.arange(3600) / 360
    y = K.resample(np.sin(2 * np.pi * 3 * t), 360.0, 128.0)
    want = np.sin(2 * np.pi * 3 * np.arange(len(y)) / 128)
    assert len(y) == 1280 and np.abs(y - want)[20:-20].max() < 0.01
    assert len(K.resample(np.empty(0), 360.0, 128.0)) == 0
    for args in ((360.0, 0.0), (360.0, 128.0, 1), (360.0, 128.0, 8, "wrap")):
        with pytest.raises(SignalError):
            K.resample(np.ones(9), *args)


def test_arrow_columns_agree_with_sql(spark):
    x = np.random.default_rng(0).normal(size=(5, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9, None), (10, [])], "id int, data array<double>")
    spec = {"type": "lowpass", "cutoff_hz": 5.0, "taps": 7, "phase": "forward"}
    rows = df.select("id", K.filter_column(F.col("data"), spec, 32.0).alias("a"), K.fir_sql(F.col("data"), K.design_fir(spec, 32.0)).alias("b")).orderBy("id").collect()
    assert rows[5].a is None and rows[6].a == [] and all(np.allclose(r.a, r.b) for r in rows[:5])
    bad = spark.createDataFrame([([1.0, float("nan")],)], "data array<double>")
    with pytest.raises(Exception, match="finite"):
        bad.select(K.filter_column(F.col("data"), spec, 32.0)).collect()
