"""Whole-signal transforms, requests, datasets and ONNX scorers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import HEADER, SIGNAL, refused

from pulsegrid.functions import kernels as K
from pulsegrid.operators import signals, transforms
from pulsegrid.plans import experiment, requests
from pulsegrid.sources import dataset, documents, edf, files, onnx, synthetic, wfdb


@pytest.fixture(scope="module")
def frame(spark):
    t = np.arange(64) / 64
    rows = [("s", c, np.sin(2 * np.pi * (c + 1) * t).tolist(), 64.0, 0.0, "mV") for c in range(2)]
    df = spark.createDataFrame(rows, "signal_id string, channel int, data array<double>, sample_rate_hz double, start_time_sec double, unit string")
    return df.withColumn("provenance", transforms.provenance(F.lit("test")))


def test_chain_of_transforms(frame):
    spec = {"type": "lowpass", "cutoff_hz": 10.0, "taps": 9, "phase": "zero"}
    out = transforms.reconstruct_signals(transforms.decompose_signals(transforms.filter_signals(frame, spec, 64.0), 3), 3).orderBy("channel").collect()
    want = K.fir_zero_phase(np.array(frame.orderBy("channel").first().data), K.design_fir(spec, 64.0))
    assert np.allclose(out[0].data, want)
    assert [s.name for s in out[0].provenance.transforms] == ["filter-lowpass-10hz-zero", "dwt-db4-level3-periodic", "idwt-db4-level3-periodic"]
    assert out[0].signal_id == "s :: filter-lowpass-10hz-zero :: dwt-db4-level3-periodic :: idwt-db4-level3-periodic"
    assert out[0].provenance.transforms[0].parameters["numTaps"] == "9"
    with pytest.raises(Exception, match="incompatible-sample-rate"):
        transforms.filter_signals(frame, spec, 360.0).collect()


def test_resample_and_normalise(frame):
    r = transforms.resample_signals(frame, 64.0, 50.0).first()
    assert len(r.data) == 50 and r.sample_rate_hz == 50.0 and r.signal_id.endswith("resample-50hz")
    for strategy in ("min-max", "z-score"):
        n = transforms.normalise_signals(frame, strategy).first()
        assert n.unit == "normalized" and (abs(np.mean(n.data)) < 1e-9 if strategy == "z-score" else (min(n.data), max(n.data)) == (0.0, 1.0))
    with pytest.raises(Exception, match="spread"):
        transforms.normalise_signals(frame.withColumn("data", F.array(F.lit(1.0), F.lit(1.0))), "min-max").collect()
    refused("invalid-input", transforms.normalise_signals, frame, "robust")


def test_coefficient_envelope(spark):
    long = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "k int, i long, x double")
    ranges = spark.createDataFrame([(1, 2, 6)], "k int, win_start long, win_end long")
    assert [(r["min"], r["max"]) for r in signals.coefficient_envelope(long, ["k"], ranges, 2).orderBy("bucket").collect()] == [(2.0, 3.0), (4.0, 5.0)]


def test_requests_carry_their_errors(spark):
    good, spec = [float(i) for i in range(64)], ("lowpass", 10.0, None, 9, "zero")
    rows = [("a", good, 64.0, 3, spec), ("b", good[:7], 64.0, 1, None), ("c", [1.0, float("nan")], 64.0, 1, None), ("d", good, 64.0, 3, ("lowpass", 99.0, None, 9, "zero")), ("e", None, 64.0, 1, None)]
    df = spark.createDataFrame(rows, "id string, data array<double>, sample_rate_hz double, level int, filter struct<type:string,cutoff_low_hz:double,cutoff_high_hz:double,taps:int,phase:string>")
    got = {r.id: (r.bands is not None, r.error and r.error.code) for r in requests.answer_dsp(df).collect()}
    assert got == {"a": (True, None), "b": (False, "invalid-input"), "c": (False, "malformed-signal"), "d": (False, "invalid-input"), "e": (False, "malformed-signal")}
    asks = spark.createDataFrame([("p@1", [1.0, 2.0]), ("q@1", [1.0]), ("bad@1", [1.0])], "model string, data array<double>")
    models = {"p@1": lambda x: [x.sum(), -x.sum()], "bad@1": lambda x: 1 / 0}
    got = {r.model: (r["values"], r.error and r.error.code) for r in requests.answer_inference(asks, models).collect()}
    assert got == {"p@1": ([3.0, -3.0], None), "q@1": (None, "model-loading-failure"), "bad@1": (None, "inference-failure")}


def test_datasets(spark, tmp_path):
    d = dataset.open_uploads(spark, [("x/900.hea", HEADER.encode()), ("x/900.dat", wfdb.encode_212(np.arange(6), np.arange(6)))])
    assert (d.format, d.record_ids) == ("wfdb", ["900"]) and d.channels("900").count() == 2 and d.events().count() == 0
    refused("file-not-found", d.channels, "901")
    for name in ("a.edf", "b.edf"):
        (tmp_path / name).write_bytes(edf.encode([(SIGNAL, np.arange(64))]))
    e = dataset.open_folder(spark, str(tmp_path))
    assert e.record_ids == ["a", "b"] and [r.record_id for r in e.channels("b").collect()] == ["b"]
    assert e.analyse(2, None, None, "a").count() == 1 and dataset.default_records(spark).count() == 2


def test_onnx_probe_agrees_with_the_built_in(spark):
    pytest.importorskip("onnxruntime")
    scorer = onnx.onnx_scorer(onnx.probe_model(), documents.PROBE)
    config = experiment.probe_configuration()
    a = experiment.run_experiment(dataset.default_records(spark), config, scorer=scorer).rows.orderBy("start_sample").collect()
    b = experiment.run_experiment(dataset.default_records(spark), config).rows.orderBy("start_sample").collect()
    assert [r.predicted_label for r in a] == [r.predicted_label for r in b] and len(a) == 10
    assert np.allclose([r.predicted_score for r in a], [r.predicted_score for r in b], atol=1e-3)
    refused("model-loading-failure", onnx.onnx_scorer, b"no model", documents.PROBE)
    assert onnx.probe_problems(onnx.probe_model()) == []
    assert len(onnx.probe_problems(onnx.probe_model() + b"x")) == 2 and onnx.probe_problems(onnx.probe_model(), {**documents.PROBE, "input": {**documents.PROBE["input"], "name": "x"}})


def test_fixtures_are_not_overwritten(spark, tmp_path):
    folder = str(tmp_path / "f")
    assert synthetic.write_fixtures(spark, folder) == {"signals": True, "wavelet": True}
    assert synthetic.write_fixtures(spark, folder) == {"signals": False, "wavelet": False}
    assert synthetic.write_fixtures(spark, folder, overwrite=True)["signals"]
    bank = spark.read.json(f"{folder}/wavelet").first()
    assert abs(bank.sum_squares_dec_lo - 1) < 1e-9 and abs(bank.sum_dec_hi) < 1e-9
    assert documents.snapshot({"a": None, "b": {"c": None, "d": [1]}}) == {"b": {"d": [1]}}
    assert files.count_extension(["A.HEA", "b.hea"], ".hea") == 2
