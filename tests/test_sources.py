"""WFDB, EDF, synthetic signals, documents, experiments and streams."""

import json

import numpy as np
import pytest

from pulsegrid.errors import SignalError
from pulsegrid.plans import experiment
from pulsegrid.sources import dataset, documents, edf, files, synthetic, wfdb
from pulsegrid.streaming.latest import LatestOnly, supersede

HEADER = "900 2 360 6 12:00:00\n900.dat 212 200(1024)/mV 12 0 995 0 0 MLII\n900.dat 212 0 11 1024 1011 0 0 lead V5\n# note\n"


def refused(code, f, *a):
    with pytest.raises(SignalError) as e:
        f(*a)
    assert e.value.code == code


def test_header_fields():
    h = wfdb.parse_header(HEADER.replace("\n", "\r\n"))
    assert (h.record, h.rate_hz, h.samples, h.base_time, h.comments) == ("900", 360.0, 6, "12:00:00", ("# note",))
    assert [(c.gain, c.baseline, c.units, c.name) for c in h.channels] == [(200.0, 1024, "mV", "MLII"), (200.0, 1024, "mV", "lead V5")]
    for old, new in (("900 2", "900 3"), ("360 6", "x 6"), ("360 6", "0 6"), ("(1024)", "(x)"), (" 12 0 995", " 12 z 995")):
        refused("malformed-header", wfdb.parse_header, HEADER.replace(old, new, 1))
    refused("unsupported-format", wfdb.parse_header, HEADER.replace(" 212 ", " 80 ", 1))
    refused("malformed-header", wfdb.parse_header, "")


def test_sample_formats():
    assert [x.tolist() for x in wfdb.decode_212(bytes.fromhex("e333f3"), 1)] == [[995], [1011]]
    a, b = np.array([-2048, 2047, 0, -1]), np.array([5, -6, 2047, -2048])
    assert [x.tolist() for x in wfdb.decode_212(wfdb.encode_212(a, b), 4)] == [a.tolist(), b.tolist()]
    assert [x.tolist() for x in wfdb.decode_16(wfdb.encode_16([a, b]), 2, 4)] == [a.tolist(), b.tolist()]
    refused("malformed-header", wfdb.decode_212, b"abc", 2)
    refused("invalid-input", wfdb.encode_212, np.array([5000]), np.array([0]))


def test_annotations():
    data = wfdb.encode_annotations([(0, 22, "## time resolution: 360"), (18, 1, ""), (5000, 5, "(AB"), (5000, 28, "")])
    found, rate, labels = wfdb.parse_annotations(data)
    assert rate == 360.0 and labels == []
    assert [(e["sample_index"], e["symbol"], e["aux_note"]) for e in found] == [(18, "N", ""), (5000, "V", "(AB"), (5000, "+", "")]
    custom = wfdb.encode_annotations([(0, 22, x) for x in ("## annotation type definitions", "45 zz my label", "## end of definitions")] + [(3, 45, ""), (4, 44, "")])
    found, rate, labels = wfdb.parse_annotations(custom)
    assert rate is None and labels[0]["description"] == "my label" and [e["symbol"] for e in found] == ["zz", ""]
    assert wfdb.parse_annotations(b"")[0] == []
    refused("annotation-parse-error", wfdb.parse_annotations, b"abc")
    refused("annotation-parse-error", wfdb.parse_annotations, np.array([1 << 10 | 3, 63 << 10 | 200, 0], "<u2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wfdb")
    a, b = np.arange(6) - 3, np.arange(6) * 100
    (d / "900.hea").write_text(HEADER)
    (d / "900.dat").write_bytes(wfdb.encode_212(a, b))
    (d / "900.atr").write_bytes(wfdb.encode_annotations([(2, 1, ""), (4, 5, "x")]))
    return d


def test_wfdb_connectors_agree(spark, folder):
    wfdb.register(spark)
    by_source = spark.read.format("wfdb").load(str(folder)).orderBy("channel_index").collect()
    loaded = files.folder_files(spark, str(folder))
    by_join = wfdb.read_channels(loaded).orderBy("channel_index").collect()
    assert by_source == by_join and by_join[0].samples == [-3, -2, -1, 0, 1, 2] and by_join[1].channel_name == "lead V5"
    events = wfdb.read_events(loaded).orderBy("ordinal").collect()
    assert [(e.sample_index, e.symbol, e.aux_note) for e in events] == [(2, "N", ""), (4, "V", "x")]
    assert spark.read.format("wfdb").option("table", "events").load(str(folder)).count() == 2
    assert wfdb.read_events(loaded, enabled=False).count() == 0
    assert files.discover(loaded) == ("wfdb", ["900"])


def test_catalogue_folds_problems(spark):
    other = HEADER.replace("900", "901")
    f = files.memory_files(spark, {"RECORDS": "900\n# no\n777 x\n", "900.hea": HEADER, "900.dat": b"x", "901.hea": other, "902.hea": "bad", "readme.txt": "x"})
    records, unexpected = wfdb.catalogue(f)
    got = [(r.record_id, r.in_records, r.readable, r.complete) for r in records.collect()]
    assert got == [("900", True, True, True), ("777", True, False, False), ("901", False, True, False), ("902", False, False, False)]
    assert [r.problem is None for r in records.collect()] == [True, False, False, False] and unexpected.first().name == "readme.txt"
    refused("file-not-found", wfdb.catalogue, files.memory_files(spark, {"a": "b"}))


def test_files(spark):
    refused("invalid-input", files.uploaded_files, spark, [("a/x.hea", b""), ("b\\x.hea", b"")])
    refused("unsupported-format", files.detect_format, files.memory_files(spark, {"a.hea": "", "b.EDF": ""}))
    refused("file-not-found", files.read_file, files.memory_files(spark, {"a": "b"}), "c")
    refused("file-not-found", files.folder_files, spark, "/no/such/folder")
    assert files.read_file(files.memory_files(spark, {"a": "b"}), "a") == b"b"


SIGNAL = edf.EdfSignal("ECG", "", "mV", -1.0, 1.0, -1000, 1000, "", 4)


def test_edf_round_trip(spark, tmp_path):
    data = edf.encode([(SIGNAL, np.array([1, -2, 3, 2000, 5, 6, 7, 8]))], patient="P7", recording="today")
    (tmp_path / "r1.edf").write_bytes(data)
    row = edf.read_channels(files.folder_files(spark, str(tmp_path))).first()
    assert (row.record_id, row.subject_id, row.gain, row.baseline, row.adc_bits, row.sample_rate_hz) == ("r1", "P7", 1000.0, 0.0, 11, 4.0)
    assert row.samples == [1, -2, 3, 2000, 5, 6, 7, 8] and any("outside" in c for c in row.comments)
    edf.register(spark)
    assert spark.read.format("edf").load(str(tmp_path)).first() == row
    assert edf.parse_header(edf.encode([(SIGNAL, np.zeros(8, int))], records=-1)).records == 2
    assert edf.subject_of(" x ", "r") == "r" and edf.format_of("") == "EDF"


@pytest.mark.parametrize("at,text,code", [(0, b"1", "unsupported-format"), (192, b"EDF+D", "unsupported-format"), (252, b"9", "malformed-header"), (236, b"7", "malformed-header"), (244, b"0 ", "malformed-header"), (256 + 96, b"uV", "unsupported-format"), (256 + 104, b"1 ", "malformed-header"), (256 + 120, b"x", "malformed-header")])
def test_edf_refusals(at, text, code):
    data = bytearray(edf.encode([(SIGNAL, np.zeros(8, int))]))
    data[at : at + len(text)] = text
    refused(code, edf.parse_header, bytes(data))
    refused("malformed-header", edf.parse_header, bytes(data)[:100])


def test_recipes():
    for name, r in synthetic.RECIPES.items():
        x = synthetic.generate(r)
        assert len(x) == r["length"] and np.isfinite(x).all(), name
    noise = synthetic.generate(synthetic.RECIPES["noise-1"])
    assert abs(noise.std() - 0.05) < 0.003 and (noise == synthetic.generate(synthetic.RECIPES["noise-1"])).all()
    assert abs(synthetic.generate(synthetic.RECIPES["synthetic-ecg-1"]).max() - 1.0) < 0.05
    for bad in ({"kind": "impulse", "length": 5, "amplitude": 1.0, "at_index": 5}, {"kind": "x", "length": 5}, {"kind": "sine", "length": 0}, {"kind": "noise", "length": 3, "std": -1.0, "seed": 1}):
        refused("invalid-input", synthetic.generate, bad)


def test_synthetic_registry(spark):
    r = synthetic.SyntheticRecords({"b": {}, "a": {"n": 10}})
    assert r.ids() == ["a", "b"] and r.read(spark, "a").count() == 20
    refused("file-not-found", r.read, spark, "c")


def test_metadata():
    assert documents.metadata_problems(documents.PROBE) == []
    assert documents.parse_metadata(json.dumps(documents.PROBE))["modelId"] == documents.PROBE["modelId"]
    refused("model-loading-failure", documents.parse_metadata, "{")
    refused("model-loading-failure", documents.parse_metadata, json.dumps({**documents.PROBE, "task": " "}))
    assert documents.fingerprint(documents.PROBE) != documents.fingerprint({**documents.PROBE, "task": "other"})
    assert documents.realise_shape([-1, 4], 12) == [3, 4] and documents.realise_shape([5], 4) is None
    good = {"modelId": documents.PROBE["modelId"], "modelVersion": "1.0.0", "tensorName": "signal", "dtype": "float32", "shape": [360], "count": 360, "fingerprint": documents.fingerprint(documents.PROBE)}
    documents.assert_input(documents.PROBE, good)
    refused("model-compatibility-failure", documents.assert_input, documents.PROBE, {**good, "shape": [359]})
    refused("invalid-input", documents.assert_contract, documents.PROBE, 360.5, 1, 360)
    refused("model-compatibility-failure", documents.assert_contract, documents.PROBE, 250, 1, 360)


def test_experiment_end_to_end(spark):
    e = experiment.run_experiment(dataset.default_records(spark), experiment.probe_configuration())
    doc = e.document("1", "note", "2026-01-01T00:00:00+00:00")
    assert len(doc["records"][0]["windows"]) == 10 and doc["metrics"]["accuracy"] == 1.0
    text = documents.serialise_result(doc)
    assert documents.serialise_result(documents.parse_result(text)) == text
    assert {r.label: r.tp for r in e.metrics().collect()} == {c["label"]: c["truePositives"] for c in doc["metrics"]["classes"]}
    wrong = json.loads(text)
    wrong["records"][0]["windows"][0]["predictedLabel"] = "positive-mean" if wrong["records"][0]["windows"][0]["predictedLabel"] != "positive-mean" else "nonpositive-mean"
    refused("invalid-input", documents.parse_result, json.dumps(wrong))
    bad = {**experiment.probe_configuration(), "selection": {"kind": "records", "recordIds": ["none"]}}
    with pytest.raises(SignalError):
        experiment.run_experiment(dataset.default_records(spark), bad).rows.collect()


def test_analysis_and_view(spark):
    a = experiment.analyse(dataset.default_records(spark), 4)
    assert experiment.coherent(a, 4).count() == 0
    assert a.first().analysis_id == "synthetic/sync :: dwt-db4-level4-periodic"
    assert len(experiment.score_view(dataset.default_records(spark), documents.PROBE, 1.0, 1.0, "lead-b").first().predictions) == 2
    with pytest.raises(Exception, match="model-compatibility-failure"):
        experiment.score_view(dataset.default_records(spark), documents.PROBE, 0.0, 2.0).collect()


def test_latest_only():
    got, failed, gate = [], [], LatestOnly()
    first = gate.issue("s", got.append, failed.append)
    second = gate.issue("s", got.append, failed.append)
    assert [e.code for e in failed] == ["request-superseded"]
    assert not gate.resolve(first, 1) and gate.resolve(second, 2) and got == [2]
    gate.close()
    refused("invalid-input", gate.issue, "s", got.append, failed.append)


def test_stream_supersedes(spark, tmp_path):
    schema = "key string, seq long, payload string"
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 7, "q"), ("a", 2, "y")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = supersede(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r.key, r.seq): r.status for r in spark.table("latest").collect()}
    assert rows == {("a", 1): "request-superseded", ("a", 2): "request-superseded", ("a", 3): "current", ("b", 7): "current"}


def test_answers_reach_their_own_kind_of_request():
    got = []
    dsp, inference = LatestOnly("dsp"), LatestOnly("inference")
    first = dsp.issue("s", got.append, got.append)
    second = dsp.issue("s", got.append, got.append)
    other = inference.issue("s", got.append, got.append)
    assert (first, second, other) == ("dsp-1", "dsp-2", "inference-1") and got[0].code == "request-superseded" and "dsp" in str(got[0])
    assert not dsp.deliver({"kind": "dsp-result", "request": first, "result": 1}) and not dsp.deliver({"kind": "inference-result", "request": second, "result": 1})
    assert dsp.deliver({"kind": "dsp-result", "request": second, "result": 7}) and got[-1] == 7
    assert inference.deliver({"kind": "inference-error", "request": other, "error": {"code": "inference-failure", "message": "no"}}) and got[-1].code == "inference-failure"
