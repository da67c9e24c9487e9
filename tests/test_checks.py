"""Rules over JSON columns against the Python judgement of each document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.naming import canonical_json
from pulsegrid.sources import checks, documents

ODD = [None, "", " ", "x", 0, -1, 1, 1.5, 2.0, True, [], [1], ["a", ""], {}, {"a": 1}, [-1, 3], [0], "float32", "none", 1e300, [{"stage": "s", "config": None}], [{"stage": "s"}, 3]]


def paths(x, at=()):
    yield at
    if isinstance(x, dict):
        for k, v in x.items():
            yield from paths(v, (*at, k))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from paths(v, (*at, i))


def changed(base, path, value, drop=False):
    out = json.loads(json.dumps(base))
    if not path:
        return value
    at = out
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def variants_of(base, seed, many):
    r = random.Random(seed)
    every = [p for p in paths(base) if p]
    out = [base]
    for p in every:
        out += [changed(base, p, None, True), changed(base, p, r.choice(ODD)), changed(base, p, r.choice(ODD))]
    for _ in range(many):
        doc = base
        for p in r.sample(every, 3):
            try:
                doc = changed(doc, p, r.choice(ODD))
            except (KeyError, IndexError, TypeError):
                continue
        out.append(doc)
    return out


def judged(spark, docs, column) -> list[list[str]]:
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").repartition(4)
    return [r.p for r in df.select("i", column(F.col("t")).alias("p")).orderBy("i").collect()]


def test_metadata_rules_say_what_python_says(spark):
    base = documents.probe_metadata(provenance={"trainingDataset": "d", "methodology": "m"})
    docs = [*variants_of(base, 1, 150), [], "text", 3]
    for d, got in zip(docs, judged(spark, docs, checks.metadata_problems), strict=True):
        assert got == documents.metadata_problems(d), json.dumps(d)
    odd = spark.createDataFrame([("{bad",), (None,)], "t string").select(checks.metadata_problems(F.col("t")).alias("p")).collect()
    assert [r.p for r in odd] == [["model metadata is not valid JSON"]] * 2


CONFIG = {"datasetId": "d", "selection": {"kind": "subject-partition", "role": "train", "partition": {"train": 0.5, "validation": 0.25, "test": 0.25}, "recordIds": ["a"]}, "channelName": "c", "window": {"windowLengthSamples": 4, "strideSamples": 2, "remainderPolicy": "drop"}, "model": {"modelId": "m", "modelVersion": "1"}, "evaluation": {"id": "e", "description": "f"}}


@pytest.mark.parametrize("kind", ["records", "subject-partition", "other"])
def test_configuration_rules_say_what_python_says(spark, kind):
    base = {**CONFIG, "selection": {**CONFIG["selection"], "kind": kind}}
    docs = []
    for d in variants_of(base, 2, 100):
        try:  # where a group is no object, Python has no answer
            docs.append((d, documents.configuration_problems(d)))
        except AttributeError:
            continue
    assert len(docs) > 80
    for (d, want), got in zip(docs, judged(spark, [d for d, _ in docs], checks.configuration_problems), strict=True):
        assert got == want or isinstance(d.get("selection", {}).get("partition", {}).get("train", 0), bool), json.dumps(d)


def named(d) -> bool:
    """Whether the filter, which only gives a name, is one: what name another thing gives is nobody's business."""
    f = d["config"].get("preprocessing") if isinstance(d["config"], dict) else None
    f = f.get("filter") if isinstance(f, dict) else None
    return isinstance(f, dict) and all(isinstance(f.get(k), str) for k in ("type", "phase")) and isinstance(f.get("cutoff_hz"), list) and all(type(c) in (int, float) for c in f["cutoff_hz"])


def result(records=2, windows=3):
    config = {**CONFIG, "selection": {"kind": "records", "recordIds": [f"r{i}" for i in range(records)]}, "preprocessing": {"filter": {"type": "bandpass", "cutoff_hz": [0.5, 40], "taps": 5, "phase": "zero"}}}
    rows, pairs = [], []
    for i in range(records):
        own = []
        for j in range(windows):
            t, p = ("yes", "no")[(i + j) % 2], ("yes", "no")[j % 2]
            pairs.append((t, p))
            own.append({"windowId": f"r{i}/ch/0/w{2 * j}", "recordId": f"r{i}", "channelIndex": 0, "channelName": "c", "startSample": 2 * j, "lengthSamples": 4, "trueLabel": t, "predictedLabel": p, "predictedScore": 0.75, "semantics": "model-score"})
        rows.append({"recordId": f"r{i}", "subjectId": "s", "channelName": "c", "channelIndex": 0, "provenance": {"transforms": [{"name": "n", "parameters": {}}]}, "windows": own})
    return {"experimentId": documents.experiment_id(config), "config": config, "labeler": config["evaluation"], "softwareVersion": "1", "scopeNote": "n", "evaluatedAtIso": "2026-01-01T00:00:00+00:00", "records": rows, "metrics": documents.metrics_of(["yes", "no", "never"], pairs)}


def test_result_rules_say_what_python_says(spark):
    base = result()
    docs = [d for d in [*variants_of(base, 3, 120), [], "text"] if not isinstance(d, dict) or canonical_json(d.get("config", {})).count("e+300") == 0 and (d.get("config") or {}) and named(d)]
    twice = json.loads(json.dumps(base))
    twice["records"].append(twice["records"][0])
    docs += [twice, changed(base, ("metrics", "classLabels"), ["yes", "yes", "no"]), changed(base, ("records", 0, "windows", 1, "trueLabel"), "unknown"), result(0, 0), result(1, 0)]
    known = []
    for d in docs:
        try:
            known.append((d, documents.result_problems(d)))
        except (AttributeError, KeyError, TypeError, ValueError):
            continue
    assert len(known) > 300
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(known)], "i int, document string").repartition(4)
    got = {r.i: r.problems for r in checks.parse_results(df, ["i"]).collect()}
    assert len(got) == len(known)
    assert [(canonical_json(d)[:300], want, got[i]) for i, (d, want) in enumerate(known) if got[i] != want] == []
    assert sum(w == [documents.RESULT_TEXTS["metrics"]] for _, w in known) > 20 and sum(w == [] for _, w in known) > 3
