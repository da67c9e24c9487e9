"""Model metadata and experiment documents: validation, fingerprints, and canonical JSON in and out."""

from __future__ import annotations

import json
import math
from datetime import datetime
from pathlib import Path

from pulsegrid.errors import SignalError
from pulsegrid.functions.naming import canonical_json, filter_name, fnv1a, number_text, selection_name, window_name
from pulsegrid.operators.evaluation import ROLES, assert_split

#: What a model may declare.
DTYPES = ("float32", "float64", "int8", "int16", "int32", "int64", "uint8", "bool", "string")
#: What a result as a whole, and a split, may be refused with.
RESULT_TEXTS = {"json": "an experiment result is not valid JSON", "object": "an experiment result must be a JSON object", "labels": "metrics can't be computed again: labels must be unique, and windows have declared ones", "metrics": "metrics don't follow from the windows"}
SPLIT_TEXT = "a split's fractions must be at least 0 and add up to 1"
SEMANTICS, ACTIVATIONS = ("logits", "probabilities", "model-scores"), ("none", "softmax", "sigmoid")


def probe_metadata(model_id: str = "probe-linear-mean-2", rate_hz: int = 360, window: int = 360, provenance: dict | None = None) -> dict:
    """The metadata of a probe, a model of one matrix whose logits are plus and minus the sum of its window. Ids and fingerprints follow from the arguments."""
    step = {"stage": "identity-window", "config": {"channelCount": 1, "windowSamples": window, "sampleRateHz": rate_hz}}
    out = {"modelId": model_id, "modelVersion": "1.0.0", "task": "probe-sign-of-mean", "preprocessingAssumptions": [step], "normalization": {"strategy": "none"}}
    out |= {"expectedSamplingRateHz": rate_hz, "expectedChannels": 1, "expectedWindowSamples": window, "input": {"name": "signal", "shape": [window], "dtype": "float32", "layout": "samples"}}
    out["output"] = {"name": "logits", "dtype": "float32", "semantics": "logits", "activation": "softmax", "classLabels": ["positive-mean", "nonpositive-mean"]}
    return out if provenance is None else {**out, "provenance": provenance}


PROBE = probe_metadata()


def _text(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _whole(x: object, least: int = 1) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and float(x).is_integer() and x >= least


def metadata_problems(m: object) -> list[str]:
    """All that is wrong with model metadata."""
    if not isinstance(m, dict):
        return ["model metadata must be a JSON object"]
    out = [f"{k} must be a non-empty string" for k in ("modelId", "modelVersion", "task") if not _text(m.get(k))]
    rate = m.get("expectedSamplingRateHz")
    if rate is not None and not (isinstance(rate, (int, float)) and not isinstance(rate, bool) and math.isfinite(rate) and rate > 0):
        out.append("expectedSamplingRateHz must be above zero when present")
    out += [f"{k} must be a positive integer when present" for k in ("expectedChannels", "expectedWindowSamples") if m.get(k) is not None and not _whole(m[k])]
    given = m.get("input")
    if not isinstance(given, dict):
        out.append("input must be an object")
    else:
        shape = given.get("shape")
        out += [f"input.{k} must be a non-empty string" for k in ("name", "layout") if not _text(given.get(k))]
        if not isinstance(shape, list) or not shape or not all(x == -1 or _whole(x) for x in shape):
            out.append("input.shape must be a non-empty array of dimensions of at least 1, or -1")
        if given.get("dtype") not in DTYPES:
            out.append("input.dtype must be a supported type")
    made = m.get("output")
    if not isinstance(made, dict):
        out.append("output must be an object")
    else:
        labels = made.get("classLabels")
        out += [] if _text(made.get("name")) else ["output.name must be a non-empty string"]
        out += [f"output.{k} must be one of {', '.join(allowed)}" for k, allowed in (("dtype", DTYPES), ("semantics", SEMANTICS), ("activation", ACTIVATIONS)) if made.get(k) not in allowed]
        if not isinstance(labels, list) or not labels or not all(map(_text, labels)):
            out.append("output.classLabels must be a non-empty array of non-empty strings")
    steps = m.get("preprocessingAssumptions")
    if not isinstance(steps, list):
        out.append("preprocessingAssumptions must list the steps")
    else:
        for i, s in enumerate(steps):
            if not isinstance(s, dict) or not _text(s.get("stage")) or not isinstance(s.get("config", {}), dict):
                out.append(f"preprocessingAssumptions[{i}] must have a stage, and an object as config when present")
    scale = m.get("normalization")
    if not isinstance(scale, dict) or not _text(scale.get("strategy")) or scale.get("fittedFrom") is not None and not _text(scale["fittedFrom"]):
        out.append("normalization must have a strategy, and a non-empty fittedFrom when present")
    origin = m.get("provenance", {})
    if not isinstance(origin, dict) or not all(_text(origin[k]) for k in ("trainingDataset", "methodology", "limitations") if origin.get(k) is not None):
        out.append("provenance must be an object of non-empty strings when present")
    return out


def parse_metadata(text: str) -> dict:
    try:
        m = json.loads(text)
    except ValueError as e:
        raise SignalError("model-loading-failure", "model metadata is not valid JSON") from e
    if problems := metadata_problems(m):
        raise SignalError("model-loading-failure", "model metadata failed validation.", "; ".join(problems), {"problems": problems})
    return m


def fingerprint_parts(m: dict) -> list[str]:
    """What a model expects of its input, as texts."""
    optional = [m.get(k) for k in ("expectedSamplingRateHz", "expectedChannels", "expectedWindowSamples")]
    parts = [m["modelId"], m["modelVersion"], m["task"], m["input"]["name"], m["input"]["dtype"], m["input"]["layout"], ",".join(map(number_text, m["input"]["shape"]))]
    parts += ["" if x is None else number_text(x) for x in optional]
    parts += [f"{s['stage']}:{canonical_json(s.get('config', {}))}" for s in m["preprocessingAssumptions"]]
    return [*parts, m["normalization"]["strategy"], m["normalization"].get("fittedFrom") or ""]


def fingerprint(m: dict) -> str:
    """A hash of what a model expects of its input."""
    return fnv1a("\0".join(fingerprint_parts(m)))


def element_count(shape: list[int]) -> int | None:
    return math.prod(shape) if all(_whole(d) for d in shape) else None


def realise_shape(contract: list[int], count: int) -> list[int] | None:
    """The contract with -1 filled in so that it has count elements; None where none does."""
    if not all(d == -1 or _whole(d) for d in contract):
        return None
    fixed = math.prod(d for d in contract if d != -1)
    if -1 not in contract:
        return list(contract) if fixed == count else None
    return None if count % fixed else [count // fixed if d == -1 else d for d in contract]


def shape_mismatch(contract: list[int], actual: list[int]) -> str | None:
    if len(contract) != len(actual):
        return f"rank {len(actual)} instead of {len(contract)}"
    return next((f"dimension {i} is {b} instead of {a}" for i, (a, b) in enumerate(zip(contract, actual, strict=True)) if a not in (-1, b)), None)


def input_problems(m: dict, given: dict) -> list[str]:
    """What keeps a prepared input {modelId, modelVersion, tensorName, dtype, shape, count, fingerprint} from a model."""
    pairs = (("modelId", m["modelId"]), ("modelVersion", m["modelVersion"]), ("tensorName", m["input"]["name"]), ("dtype", m["input"]["dtype"]))
    out = [f"{k} is {given.get(k)!r} instead of {want!r}" for k, want in pairs if given.get(k) != want]
    shape = list(given.get("shape", []))
    if not all(_whole(d) for d in shape):
        out.append("the shape must be concrete")
    if wrong := shape_mismatch(m["input"]["shape"], shape):
        out.append(f"the shape has {wrong}")
    if (n := element_count(shape)) is not None and n != given.get("count"):
        out.append(f"the shape holds {n} elements, the payload {given.get('count')}")
    if given.get("fingerprint") != fingerprint(m):
        out.append("the preprocessing fingerprint is another model's")
    return out


def assert_input(m: dict, given: dict) -> None:
    if problems := input_problems(m, given):
        raise SignalError("model-compatibility-failure", "model input failed validation.", "; ".join(problems), {"problems": problems})


def assert_contract(m: dict, rate_hz: float, channels: int, window: int) -> list[int]:
    """The concrete input shape of windows for a model; never resampled or padded to fit. The rate must be a whole number."""
    if not _whole(rate_hz) or not _whole(channels) or not _whole(window):
        raise SignalError("invalid-input", "the sample rate, channels and window length must be positive whole numbers")
    want = m.get("expectedSamplingRateHz")
    if want is not None and abs(want - rate_hz) > 1e-6 * max(1, abs(want), abs(rate_hz)):
        raise SignalError("model-compatibility-failure", f"windows are at {rate_hz} Hz, the model wants {want}")
    for key, have in (("expectedChannels", channels), ("expectedWindowSamples", window)):
        if m.get(key) is not None and m[key] != have:
            raise SignalError("model-compatibility-failure", f"{key} is {m[key]}, windows have {have}")
    shape = realise_shape(m["input"]["shape"], channels * window)
    if shape is None:
        raise SignalError("model-compatibility-failure", f"{channels * window} samples don't fit the shape {m['input']['shape']}")
    return shape


def file_problems(path: str, size: int, sha256: str) -> list[str]:
    """What differs between a model file and its declared length and digest."""
    import hashlib

    data = Path(path).read_bytes()
    out = [] if len(data) == size else [f"{len(data)} bytes instead of {size}"]
    return out + ([] if hashlib.sha256(data).hexdigest() == sha256 else ["the SHA-256 differs"])


def configuration_problems(c: object) -> list[str]:
    """All that is wrong with an experiment's configuration."""
    c = c if isinstance(c, dict) else {}
    filled = lambda x: isinstance(x, str) and bool(x)
    out = [f"{k} must be a non-empty string" for k in ("datasetId", "channelName") if not filled(c.get(k))]
    s = c.get("selection") or {}
    if s.get("kind") == "records":
        ids = s.get("recordIds")
        if not isinstance(ids, list) or not ids or not all(map(filled, ids)):
            out.append("selection.recordIds must list non-empty record ids")
    elif s.get("kind") == "subject-partition":
        if s.get("role") not in ROLES:
            out.append(f"selection.role must be one of {', '.join(ROLES)}")
        try:
            assert_split(s.get("partition") or {})
        except SignalError as e:
            out.append(f"selection.partition: {e}")
    else:
        out.append("selection.kind must be records or subject-partition")
    w = c.get("window")
    if not isinstance(w, dict):
        out.append("window must be present")
    else:
        out += [f"window.{k} must be a positive integer" for k in ("windowLengthSamples", "strideSamples") if not _whole(w.get(k))]
        if w.get("remainderPolicy") not in ("drop", "pad-zero", "error"):
            out.append("window.remainderPolicy must be drop, pad-zero or error")
    for group, keys in (("model", ("modelId", "modelVersion")), ("evaluation", ("id", "description"))):
        out += [f"{group}.{k} must be a non-empty string" for k in keys if not filled((c.get(group) or {}).get(k))]
    return out


def assert_configuration(c: object) -> None:
    if problems := configuration_problems(c):
        raise SignalError("invalid-input", "invalid experiment configuration.", "; ".join(problems), {"problems": problems})


def snapshot(c: dict) -> dict:
    """A copy of a configuration that later changes don't reach, without absent (None) keys."""
    if isinstance(c, dict):
        return {k: snapshot(v) for k, v in c.items() if v is not None}
    return [snapshot(v) for v in c] if isinstance(c, (list, tuple)) else c


def experiment_id(c: dict) -> str:
    parts = [selection_name(c["selection"]), c["channelName"], f"{c['model']['modelId']}@{c['model']['modelVersion']}", window_name(c["window"]), f"gt:{c['evaluation']['id']}"]
    chosen = (c.get("preprocessing") or {}).get("filter")
    return " :: ".join([c["datasetId"], *parts, *([f"filter:{filter_name(chosen)}"] if chosen else [])])


def metrics_of(labels: list[str], outcomes: list[tuple[str, str]]) -> dict:
    """The metrics document of (true, predicted) pairs; the same numbers as classification_metrics."""
    if not labels or len(set(labels)) < len(labels) or not all(t in labels and p in labels for t, p in outcomes):
        raise SignalError("invalid-input", "labels must be unique, and outcomes must have declared labels")
    n = {(t, p): 0 for t in labels for p in labels}
    for pair in outcomes:
        n[pair] += 1
    share = lambda a, b: a / b if b else None
    classes = []
    for x in labels:
        tp = n[x, x]
        fn, fp = sum(n[x, p] for p in labels) - tp, sum(n[t, x] for t in labels) - tp
        tn = len(outcomes) - tp - fn - fp
        classes.append({"label": x, "truePositives": tp, "falseNegatives": fn, "falsePositives": fp, "trueNegatives": tn, "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp), "f1": share(2 * tp, 2 * tp + fp + fn)})
    return {"classLabels": list(labels), "confusion": [[n[t, p] for p in labels] for t in labels], "classes": classes, "accuracy": share(sum(n[x, x] for x in labels), len(outcomes)), "total": len(outcomes)}


def _is_time(x: object) -> bool:
    try:
        return isinstance(x, str) and bool(x) and datetime.fromisoformat(x) is not None
    except ValueError:
        return False


def _window_problems(w: object, parent: dict, at: str, seen: set[str]) -> list[str]:
    if not isinstance(w, dict):
        return [f"{at} must be an object"]
    out = [f"{at}.{k} must be a non-empty string" for k in ("windowId", "recordId", "channelName", "trueLabel", "predictedLabel") if not (isinstance(w.get(k), str) and w[k])]
    out += [f"{at}.{k} must be a whole number of at least {least}" for k, least in (("channelIndex", 0), ("startSample", 0), ("lengthSamples", 1)) if not _whole(w.get(k), least)]
    score = w.get("predictedScore")
    if isinstance(score, bool) or not isinstance(score, (int, float)) or not math.isfinite(score):
        out.append(f"{at}.predictedScore must be finite")
    if w.get("semantics") not in ("predicted-probability", "model-score"):
        out.append(f"{at}.semantics must be predicted-probability or model-score")
    if w.get("windowId") in seen:
        out.append(f"{at}.windowId is repeated")
    seen.add(w.get("windowId"))
    plain = lambda x: number_text(x) if isinstance(x, (int, float)) and math.isfinite(x) else x
    if w.get("windowId") != f"{plain(parent.get('recordId'))}/ch/{plain(w.get('channelIndex'))}/w{plain(w.get('startSample'))}":
        out.append(f"{at}.windowId doesn't match its record, channel and start")
    out += [f"{at}.{k} differs from its record's" for k in ("recordId", "channelName", "channelIndex") if w.get(k) != parent.get(k)]
    return out


def result_problems(r: object) -> list[str]:
    """All that is wrong with an experiment result: structure, references, and metrics that its windows don't give."""
    if not isinstance(r, dict):
        return [RESULT_TEXTS["object"]]
    filled = lambda x: isinstance(x, str) and bool(x)
    out = [f"{k} must be a non-empty string" for k in ("experimentId", "softwareVersion", "scopeNote") if not filled(r.get(k))]
    if not _is_time(r.get("evaluatedAtIso")):
        out.append("evaluatedAtIso must be an ISO-8601 time")
    labeler, c = r.get("labeler"), r.get("config")
    if not isinstance(labeler, dict) or not filled(labeler.get("id")) or not filled(labeler.get("description")):
        out.append("labeler must have an id and a description")
    bad = [f"config: {p}" for p in configuration_problems(c)]
    out += bad
    if not bad:
        if r.get("experimentId") != experiment_id(c):
            out.append(f"experimentId doesn't match the configuration ({experiment_id(c)})")
        if canonical_json(labeler) != canonical_json(c["evaluation"]):
            out.append("the labeler isn't the one that the configuration names")
    records, windows, seen, ids = r.get("records"), [], set(), set()
    if not isinstance(records, list):
        out.append("records must be an array")
    for i, record in enumerate(records if isinstance(records, list) else []):
        at = f"records[{i}]"
        if not isinstance(record, dict):
            out.append(f"{at} must be an object")
            continue
        out += [f"{at}.{k} must be a non-empty string" for k in ("recordId", "subjectId", "channelName") if not filled(record.get(k))]
        if record.get("recordId") in ids:
            out.append(f"{at}.recordId is repeated")
        ids.add(record.get("recordId"))
        if not _whole(record.get("channelIndex"), 0):
            out.append(f"{at}.channelIndex must be a whole number of at least 0")
        steps = (record.get("provenance") or {}).get("transforms") if isinstance(record.get("provenance"), dict) else None
        if not isinstance(steps, list) or not all(isinstance(s, dict) and filled(s.get("name")) and isinstance(s.get("parameters"), dict) and (s.get("appliedAtIso") is None or _is_time(s["appliedAtIso"])) for s in steps):
            out.append(f"{at}.provenance must list named steps with parameters")
        if not isinstance(record.get("windows"), list):
            out.append(f"{at}.windows must be an array")
            continue
        for j, w in enumerate(record["windows"]):
            out += _window_problems(w, record, f"{at}.windows[{j}]", seen)
            windows.append(w)
    metrics = r.get("metrics")
    labels = metrics.get("classLabels") if isinstance(metrics, dict) else None
    if not isinstance(labels, list) or not labels or not all(map(filled, labels)):
        out.append("metrics.classLabels must list non-empty strings")
    if not out:
        try:
            again = metrics_of(labels, [(w["trueLabel"], w["predictedLabel"]) for w in windows])
            if canonical_json(again) != canonical_json(metrics):
                out.append(RESULT_TEXTS["metrics"])
        except SignalError:
            out.append(RESULT_TEXTS["labels"])
    return out


def serialise_result(r: dict) -> str:
    return canonical_json(r)


def parse_result(text: str) -> dict:
    try:
        r = json.loads(text)
    except ValueError as e:
        raise SignalError("invalid-input", RESULT_TEXTS["json"], str(e)) from e
    if problems := result_problems(r):
        raise SignalError("invalid-input", "invalid experiment result.", "; ".join(problems), {"problems": problems})
    return r
