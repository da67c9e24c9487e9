"""Analyses and experiments as one DataFrame each: read, calibrate, filter, segment, score, label, measure."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.functions.kernels import decompose_column, filter_column
from pulsegrid.functions.naming import analysis_id, dwt_name, filter_name, window_id
from pulsegrid.functions.timeaxis import sample_window, samples_to_millivolt
from pulsegrid.operators.evaluation import classification_metrics, interpret, probe_scores, records_of_role, self_subjects
from pulsegrid.operators.signals import segment
from pulsegrid.sources import checks, documents

#: A model: logits (array<double>) of a window's samples (array<double>). A labeller: the true label of a window's samples.
Scorer = Callable[[Column], Column]
Labeller = Callable[[Column], Column]


def millivolt_signals(channels: DataFrame) -> DataFrame:
    """Array form in millivolts of channel rows (samples, gain, baseline, unit, ...); other units are refused."""
    other = F.raise_error(F.concat(F.lit("[unsupported-format] a channel is in "), F.col("unit"))).cast("array<double>")
    data = F.when(F.col("unit") == "mV", samples_to_millivolt(F.col("samples"), F.col("gain"), F.col("baseline"))).otherwise(other)
    return channels.withColumn("data", data).drop("samples")


def analyse(channels: DataFrame, level: int = 4, wavelet: str = "db4", filter_spec: dict | None = None, rate_hz: float | None = None) -> DataFrame:
    """Each channel in millivolts, filtered if asked, with its wavelet bands (detail 1 to L, approximation) and analysis id."""
    signals = millivolt_signals(channels)
    if filter_spec:
        if rate_hz is None:
            raise SignalError("invalid-input", "a filter needs the signals' sample rate")
        signals = signals.where(F.when(F.col("sample_rate_hz") == rate_hz, True).otherwise(F.raise_error(F.lit("[incompatible-sample-rate] a channel has another rate")).cast("boolean")))
        signals = signals.withColumn("data", filter_column(F.col("data"), filter_spec, rate_hz))
    name = analysis_id(F.col("dataset_id"), F.col("record_id"), dwt_name(wavelet, level), filter_name(filter_spec) if filter_spec else None)
    return signals.withColumn("bands", decompose_column(F.col("data"), level, wavelet)).withColumn("analysis_id", name)


def coherent(analysis: DataFrame, level: int) -> DataFrame:
    """Rows whose bands don't fit their signal."""
    sizes = F.transform(F.col("bands"), lambda b: F.size(b))
    want = F.transform(F.sequence(F.lit(1), F.lit(level)), lambda j: (F.size("data") / F.pow(F.lit(2.0), j)).cast("int"))
    return analysis.where((F.size("bands") != level + 1) | (F.slice(sizes, 1, level) != want) | (F.element_at(sizes, -1) != F.element_at(want, -1)))


def select_records(channels: DataFrame, config: dict) -> DataFrame:
    """The channels of the records that a configuration selects; an unknown record or an empty role is refused."""
    selection = config["selection"]
    if selection["kind"] == "records":
        chosen = channels.where(F.col("record_id").isin(selection["recordIds"]))
        missing = set(selection["recordIds"]) - {r[0] for r in chosen.select("record_id").distinct().collect()}
        if missing:
            raise SignalError("file-not-found", f"no record {sorted(missing)[0]!r}")
        return chosen
    subjects = channels.select("record_id", "subject_id").distinct()
    return channels.join(records_of_role(subjects, "subject_id", selection["role"], selection["partition"]).select("record_id"), "record_id", "left_semi")


def outcomes(channels: DataFrame, config: dict, metadata: dict, scorer: Scorer = probe_scores, labeller: Labeller | None = None) -> DataFrame:
    """A row for each window: ids, place, true and predicted label, score and its meaning.

    The chosen channel is selected before anything is computed. A record without that channel, or at another rate
    than the model's, is refused.
    """
    documents.assert_configuration(config)
    return window_outcomes(select_records(channels, config), config, metadata, scorer, labeller)


def window_outcomes(records: DataFrame, config: dict, metadata: dict, scorer: Scorer = probe_scores, labeller: Labeller | None = None) -> DataFrame:
    """The rows of `outcomes` over all records given, whatever the configuration selects; no job runs before they are asked for."""
    window, out = config["window"], metadata["output"]
    rate = metadata.get("expectedSamplingRateHz")
    documents.assert_contract(metadata, rate or 1, 1, window["windowLengthSamples"])
    if (config["model"]["modelId"], config["model"]["modelVersion"]) != (metadata["modelId"], metadata["modelVersion"]):
        raise SignalError("model-compatibility-failure", "the configuration names another model")
    chosen = records.where(F.col("channel_name") == config["channelName"])
    if rate is not None:
        ok = F.when(F.abs(F.col("sample_rate_hz") - rate) <= 1e-6 * F.greatest(F.lit(1.0), F.lit(float(rate)), F.col("sample_rate_hz")), True)
        chosen = chosen.where(ok.otherwise(F.raise_error(F.lit("[model-compatibility-failure] a record has another rate than the model")).cast("boolean")))
    signals = millivolt_signals(chosen)
    spec = (config.get("preprocessing") or {}).get("filter")
    if spec:
        signals = signals.withColumn("data", filter_column(F.col("data"), spec, float(rate)))
    keys = ["record_id", "subject_id", "channel_index", "channel_name"]
    windows = segment(signals, keys, window["windowLengthSamples"], window["strideSamples"], window["remainderPolicy"])
    ranked = interpret(F.col("scores"), out["classLabels"], out["semantics"], out["activation"])
    label = (labeller or sign_labeller(*out["classLabels"][:2]))(F.col("data"))
    rows = windows.withColumn("scores", scorer(F.col("data"))).withColumn("top", F.get(ranked, F.lit(0))).withColumn("true_label", label)
    return rows.select(window_id(F.col("record_id"), F.col("channel_index"), F.col("start")).alias("window_id"), *keys, F.col("start").alias("start_sample"), F.col("length").alias("length_samples"), "true_label", F.col("top.label").alias("predicted_label"), F.col("top.score").alias("predicted_score"), F.col("top.semantics").alias("semantics"))


def sign_labeller(positive: str, other: str) -> Labeller:
    """positive where the window's sum is at least 0."""
    return lambda data: F.when(F.aggregate(data, F.lit(0.0), lambda s, x: s + x) >= 0, positive).otherwise(other)


@dataclass
class Experiment:
    """An experiment's outcome rows and metrics; document() is its JSON form."""

    config: dict
    labels: list[str]
    rows: DataFrame

    def metrics(self) -> DataFrame:
        return classification_metrics(self.rows, self.labels)

    def document(self, version: str, note: str, at: str | None = None) -> dict:
        """The result document; brings all windows to the driver, so it is for results of one desk's size."""
        found = self.rows.orderBy("record_id", "channel_index", "start_sample").collect()
        records: dict[str, dict] = {}
        for r in found:
            record = records.setdefault(r["record_id"], {"recordId": r["record_id"], "subjectId": r["subject_id"], "channelName": r["channel_name"], "channelIndex": r["channel_index"], "provenance": {"transforms": [{"name": "adc-to-millivolt", "parameters": {}}]}, "windows": []})
            names = ("window_id", "record_id", "channel_index", "channel_name", "start_sample", "length_samples", "true_label", "predicted_label", "predicted_score", "semantics")
            record["windows"].append({n.split("_")[0] + "".join(p.title() for p in n.split("_")[1:]): r[n] for n in names})
        metrics = documents.metrics_of(self.labels, [(r["true_label"], r["predicted_label"]) for r in found])
        out = {"experimentId": documents.experiment_id(self.config), "config": self.config, "labeler": self.config["evaluation"], "softwareVersion": version, "scopeNote": note, "evaluatedAtIso": at or datetime.now(UTC).isoformat(), "records": list(records.values()), "metrics": metrics}
        if problems := documents.result_problems(out):
            raise SignalError("invalid-input", "the experiment's result is incoherent.", "; ".join(problems))
        return out


def result_documents(rows: DataFrame, by: list[str], config: dict, labels: list[str], version: str, note: str, at: str) -> DataFrame:
    """(by..., document) of outcome rows with the columns by: an experiment result as canonical JSON for each of their values, which names
    its records, with their windows in order, and its metrics. Nothing reaches the driver; the windows of one document meet in one row.

    config has everything but the selection. Numbers are written as Spark writes them.
    """
    names = {"windowId": "window_id", "recordId": "record_id", "channelIndex": "channel_index", "channelName": "channel_name", "startSample": "start_sample", "lengthSamples": "length_samples", "trueLabel": "true_label", "predictedLabel": "predicted_label", "predictedScore": "predicted_score", "semantics": "semantics"}
    window = F.struct(*[F.col(names[k]).alias(k) for k in sorted(names)])
    own = {"recordId": "record_id", "subjectId": "subject_id", "channelName": "channel_name", "channelIndex": "channel_index"}
    outer = [b for b in by if b not in own.values()]
    records = rows.groupBy(*outer, *own.values()).agg(F.sort_array(F.collect_list(F.struct("start_sample", window.alias("w")))).alias("_w"))
    steps = F.struct(F.array(F.struct(F.lit("adc-to-millivolt").alias("name"), F.from_json(F.lit("{}"), "map<string,string>").alias("parameters"))).alias("transforms"))
    fields = {**{k: F.col(c) for k, c in own.items()}, "provenance": steps, "windows": F.transform("_w", lambda x: x["w"])}
    record = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    json_of = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    keyed = records.select(*by, F.struct(F.col("record_id").alias("id"), "channel_index", json_of(record).alias("text")).alias("_r"))
    docs = keyed.groupBy(*by).agg(F.sort_array(F.collect_list("_r")).alias("_records"))
    counted = rows.groupBy(*by, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(checks.pair(F.col("true_label"), F.col("predicted_label")), "_n"))).alias("_counts"))
    joined = docs.join(counts, by)
    mark = "\u0001"  # stands for the record ids
    template = {**config, "selection": {"kind": "records", "recordIds": [mark]}}
    documents.assert_configuration(template)
    ids = F.array_distinct(F.transform("_records", lambda r: r["id"]))
    inner = lambda c: F.regexp_replace(F.to_json(c), r"^\[|\]$", "")
    told = F.replace(F.lit(documents.experiment_id(template)), F.lit(mark), F.array_join(ids, ","))
    text = {
        "config": F.replace(F.lit(documents.canonical_json(template)), F.lit(json.dumps(mark)), inner(ids)),
        "evaluatedAtIso": F.lit(json.dumps(at)),
        "experimentId": inner(F.array(told)),
        "labeler": F.lit(documents.canonical_json(config["evaluation"])),
        "metrics": json_of(checks.metrics_of(F.array(*map(F.lit, labels)), F.col("_counts"))),
        "records": F.concat(F.lit("["), F.array_join(F.transform("_records", lambda r: r["text"]), ","), F.lit("]")),
        "scopeNote": F.lit(json.dumps(note, ensure_ascii=False)),
        "softwareVersion": F.lit(json.dumps(version, ensure_ascii=False)),
    }
    parts = [p for k in sorted(text) for p in (F.lit(("{" if k == min(text) else ",") + json.dumps(k) + ":"), text[k])]
    return joined.select(*by, F.concat(*parts, F.lit("}")).alias("document"))


def run_experiment(channels: DataFrame, config: dict, metadata: dict = documents.PROBE, scorer: Scorer = probe_scores, labeller: Labeller | None = None) -> Experiment:
    config = documents.snapshot(config)
    return Experiment(config, metadata["output"]["classLabels"], outcomes(channels, config, metadata, scorer, labeller))


def score_view(channels: DataFrame, metadata: dict, start_sec: float, duration_sec: float, channel: str | None = None, scorer: Scorer = probe_scores) -> DataFrame:
    """Of each record the predictions for a view of exactly the model's window; another length is refused, never padded."""
    want = metadata["expectedWindowSamples"]
    if channel is not None:
        channels = channels.where(F.col("channel_name") == channel)
    else:
        channels = channels.where("channel_index = 0")
    signals = millivolt_signals(channels)
    w = sample_window(start_sec, duration_sec, F.col("sample_rate_hz"), F.col("start_time_sec"), F.size("data"))
    rows = signals.withColumn("w", w)
    wrong = F.raise_error(F.concat(F.lit(f"[model-compatibility-failure] the model wants {want} samples, the view has "), (F.col("w.end") - F.col("w.start")).cast("string"))).cast("array<double>")
    data = F.when(F.col("w.end") - F.col("w.start") == want, F.slice("data", (F.col("w.start") + 1).cast("int"), F.lit(want))).otherwise(wrong)
    out = metadata["output"]
    return rows.withColumn("data", data).withColumn("scores", scorer(F.col("data"))).select("record_id", "channel_name", F.col("w.start").alias("start_sample"), F.col("w.end").alias("end_sample"), interpret(F.col("scores"), out["classLabels"], out["semantics"], out["activation"]).alias("predictions"))


def probe_configuration() -> dict:
    """The default experiment: the probe on lead-b of the synthetic record, in windows of a second."""
    return {"datasetId": "synthetic", "selection": {"kind": "records", "recordIds": ["sync"]}, "channelName": "lead-b", "window": {"windowLengthSamples": 360, "strideSamples": 360, "remainderPolicy": "drop"}, "model": {"modelId": documents.PROBE["modelId"], "modelVersion": documents.PROBE["modelVersion"]}, "evaluation": {"id": "probe-sign-of-sum", "description": "positive-mean where the window's sum is at least 0, by construction the probe's own answer"}}


__all__ = ["Experiment", "analyse", "coherent", "millivolt_signals", "outcomes", "probe_configuration", "result_documents", "run_experiment", "score_view", "select_records", "self_subjects", "sign_labeller", "window_outcomes"]
