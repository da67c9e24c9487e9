"""Registered queries: whole-signal transforms, files and records, names, captions, documents and requests over the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid import errors
from pulsegrid.functions import kernels as K
from pulsegrid.functions import naming, timeaxis, viewport
from pulsegrid.operators import evaluation, events, signals, transforms
from pulsegrid.plans import experiment, requests
from pulsegrid.plans.queries import _BAND, _LOW, _ROLES, _Z, _dwt_levels, _leads, _resample_sql
from pulsegrid.plans.registry import ORACLES, long_of, query, r6, values
from pulsegrid.plans.views import RATE_HZ, ann_user, duck, read, sig_embed, sig_embed_long, spread
from pulsegrid.sources import checks, documents, edf, files, synthetic, wfdb

# --- whole-signal transforms, with derived ids and provenance ---------------------------------------------------------


def _signals(spark, sf_dir):
    """Each embedding as a signal of one channel, with provenance; signals of one label share nothing but that."""
    rows = sig_embed(spark, sf_dir).select("rid", F.concat(F.lit("s"), F.col("rid").cast("string")).alias("signal_id"), "label", "data", F.lit(RATE_HZ).alias("sample_rate_hz"), F.lit(0.0).alias("start_time_sec"), F.lit("mV").alias("unit"))
    return rows.withColumn("provenance", transforms.provenance(F.lit("embeddings")))


def _stepped(df, *more: str):
    """Long form of a transformed signal, with its id and its last step's name."""
    df = df.withColumn("step", F.element_at("provenance.transforms", -1)["name"])
    return long_of(df, ["rid", "signal_id", "step", *more], F.col("data"))


def _named(sql: str, step: str) -> str:
    return sql.replace("SELECT a.rid, a.i, round", f"SELECT a.rid, 's' || a.rid || ' :: {step}' AS signal_id, '{step}' AS step, a.i, round")


@query(_named(duck("+" + values("taps", K.design_fir(_BAND, RATE_HZ)) + " SELECT a.rid, a.i, round(sum(h * b.x), 6) + 0.0 AS y FROM sig_embed_long a, taps JOIN sig_embed_long b ON b.rid = a.rid AND b.i = a.i - k GROUP BY a.rid, a.i", "sig_embed_long"), "filter-bandpass-4-12hz-forward"))
def signal_filter(spark, sf_dir):
    return _stepped(transforms.filter_signals(_signals(spark, sf_dir), _BAND, RATE_HZ))


@query(_resample_sql("reflect", 96.0).replace("SELECT rid, m::BIGINT", "SELECT rid, 's' || rid || ' :: resample-96hz' AS signal_id, 'resample-96hz' AS step, m::BIGINT"))
def signal_resample(spark, sf_dir):
    return _stepped(transforms.resample_signals(_signals(spark, sf_dir), RATE_HZ, 96.0))


@query(duck("""+f AS (SELECT rid, min(x) AS a, max(x) - min(x) AS b FROM sig_embed_long GROUP BY rid)
SELECT s.rid, 's' || s.rid || ' :: normalize-min-max-per-channel' AS signal_id, 'normalize-min-max-per-channel' AS step, 'normalized' AS unit, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_embed_long s JOIN f USING (rid)""", "sig_embed_long"))
def signal_normalize_channel(spark, sf_dir):
    return _stepped(transforms.normalise_signals(_signals(spark, sf_dir), "min-max"), "unit")


@query(duck(f"""+f AS (SELECT label, {_Z} FROM sig_embed_long GROUP BY label)
SELECT s.rid, 'l' || s.label || ' :: normalize-z-score-global' AS signal_id, 'normalize-z-score-global' AS step, 'normalized' AS unit, i, round((x - a) / b, 6) + 0.0 AS y FROM sig_embed_long s JOIN f USING (label)""", "sig_embed_long"))
def signal_normalize_global(spark, sf_dir):
    """The embeddings of a label as the channels of one signal, fitted together."""
    pooled = _signals(spark, sf_dir).withColumn("signal_id", F.concat(F.lit("l"), F.col("label").cast("string")))
    return _stepped(transforms.normalise_signals(pooled, "z-score", "global"), "unit")


@query(duck(_dwt_levels(3) + " " + " UNION ALL ".join(f"SELECT rid, 's' || rid || ' :: dwt-db4-level3-periodic' AS signal_id, {b} AS band, i::BIGINT AS i, round(x, 6) + 0.0 AS y FROM {t}" for b, t in ((1, "d1"), (2, "d2"), (3, "d3"), (4, "a3"))), "sig_embed_long"))
def signal_decompose(spark, sf_dir):
    bands = transforms.decompose_signals(_signals(spark, sf_dir), 3).select("rid", "signal_id", F.posexplode("bands").alias("band", "data"))
    return long_of(bands.withColumn("band", F.col("band") + 1), ["rid", "signal_id", "band"], F.col("data"))


@query(duck("SELECT rid, 's' || rid || ' :: dwt-db4-level3-periodic :: idwt-db4-level3-periodic' AS signal_id, 'idwt-db4-level3-periodic' AS step, i, round(x, 6) + 0.0 AS y FROM sig_embed_long", "sig_embed_long"))
def signal_reconstruct(spark, sf_dir):
    return _stepped(transforms.reconstruct_signals(transforms.decompose_signals(_signals(spark, sf_dir), 3), 3))


@query(duck("SELECT rid, i, round((floor(x * 100 + 0.5) - 8) / 200.0::DOUBLE, 6) + 0.0 AS y, 'adc-to-millivolt' AS step FROM sig_embed_long", "sig_embed_long"))
def signal_calibrate(spark, sf_dir):
    """Raw samples in hundredths, at a gain of 200 and a baseline of 8, in millivolts."""
    raw = F.transform("data", lambda x: F.floor(x * 100 + 0.5).cast("short"))
    rows = _signals(spark, sf_dir).withColumn("samples", raw).withColumn("gain", F.lit(200.0)).withColumn("baseline", F.lit(8.0)).drop("data")
    return _stepped(transforms.calibrate_signals(rows)).drop("signal_id")


def _analysis_sql() -> str:
    taps = values("taps", K.design_fir(_LOW, RATE_HZ))
    ctes = _dwt_levels(4).lstrip("+").replace("a0 AS (SELECT rid, i, x FROM sig_embed_long)", "a0 AS (SELECT a.rid, a.i, sum(h * b.x) AS x FROM q a, taps JOIN q b ON b.rid = a.rid AND b.i = a.i - k GROUP BY a.rid, a.i)")
    union = " UNION ALL ".join(f"SELECT rid, {b} AS band, i, x FROM {t}" for b, t in ((0, "d1"), (1, "d2"), (2, "d3"), (3, "d4"), (4, "a4")))
    return duck(f"""+{taps}, q AS (SELECT rid, i, (floor(x * 100 + 0.5) - 4) / 100.0::DOUBLE AS x FROM sig_embed_long), {ctes}, u AS ({union})
SELECT rid::VARCHAR AS record_id, 'vectors/' || rid || ' :: filter-lowpass-10hz-forward :: dwt-db4-level4-periodic' AS analysis_id, band, i::BIGINT AS i, round(x, 6) + 0.0 AS y FROM u""", "sig_embed_long")


def _channels(spark, sf_dir):
    """Each embedding in hundredths as a record's channel, with a gain of 100 and a baseline of 4."""
    rows = sig_embed(spark, sf_dir).withColumn("record_id", F.col("rid").cast("string"))
    samples = F.transform("data", lambda x: F.floor(x * 100 + 0.5).cast("short"))
    return rows.select(F.lit("vectors").alias("dataset_id"), "record_id", F.concat(F.lit("subject-"), F.col("label").cast("string")).alias("subject_id"), F.lit(0).alias("channel_index"), F.lit("first").alias("channel_name"), F.lit("mV").alias("unit"), F.lit(RATE_HZ).alias("sample_rate_hz"), F.lit(0.0).alias("start_time_sec"), F.lit(100.0).alias("gain"), F.lit(4.0).alias("baseline"), samples.alias("samples"))


@query(_analysis_sql())
def analysis_bands(spark, sf_dir):
    """Records read, calibrated, filtered and decomposed; those whose bands don't fit (none) are left out."""
    a = experiment.analyse(_channels(spark, sf_dir), 4, filter_spec=_LOW, rate_hz=RATE_HZ)
    odd = experiment.coherent(a, 4).select("analysis_id")
    rows = a.join(odd, "analysis_id", "left_anti").select("record_id", "analysis_id", F.posexplode("bands").alias("band", "data"))
    return long_of(rows, ["record_id", "analysis_id", "band"], F.col("data"))


# --- experiments ------------------------------------------------------------------------------------------------------

_METADATA = documents.probe_metadata("window-sum-2", 64, 16)
_CONFIG = {"datasetId": "vectors", "channelName": "first", "window": {"windowLengthSamples": 16, "strideSamples": 8, "remainderPolicy": "drop"}, "model": {"modelId": "window-sum-2", "modelVersion": "1.0.0"}, "evaluation": {"id": "first-sample", "description": "positive-mean where the first sample is at least 0"}}
_OUTCOMES = """+w AS (SELECT rid, label, k * 8 AS s FROM (SELECT DISTINCT rid, label FROM sig_embed_long), range(0, 7) AS t(k)),
v AS (SELECT w.rid, w.label, w.s, sum((floor(x * 100 + 0.5) - 4) / 100.0::DOUBLE ORDER BY i) AS total, arg_min(floor(x * 100 + 0.5) - 4, i) AS first FROM w JOIN sig_embed_long e ON e.rid = w.rid AND e.i >= w.s AND e.i < w.s + 16 GROUP BY w.rid, w.label, w.s),
o AS (SELECT rid, label, s, CASE WHEN first >= 0 THEN 'positive-mean' ELSE 'nonpositive-mean' END AS true_label, CASE WHEN round(total, 9) >= 0 THEN 'positive-mean' ELSE 'nonpositive-mean' END AS predicted_label, 1 / (1 + exp(-2 * abs(total))) AS score FROM v)"""


def _first_sample(data):
    return F.when(F.get(data, F.lit(0)) >= 0, "positive-mean").otherwise("nonpositive-mean")


def _sum_scores(data):
    total = F.round(F.aggregate(data, F.lit(0.0), lambda s, x: s + x), 9)
    return F.array(total, -total)


@query(duck(_OUTCOMES + """ SELECT rid || '/ch/0/w' || s AS window_id, rid::VARCHAR AS record_id, 'subject-' || label AS subject_id, s::BIGINT AS start_sample, 16::BIGINT AS length_samples, true_label, predicted_label,
  round(score, 6) + 0.0 AS score, 'predicted-probability' AS semantics FROM o""", "sig_embed_long"))
def experiment_outcomes(spark, sf_dir):
    """Every window of every record scored, labelled and interpreted: the rows of an experiment over all records."""
    return _all_outcomes(spark, sf_dir).select("window_id", "record_id", "subject_id", "start_sample", "length_samples", "true_label", "predicted_label", r6("predicted_score").alias("score"), "semantics")


def _all_outcomes(spark, sf_dir):
    """Outcome rows of all records in one pass, with the label of the embedding."""
    rows = experiment.window_outcomes(_channels(spark, sf_dir), _CONFIG, _METADATA, _sum_scores, _first_sample)
    return rows.withColumn("label", F.substring("subject_id", len("subject-") + 1, 20).cast("int"))


@query(duck(_OUTCOMES + """ SELECT rid || '/ch/0/w' || s AS window_id, s::BIGINT AS start_sample, true_label, predicted_label, round(score, 6) + 0.0 AS score FROM o""", "sig_embed_long"))
def experiment_result_json(spark, sf_dir):
    """The same experiment as a table of documents, one for each subject: written as canonical JSON, parsed, judged, and taken apart again."""
    docs = experiment.result_documents(_all_outcomes(spark, sf_dir), ["subject_id"], _CONFIG, _METADATA["output"]["classLabels"], "1", "check", "2026-01-01T00:00:00+00:00")
    judged = checks.parse_results(docs, ["subject_id"])
    refused = F.raise_error(F.concat(F.lit("[invalid-input] invalid experiment result: "), F.array_join("problems", "; "))).cast("boolean")
    w = lambda path, kind: F.try_variant_get("w", f"$.{path}", kind)
    rows = checks.windows_of(judged.where(F.when(F.size("problems") > 0, refused).otherwise(True)), ["subject_id"])
    return rows.select(w("windowId", "string").alias("window_id"), w("startSample", "long").alias("start_sample"), w("trueLabel", "string").alias("true_label"), w("predictedLabel", "string").alias("predicted_label"), r6(w("predictedScore", "double")).alias("score"))


@query(duck(_OUTCOMES + """ SELECT rid::VARCHAR AS record_id, CASE label % 5
  WHEN 0 THEN 'softwareVersion must be a non-empty string'
  WHEN 1 THEN 'metrics don''t follow from the windows'
  WHEN 2 THEN 'records[0].windows[1].windowId is repeated; records[0].windows[1].windowId doesn''t match its record, channel and start'
  WHEN 3 THEN 'records[0].windows[2].lengthSamples must be a whole number of at least 1' ELSE '' END AS problems FROM o GROUP BY rid, label""", "sig_embed_long"))
def experiment_result_problems(spark, sf_dir):
    """A document for each record, spoilt in a way that its label chooses: a text taken out, an answer turned round (so that the counts are
    another's), an id given twice, a length that is no number. What is wrong is found from the documents alone."""
    docs = experiment.result_documents(_all_outcomes(spark, sf_dir), ["record_id", "label"], _CONFIG, _METADATA["output"]["classLabels"], "1", "check", "2026-01-01T00:00:00+00:00")
    text, label, (yes, no) = F.col("document"), F.col("label") % 5, _METADATA["output"]["classLabels"]
    first = F.regexp_extract(text, '"predictedLabel":"([^"]*)"', 1)
    turned = F.concat(F.regexp_extract(text, '(?s)^(.*?"predictedLabel":")', 1), F.when(first == yes, no).otherwise(yes), F.regexp_extract(text, '(?s)^.*?"predictedLabel":"[^"]*(".*)$', 1))
    spoilt = F.when(label == 0, F.replace(text, F.lit('"softwareVersion":"1"'), F.lit('"softwareVersion":""'))).when(label == 1, turned)
    spoilt = spoilt.when(label == 2, F.regexp_replace(text, '/w8"', '/w0"')).when(label == 3, F.regexp_replace(text, '(?s)^((?:.*?"lengthSamples":){3})16', '$1"16"')).otherwise(text)
    return checks.parse_results(docs.withColumn("document", spoilt), ["record_id"]).select("record_id", F.array_join("problems", "; ").alias("problems"))


@query(duck("""+v AS (SELECT rid, sum((floor(x * 100 + 0.5) - 4) / 100.0::DOUBLE ORDER BY i) AS total FROM sig_embed_long WHERE i >= 32 AND i < 48 GROUP BY rid)
SELECT rid::VARCHAR AS record_id, 32::BIGINT AS start_sample, 48::BIGINT AS end_sample, CASE WHEN round(total, 9) >= 0 THEN 'positive-mean' ELSE 'nonpositive-mean' END AS label, round(1 / (1 + exp(-2 * abs(total))), 6) + 0.0 AS score FROM v""", "sig_embed_long"))
def score_view(spark, sf_dir):
    """The model's answer for half a second of each record, from 0.5 s on."""
    rows = experiment.score_view(_channels(spark, sf_dir), {**_METADATA}, 0.5, 0.25, "first", _sum_scores)
    return rows.select("record_id", "start_sample", "end_sample", F.get("predictions", F.lit(0))["label"].alias("label"), r6(F.get("predictions", F.lit(0))["score"]).alias("score"))


@query(duck("""+l AS (SELECT rid, sum(x) FILTER (i < 32) AS a, sum(x) FILTER (i >= 32) AS b FROM sig_embed_long GROUP BY rid)
SELECT rid, round(1 / (1 + exp(-a)), 6) + 0.0 AS sigmoid, round(1 / (1 + exp(-a)), 6) + 0.0 AS s0, round(1 / (1 + exp(-b)), 6) + 0.0 AS s1, round(a, 6) + 0.0 AS n0, round(1 / (1 + exp(b - a)), 6) + 0.0 AS m0 FROM l""", "sig_embed_long"))
def activations(spark, sf_dir):
    part = lambda a, n: F.aggregate(F.slice("data", a, n), F.lit(0.0), lambda s, x: s + x)
    logits = F.array(part(1, 32), part(33, 32))
    s, n, m = (evaluation.activated(logits, "logits", kind)[0] for kind in ("sigmoid", "none", "softmax"))
    return sig_embed(spark, sf_dir).select("rid", r6(F.get(evaluation.sigmoid(logits), F.lit(0))).alias("sigmoid"), r6(s[0]).alias("s0"), r6(s[1]).alias("s1"), r6(n[0]).alias("n0"), r6(m[0]).alias("m0"))


@query("WITH " + _ROLES.format(s="c_custkey", t="customer") + " SELECT c_custkey, c_custkey AS subject_id FROM customer JOIN roles ON s = c_custkey WHERE role = 'validation'")
def partition_records(spark, sf_dir):
    """The validation records where each record is its own subject."""
    records = evaluation.self_subjects(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return evaluation.records_of_role(records, "subject_id", "validation").select("c_custkey", "subject_id")


# --- files, headers, records --------------------------------------------------------------------------------------------


def _arrow(kind: str, arrow: pa.DataType, f):
    """A column function of whole Arrow batches: f over each row's values."""

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return pa.array([f(x.as_py()) for x in a], arrow)

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], arrow)

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def _hundredths(data) -> np.ndarray:
    return np.floor(np.array(data) * 100 + 0.5).astype(np.int64)


def _wfdb_files(spark, sf_dir, fmt: int):
    """A header and a data file for each embedding and its reverse: record r<rid>, at 64 Hz, gains 200 and 100, baselines 8 and -8."""

    def header(rid: int) -> bytes:
        return f"r{rid} 2 64 64 12:00:00 01/02/2020\nr{rid}.dat {fmt} 200(8)/mV 12 0 5 6 0 first\nr{rid}.dat {fmt} 100(-8)/mV 12 1 7 8 0 second lead\n# made of vector {rid}\n".encode()

    def body(data) -> bytes:
        v = _hundredths(data)
        return wfdb.encode_212(v, v[::-1]) if fmt == 212 else wfdb.encode_16([v, v[::-1]])

    rows = sig_embed(spark, sf_dir)
    name = lambda e: F.concat(F.lit("r"), F.col("rid").cast("string"), F.lit(e)).alias("name")
    heads = rows.select(name(".hea"), _arrow("binary", pa.binary(), header)("rid").alias("content"))
    return heads.unionByName(rows.select(name(".dat"), _arrow("binary", pa.binary(), body)("data").alias("content")))


def _record_sql(fmt: int) -> str:
    return duck(f"""+r AS (SELECT rid, i, floor(x * 100 + 0.5) AS v FROM sig_embed_long), c AS (SELECT rid, 0 AS channel_index, i, v FROM r UNION ALL SELECT rid, 1, 63 - i, v FROM r)
SELECT 'r' || rid AS record_id, 'r' || rid AS subject_id, channel_index, CASE channel_index WHEN 0 THEN 'first' ELSE 'second lead' END AS channel_name, channel_index AS adc_zero, 12 AS adc_bits,
  CASE channel_index WHEN 0 THEN 5 ELSE 7 END AS initial_value, '{fmt}' AS source_format, '# made of vector ' || rid AS comment, i::BIGINT AS i,
  round(CASE channel_index WHEN 0 THEN (v - 8) / 200.0::DOUBLE ELSE (v + 8) / 100.0::DOUBLE END, 6) + 0.0 AS y FROM c""", "sig_embed_long")


def _record_read(spark, sf_dir, fmt: int):
    rows = wfdb.read_channels(_wfdb_files(spark, sf_dir, fmt)).withColumn("comment", F.array_join("comments", "; "))
    mv = experiment.millivolt_signals(rows)
    return long_of(mv, ["record_id", "subject_id", "channel_index", "channel_name", "adc_zero", "adc_bits", "initial_value", "source_format", "comment"], F.col("data"))


@query(_record_sql(212))
def wfdb_record_read(spark, sf_dir):
    """Headers parsed, data files of format 212 found and decoded, channels named and calibrated."""
    return _record_read(spark, sf_dir, 212)


@query(_record_sql(16))
def wfdb16_record_read(spark, sf_dir):
    return _record_read(spark, sf_dir, 16)


@query(duck("SELECT 'u' || user_id AS record_id, ordinal::INT AS ordinal, sample_index, (ascii(symbol) % 9 + 1)::INT AS code, ['N','L','R','a','V','F','J','A','S'][ascii(symbol) % 9 + 1] AS symbol, symbol AS aux_note FROM ann_user", "ann_user"))
def wfdb_events_read(spark, sf_dir):
    """Each user's events as an annotation file, read from a table of files."""
    rows = ann_user(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("sample_index", "ordinal", "symbol"))).alias("e"))
    write = _arrow("binary", pa.binary(), lambda e: wfdb.encode_annotations([(x["sample_index"], ord(x["symbol"][0]) % 9 + 1, x["symbol"]) for x in e]))
    return wfdb.read_events(rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".atr")).alias("name"), write("e").alias("content")))


_LISTED = "(s_suppkey % 5 <> 4)"
_HAS = {"hea": "(s_suppkey % 3 <> 0)", "dat": "(s_suppkey % 4 <> 0)", "atr": "(s_suppkey % 2 = 0)"}


@query(f"""WITH s AS (SELECT 'x' || s_suppkey AS record_id, s_suppkey, {_LISTED} AS listed, {_HAS["hea"]} AS hea, {_HAS["dat"]} AS dat, {_HAS["atr"]} AS atr FROM supplier),
l AS (SELECT record_id, (row_number() OVER (ORDER BY s_suppkey) - 1)::INT AS position FROM s WHERE listed)
SELECT s.record_id, coalesce(l.position, -1)::INT AS position, listed AS in_records, hea AS has_header, dat AS has_data, atr AS has_annotations, hea AND s_suppkey % 7 <> 0 AS readable, hea AND s_suppkey % 7 <> 0 AND dat AS complete,
  CASE WHEN NOT hea THEN 'the record has no header file' WHEN s_suppkey % 7 = 0 THEN 'a header needs a record line and signal lines' WHEN NOT dat THEN 'data files that the header names are not there: ' || s.record_id || '.dat.' END AS problem
FROM s LEFT JOIN l USING (record_id) WHERE listed OR hea""")
def wfdb_catalogue(spark, sf_dir):
    """A RECORDS file and the files that some suppliers have: what is declared, what is there, and the first problem of each."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("id"))
    text = s.where(_LISTED).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "id"))), lambda x: x["id"]), "\n").alias("t"))
    listed = text.select(F.lit("RECORDS").alias("name"), F.concat(F.lit("# declared\n"), "t").cast("binary").alias("content"))
    line = F.concat("id", F.lit(" 1 360 6\n"), "id", F.lit(".dat 16 200 12 0 0 0 0 lead\n"))
    head = F.when(F.col("s_suppkey") % 7 == 0, F.lit("# nothing\n")).otherwise(line)
    parts = [s.where(_HAS[e]).select(F.concat("id", F.lit("." + e)).alias("name"), (head if e == "hea" else F.lit("")).cast("binary").alias("content")) for e in _HAS]
    return wfdb.catalogue(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(listed))[0].withColumn("position", F.coalesce("position", F.lit(-1)))


@query("SELECT 'n' || n_nationkey AS record_id, 'wfdb' AS format FROM nation WHERE n_nationkey % 2 = 0")
def record_discovery(spark, sf_dir):
    """The format of a set of files by their extensions, and the records that have a header."""
    n = read(spark, sf_dir, "nation")
    ext = F.when(F.col("n_nationkey") % 2 == 0, ".HEA").otherwise(".dat")
    found = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), ext).alias("name"), F.lit(b"").alias("content"))
    return files.record_ids(found, "hea").withColumn("format", F.lit(files.detect_format(found)))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS name FROM pages), b AS (SELECT page_id, regexp_extract(replace(name, '/', '\'), '[^\\]*$') AS bare FROM n)
SELECT page_id, bare, CASE WHEN regexp_matches(bare, '^.+\.[^.]*$') THEN regexp_extract(bare, '^(.+)\.[^.]*$', 1) ELSE bare END AS stem, lower(regexp_extract(bare, '^.+\.([^.]*)$', 1)) AS extension FROM b""")
def file_names(spark, sf_dir):
    """Bare names, stems and extensions of the pages' paths, written with either separator."""
    name = F.translate(F.regexp_replace("url", r"[?#].*$", ""), "/", "\\")
    rows = read(spark, sf_dir, "pages").select("page_id", naming.bare_name_column(name).alias("bare"))
    return rows.select("page_id", "bare", naming.stem_column(F.col("bare")).alias("stem"), naming.extension_column(F.col("bare")).alias("extension"))


@query("""SELECT p_partkey, CASE WHEN upper(trim(p)) IN ('', 'X') THEN 'r' || p_partkey ELSE trim(p) END AS subject_id, (p_size < -10)::INT + (p_size > 30)::INT AS beyond
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN ' x ' WHEN 1 THEN '' ELSE ' ' || p_name END AS p FROM part)""")
def edf_subjects(spark, sf_dir):
    """Subjects of EDF patient fields, and samples beyond a declared range."""
    k = F.col("p_partkey") % 4
    patient = F.when(k == 0, " x ").when(k == 1, "").otherwise(F.concat(F.lit(" "), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", edf.subject_column(patient, F.concat(F.lit("r"), F.col("p_partkey").cast("string"))).alias("subject_id"), edf.out_of_range_column(F.array("p_size", F.lit(0)), F.lit(-10), F.lit(30)).alias("beyond"))


@query(ORACLES["synthetic_record"].replace("SELECT record_id, channel_index, channel_name, i::BIGINT AS i, floor", "SELECT record_id, channel_index, channel_name, 'synthetic' AS dataset_id, rate AS sample_rate_hz, i::BIGINT AS i, floor"))
def default_records(spark, sf_dir):
    """The synthetic records as channel rows of a dataset, calibrated again."""
    rows = synthetic.synthetic_channels(_leads(spark, sf_dir)).withColumn("mv", timeaxis.samples_to_millivolt(F.col("samples"), F.col("gain"), F.col("baseline")))
    out = rows.select("record_id", "channel_index", "channel_name", "dataset_id", "sample_rate_hz", F.posexplode(F.arrays_zip("samples", "mv")).alias("i", "p"))
    return out.select("record_id", "channel_index", "channel_name", "dataset_id", "sample_rate_hz", F.col("i").cast("long").alias("i"), F.col("p.samples").cast("int").alias("adc"), r6("p.mv").alias("mv"))


# --- validation ---------------------------------------------------------------------------------------------------------

_PROBLEMS = (
    ("k % 5 = 0", "identity must not be empty"),
    ("k % 7 = 0", "subject must not be empty"),
    ("c_acctbal <= 0", "sample rate must be positive"),
    ("k % 4 = 0", "gain must be above zero"),
    ("k % 9 = 0", "unit must be adc, mV or normalized"),
    ("k % 6 = 0", "channels must have the declared length"),
    ("k % 3 = 0", "channel names must be unique"),
    ("k % 8 = 0", "annotations must not be before the start"),
    ("k % 11 = 0", "annotations must be sorted"),
    ("k % 10 = 0", "annotation symbols must not be empty"),
)


@query("SELECT k AS c_custkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _PROBLEMS) + "], lambda x: x IS NOT NULL), '; ') AS problems FROM (SELECT *, c_custkey AS k FROM customer)")
def record_problems(spark, sf_dir):
    k = F.col("c_custkey")
    channel = lambda name, unit, gain, n: F.struct(name.alias("name"), unit.alias("unit"), gain.alias("gain"), F.lit(0.0).alias("baseline"), F.array_repeat(F.lit(1), n).alias("samples"))
    chans = F.array(channel(F.lit("a"), F.when(k % 9 == 0, "volts").otherwise("mV"), F.when(k % 4 == 0, 0.0).otherwise(200.0), F.lit(6)), channel(F.when(k % 3 == 0, "a").otherwise("b"), F.lit("mV"), F.lit(1.0), F.when(k % 6 == 0, 5).otherwise(6)))
    note = lambda at, symbol: F.struct(at.cast("long").alias("sample_index"), symbol.alias("symbol"))
    first = F.when(k % 8 == 0, -1).otherwise(2)
    notes = F.array(note(first, F.when(k % 10 == 0, "").otherwise("N")), note(F.when(k % 11 == 0, first - 1 + 2 * (k % 8 == 0).cast("int")).otherwise(5), F.lit("V")))
    notes = F.when((k % 11 == 0) & (k % 8 == 0), F.array(note(F.lit(4), F.when(k % 10 == 0, "").otherwise("N")), note(F.lit(-1), F.lit("V")))).otherwise(notes)
    row = {"dataset_id": F.when(k % 5 == 0, " ").otherwise("d"), "record_id": F.col("c_name"), "subject_id": F.when(k % 7 == 0, "").otherwise("s"), "rate_hz": F.col("c_acctbal"), "start_sec": F.lit(0.0), "sample_count": F.lit(6), "channels": chans, "annotations": notes}
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(signals.record_problems(row), "; ").alias("problems"))


def _joined(*pairs: tuple[str, str]) -> str:
    """SQL of the sentences whose condition holds, joined."""
    whens = ", ".join("CASE WHEN {} THEN '{}' END".format(c, t.replace("'", "''")) for c, t in pairs)
    return f"array_to_string(list_filter([{whens}], lambda p: p IS NOT NULL), '; ')"


_SEMANTICS = ", ".join(documents.SEMANTICS)


@query(f"""SELECT p_partkey, {_joined(
    ("p_size % 9 = 8", "modelVersion must be a non-empty string"),
    ("p_size <= 12", "expectedSamplingRateHz must be above zero when present"),
    ("p_size % 2 = 1", "expectedChannels must be a positive integer when present"),
    ("p_brand LIKE 'Brand#1%'", "input.layout must be a non-empty string"),
    ("p_size % 4 = 1", "input.shape must be a non-empty array of dimensions of at least 1, or -1"),
    ("p_type = 'PROMO'", "input.dtype must be a supported type"),
    ("p_retailprice >= 950", f"output.semantics must be one of {_SEMANTICS}"),
    ("p_size % 5 = 0", "output.classLabels must be a non-empty array of non-empty strings"),
    ("p_size % 6 = 0", "preprocessingAssumptions[1] must have a stage, and an object as config when present"),
    ("p_name LIKE '%widget'", "normalization must have a strategy, and a non-empty fittedFrom when present"),
    ("p_size % 7 = 3", "provenance must be an object of non-empty strings when present"))} AS problems FROM part""")
def metadata_problems(spark, sf_dir):
    """Model metadata written from each part's columns as JSON, and all that is wrong with it: sizes as rates, channels and shapes, brands and names as texts."""
    size, words = F.col("p_size"), F.split("p_name", " ")
    input_ = F.struct(F.lit("signal").alias("name"), F.when(F.col("p_brand").startswith("Brand#1"), " ").otherwise(F.col("p_brand")).alias("layout"), F.array(size % 4 - 1, size + 1).alias("shape"), F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise("float32").alias("dtype"))
    output = F.struct(F.lit("out").alias("name"), F.lit("float64").alias("dtype"), F.when(F.col("p_retailprice") >= 950, F.col("p_name")).otherwise("logits").alias("semantics"), F.lit("none").alias("activation"), F.slice(words, F.lit(1), F.least(F.lit(2), size % 5)).alias("classLabels"))
    config = F.struct(size.alias("by"))
    steps = F.array(F.struct(F.element_at(words, 1).alias("stage"), config.alias("config")), F.struct(F.when(size % 6 == 0, "").otherwise(F.col("p_type")).alias("stage"), config.alias("config")))
    scale = F.struct(F.lit("z-score").alias("strategy"), F.regexp_replace("p_name", "^.*widget$", "").alias("fittedFrom"))
    text = F.to_json(
        F.struct(
            F.col("p_name").alias("modelId"), F.substring("p_brand", F.when(size % 9 == 8, 99).otherwise(F.lit(1)), F.lit(20)).alias("modelVersion"), F.col("p_type").alias("task"),
            (size - 12).alias("expectedSamplingRateHz"), (size / 2.0).alias("expectedChannels"), input_.alias("input"), output.alias("output"), steps.alias("preprocessingAssumptions"),
            scale.alias("normalization"), F.create_map(F.lit("methodology"), F.when(size % 7 == 3, F.lit(" ")).otherwise(F.col("p_name"))).alias("provenance"),
        )
    )
    return spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.array_join(checks.metadata_problems(text), "; ").alias("problems"))


@query(f"""SELECT c_custkey, {_joined(
    ("c_custkey % 9 = 4", "datasetId must be a non-empty string"),
    ("c_nationkey < 12 AND c_nationkey % 4 = 0", "selection.recordIds must list non-empty record ids"),
    ("c_nationkey >= 12 AND c_nationkey < 20 AND c_mktsegment <> 'BUILDING'", f"selection.role must be one of {', '.join(evaluation.ROLES)}"),
    ("c_nationkey >= 12 AND c_nationkey < 20 AND (c_nationkey <> 16 OR c_acctbal < 0)", f"selection.partition: {documents.SPLIT_TEXT}"),
    ("c_nationkey >= 20", "selection.kind must be records or subject-partition"),
    ("c_acctbal < 1", "window.windowLengthSamples must be a positive integer"),
    ("c_nationkey % 2 = 1", "window.strideSamples must be a positive integer"),
    ("c_mktsegment NOT IN ('MACHINERY', 'BUILDING')", "window.remainderPolicy must be drop, pad-zero or error"),
    ("c_custkey % 5 = 0", "evaluation.description must be a non-empty string"))} AS problems FROM customer""")
def configuration_problems(spark, sf_dir):
    """Configurations written from each customer's columns as JSON: nations choose the selection and shares, balances the window."""
    nation, key, segment = F.col("c_nationkey"), F.col("c_custkey"), F.col("c_mktsegment")
    kind = F.when(nation < 12, "records").when(nation < 20, "subject-partition").otherwise(segment)
    share = nation / 32.0
    split = F.struct(share.alias("train"), share.alias("validation"), F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).otherwise(0.0).alias("test"))
    selection = F.struct(kind.alias("kind"), F.slice(F.array("c_name", segment, "c_name"), F.lit(1), nation % 4).alias("recordIds"), F.when(segment == "BUILDING", "test").otherwise(segment).alias("role"), split.alias("partition"))
    window = F.struct(F.floor("c_acctbal").alias("windowLengthSamples"), (nation / 2.0 + 1).alias("strideSamples"), F.when(segment == "MACHINERY", "drop").when(segment == "BUILDING", "error").otherwise(segment).alias("remainderPolicy"))
    model = F.struct(F.col("c_name").alias("modelId"), segment.alias("modelVersion"))
    judged = F.struct(F.lit("truth").alias("id"), F.when(key % 5 == 0, "").otherwise(F.col("c_name")).alias("description"))
    text = F.to_json(F.struct(F.when(key % 9 != 4, segment).alias("datasetId"), F.lit("lead").alias("channelName"), selection.alias("selection"), window.alias("window"), model.alias("model"), judged.alias("evaluation")))
    return spread(read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.array_join(checks.configuration_problems(text), "; ").alias("problems"))


@query("""WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lowpass' WHEN 1 THEN 'highpass' WHEN 2 THEN 'bandpass' ELSE p_type END AS kind, p_size / 2.0::DOUBLE AS low, CASE WHEN p_partkey % 4 = 2 OR p_partkey % 10 = 0 THEN p_retailprice - 930 END AS high, p_size AS taps, (p_partkey % 90 - 5)::DOUBLE AS rate FROM part),
g AS (SELECT *, kind IN ('lowpass', 'highpass', 'bandpass') AS known, rate > 0 AS rated, (kind = 'bandpass') = (high IS NOT NULL) AS shaped,
  low > 0 AND low < rate / 2 AND (kind <> 'bandpass' OR high > 0 AND high < rate / 2 AND low < high) AS ordered FROM f)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT rated THEN 'the sample rate must be above zero' END, CASE WHEN taps < 5 OR taps % 2 = 0 THEN 'the number of taps must be odd and at least 5' END,
  CASE WHEN NOT known THEN 'the type must be lowpass, highpass or bandpass' END, CASE WHEN known AND NOT shaped THEN 'a band takes two cutoffs, other filters one' END,
  CASE WHEN known AND rated AND shaped AND NOT ordered THEN 'cutoffs must be ordered and between zero and half the rate' END], lambda p: p IS NOT NULL), '; ') AS problems FROM g""")
def filter_refusals(spark, sf_dir):
    """A filter for each part, its type, cutoffs, taps and rate by the part's columns, and why it can't be designed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 4 == 0, "lowpass").when(key % 4 == 1, "highpass").when(key % 4 == 2, "bandpass").otherwise(F.col("p_type"))
    high = F.when((key % 4 == 2) | (key % 10 == 0), F.col("p_retailprice") - 930)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(K.filter_problems(kind, size / F.lit(2.0), high, size, (key % 90 - 5).cast("double")), "; ").alias("problems"))


@query("""WITH s AS (SELECT c_custkey, c_nationkey / 16.0::DOUBLE AS a, c_custkey % 5 / 8.0::DOUBLE AS b, CASE WHEN c_acctbal < 0 THEN -0.25 ELSE (c_nationkey % 3) / 8.0::DOUBLE END AS c, c_mktsegment, c_nationkey, c_acctbal FROM customer)
SELECT c_custkey, CASE WHEN c >= 0 AND abs(a + b + c - 1) <= 1e-9 THEN '' ELSE 'a split''s fractions must be at least 0 and add up to 1' END AS split,
  array_to_string(list_filter([CASE WHEN c_nationkey % 4 = 0 THEN 'at least one label is needed' END, CASE WHEN c_nationkey % 4 = 3 THEN 'labels must be unique' END,
    CASE WHEN c_nationkey % 4 = 0 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'labels are not declared: ' || c_mktsegment END], lambda p: p IS NOT NULL), '; ') AS labels,
  CASE WHEN c_nationkey % 4 = 2 THEN '' ELSE 'a filter bank needs two filters of one even length' END AS bank FROM s""")
def split_and_label_refusals(spark, sf_dir):
    """Splits, declared labels and filter banks made from each customer's columns, and why they are refused."""
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    third = F.when(F.col("c_acctbal") < 0, F.lit(-0.25)).otherwise((nation % 3) / F.lit(8.0))
    split = evaluation.split_problems(nation / F.lit(16.0), (key % 5) / F.lit(8.0), third)
    declared = F.slice(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("BUILDING")), F.lit(1), nation % 4)
    declared = F.when(nation % 4 == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).otherwise(declared)
    taps = F.array_repeat(F.lit(0.5), nation % 4)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(split, "; ").alias("split"), F.array_join(evaluation.label_problems(declared, F.array("c_mktsegment")), "; ").alias("labels"), F.array_join(K.bank_problems(taps, taps), "; ").alias("bank"))


_WANTED = documents.probe_metadata("small widget", 360, 25)


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size END * CASE WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS n FROM part) SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_name <> 'small widget' THEN 'modelId is ''' || p_name || ''' instead of ''small widget''' END,
  CASE WHEN p_size > 40 THEN 'dtype is ''float64'' instead of ''float32''' END,
  CASE WHEN p_size % 10 = 0 THEN 'the shape must be concrete' END,
  CASE WHEN p_type = 'PROMO' THEN 'the shape has rank 2 instead of 1' WHEN p_size % 10 = 0 THEN 'the shape has dimension 0 is 0 instead of 25' WHEN p_size <> 25 THEN 'the shape has dimension 0 is ' || p_size || ' instead of 25' END,
  CASE WHEN p_size % 10 <> 0 AND n <> 25 THEN 'the shape holds ' || n || ' elements, the payload 25' END,
  CASE WHEN p_partkey % 3 = 0 THEN 'the preprocessing fingerprint is another model''s' END], lambda p: p IS NOT NULL), '; ') AS problems FROM p""")
def input_problems(spark, sf_dir):
    """Prepared inputs of each part, by its name, size and type, against a model of windows of 25 samples."""
    size = F.col("p_size")
    known = documents.fingerprint(_WANTED)
    first = F.when(size % 10 == 0, 0).otherwise(size)
    given = {"model_id": F.col("p_name"), "model_version": F.lit("1.0.0"), "tensor_name": F.lit("signal"), "dtype": F.when(size > 40, "float64").otherwise("float32"), "shape": F.when(F.col("p_type") == "PROMO", F.array(first, F.lit(2))).otherwise(F.array(first)), "count": F.lit(25), "fingerprint": F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(known)}
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(checks.input_problems(_WANTED, known, given), "; ").alias("problems"))


_FNV_SQL = "lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296::UBIGINT))), 8, '0')"


@query(f"""WITH m AS (SELECT p_partkey, concat_ws(chr(1), replace(p_name, ' ', '-'), 'v' || p_size, 'task', 'signal', 'float32', 'samples', p_size || ',-1', '360', '', p_size, 'scale:{{"by":' || p_size || '}}', 'z-score', '') AS t FROM part)
SELECT p_partkey, t AS parts, {_FNV_SQL.format(x="replace(t, chr(1), '#')")} AS hash FROM m""")
def model_fingerprint(spark, sf_dir):
    """What a fingerprint hashes: identity, input, optional expectations, canonical JSON of the steps, scaling."""

    def parts(name: str, size: int) -> str:
        m = {"modelId": name.replace(" ", "-"), "modelVersion": f"v{size}", "task": "task", "input": {"name": "signal", "dtype": "float32", "layout": "samples", "shape": [size, -1]}, "expectedSamplingRateHz": 360.0, "expectedWindowSamples": size}
        return "\x01".join(documents.fingerprint_parts({**m, "preprocessingAssumptions": [{"stage": "scale", "config": {"by": size}}], "normalization": {"strategy": "z-score"}}))

    rows = read(spark, sf_dir, "part").select("p_partkey", _arrow("string", pa.string(), parts)("p_name", "p_size").alias("parts"))
    return rows.select("p_partkey", "parts", naming.fnv1a_column(F.replace("parts", F.lit("\x01"), F.lit("#"))).alias("hash"))


@query("""WITH t AS (SELECT p_partkey, p_size, p_name || ' ' || chr((233 + p_size)::INT) || chr((20000 + p_partkey % 5000)::INT) || chr((128512 + p_partkey % 70)::INT) || p_brand AS x FROM part),
u AS (SELECT p_partkey, p_size, x, flatten(list_transform(list_transform(range(1, length(x) + 1), lambda i: unicode(substr(x, i, 1))::UBIGINT),
  lambda p: CASE WHEN p > 65535 THEN [55296 + ((p - 65536) >> 10), 56320 + ((p - 65536) & 1023)] ELSE [p] END)) AS units FROM t)
SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, units), lambda h, c: (xor(h, c::UBIGINT) * 16777619) % 4294967296::UBIGINT))), 8, '0') AS hash,
  '{"a":[' || p_size || ',"' || x || '"],"b":{"c":null,"d":' || p_size || '.5},"z":true}' AS document FROM u""")
def fnv1a_utf16(spark, sf_dir):
    """Hashes of texts with characters of one, two, three and four bytes, and canonical JSON of documents that have them."""
    key, size = F.col("p_partkey"), F.col("p_size")
    character = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")
    x = F.concat("p_name", F.lit(" "), character(233 + size), character(20000 + key % 5000), character(128512 + key % 70), "p_brand")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", x.alias("x"))
    text = F.concat(F.lit('{"z": true, "b": {"d": '), size.cast("string"), F.lit('.50, "c": null},  "a": ['), size.cast("string"), F.lit(', "'), F.col("x"), F.lit('"]}'))
    return rows.select("p_partkey", naming.fnv1a_column(F.col("x")).alias("hash"), naming.canonical_json_column(text).alias("document"))


@query("""SELECT p_partkey, CASE WHEN (p_size * 6) % 12 = 0 THEN '[12, ' || p_size * 6 // 12 || ']' ELSE '' END AS shape, (p_size * 12)::BIGINT AS elements,
  CASE WHEN p_size = 7 THEN '' ELSE 'dimension 1 is ' || p_size || ' instead of 7' END AS mismatch FROM part""")
def tensor_shapes(spark, sf_dir):
    """A contract [12, -1] filled in, the elements of a shape, and what differs from another."""
    text = _arrow("string", pa.string(), lambda n: str(documents.realise_shape([12, -1], n * 6) or ""))
    count = _arrow("long", pa.int64(), lambda n: documents.element_count([12, n]))
    other = _arrow("string", pa.string(), lambda n: documents.shape_mismatch([12, 7], [12, n]) or "")
    return read(spark, sf_dir, "part").select("p_partkey", text("p_size").alias("shape"), count("p_size").alias("elements"), other("p_size").alias("mismatch"))


@query("""SELECT c_custkey, c_mktsegment IN ('adc', 'mV', 'normalized') OR c_custkey % 4 = 1 AS is_unit, c_custkey % 3 = 0 AS is_code FROM customer""")
def units_and_codes(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.lit("malformed-signal")).when(k % 3 == 1, F.lit("unknown"))
    return read(spark, sf_dir, "customer").select("c_custkey", timeaxis.is_unit(F.when(k % 4 == 1, "mV").otherwise(F.col("c_mktsegment"))).alias("is_unit"), errors.is_error_code_column(code).alias("is_code"))


# --- names, ids and captions ----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'r' || c_custkey || '/ch/' || c_nationkey || '/w' || c_custkey * 3 AS window_id,
  'm@2 :: ' || c_name || ' :: ' || c_nationkey || ' :: [' || c_custkey || ', ' || c_custkey + 5 || ')' AS candidate_id,
  c_mktsegment || '/' || c_name || ' :: filter-bandpass-0.5-40hz-zero :: dwt-db4-level5-periodic' AS analysis_id,
  'idwt-db4-level5-periodic' AS inverse, 'normalize-min-max-global' AS scaling, 'resample-128hz' AS rate,
  'd :: records[a,b] :: lead :: m@2 :: w360s180-pad-zero :: gt:g :: filter:filter-bandpass-0.5-40hz-zero' AS experiment_id,
  'subject-partition:role=test(0.7/0.15/0.15)' AS selection FROM customer""")
def identifiers(spark, sf_dir):
    spec = {"type": "bandpass", "cutoff_hz": [0.5, 40.0], "taps": 65, "phase": "zero"}
    config = {"datasetId": "d", "selection": {"kind": "records", "recordIds": ["a", "b"]}, "channelName": "lead", "model": {"modelId": "m", "modelVersion": "2"}, "window": {"windowLengthSamples": 360, "strideSamples": 180, "remainderPolicy": "pad-zero"}, "evaluation": {"id": "g"}, "preprocessing": {"filter": spec}}
    k, name = F.col("c_custkey"), F.col("c_name")
    selection = naming.selection_name({"kind": "subject-partition", "role": "test", "partition": {"train": 0.7, "validation": 0.15, "test": 0.15}})
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        naming.window_id(F.concat(F.lit("r"), k.cast("string")), F.col("c_nationkey"), k * 3).alias("window_id"),
        naming.candidate_id("m", "2", name, F.col("c_nationkey").cast("string"), k, k + 5).alias("candidate_id"),
        naming.analysis_id(F.col("c_mktsegment"), name, naming.dwt_name("db4", 5), naming.filter_name(spec)).alias("analysis_id"),
        F.lit(naming.idwt_name("db4", 5)).alias("inverse"),
        F.lit(naming.normalisation_name("min-max", "global")).alias("scaling"),
        F.lit(naming.resample_name(128.0)).alias("rate"),
        F.lit(documents.experiment_id(config)).alias("experiment_id"),
        F.lit(selection).alias("selection"),
    )


@query("""WITH e AS (SELECT event_id, event_id % 4000 AS s, event_type, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'note' END AS note, event_id % 13 AS v, CASE WHEN event_id % 2 = 0 THEN 150.0 + event_id % 7 ELSE -(event_id % 9) / 10.0::DOUBLE END AS a FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Cursor: —' ELSE printf('Cursor: %.2f s · sample %d', s / 50.0::DOUBLE, s) || CASE WHEN event_id % 3 = 1 THEN ' · nearest ' || event_type ELSE '' END END AS cursor_text,
  'Annotation: ' || event_type || ' · sample ' || s || CASE WHEN event_id % 3 = 1 THEN ' · note' ELSE '' END AS detail,
  CASE WHEN v = 0 THEN 'No annotations in view' WHEN v > 9 THEN 'Showing first 9 of ' || v || ' in view' ELSE v || ' in view' END AS caption,
  v || ' annotation(s)' || CASE WHEN v > 6 THEN ', ' || (v - 6) || ' merged' ELSE '' END AS summary,
  CASE WHEN abs(a) >= 100 THEN printf('%.0f', a) ELSE printf('%.2f', a) END AS amplitude, (s % 50) / 2.0 || '' AS hz, '≈ ' || (s % 50) || '–' || (s % 50 + 7) || ' Hz' AS band FROM e""".replace("(s % 50) / 2.0 || ''", "regexp_replace(((s % 50) / 2.0::DOUBLE)::VARCHAR, '[.]0$', '')"))
def captions(spark, sf_dir):
    k = F.col("event_id")
    s, v = k % 4000, k % 13
    time = F.when(k % 5 != 0, s / F.lit(50.0))
    note = F.when(k % 3 == 0, "").when(k % 3 == 1, "note")
    amplitude = F.when(k % 2 == 0, F.lit(150.0) + k % 7).otherwise(-(k % 9) / F.lit(10.0))
    band = F.struct((s % 50).cast("double").alias("low_hz"), (s % 50 + 7).cast("double").alias("high_hz"))
    return read(spark, sf_dir, "events").select(
        "event_id",
        viewport.format_cursor(time, s, F.when(k % 3 == 1, F.col("event_type"))).alias("cursor_text"),
        viewport.format_annotation(F.col("event_type"), s, note).alias("detail"),
        viewport.format_list_caption(F.lit(9), v, v > 9).alias("caption"),
        viewport.format_marker_summary(v, F.greatest(F.lit(0), v - 6)).alias("summary"),
        viewport.format_amplitude(amplitude).alias("amplitude"),
        viewport.format_frequency((s % 50) / F.lit(2.0)).alias("hz"),
        K.band_text(band).alias("band"),
    )


# --- time axis, views and arrays --------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, 100.0::DOUBLE AS bd, 0.5 + (event_id % 4) AS b0, (event_id % 13) / 10.0::DOUBLE - 0.1::DOUBLE AS f, (event_id % 7) / 6.0::DOUBLE AS g FROM events),
c AS (SELECT *, least(1.0, greatest(0.0, f)) AS p, least(1.0, greatest(0.0, g)) AS q FROM e),
d AS (SELECT *, least(p, q) AS low, least(bd, greatest(2 / 64.0::DOUBLE, (greatest(p, q) - least(p, q)) * bd)) AS sec FROM c)
SELECT event_id, round(bd, 6) + 0.0 AS bounds_sec, round(least(b0 + bd - sec, greatest(b0, b0 + low * bd)), 6) + 0.0 AS start_sec, round(sec, 6) + 0.0 AS duration_sec, round(b0, 6) + 0.0 AS whole_start FROM d""")
def viewport_fractions(spark, sf_dir):
    """The view between two fractions of a record of 6,400 samples at 64 Hz that starts anywhere."""
    k = F.col("event_id")
    start = F.lit(0.5) + k % 4
    bounds = viewport.bounds_of(64.0, start, 6400)
    v = viewport.from_fractions(bounds, (k % 13) / F.lit(10.0) - F.lit(0.1), (k % 7) / F.lit(6.0), viewport.least_duration(64.0))
    whole = timeaxis.whole_record(64.0, start, F.lit(6400))
    return read(spark, sf_dir, "events").select("event_id", r6(whole["duration_sec"]).alias("bounds_sec"), r6(v["start_sec"]).alias("start_sec"), r6(v["duration_sec"]).alias("duration_sec"), r6(whole["start_sec"]).alias("whole_start"))


@query("""SELECT p_partkey, (100 + p_size)::DOUBLE AS rate_hz, p_size = 7 AS same, abs(p_size - 7.0) * (CASE WHEN p_partkey % 2 = 0 THEN 1e-7 ELSE 1 END) <= 1e-6 * (100 + p_size) AS close FROM part""")
def sampling_checks(spark, sf_dir):
    rate = (100 + F.col("p_size")).cast("double")
    a, b = timeaxis.sampling(rate, 0.0), timeaxis.sampling(F.lit(107.0), 0.0)
    other = rate + (F.col("p_size") - 7) * F.when(F.col("p_partkey") % 2 == 0, 1e-7).otherwise(1.0)
    return read(spark, sf_dir, "part").select("p_partkey", a["sample_rate_hz"].alias("rate_hz"), timeaxis.same_sampling(a, b).alias("same"), timeaxis.rates_equal(rate, other).alias("close"))


@query(duck("""+m AS (SELECT rid, max(label) AS label, list(x ORDER BY i) AS v FROM sig_embed_long GROUP BY rid)
SELECT rid, CASE WHEN label % 3 = 1 THEN 'second' ELSE 'first' END AS channel, round(list_sum(list_transform(v, lambda x: x * x)), 6) + 0.0 AS squares, label % 2 = 0 AS close,
  round(coalesce(list_min(v[label % 60 + 1:label % 60 + 8]), 0), 6) + 0.0 AS low, round(coalesce(list_max(v[label % 60 + 1:label % 60 + 8]), 0), 6) + 0.0 AS high FROM m""", "sig_embed_long"))
def array_measures(spark, sf_dir):
    """A chosen channel, inner products, closeness and the range of some samples."""
    d, label = F.col("data"), F.col("label")
    chans = F.array(F.struct(F.lit("first").alias("name"), d.alias("data")), F.struct(F.lit("second").alias("name"), d.alias("data")))
    pick = F.when(label % 3 == 1, signals.select_channel(chans, "second")["name"]).when(label % 3 == 2, signals.select_channel(chans, "unknown")["name"]).otherwise(signals.select_channel(chans, None)["name"])
    near = F.transform(d, lambda x: x + F.when(label % 2 == 0, 1e-12).otherwise(0.5))
    part = signals.reduce_range(d, label % 60, label % 60 + 8)
    return sig_embed(spark, sf_dir).select("rid", pick.alias("channel"), r6(signals.inner_product(d, d)).alias("squares"), signals.arrays_close(d, near).alias("close"), r6(part["min"]).alias("low"), r6(part["max"]).alias("high"))


@query(duck(_dwt_levels(2) + """, k AS (SELECT rid, unnest(range(0, 6)) AS bucket FROM (SELECT DISTINCT rid FROM a0)),
e AS (SELECT k.rid, bucket::INT AS bucket, min(x) AS lo, max(x) AS hi FROM k LEFT JOIN d2 ON d2.rid = k.rid AND d2.i - 2 >= (bucket * 11) // 6 AND d2.i - 2 < ((bucket + 1) * 11) // 6 GROUP BY k.rid, bucket)
SELECT rid, bucket, round(coalesce(lo, 0.0), 6) + 0.0 AS min, round(coalesce(hi, 0.0), 6) + 0.0 AS max, lo IS NOT NULL AS populated FROM e""", "sig_embed_long"))
def coefficient_envelope(spark, sf_dir):
    """Level-2 details that a view from sample 8 to 52 reaches (coefficients 2 to 12), in six columns."""
    s = sig_embed(spark, sf_dir)
    long = signals.to_long(s.select("rid", K.band_column(F.col("data"), 2, 2).alias("data")), ["rid"])
    reach = K.coefficient_range(F.struct(F.lit(8).cast("long").alias("start"), F.lit(52).cast("long").alias("end")), F.lit(2), F.lit(16))
    ranges = s.select("rid", reach["start"].alias("win_start"), reach["end"].alias("win_end"))
    return signals.coefficient_envelope(long, ["rid"], ranges, 6).select("rid", "bucket", r6("min").alias("min"), r6("max").alias("max"), "populated")


@query(duck("SELECT user_id, sample_index, symbol FROM ann_user WHERE symbol = (SELECT min(event_type) FROM events)", "ann_user"))
def symbol_filter_one(spark, sf_dir):
    a = ann_user(spark, sf_dir)
    return events.filter_symbol(a, a.agg(F.min("symbol")).first()[0]).select("user_id", "sample_index", "symbol")


@query("""SELECT c_custkey, array_to_string(list_filter(['A', 'N', c_mktsegment, 'V'], lambda s: list_contains(['V', c_mktsegment, 'z'], s)), ',') AS chosen,
  CASE WHEN c_custkey % 3 = 0 THEN 'N' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS one FROM customer""")
def symbol_resolve(spark, sf_dir):
    """Chosen symbols that are still there, in the order of those that are."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    there = F.array(F.lit("A"), F.lit("N"), seg, F.lit("V"))
    active = F.when(k % 3 == 0, F.lit("N")).when(k % 3 == 1, seg).otherwise(F.lit("gone"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(events.resolve_symbols(F.array(F.lit("V"), seg, F.lit("z")), there), ",").alias("chosen"), F.coalesce(events.resolve_symbol(active, there), F.lit("")).alias("one"))


# --- requests -----------------------------------------------------------------------------------------------------------------


@query(duck(_dwt_levels(2) + """, g AS (SELECT rid, max(label) AS label FROM sig_embed_long GROUP BY rid)
SELECT g.rid, CASE WHEN label % 4 = 3 THEN 'invalid-input' WHEN label % 4 = 2 THEN 'malformed-signal' ELSE '' END AS error, CASE WHEN label % 4 < 2 THEN e.energy END AS energy
FROM g LEFT JOIN (SELECT rid, round(sum(x * x), 6) + 0.0 AS energy FROM a2 GROUP BY rid) e USING (rid)""", "sig_embed_long"))
def dsp_requests(spark, sf_dir):
    """Decomposition requests, some of them with a missing sample or a level of 9, answered or refused one by one."""
    k = F.col("label") % 4
    data = F.when(k == 2, F.concat("data", F.array(F.lit(float("nan"))))).otherwise(F.col("data"))
    rows = sig_embed(spark, sf_dir).select("rid", data.alias("data"), F.lit(RATE_HZ).alias("sample_rate_hz"), F.when(k == 3, 9).otherwise(2).alias("level"), F.lit(None).cast("struct<type:string,cutoff_low_hz:double,cutoff_high_hz:double,taps:int,phase:string>").alias("filter"))
    got = requests.answer_dsp(rows)
    return got.select("rid", F.coalesce("error.code", F.lit("")).alias("error"), r6(F.aggregate(F.element_at("bands", -1), F.lit(0.0), lambda s, x: s + x * x)).alias("energy"))


def _sums(x):
    return [float(x.astype(float).sum()), -float(x.astype(float).sum())]


@query(duck("""+g AS (SELECT rid, max(label) AS label, sum(x::FLOAT::DOUBLE) AS s FROM sig_embed_long GROUP BY rid)
SELECT rid, CASE label % 3 WHEN 1 THEN 'model-loading-failure' WHEN 2 THEN 'inference-failure' ELSE '' END AS error, CASE WHEN label % 3 = 0 THEN round(s, 4) + 0.0 END AS score FROM g""", "sig_embed_long"))
def inference_requests(spark, sf_dir):
    model = F.when(F.col("label") % 3 == 0, "sums@1").when(F.col("label") % 3 == 1, "gone@1").otherwise("bad@1")
    got = requests.answer_inference(sig_embed(spark, sf_dir).select("rid", model.alias("model"), "data"), {"sums@1": _sums, "bad@1": lambda x: [float("nan")]})
    return got.select("rid", F.coalesce("error.code", F.lit("")).alias("error"), (F.round(F.get("values", F.lit(0)), 4) + 0.0).alias("score"))


# --- generated signals ------------------------------------------------------------------------------------------------------------


def _recipes_sql() -> str:
    """The seven kinds by their formulas; the noise's uniform numbers are a function of seed and place in the sequence."""
    word, t = "4294967296::HUGEINT", "(i / 360.0::DOUBLE)"
    bumps = " + ".join(f"CASE WHEN abs(i - (b * gap + {at} * 360.0::DOUBLE)) <= {synthetic.SPREAD} * {sd} * 360.0::DOUBLE THEN {share}::DOUBLE * exp(-0.5 * ((i - (b * gap + {at} * 360.0::DOUBLE)) / ({sd} * 360.0::DOUBLE)) ** 2) ELSE 0 END" for at, sd, share in synthetic.BEAT)
    return f"""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS z, p_size, p_retailprice, p_partkey % 7 AS kind, 40 + p_size AS n FROM part),
s AS (SELECT *, unnest(range(0, n)) AS i FROM p),
u0 AS (SELECT p_partkey, k, (p_partkey::HUGEINT + k::HUGEINT * 1831565813) % {word} AS s FROM (SELECT *, unnest(range(1, n + 2)) AS k FROM p WHERE kind = 5)),
u1 AS (SELECT p_partkey, k, (xor(s, s >> 15) * (s | 1)) % {word} AS t FROM u0),
u2 AS (SELECT p_partkey, k, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % {word}) % {word}) AS t FROM u1),
u AS (SELECT p_partkey, k, (xor(t, t >> 14) % {word})::DOUBLE / 4294967296.0::DOUBLE AS u FROM u2),
g AS (SELECT a.p_partkey, a.k // 2 AS j, sqrt(-2 * ln(a.u)) AS r, 2 * pi() * b.u AS w FROM u a JOIN u b ON b.p_partkey = a.p_partkey AND b.k = a.k + 1 WHERE a.k % 2 = 1),
n AS (SELECT p_partkey, 2 * j AS i, r * cos(w) AS x FROM g UNION ALL SELECT p_partkey, 2 * j + 1, r * sin(w) FROM g),
e AS (SELECT p_partkey, i, sum({bumps}) AS x FROM (SELECT *, floor(21600 / (300 + z * 20) + 0.5) AS gap, unnest(range(0, 8)) AS b FROM s WHERE kind = 6) WHERE b * gap < n GROUP BY p_partkey, i)
SELECT s.p_partkey, s.i::BIGINT AS i, round(CASE kind WHEN 0 THEN CASE WHEN s.i = p_size % 40 THEN p_retailprice / 1000 ELSE 0 END WHEN 1 THEN z / 10
  WHEN 2 THEN 0.25 + 0.5 * sin(2 * pi() * z * {t.replace('i', 's.i')} + z / 7) WHEN 3 THEN sin(2 * pi() * z * {t.replace('i', 's.i')}) + z / 50 * sin(2 * pi() * 3 * z * {t.replace('i', 's.i')})
  WHEN 4 THEN sin(2 * pi() * (0.5 * {t.replace('i', 's.i')} + 0.5 * ((z - 0.5) / ((n - 1) / 360.0::DOUBLE)) * {t.replace('i', 's.i')} * {t.replace('i', 's.i')}))
  WHEN 5 THEN z / 100 * n.x ELSE e.x END, 6) + 0.0 AS x FROM s LEFT JOIN n ON n.p_partkey = s.p_partkey AND n.i = s.i LEFT JOIN e ON e.p_partkey = s.p_partkey AND e.i = s.i"""


@query(_recipes_sql())
def noise_recipe(spark, sf_dir):
    """A signal for each part, of the kind that its key chooses, with lengths, amplitudes, frequencies and seeds of its columns."""
    key, z = F.col("p_partkey"), F.col("p_size").cast("double")
    kinds = ("impulse", "constant", "sine", "multi-frequency", "chirp", "noise", "synthetic-ecg")
    of = lambda *which: key.isNotNull() & (key % 7).isin(*which)
    fields = {
        "kind": F.get(F.array(*map(F.lit, kinds)), (key % 7).cast("int")), "length": (F.col("p_size") + 40).cast("int"),
        "amplitude": F.when(of(0), F.col("p_retailprice") / 1000).when(of(2), 0.5).otherwise(1.0), "at_index": F.when(of(0), (F.col("p_size") % 40).cast("int")),
        "offset": F.when(of(1), z / 10).when(of(2), 0.25).otherwise(0.0), "frequency_hz": z, "phase_rad": z / 7, "amplitudes": F.array(F.lit(1.0), z / 50), "frequencies_hz": F.array(z, 3 * z),
        "f0_hz": F.lit(0.5), "f1_hz": z, "std": z / 100, "seed": key, "heart_rate_bpm": 300 + z * 20,
    }
    rows = spread(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", synthetic.generated(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("data"))
    return rows.select("p_partkey", F.posexplode("data").alias("i", "x")).select("p_partkey", F.col("i").cast("long").alias("i"), r6("x").alias("x"))
