"""Rules over columns of JSON documents: what is wrong with model metadata, configurations and experiment results, row by row.

Texts are parsed to VARIANT. A rule is a condition on paths of it and the sentence it gives; a row's problems are an array<string>, in
the order and words of `sources.documents`, which judges one document in Python. A result's metrics are counted again from
its windows by grouping, so that no document reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.naming import SEPARATOR
from pulsegrid.operators.evaluation import ROLES
from pulsegrid.plans.storage import materialise
from pulsegrid.sources.documents import ACTIVATIONS, DTYPES, RESULT_TEXTS, SEMANTICS, SPLIT_TEXT

_TEXTS = "array<string>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(v: Column, path: str) -> Column:
    """The part of a variant at a path; null where there is none."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, VOID (a JSON null), a kind of number, or '' where there is nothing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def missing(v: Column) -> Column:
    return kind(v).isin("", "VOID")


def string(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(v: Column) -> Column:
    """A finite number as double, else null."""
    found = F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, "$", "double"))
    return let(found, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def items(v: Column) -> Column:
    """The elements of an array, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def text(v: Column) -> Column:
    """Whether v is a string with a character that isn't blank."""
    return yes(string(v).rlike(r"(?U)\S"))


def filled(v: Column) -> Column:
    return yes(string(v) != "")


def whole(v: Column, least: int = 1) -> Column:
    return yes(let(number(v), lambda x: (x % 1 == 0) & (x >= least)))


def one_of(v: Column, allowed) -> Column:
    return yes(string(v).isin(*allowed))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def rules(*pairs: tuple[Column, str | Column]) -> Column:
    """array<string> of the sentences whose condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(words) if isinstance(words, str) else words) for ok, words in pairs])).cast(_TEXTS)


def numbered(found: Column, each) -> Column:
    """The problems of each element, by each(element, index), one after another; none where there are no elements."""
    return F.coalesce(F.flatten(F.transform(found, each)), F.array().cast(_TEXTS))


def _and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: The paths that rules look at, taken from a document at once; a part that isn't of its kind is null.
_METADATA = """struct<modelId:variant,modelVersion:variant,task:variant,expectedSamplingRateHz:variant,expectedChannels:variant,expectedWindowSamples:variant,
input:struct<name:variant,layout:variant,shape:array<variant>,dtype:variant>,
output:struct<name:variant,dtype:variant,semantics:variant,activation:variant,classLabels:array<variant>>,
preprocessingAssumptions:array<struct<stage:variant,config:variant>>,normalization:struct<strategy:variant,fittedFrom:variant>,provenance:variant>"""
_PROVENANCE = "struct<trainingDataset:variant,methodology:variant,limitations:variant>"
_CONFIGURATION = """struct<datasetId:variant,channelName:variant,
selection:struct<kind:variant,recordIds:array<variant>,role:variant,partition:struct<train:variant,validation:variant,test:variant>>,
window:struct<windowLengthSamples:variant,strideSamples:variant,remainderPolicy:variant>,model:struct<modelId:variant,modelVersion:variant>,evaluation:struct<id:variant,description:variant>>"""


def _metadata(m: Column) -> Column:
    given, made, scale, steps = m["input"], m["output"], m["normalization"], m["preprocessingAssumptions"]
    rate, shape, labels = m["expectedSamplingRateHz"], given["shape"], made["classLabels"]
    dimension = lambda d: yes(let(number(d), lambda x: (x == -1) | (x % 1 == 0) & (x >= 1)))
    texts = [(text(m[k]), f"{k} must be a non-empty string") for k in ("modelId", "modelVersion", "task")]
    counts = [(missing(m[k]) | whole(m[k]), f"{k} must be a positive integer when present") for k in ("expectedChannels", "expectedWindowSamples")]
    inputs = [(given.isNull() | text(given[k]), f"input.{k} must be a non-empty string") for k in ("name", "layout")]
    outputs = [(made.isNull() | one_of(made[k], allowed), f"output.{k} must be one of {', '.join(allowed)}") for k, allowed in (("dtype", DTYPES), ("semantics", SEMANTICS), ("activation", ACTIVATIONS))]
    first = rules(
        *texts,
        (missing(rate) | yes(number(rate) > 0), "expectedSamplingRateHz must be above zero when present"),
        *counts,
        (given.isNotNull(), "input must be an object"),
        *inputs,
        (given.isNull() | yes((F.size(shape) > 0) & F.forall(shape, dimension)), "input.shape must be a non-empty array of dimensions of at least 1, or -1"),
        (given.isNull() | one_of(given["dtype"], DTYPES), "input.dtype must be a supported type"),
        (made.isNotNull(), "output must be an object"),
        (made.isNull() | text(made["name"]), "output.name must be a non-empty string"),
        *outputs,
        (made.isNull() | yes((F.size(labels) > 0) & F.forall(labels, text)), "output.classLabels must be a non-empty array of non-empty strings"),
        (steps.isNotNull(), "preprocessingAssumptions must list the steps"),
    )
    step = lambda s, i: rules((s.isNotNull() & text(s["stage"]) & (s["config"].isNull() | is_object(s["config"])), F.concat(F.lit("preprocessingAssumptions["), i.cast("string"), F.lit("] must have a stage, and an object as config when present"))))
    fitted = scale["fittedFrom"]
    told = lambda o: o.isNotNull() & _and(*[missing(o[k]) | text(o[k]) for k in ("trainingDataset", "methodology", "limitations")])
    last = rules(
        (scale.isNotNull() & text(scale["strategy"]) & (missing(fitted) | text(fitted)), "normalization must have a strategy, and a non-empty fittedFrom when present"),
        (m["provenance"].isNull() | let(F.try_variant_get(m["provenance"], "$", _PROVENANCE), told), "provenance must be an object of non-empty strings when present"),
    )
    return F.concat(first, numbered(steps, step), last)


def metadata_problems(source: Column) -> Column:
    """array<string> of all that is wrong with the model metadata of a JSON text; a null or unreadable text is one problem."""
    none = F.array(F.lit("model metadata is not valid JSON"))
    other = F.array(F.lit("model metadata must be a JSON object"))
    judge = lambda v: let(F.try_variant_get(v, "$", _METADATA), lambda m: F.when(v.isNull(), none).when(m.isNull(), other).otherwise(_metadata(m)))
    return let(F.try_parse_json(source), judge)


def configuration_rules(c: Column) -> Column:
    """array<string> of all that is wrong with an experiment's configuration, a variant."""
    parts = F.try_variant_get(c, "$", _CONFIGURATION)
    return let(parts, lambda p: let(string(p["selection"]["kind"]), lambda chosen: _configuration(p, chosen)))


def _configuration(c: Column, chosen: Column) -> Column:
    ids, role, window = c["selection"]["recordIds"], c["selection"]["role"], c["window"]
    fits = lambda s: _and(*[s[k] >= 0 for k in range(len(ROLES))]) & (F.abs(sum((s[k] for k in range(1, len(ROLES))), s[0]) - 1) <= 1e-9)
    split = yes(let(F.array(*[number(c["selection"]["partition"][r]) for r in ROLES]), fits))
    is_kind = lambda k: yes(chosen == k)
    none = window.isNull()
    return rules(
        *[(filled(c[k]), f"{k} must be a non-empty string") for k in ("datasetId", "channelName")],
        (~is_kind("records") | yes((F.size(ids) > 0) & F.forall(ids, filled)), "selection.recordIds must list non-empty record ids"),
        (~is_kind("subject-partition") | one_of(role, ROLES), f"selection.role must be one of {', '.join(ROLES)}"),
        (~is_kind("subject-partition") | split, f"selection.partition: {SPLIT_TEXT}"),
        (is_kind("records") | is_kind("subject-partition"), "selection.kind must be records or subject-partition"),
        (~none, "window must be present"),
        *[(none | whole(window[k]), f"window.{k} must be a positive integer") for k in ("windowLengthSamples", "strideSamples")],
        (none | one_of(window["remainderPolicy"], ("drop", "pad-zero", "error")), "window.remainderPolicy must be drop, pad-zero or error"),
        *[(filled(c[group][k]), f"{group}.{k} must be a non-empty string") for group, keys in (("model", ("modelId", "modelVersion")), ("evaluation", ("id", "description"))) for k in keys],
    )


def configuration_problems(source: Column) -> Column:
    """array<string> of all that is wrong with the configuration of a JSON text."""
    return let(F.try_parse_json(source), configuration_rules)


def input_problems(metadata: dict, fingerprint: str, given: dict[str, Column]) -> Column:
    """array<string> of what keeps prepared inputs from a model. given: model_id, model_version, tensor_name, dtype, shape
    (array<int>), count and fingerprint as columns; `fingerprint` is the model's own."""
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    wants = (("modelId", "model_id", metadata["modelId"]), ("modelVersion", "model_version", metadata["modelVersion"]), ("tensorName", "tensor_name", metadata["input"]["name"]), ("dtype", "dtype", metadata["input"]["dtype"]))
    contract, shape = metadata["input"]["shape"], given["shape"]
    same = [(yes(given[c] == want), F.concat(F.lit(f"{k} is "), quoted(given[c]), F.lit(f" instead of '{want}'"))) for k, c, want in wants]
    concrete = yes(F.forall(shape, lambda d: d >= 1))
    count = F.aggregate(shape, F.lit(1).cast("long"), lambda n, d: n * d)
    differs = F.filter(F.sequence(F.lit(0), F.lit(len(contract) - 1)), lambda i: (F.get(F.array(*map(F.lit, contract)), i) != -1) & (F.get(shape, i) != F.get(F.array(*map(F.lit, contract)), i)))
    first = F.get(differs, F.lit(0))
    rank = yes(F.size(shape) == len(contract))
    wrong = F.when(~rank, F.concat(F.lit("rank "), F.size(shape).cast("string"), F.lit(f" instead of {len(contract)}"))).when(
        first.isNotNull(), F.concat(F.lit("dimension "), first.cast("string"), F.lit(" is "), F.get(shape, first).cast("string"), F.lit(" instead of "), F.get(F.array(*map(F.lit, contract)), first).cast("string"))
    )
    return rules(
        *same,
        (concrete, "the shape must be concrete"),
        (wrong.isNull(), F.concat(F.lit("the shape has "), wrong)),
        (~concrete | yes(count == given["count"]), F.concat(F.lit("the shape holds "), count.cast("string"), F.lit(" elements, the payload "), F.coalesce(given["count"].cast("string"), F.lit("None")))),
        (yes(given["fingerprint"] == fingerprint), "the preprocessing fingerprint is another model's"),
    )


# --- experiment results -----------------------------------------------------------------------------------------------


def number_name(v: Column) -> Column:
    """A number as JSON writes it."""
    return F.to_json(v)


def experiment_id(c: Column) -> Column:
    """The id that a valid configuration (a variant) gives its experiment."""
    ids = F.concat(F.lit("records["), F.array_join(F.transform(items(at(c, "selection.recordIds")), string), ","), F.lit("]"))
    shares = F.array_join(F.array(*[number_name(at(c, f"selection.partition.{r}")) for r in ROLES]), "/")
    part = F.concat(F.lit("subject-partition:role="), string(at(c, "selection.role")), F.lit("("), shares, F.lit(")"))
    w = lambda k: number_name(at(c, f"window.{k}"))
    window = F.concat(F.lit("w"), w("windowLengthSamples"), F.lit("s"), w("strideSamples"), F.lit("-"), string(at(c, "window.remainderPolicy")))
    model = F.concat(string(at(c, "model.modelId")), F.lit("@"), string(at(c, "model.modelVersion")))
    f = at(c, "preprocessing.filter")
    cuts = F.coalesce(F.array_join(F.transform(items(at(f, "cutoff_hz")), number_name), "-"), number_name(at(f, "cutoff_hz")))
    chosen = F.when(~missing(f), F.concat(F.lit("filter:filter-"), string(at(f, "type")), F.lit("-"), cuts, F.lit("hz-"), string(at(f, "phase"))))
    selection = F.when(string(at(c, "selection.kind")) == "records", ids).otherwise(part)
    return F.concat_ws(SEPARATOR, string(at(c, "datasetId")), selection, string(at(c, "channelName")), model, window, F.concat(F.lit("gt:"), string(at(c, "evaluation.id"))), chosen)


def is_time(v: Column) -> Column:
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return yes(string(v).rlike(shape) & F.try_to_timestamp(F.replace(F.substring(string(v), 1, 16), F.lit("T"), F.lit(" "))).isNotNull())


def _json(v: Column) -> Column:
    """A variant as key-sorted JSON; nothing is as a null."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def _again(ids: Column) -> Column:
    """Of array<struct<id, at>> the places `at` whose id stands at an earlier place too."""
    return let(F.array_sort(ids), lambda s: F.transform(F.filter(s, lambda x, i: yes((i > 0) & (x["id"] == F.get(s, i - 1)["id"]))), lambda x: x["at"]))


def _window(w: Column, record: Column, place: Column, again: Column) -> Column:
    say = lambda words: F.concat(place, F.lit(words))
    score = at(w, "predictedScore")
    name = F.concat(_plain(at(record, "recordId")), F.lit("/ch/"), _plain(at(w, "channelIndex")), F.lit("/w"), _plain(at(w, "startSample")))
    found = rules(
        *[(filled(at(w, k)), say(f".{k} must be a non-empty string")) for k in ("windowId", "recordId", "channelName", "trueLabel", "predictedLabel")],
        *[(whole(at(w, k), least), say(f".{k} must be a whole number of at least {least}")) for k, least in (("channelIndex", 0), ("startSample", 0), ("lengthSamples", 1))],
        (number(score).isNotNull(), say(".predictedScore must be finite")),
        (one_of(at(w, "semantics"), ("predicted-probability", "model-score")), say(".semantics must be predicted-probability or model-score")),
        (~again, say(".windowId is repeated")),
        (yes(string(at(w, "windowId")) == name), say(".windowId doesn't match its record, channel and start")),
        *[(_json(at(w, k)) == _json(at(record, k)), say(f".{k} differs from its record's")) for k in ("recordId", "channelName", "channelIndex")],
    )
    return F.when(is_object(w), found).otherwise(rules((F.lit(False), say(" must be an object"))))


def _plain(v: Column) -> Column:
    return F.coalesce(string(v), F.when(~missing(v), F.to_json(v)), F.lit("None"))


def _step(s: Column) -> Column:
    time = at(s, "appliedAtIso")
    return is_object(s) & filled(at(s, "name")) & is_object(at(s, "parameters")) & (missing(time) | is_time(time))


def _record(r: Column, i: Column, again: Column, repeated: Column) -> Column:
    place = F.concat(F.lit("records["), i.cast("string"), F.lit("]"))
    say = lambda words: F.concat(place, F.lit(words))
    windows = at(r, "windows")
    own = rules(
        *[(filled(at(r, k)), say(f".{k} must be a non-empty string")) for k in ("recordId", "subjectId", "channelName")],
        (~F.array_contains(again, i), say(".recordId is repeated")),
        (whole(at(r, "channelIndex"), 0), say(".channelIndex must be a whole number of at least 0")),
        (yes(F.forall(items(at(r, "provenance.transforms")), _step)), say(".provenance must list named steps with parameters")),
        (kind(windows) == "ARRAY", say(".windows must be an array")),
    )
    each = numbered(items(windows), lambda w, j: _window(w, r, F.concat(place, F.lit(".windows["), j.cast("string"), F.lit("]")), F.array_contains(repeated, F.struct(i.alias("i"), j.alias("j")))))
    return F.when(is_object(r), F.concat(own, each)).otherwise(rules((F.lit(False), say(" must be an object"))))


def _structure(v: Column) -> Column:
    """All that is wrong with a result (a variant), its metrics' numbers aside."""
    labeler, config, metrics = at(v, "labeler"), at(v, "config"), at(v, "metrics")
    labels = items(at(v, "metrics.classLabels"))
    head = rules(
        *[(filled(at(v, k)), f"{k} must be a non-empty string") for k in ("experimentId", "softwareVersion", "scopeNote")],
        (is_time(at(v, "evaluatedAtIso")), "evaluatedAtIso must be an ISO-8601 time"),
        (is_object(labeler) & filled(at(v, "labeler.id")) & filled(at(v, "labeler.description")), "labeler must have an id and a description"),
    )

    def configured(bad: Column) -> Column:
        wanted = experiment_id(config)
        matches = rules(
            (yes(string(at(v, "experimentId")) == wanted), F.concat(F.lit("experimentId doesn't match the configuration ("), wanted, F.lit(")"))),
            (_json(labeler) == _json(at(v, "config.evaluation")), "the labeler isn't the one that the configuration names"),
        )
        return F.when(F.size(bad) > 0, F.transform(bad, lambda p: F.concat(F.lit("config: "), p))).otherwise(matches)

    records = items(at(v, "records"))
    record_ids = F.transform(records, lambda r, i: F.struct(_json(at(r, "recordId")).alias("id"), i.alias("at")))
    window_ids = F.flatten(F.transform(records, lambda r, i: F.coalesce(F.transform(items(at(r, "windows")), lambda w, j: F.struct(_json(at(w, "windowId")).alias("id"), F.struct(i.alias("i"), j.alias("j")).alias("at"))), F.array().cast("array<struct<id:string,at:struct<i:int,j:int>>>"))))
    none = F.array().cast(_TEXTS)
    listed = let(_again(record_ids), lambda again: let(_again(window_ids), lambda repeated: numbered(records, lambda r, i: _record(r, i, again, repeated))))
    body = F.concat(rules((kind(at(v, "records")) == "ARRAY", "records must be an array")), F.when(records.isNotNull(), listed).otherwise(none))
    tail = rules((is_object(metrics) & yes((F.size(labels) > 0) & F.forall(labels, filled)), "metrics.classLabels must list non-empty strings"))
    return F.concat(head, let(configuration_rules(config), configured), body, tail)


#: Metrics with sorted keys; counts are doubles too, so that 1.5 is no 1.
_METRICS = "struct<accuracy:double,classLabels:array<string>,classes:array<struct<f1:double,falseNegatives:double,falsePositives:double,label:string,precision:double,recall:double,specificity:double,trueNegatives:double,truePositives:double>>,confusion:array<array<double>>,total:double>"
_NUMBER = r"-?\d+(\.\d+)?([eE][+-]?\d+)?"


def pair(true_label: Column, predicted: Column) -> Column:
    """One text for a pair of labels: the first's length tells where it ends."""
    return F.concat(F.char_length(true_label).cast("string"), F.lit(":"), true_label, predicted)


def metrics_of(labels: Column, counts: Column) -> Column:
    """The metrics (fields of _METRICS, counts as longs) of counts map<pair(true, predicted), long> over declared labels array<string>; the numbers of
    `documents.metrics_of`."""
    n = lambda t, p: F.coalesce(F.try_element_at(counts, pair(t, p)), F.lit(0).cast("long"))
    total = lambda f: F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + f(x))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    every = F.aggregate(labels, F.lit(0).cast("long"), lambda s, t: s + F.aggregate(labels, F.lit(0).cast("long"), lambda q, p: q + n(t, p)))

    def one(x: Column, all_: Column) -> Column:
        tp = n(x, x)
        fn, fp = total(lambda p: n(x, p)) - tp, total(lambda t: n(t, x)) - tp
        tn = all_ - tp - fn - fp
        return F.struct(share(2 * tp, 2 * tp + fp + fn).alias("f1"), fn.alias("falseNegatives"), fp.alias("falsePositives"), x.alias("label"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tn, tn + fp).alias("specificity"), tn.alias("trueNegatives"), tp.alias("truePositives"))

    confusion = F.transform(labels, lambda t: F.transform(labels, lambda p: n(t, p)))
    return let(every, lambda a: F.struct(share(total(lambda x: n(x, x)), a).alias("accuracy"), labels.alias("classLabels"), F.transform(labels, lambda x: one(x, a)).alias("classes"), confusion.alias("confusion"), a.alias("total")))


def windows_of(results: DataFrame, keys: list[str], parsed: str = "v") -> DataFrame:
    """(keys..., record, w) of results (keys..., v): a row for each window, record and w being variants."""
    records = results.select(*keys, F.explode(items(at(F.col(parsed), "records"))).alias("record"))
    return records.select(*keys, "record", F.explode(items(at(F.col("record"), "windows"))).alias("w"))


def parse_results(docs: DataFrame, keys: list[str], source: str = "document") -> DataFrame:
    """(keys..., v, problems) of docs (keys..., source), whose keys are distinct: each result parsed to VARIANT, with all that is wrong with it.

    Metrics are held against the windows' counts by (document, true label, predicted label), and only where nothing else is wrong. A document must fit a row.
    """
    none = F.array(F.lit(RESULT_TEXTS["json"]))
    other = F.array(F.lit(RESULT_TEXTS["object"]))
    judge = lambda v: F.when(v.isNull(), none).when(~is_object(v), other).otherwise(_structure(v))
    # written, for a filter on what the rules found would run all of them again for each path that they look at
    parsed = materialise(docs.select(*keys, F.col(source).alias("_text"), let(F.try_parse_json(source), judge).alias("_found")), "judged")
    sound = parsed.where(F.size("_found") == 0).select(*keys, F.try_parse_json("_text").alias("v"))
    counted = windows_of(sound, keys).groupBy(*keys, string(at(F.col("w"), "trueLabel")).alias("_t"), string(at(F.col("w"), "predictedLabel")).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    labels = F.collect_set("_t").alias("_ts"), F.collect_set("_p").alias("_ps")
    counts = counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(pair(F.col("_t"), F.col("_p")), "_n"))).alias("_counts"), *labels)
    joined = parsed.join(counts, keys, "left").withColumn("v", F.try_parse_json("_text"))
    declared = F.transform(items(at(F.col("v"), "metrics.classLabels")), string)
    empty = F.map_from_arrays(F.array().cast(_TEXTS), F.array().cast("array<bigint>"))
    said = at(F.col("v"), "metrics")
    # the same but for how numbers are written, and the same numbers
    shape = lambda c: F.regexp_replace(c, _NUMBER, "0")
    follows = lambda m: (shape(F.to_json(m, {"ignoreNullFields": "false"})) == shape(F.to_json(said))) & F.try_variant_get(said, "$", _METRICS).eqNullSafe(m.cast(_METRICS))
    seen = F.array_union(F.coalesce("_ts", F.array().cast(_TEXTS)), F.coalesce("_ps", F.array().cast(_TEXTS)))
    numbers = F.coalesce("_counts", empty)

    def counted_again(names: Column) -> Column:
        undeclared = (F.size(F.array_distinct(names)) < F.size(names)) | (F.size(F.array_except(seen, names)) > 0)
        wrong = ~yes(let(metrics_of(names, numbers), follows))
        return F.when(undeclared, F.array(F.lit(RESULT_TEXTS["labels"]))).when(wrong, F.array(F.lit(RESULT_TEXTS["metrics"]))).otherwise(F.col("_found"))

    last = F.when(F.size("_found") > 0, F.col("_found")).otherwise(let(declared, counted_again))
    return joined.select(*keys, "v", last.alias("problems"))
