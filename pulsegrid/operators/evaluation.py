"""Scoring windows, ordering predictions, confusion and classification metrics, and subject-aware splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.errors import SignalError
from pulsegrid.plans.storage import materialise

ROLES = ("train", "validation", "test")
DEFAULT_SPLIT = {"train": 0.7, "validation": 0.15, "test": 0.15}


def softmax(scores: Column) -> Column:
    """Of an array of logits, shifted by their maximum."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / F.aggregate(F.transform(scores, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, b: a + b))


def sigmoid(scores: Column) -> Column:
    return F.transform(scores, lambda s: 1 / (1 + F.exp(-s)))


def activated(scores: Column, semantics: str, activation: str) -> tuple[Column, str]:
    """(scores, meaning) as a model's declared output is to be read."""
    if semantics == "probabilities":
        return scores, "predicted-probability"
    if semantics == "logits" and activation in ("softmax", "sigmoid"):
        return (softmax if activation == "softmax" else sigmoid)(scores), "predicted-probability"
    return scores, "model-score"


def interpret(scores: Column, labels: list[str], semantics: str = "logits", activation: str = "softmax") -> Column:
    """array<struct<label, score, semantics>>, the highest score first; ties by the labels' order."""
    values, meaning = activated(scores, semantics, activation)
    names = F.array(*[F.lit(x) for x in labels])
    rows = F.transform(values, lambda v, i: F.struct((-v).alias("k"), i.alias("i"), F.get(names, i).alias("label"), v.alias("score")))
    ordered = F.transform(F.array_sort(rows), lambda r: F.struct(r["label"].alias("label"), r["score"].alias("score"), F.lit(meaning).alias("semantics")))
    bad = (F.size(scores) != len(labels)) | F.exists(scores, lambda s: F.isnan(s) | (F.abs(s) == math.inf))
    refused = F.raise_error(F.lit("[inference-failure] a model's output must be finite and have a value for each label"))
    return F.when(bad, refused.cast("array<struct<label:string,score:double,semantics:string>>")).otherwise(ordered)


def ranked_predictions(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, class_index, score) with rank 1 for the highest score; ties by class index."""
    return long.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc("score"), "class_index")))


def _sum(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda s, x: s + x)


def probe_scores(data: Column) -> Column:
    """Logits [+sum, -sum] of the window as single precision."""
    total = _sum(F.transform(data, lambda x: x.cast("float").cast("double")))
    return F.array(total, -total)


def stub_scores(data: Column, classes: int, bias: list[float] | None = None) -> Column:
    """Logits that follow a window's mean and root mean square, for tests without a model."""
    n, bias = F.size(data), bias or []
    mean, rms = _sum(data) / n, F.sqrt(_sum(F.transform(data, lambda x: x * x)) / n)
    return F.array(*[F.lit(float(bias[c]) if c < len(bias) else 0.0) + mean * 0.1 * (c + 1) + rms * 0.05 * (classes - c) for c in range(classes)])


def assert_labels(labels: list[str]) -> None:
    if not labels or len(set(labels)) < len(labels) or not all(isinstance(x, str) and x for x in labels):
        raise SignalError("invalid-input", "class labels must be non-empty and unique")


def confusion_matrix(outcomes: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, true_label, predicted_label, n) over all pairs of declared labels; an undeclared label is refused."""
    assert_labels(labels)
    keys = keys or []
    known = F.coalesce(F.col("true_label").isin(labels) & F.col("predicted_label").isin(labels), F.lit(False))
    checked = outcomes.where(F.when(known, True).otherwise(F.raise_error(F.lit("[invalid-input] an outcome has an undeclared label")).cast("boolean")))
    counted = checked.groupBy(*keys, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in labels])
    base = outcomes.select(*keys).distinct() if keys else outcomes.sparkSession.range(1)
    spine = base.select(*keys, F.explode(names).alias("true_label")).select(*keys, "true_label", F.explode(names).alias("predicted_label"))
    return spine.join(F.broadcast(counted) if not keys else counted, [*keys, "true_label", "predicted_label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))  # len(labels)^2 rows


def classification_metrics(outcomes: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each declared label: tp, fn, fp, tn, precision, recall, specificity, f1, and the overall accuracy and total.

    A ratio without a denominator is null.
    """
    assert_labels(labels)
    names = F.array(*[F.lit(x) for x in labels])
    matrix = confusion_matrix(outcomes, labels)
    rows = matrix.select(F.explode(names).alias("label"), "true_label", "predicted_label", "n")
    t, p = F.col("true_label") == F.col("label"), F.col("predicted_label") == F.col("label")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    hit = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    out = rows.groupBy("label").agg(count(t & p).alias("tp"), count(t & ~p).alias("fn"), count(~t & p).alias("fp"), count(~t & ~p).alias("tn"), F.sum("n").alias("total"), hit.alias("correct"))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    return out.select(
        "label", "tp", "fn", "fp", "tn",
        share(c("tp"), c("tp") + c("fp")).alias("precision"), share(c("tp"), c("tp") + c("fn")).alias("recall"),
        share(c("tn"), c("tn") + c("fp")).alias("specificity"), share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        share(c("correct"), c("total")).alias("accuracy"), "total",
    )


def assert_split(split: dict[str, float]) -> None:
    values = [split.get(r) for r in ROLES]
    if not all(isinstance(v, (int, float)) and math.isfinite(v) and v >= 0 for v in values) or abs(sum(values) - 1) > 1e-9:
        raise SignalError("invalid-input", "a split's fractions must be at least 0 and add up to 1")


def ranks(subjects: DataFrame, column: str) -> DataFrame:
    """(column, position, total) of the distinct subjects in order, position from 0, without a sort in one task.

    Range partitions are numbered on their own; the counts of the partitions before are added, a row for each partition.
    """
    dealt = subjects.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "subjects")
    own = F.row_number().over(W.Window.partitionBy("_part").orderBy(column))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # over a row for each partition
    every = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("total"))
    return dealt.withColumn("_own", own).join(before, "_part").select(column, (F.col("_before") + F.col("_own") - 1).alias("position"), "total")


def split_subjects(subjects: DataFrame, column: str, split: dict[str, float] | None = None) -> DataFrame:
    """(column, role) of each distinct subject, in order of name: by rank / (n - 1); the last is always in test."""
    split = split or DEFAULT_SPLIT
    assert_split(split)
    r = ranks(subjects, column)
    at = F.when(F.col("total") > 1, F.col("position") / (F.col("total") - 1)).otherwise(0.0)
    role = F.when(F.col("position") == F.col("total") - 1, "test").when(at < split["train"], "train").when(at < split["train"] + split["validation"], "validation").otherwise("test")
    return r.select(column, role.alias("role"))


def split_records(records: DataFrame, subject: str, split: dict[str, float] | None = None) -> DataFrame:
    """records with their subject's role; a record without a subject is refused."""
    roles = split_subjects(records, subject, split)
    refused = F.raise_error(F.lit("[invalid-input] a record has no subject with a role")).cast("string")
    return records.join(roles, subject, "left").withColumn("role", F.when(F.col("role").isNull(), refused).otherwise(F.col("role")))


def leakage(roles: DataFrame, subject: str) -> DataFrame:
    """(subject, problem): subjects that stand in one role twice, or in more than one."""
    each = roles.groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles"))
    problem = F.when(F.col("roles") > 1, "in more than one role").when(F.col("n") > F.col("roles"), "repeated within a role")
    return each.withColumn("problem", problem).where("problem IS NOT NULL").select(subject, "problem")


def assert_no_leakage(roles: DataFrame, subject: str) -> None:
    found = leakage(roles, subject).take(5)
    if found:
        raise SignalError("invalid-input", "subjects leak between roles: " + ", ".join(f"{r[0]} ({r[1]})" for r in found))


def records_of_role(records: DataFrame, subject: str, role: str, split: dict[str, float] | None = None) -> DataFrame:
    """The records of one role; none at all is refused."""
    if role not in ROLES:
        raise SignalError("invalid-input", f"unknown role {role!r}")
    chosen = split_records(records, subject, split).where(F.col("role") == role)
    if chosen.isEmpty():
        raise SignalError("invalid-input", f"the role {role!r} has no records")
    return chosen


def self_subjects(records: DataFrame, record: str = "record_id") -> DataFrame:
    return records.withColumn("subject_id", F.col(record))


def latest_requests(requests: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The newest request of each key; all before it are superseded."""
    newest = requests.groupBy(*keys).agg(F.max_by(F.struct(*requests.columns), seq).alias("r"))
    return newest.select("r.*")


def request_status(requests: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Every request with status current or request-superseded."""
    top = F.max(seq).over(W.Window.partitionBy(*keys))
    return requests.withColumn("status", F.when(F.col(seq) == top, "current").otherwise("request-superseded"))


def split_problems(train: Column, validation: Column, test: Column) -> Column:
    """array<string> of what is wrong with a row's split, as `assert_split`."""
    shares = (train, validation, test)
    fine = [F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(False)) for x in shares]
    ok = fine[0] & fine[1] & fine[2] & F.coalesce(F.abs(train + validation + test - 1) <= 1e-9, F.lit(False))
    return F.array_compact(F.array(F.when(~ok, F.lit("a split's fractions must be at least 0 and add up to 1"))))


def label_problems(labels: Column, seen: Column) -> Column:
    """array<string> of what is wrong with declared labels (array<string>), and with the labels seen beside them."""
    n = F.coalesce(F.size(labels), F.lit(0))
    unknown = F.array_sort(F.array_except(F.coalesce(seen, F.array().cast("array<string>")), F.coalesce(labels, F.array().cast("array<string>"))))
    return F.array_compact(
        F.array(
            F.when(n < 1, F.lit("at least one label is needed")),
            F.when(F.size(F.array_distinct(labels)) < n, F.lit("labels must be unique")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("labels are not declared: "), F.array_join(unknown, ", "))),
        )
    )
