"""Segmentation, statistics, events, evaluation: small cases against hand-made results."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.operators import evaluation, events, signals


def channel(spark, n, key=1):
    return spark.createDataFrame([(key, [float(i) for i in range(n)])], "k int, data array<double>")


def test_segment_policies(spark):
    df = channel(spark, 10)
    starts = lambda *a: [(r.start, r.is_partial, r.source_samples) for r in signals.segment(df, ["k"], *a).orderBy("start").collect()]
    assert starts(4, 4, "drop") == [(0, False, 4), (4, False, 4)]
    assert starts(4, 4, "pad-zero") == [(0, False, 4), (4, False, 4), (8, True, 2)]
    assert starts(4, 2, "pad-zero") == [(0, False, 4), (2, False, 4), (4, False, 4), (6, False, 4), (8, True, 2)]
    assert starts(20, 5, "pad-zero") == [(0, True, 10)] and starts(20, 5, "drop") == []
    assert [r.data for r in signals.segment(df, ["k"], 4, 4, "pad-zero").orderBy("start").collect()][2] == [8.0, 9.0, 0.0, 0.0]
    assert tuple(signals.segment_summary(df, 4, 2, "drop").first()) == (4, 0, 2)
    with pytest.raises(Exception, match="trailing"):
        signals.segment(df, ["k"], 4, 4, "error").collect()
    for bad in ((0, 1, "drop"), (1, 0, "drop"), (1, 1, "wrap"), (True, 1, "drop")):
        with pytest.raises(SignalError):
            signals.segment(df, ["k"], *bad)


def test_empty_tables(spark):
    empty = channel(spark, 4).limit(0)
    assert signals.segment(empty, ["k"], 4, 4, "pad-zero").count() == 0
    assert tuple(signals.segment_summary(empty, 4, 4).first()) == (0, 0, 0)
    long = signals.to_long(empty, ["k"])
    assert signals.basic_stats(long, ["k"]).count() == 0 and signals.envelope(long, ["k"], 4).count() == 0


def test_stats_take_the_first_peak(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, -3.0, 3.0, 0.0])], "k int, i long, x double")
    r = signals.basic_stats(df, ["k"]).first()
    assert (r.n, r["min"], r["max"], r.peak_index, r.peak_value) == (4, -3.0, 3.0, 1, -3.0)


def test_normalisation_fits(spark):
    df = spark.createDataFrame([(1, 0, i, float(i)) for i in range(5)] + [(1, 1, i, 10.0 + i) for i in range(5)], "r int, c int, i long, x double")
    fit = signals.fit_normalisation(df, ["r"], ["c"], "min-max")
    assert sorted(x.x for x in signals.apply_normalisation(df, fit, ["r", "c"]).where("c = 1").collect()) == [0.0, 0.25, 0.5, 0.75, 1.0]
    pooled = signals.fit_normalisation(df, ["r"], ["c"], "min-max", "global")
    assert {(x.c, x.a, x.b) for x in pooled.collect()} == {(0, 0.0, 14.0), (1, 0.0, 14.0)}
    with pytest.raises(Exception, match="spread"):
        signals.fit_normalisation(df.withColumn("x", F.lit(1.0)), ["r"], ["c"], "min-max").collect()
    with pytest.raises(Exception, match="no stored fit"):
        signals.apply_normalisation(df, fit.where("c = 0"), ["r", "c"]).collect()


def test_envelope_has_empty_buckets(spark):
    long = signals.to_long(channel(spark, 3), ["k"])
    got = [(r.bucket, r["min"], r["max"], r.populated) for r in signals.envelope(long, ["k"], 5).orderBy("bucket").collect()]
    assert got == [(0, 0.0, 0.0, False), (1, 0.0, 0.0, True), (2, 0.0, 0.0, False), (3, 1.0, 1.0, True), (4, 2.0, 2.0, True)]


def test_problems_are_all_named(spark):
    row = spark.range(1).select(signals.signal_problems(F.lit(""), F.lit(0.0), F.lit(float("nan")), F.array(F.struct(F.lit("a").alias("name"), F.lit("V").alias("unit"), F.array(F.lit(1.0)).alias("data")))).alias("p")).first()
    assert len(row.p) == 4


def events_of(spark):
    rows = [(1, s, i, y, "") for i, (s, y) in enumerate([(0, "N"), (5, "V"), (5, "A"), (9, "N"), (30, "V")])]
    return spark.createDataFrame(rows, "k int, sample_index long, ordinal long, symbol string, aux_note string")


VIEW = dict(start_sec=0.0, duration=1.0, rate_hz=10.0, record_start=0.0, n=40)


def test_markers_keep_the_first_of_equal_samples(spark):
    got = [(r.column, r.sample_index, r.symbol, r.merged) for r in events.markers(events_of(spark), ["k"], columns=4, **VIEW).orderBy("column").collect()]
    assert got == [(0, 0, "N", 1), (2, 5, "V", 2), (3, 9, "N", 1)]
    assert events.marker_summary(events_of(spark), ["k"], columns=4, **VIEW).first().symbols == ["A", "N", "V"]


def test_nearest_breaks_ties_by_sample_then_symbol(spark):
    cursors = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.7), (1, 2, 0.25)], "k int, cursor int, fraction double")
    got = {r.cursor: (r.sample_index, r.symbol) for r in events.nearest(events_of(spark), cursors, ["k"], "cursor", tolerance=0.2, **VIEW).collect()}
    assert got == {0: (5, "A"), 1: (5, "A")} or got == {0: (5, "A"), 1: (9, "N")}
    assert got[1] == ((9, "N") if abs(0.9 - 0.7) < abs(0.5 - 0.7) else (5, "A"))
    with pytest.raises(SignalError):
        events.nearest(events_of(spark), cursors, ["k"], "cursor", tolerance=-1.0, **VIEW)


def test_symbol_filters(spark):
    e = events_of(spark)
    assert events.filter_symbols(e, []).count() == 5 and events.filter_symbols(e, ["V"]).count() == 2 and events.filter_symbol(e, "").count() == 5
    r = spark.range(1).select(events.resolve_symbols(F.array(F.lit("V"), F.lit("x")), F.array(F.lit("A"), F.lit("V"))).alias("a"), events.resolve_symbol(F.lit("x"), F.array(F.lit("A"))).alias("b")).first()
    assert r.a == ["V"] and r.b is None


def test_lists_and_intervals(spark):
    rows = events.event_list(events_of(spark), ["k"], limit=2, **VIEW).orderBy("position").collect()
    assert [(r.sample_index, r.symbol, r.visible, r.truncated) for r in rows] == [(0, "N", 4, True), (5, "A", 4, True)]
    w = spark.createDataFrame([(1, 4, 10), (1, 9, 31), (1, 3, 3)], "k int, win_start long, win_end long")
    assert events.in_windows(events_of(spark), w, ["k"], 4).count() == 3 + 2


def test_predictions_and_metrics(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    top = df.select(evaluation.interpret(F.col("s"), ["a", "b", "c"]).alias("p")).first().p
    assert [x.label for x in top] == ["b", "c", "a"] and abs(sum(x.score for x in top) - 1) < 1e-12
    assert df.select(evaluation.interpret(F.col("s"), ["a", "b", "c"], "logits", "none").alias("p")).first().p[0].semantics == "model-score"
    with pytest.raises(Exception, match="inference-failure"):
        df.select(evaluation.interpret(F.col("s"), ["a", "b"])).collect()
    out = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "true_label string, predicted_label string")
    m = {r.label: r for r in evaluation.classification_metrics(out, ["a", "b", "c"]).collect()}
    assert (m["a"].precision, m["a"].recall, m["c"].precision, m["c"].f1) == (1.0, 0.5, None, None)
    with pytest.raises(Exception, match="undeclared"):
        evaluation.confusion_matrix(out, ["a"]).collect()
    assert evaluation.confusion_matrix(out.limit(0), ["a", "b"]).count() == 4


def test_subject_split(spark):
    s = spark.createDataFrame([(f"s{i:02d}",) for i in range(11) for _ in range(2)], "s string")
    roles = {r.s: r.role for r in evaluation.split_subjects(s, "s", {"train": 0.5, "validation": 0.2, "test": 0.3}).collect()}
    assert [roles[f"s{i:02d}"] for i in range(11)] == ["train"] * 5 + ["validation"] * 2 + ["test"] * 4
    assert evaluation.split_subjects(s.limit(1), "s").first().role == "test"
    with pytest.raises(SignalError):
        evaluation.split_subjects(s, "s", {"train": 0.5, "validation": 0.5, "test": 0.5})
    with pytest.raises(SignalError):
        evaluation.records_of_role(s.limit(1), "s", "train")
