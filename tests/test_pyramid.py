"""Views from pyramids against envelopes of all samples, and the sorted nearest-event join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import chunks, events, pyramid, signals

LENGTHS = {"a": 5000, "b": 1, "c": 64, "d": 777}


@pytest.fixture(scope="module")
def long(spark):
    r = np.random.default_rng(9)
    arrays = [(k, r.normal(size=n).tolist()) for k, n in LENGTHS.items()]
    return spark.createDataFrame(arrays, "k string, data array<double>").persist()


@pytest.fixture(scope="module")
def windows(spark):
    r, rows = random.Random(3), []
    for k, n in LENGTHS.items():
        for w in range(12):
            a = r.randrange(n)
            rows.append((k, w, a, r.choice([a, a + 1, min(n, a + 40), n, r.randrange(a, n + 1)])))
    return spark.createDataFrame(rows, "k string, w int, win_start long, win_end long")


@pytest.mark.parametrize(("block", "fan", "columns"), [(64, 8, 48), (3, 2, 7), (1, 5, 1), (16, 4, 1000)])
def test_views_equal_envelopes_of_all_samples(long, windows, block, fan, columns):
    nodes = pyramid.pyramid(chunks.of_arrays(long, ["k"], size=37), ["k"], block, fan)
    got = sorted(tuple(r) for r in pyramid.view(nodes, windows, ["k"], columns, block, fan).select("k", "w", "bucket", "min", "max", "populated").collect())
    samples = signals.to_long(long, ["k"]).join(windows.select("k", "w"), "k")
    want = sorted(tuple(r) for r in signals.envelope(samples, ["k", "w"], columns, windows.select("k", "w", "win_start", "win_end")).select("k", "w", "bucket", "min", "max", "populated").collect())
    assert got == want


def test_a_view_looks_up_nodes_by_columns_not_by_samples(spark):
    for n in (10**6, 10**9, 10**12):
        one = spark.createDataFrame([("a", n // 7, n // 7 + n // 2)], "k string, win_start long, win_end long")
        assert pyramid.lookups(one, 100).count() <= 100 * (2 + 2 * 7 * 15)
        big = pyramid.lookups(one, 100).groupBy("level").count().collect()
        # on each level but the highest a bucket asks for less than two fans of nodes
        assert all(r["count"] <= 100 * 2 * (pyramid.FAN + 1) for r in big)


def test_views_of_a_written_pyramid_push_their_filters(spark, long, tmp_path):
    path = f"file://{tmp_path}/pyramid"
    nodes = pyramid.pyramid(chunks.of_arrays(long, ["k"]), ["k"], 4, 4)
    pyramid.write_pyramid(nodes, ["k"], path)
    got = pyramid.read_view(path, spark, {"k": "a", "win_start": 1001, "win_end": 4003}, 20, 4, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan and "GreaterThanOrEqual(node," in plan
    rows = sorted(tuple(r) for r in got.select("bucket", "min", "max").collect())
    x = np.array(long.where("k = 'a'").first()["data"])
    edges = [1001 + j * 3002 // 20 for j in range(21)]
    assert rows == [(j, x[s:e].min(), x[s:e].max()) for j, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
    assert pyramid.read_view(path, spark, {"k": "none", "win_start": 0, "win_end": 4}, 2, 4, 4).where("populated").count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 1.0])
def test_nearest_of_sorted_ranges_equals_all_pairs(spark, tolerance):
    r = random.Random(6)
    marks = [("big" if i % 8 else f"k{i % 5}", r.randrange(300), r.choice("NVA"), i, None if i % 3 else "note") for i in range(500)]
    cursors = [(r.choice(["big", "big", "k0", "k1", "none", None]), i, r.choice([r.random(), 0.0, 1.0, 1.5, float("nan")])) for i in range(200)]
    view = dict(start_sec=0.5, duration=3.0, rate_hz=64.0, record_start=0.0, n=250)
    a = spark.createDataFrame(marks, "k string, sample_index long, symbol string, ordinal long, aux_note string")
    c = spark.createDataFrame(cursors, "k string, c int, fraction double")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(x) for x in events.nearest_sorted(a, c, ["k"], "c", tolerance=tolerance, **view).select("k", "c", "sample_index", "symbol", "distance").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for k, i, f in cursors:
        f = min(1.0, f) if f > 0 else 0.0
        near = [(abs(min(1.0, max(0.0, (s / 64 - 0.5) / 3)) - f), s, symbol, o) for own, s, symbol, o, _ in marks if own == k and 32 <= s < 224]
        near = [x for x in near if x[0] <= tolerance]
        if near:
            d, s, symbol, _ = min(near)
            want.append((k, i, s, symbol, d))
    assert got == sorted(want)
    if tolerance == 0.02:
        plain = events.nearest(a, c, ["k"], "c", tolerance=tolerance, **view).select("k", "c", "sample_index", "symbol", "distance")
        assert sorted(tuple(x) for x in plain.collect()) == got


def test_nearest_of_no_events(spark):
    a = spark.createDataFrame([], "k string, sample_index long, symbol string, ordinal long, aux_note string")
    c = spark.createDataFrame([("k", 1, 0.5)], "k string, c int, fraction double")
    assert events.nearest_sorted(a, c, ["k"], "c", start_sec=0.0, duration=1.0, rate_hz=64.0, record_start=0.0, n=64).count() == 0
    assert pyramid.view(pyramid.pyramid(chunks.of_arrays(a.select("k", F.array().cast("array<double>").alias("data")), ["k"]), ["k"]), a.select("k", F.lit(0).cast("long").alias("win_start"), F.lit(3).cast("long").alias("win_end")), ["k"], 4).count() == 0
