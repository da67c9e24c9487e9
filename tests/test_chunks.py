"""Chunk form against the array form, with stretches and cells of odd sizes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.functions import kernels as K
from pulsegrid.operators import chunks, signals

RATE = 64.0
LENGTHS = {("a", 1): 900, ("b", None): 1, ("c", 2): 7, (None, 3): 64, ("d", 4): 333, ("e", 5): 2}


@pytest.fixture(scope="module")
def channels():
    r = np.random.default_rng(5)
    return {k: r.normal(size=n) for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def ragged(spark, channels):
    """Chunk form with stretches of odd lengths, out of order, over several partitions."""
    r = random.Random(4)
    rows = []
    for (k, c), x in channels.items():
        at = 0
        while at < len(x):
            n = r.choice([1, 2, 5, 31, 100])
            rows.append((k, c, at, len(x), x[at : at + n].tolist()))
            at += n
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, c int, start long, n long, data array<double>").repartition(3).persist()


def whole(df, *by) -> dict:
    """Channels put together again; stretches must touch, and cover n."""
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.start):
        key = (r.k, r.c, *(r[b] for b in by))
        have = out.setdefault(key, [])
        assert len(have) == r.start and r.start + len(r.data) <= r.n
        have += r.data
        out[key] = have
    return out


def same(got: dict, want: dict) -> None:
    assert set(got) == set(want)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
@pytest.mark.parametrize("phase", ["forward", "zero"])
def test_filters_equal_those_of_arrays(ragged, channels, size, phase):
    spec = {"type": "bandpass", "cutoff_hz": [4.0, 12.0], "taps": 15, "phase": phase}
    taps = K.design_fir(spec, RATE)
    plain = K.fir_zero_phase if phase == "zero" else K.fir
    same(whole(chunks.filtered(ragged, ["k", "c"], spec, RATE, size)), {k: plain(x, taps) for k, x in channels.items()})


def test_many_taps_run_by_transforms(ragged, channels):
    spec = {"type": "lowpass", "cutoff_hz": 2.0, "taps": 301, "phase": "zero"}
    taps = K.design_fir(spec, RATE)
    plain = lambda x: np.convolve(np.convolve(K.reflected(x, np.arange(-150, len(x) + 150)), taps)[: len(x) + 300][::-1], taps)[: len(x) + 300][::-1][150 : 150 + len(x)]
    same(whole(chunks.filtered(ragged, ["k", "c"], spec, RATE, 400)), {k: plain(x) for k, x in channels.items()})
    x = np.random.default_rng(1).normal(size=10_000)
    np.testing.assert_allclose(K.convolve(x, taps), np.convolve(x, taps), atol=1e-12)


@pytest.mark.parametrize("size", [1, 30, 1000])
@pytest.mark.parametrize("edge", ["reflect", "zero"])
@pytest.mark.parametrize("target", [50.0, 96.0, 64.0 / 3.3, 20 * 3.14159265])
def test_resampling_equals_that_of_arrays(ragged, channels, size, edge, target):
    want = {k: K.resample(x, RATE, target, edge=edge) for k, x in channels.items()}
    got = whole(chunks.resampled(ragged, ["k", "c"], RATE, target, edge=edge, size=size))
    same(got, {k: x for k, x in want.items() if len(x)})


@pytest.mark.parametrize("size", [1, 3, 5, 37, 1000])
def test_wavelets_equal_those_of_arrays(ragged, channels, size):
    even = ragged.where("n % 4 = 0 AND n >= 16")
    want = {k: x for k, x in channels.items() if len(x) % 4 == 0 and len(x) >= 16}
    bands = chunks.decomposed(even, ["k", "c"], 2, size=size)
    same(whole(bands, "band"), {(*k, b + 1): band for k, x in want.items() for b, band in enumerate(K.decompose(x, 2))})
    same(whole(chunks.reconstructed(bands, ["k", "c"], 2, size=size)), want)


def test_impossible_levels_and_unfit_bands_are_refused(ragged):
    with pytest.raises(Exception, match=r"\[invalid-input\] level 3 is not possible for"):
        chunks.decomposed(ragged, ["k", "c"], 3)
    bands = chunks.decomposed(ragged.where("n = 64"), ["k", "c"], 1)
    with pytest.raises(Exception, match="don't fit together"):
        chunks.reconstructed(bands.where("band = 1"), ["k", "c"], 1).collect()
        chunks.reconstructed(bands.where("band = 1").unionByName(bands.where("band = 2").withColumn("n", F.col("n") + 1)), ["k", "c"], 1)


@pytest.mark.parametrize("policy", ["drop", "pad-zero"])
@pytest.mark.parametrize(("width", "stride", "size"), [(20, 5, 1), (20, 5, 12), (5, 20, 1), (360, 7, 50), (64, 64, 1000), (1, 1, 3)])
def test_segments_equal_those_of_arrays(spark, ragged, channels, width, stride, policy, size):
    arrays = spark.createDataFrame([(k, c, x.tolist()) for (k, c), x in channels.items()], "k string, c int, data array<double>")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(chunks.segments(ragged, ["k", "c"], width, stride, policy, size)) == rows(signals.segment(arrays, ["k", "c"], width, stride, policy))


def test_segments_with_a_rest_are_refused(ragged):
    with pytest.raises(Exception, match="leaves 1 trailing"):
        chunks.segments(ragged.where("k = 'a'").withColumn("n", F.lit(901).cast("long")), ["k", "c"], 9, 9, "error").collect()
    assert chunks.segments(ragged.where("k = 'a'"), ["k", "c"], 9, 9, "error", 50).count() == 100


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_positions_of_rows_with_one_large_key(spark, size):
    r = random.Random(2)
    rows = [(None if i % 50 == 0 else "big" if i % 10 else f"k{i % 7}", i // 3, i, r.random()) for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, a int, b int, x double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chunks.of_rows(df, ["k"], ["a", "b"], "x", size)
        assert all(len(r.data) <= size and r.n == sum(q[0] == r.k for q in rows) for r in got.collect())
        found = sorted((tuple(r) for r in chunks.positions(got, ["k"]).collect()), key=str)
        assert got.where("k = 'big'").count() > (1 if size > 3 else 100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for k in {q[0] for q in rows}:
        want += [(k, i, q[3]) for i, q in enumerate(sorted((q for q in rows if q[0] == k), key=lambda q: q[1:3]))]
    assert found == sorted(want, key=str)
    assert chunks.of_rows(df.limit(0), ["k"], ["a", "b"], "x").count() == 0
    with pytest.raises(Exception, match="missing sample"):
        chunks.of_rows(df.withColumn("x", F.when(F.col("b") > 9, F.col("x"))), ["k"], ["a", "b"], "x")


def test_arrays_and_chunks_round_trip(spark, channels):
    arrays = spark.createDataFrame([(k, c, x.tolist()) for (k, c), x in channels.items()] + [("none", 0, []), ("null", 0, None)], "k string, c int, data array<double>")
    same(whole(chunks.of_arrays(arrays, ["k", "c"], size=10)), {k: x.tolist() for k, x in channels.items()})


def test_zero_crossings_over_stretches(ragged, channels):
    got = {(r.k, r.c): (r.crossings, r.frequency_hz) for r in chunks.zero_crossing_hz(ragged, ["k", "c"], RATE).collect()}
    assert set(got) == set(channels)
    for k, x in channels.items():
        ups = np.flatnonzero((x[:-1] < 0) & (x[1:] >= 0)) + 1
        assert got[k][0] == len(ups)
        if len(ups) < 2:
            assert got[k][1] is None
        else:
            assert got[k][1] == pytest.approx(RATE * (len(ups) - 1) / (ups[-1] - ups[0]))


def test_kernels_take_a_large_batch_by_slices(spark):
    """A batch of 128 MB of cells is filled, filtered and given back by some megabytes at a time, and a bad sample late in it is found."""
    width, rows = 1 << 14, 1000
    frame = spark.createDataFrame([], "k long, cell long, n long, pieces array<struct<at:int,data:array<double>>>")

    def run_of(kernel):
        class Cells:
            schema = frame.schema
            mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

        return chunks.over_cells(Cells, ["k"], width, kernel)

    def batch(samples):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(samples))
        piece = pa.StructArray.from_arrays([pa.array(np.zeros(rows, np.int32)), lists], ["at", "data"])
        own = pa.array(np.arange(rows))
        return pa.RecordBatch.from_arrays([own, own, pa.array(np.full(rows, width * rows)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32)), piece)], names=["k", "cell", "n", "pieces"])

    samples = np.arange(rows * width, dtype=float)
    given = batch(samples)
    run = run_of(lambda x, cell, n: [(0, cell * width, n, 2 * x)])
    seen = 0
    tracemalloc.start()
    for out in run(iter([given])):
        for row in range(out.num_rows):
            assert out.column("k")[row].as_py() == seen and np.array_equal(out.column("data")[row].values.to_numpy(), 2 * samples[seen * width : (seen + 1) * width])
            seen += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == rows and peak < 64e6
    samples = samples.copy()
    samples[-1] = np.nan
    with pytest.raises(SignalError, match="not finite"):
        list(run(iter([batch(samples)])))
