"""Ranged reads and committed writes of records."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from pulsegrid.sources import ranged, storage, wfdb

LONG = 500_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ten short records of two channels, and a long one, written by the sink."""
    d = str(tmp_path_factory.mktemp("records"))
    r = np.random.default_rng(1)
    rows = [(f"r{k}", c, f"lead {c}", 360.0, 200.0, 5.0, 12, r.integers(-2048, 2048, 50 + k).tolist()) for k in range(10) for c in (0, 1)]
    rows += [("long", c, f"lead {c}", 360.0, 200.0, 0.0, 12, (np.arange(LONG) * (c + 1) % 4001 - 2000).tolist()) for c in (0, 1)]
    schema = "record_id string, channel_index int, channel_name string, sample_rate_hz double, gain double, baseline double, adc_bits int, samples array<smallint>"
    ranged.write_records(spark.createDataFrame(rows, schema).repartition(5), d, 212)
    return d


def test_written_records_are_read_back_by_both_sources(spark, folder):
    assert not [n for n in os.listdir(folder) if n.startswith("_")]
    wfdb.register(spark)
    whole = {(r.record_id, r.channel_index): r for r in spark.read.format("wfdb").load(folder).collect()}
    parts: dict = {}
    for r in sorted(ranged.read_chunks(spark, folder, 40_000, 100_000).collect(), key=lambda r: r.start):
        have = parts.setdefault((r.record_id, r.channel_index), [])
        assert len(have) == r.start and r.n == len(whole[r.record_id, r.channel_index].samples) and (r.gain, r.channel_name) == (200.0, f"lead {r.channel_index}")
        have += r.samples
    assert len(parts) == 22 and all(parts[k] == whole[k].samples for k in whole)


def test_small_records_share_a_task_and_long_ones_are_split(folder):
    parts = ranged.ChunkReader({"path": folder, "task_bytes": "100000"}).partitions()
    assert sum(p.of > 1 for p in parts) == 15 and [len(p.records) for p in parts if p.of == 1] == [10]
    reader = ranged.ChunkReader({"path": folder})
    assert list(reader.pushFilters([In(("record_id",), ("r1", "r3"))])) == [] and [p.records for p in reader.partitions()] == [["r1", "r3"]]


def test_two_seconds_of_a_long_record_read_less_than_a_hundredth(folder, monkeypatch):
    read = []
    monkeypatch.setattr(storage, "read_range", lambda d, name, start, size, f=storage.read_range: read.append(size) or f(d, name, start, size))
    reader = ranged.ChunkReader({"path": folder, "samples": "720"})
    kept = EqualTo(("gain",), 1.0)
    assert list(reader.pushFilters([EqualTo(("record_id",), "long"), GreaterThanOrEqual(("start",), 360_000), LessThan(("start",), 360_720), EqualTo(("channel_index",), 1), kept])) == [kept]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["channel_index"], r["start"], len(r["samples"])) for r in rows] == [("long", 1, 360_000, 720)]
    assert sum(read) < 0.01 * os.path.getsize(f"{folder}/long.dat")


def test_views_push_their_filters(spark, folder):
    v = ranged.view(ranged.read_chunks(spark, folder, 720), 359_990, 361_000, 720).where("record_id = 'long' AND channel_name = 'lead 0'")
    plan = v._jdf.queryExecution().executedPlan().toString()
    # what the source has met itself is no Filter of the plan any more
    assert "BatchScan wfdb-chunks" in plan and "= long" not in plan and "361000" not in plan.replace("361000 - ", "") and "359280" not in plan
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    late = spark.read.format("wfdb-chunks").load(folder).where("record_id = 'long'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert "= long" in late
    x = [s for r in sorted(v.collect(), key=lambda r: r.start) for s in r.samples]
    assert x == (np.arange(359_990, 361_000) % 4001 - 2000).tolist()
    assert ranged.view(ranged.read_chunks(spark, folder), 10**7, 10**7 + 5).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    schema = "record_id string, channel_index int, channel_name string, sample_rate_hz double, gain double, baseline double, adc_bits int, samples array<smallint>"
    good = [(f"r{k}", c, "x", 1.0, 1.0, 0.0, 12, [1, 2, 3]) for k in range(6) for c in (0, 1)]
    bad = spark.createDataFrame([*good, ("bad", 0, "x", 1.0, 1.0, 0.0, 12, [1]), ("bad", 1, "x", 1.0, 1.0, 0.0, 12, [5000])], schema)
    with pytest.raises(Exception, match="format 212 takes"):
        ranged.write_records(bad, str(tmp_path / "a"), 212)
    assert os.listdir(tmp_path / "a") == []
    twice = spark.createDataFrame([("r", 0, "x", 1.0, 1.0, 0.0, 12, [1]), ("r", 0, "x", 2.0, 1.0, 0.0, 12, [1])], schema)
    with pytest.raises(Exception, match="written twice"):
        ranged.write_records(twice, str(tmp_path / "b"))
    assert os.listdir(tmp_path / "b") == []


def test_refusals(spark, folder, tmp_path):
    with pytest.raises(Exception, match="file-not-found|does not exist"):
        ranged.read_chunks(spark, str(tmp_path / "none")).collect()
    (tmp_path / "x.hea").write_text("x 1 360 10\nx.dat 16 200 12 0 0 0 0 a\n")
    (tmp_path / "x.dat").write_bytes(b"123")
    with pytest.raises(Exception, match="3 bytes long; 10 frames take 20"):
        ranged.read_chunks(spark, str(tmp_path)).collect()
    assert ranged.read_chunks(spark, str(tmp_path)).where(F.col("record_id") == "other").count() == 0


def test_many_small_records_are_many_tasks_and_few_batches(tmp_path):
    """3000 records of a few bytes each are no single task, and a task gives its stretches in batches."""
    rows = [{"record_id": f"s{k}", "sample_rate_hz": 64.0, "channels": [{"channel_index": c, "channel_name": f"lead {c}", "gain": 200.0, "baseline": 8.0, "adc_bits": 12, "samples": [k % 100, c, -c, 7, k % 9]} for c in (0, 1)]} for k in range(3000)]
    writer = ranged.RecordWriter({"path": str(tmp_path), "signal_format": "212"})
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    reader = ranged.ChunkReader({"path": str(tmp_path), "samples": "2"})
    parts = reader.partitions()
    assert max(len(p.records) for p in parts) <= 512 and sorted(r for p in parts for r in p.records) == sorted(r["record_id"] for r in rows)
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) < 20
    got = {(r["record_id"], r["channel_index"], r["start"]): r["samples"] for b in batches for r in b.to_pylist()}
    want = {(r["record_id"], c["channel_index"], s): c["samples"][s : s + 2] for r in rows for c in r["channels"] for s in (0, 2, 4)}
    assert got == want
