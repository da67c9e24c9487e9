"""Records read by ranges and written with a commit: data sources `wfdb-chunks` (read) and `wfdb-records` (write).

Reading gives chunk form: a row (record, channel, start, n, samples) for each stretch. The driver lists the folder and no more. Tasks
get packs of some hundred small records, or parts of a long one; each reads the header, and of the data file only the stretches that the pushed
filters on record, channel and start leave. Writing encodes a record in one task, to files under the attempt's own name; the
commit gives them their names, and an abort takes them away.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from pulsegrid.errors import SignalError
from pulsegrid.functions.naming import split_name
from pulsegrid.sources import storage, wfdb

#: Samples of a stretch; bytes of data files of a task, and its small records, each of which costs the opening of files.
SAMPLES, TASK_BYTES, TASK_RECORDS = 65_536, 32 << 20, 512
#: Rows and samples of a batch that a task gives.
BATCH_ROWS, BATCH_SAMPLES = 4096, 1 << 20

CHUNK_SCHEMA = "record_id string, channel_index int, channel_name string, unit string, sample_rate_hz double, gain double, baseline double, start long, n long, samples array<smallint>"
RECORD_SCHEMA = "record_id string, sample_rate_hz double, channels array<struct<channel_index:int,channel_name:string,gain:double,baseline:double,adc_bits:int,samples:array<smallint>>>"


@dataclass
class _Part(InputPartition):
    """Records read whole (of 1), or part `which` of `of` of one record."""

    records: list[str]
    which: int = 0
    of: int = 1


@dataclass
class _Wanted:
    """What pushed filters leave: None is everything."""

    records: set | None = None
    indices: set | None = None
    names: set | None = None
    low: int = 0
    high: int | None = None

    def take(self, f) -> bool:
        """Whether the filter is wholly met from here on."""
        if len(f.attribute) != 1:
            return False
        column, sets = f.attribute[0], {"record_id": "records", "channel_index": "indices", "channel_name": "names"}
        if column in sets and isinstance(f, (EqualTo, In)):
            values, have = {f.value} if isinstance(f, EqualTo) else set(f.value), getattr(self, sets[column])
            setattr(self, sets[column], values if have is None else have & values)
            return True
        if column == "start" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                last = f.value - isinstance(f, LessThan)
                self.high = last if self.high is None else min(self.high, last)
            return True
        return False

    def starts(self, n: int, samples: int) -> range:
        """The starts of stretches that are wanted."""
        first = -(-max(0, self.low) // samples) * samples
        end = n if self.high is None else min(n, self.high + 1)
        return range(first, max(first, end), samples)


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.samples, self.bytes = options["path"], int(options.get("samples", SAMPLES)), int(options.get("task_bytes", TASK_BYTES))
        if self.samples < 1 or self.bytes < 1:
            raise SignalError("invalid-input", "samples and task_bytes have to be above 0")
        self.wanted = _Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        sizes: dict[str, int] = {}
        records = []
        for name, size in storage.list_sizes(self.folder):
            stem, ext = split_name(name)
            if ext == "hea":
                records.append(stem)
            else:
                sizes[stem] = sizes.get(stem, 0) + size
        out, pack, room = [], [], self.bytes
        for record in records:
            if self.wanted.records is not None and record not in self.wanted.records:
                continue
            size = sizes.get(record, 0)
            if size > self.bytes:
                of = -(-size // self.bytes)
                out += [_Part([record], k, of) for k in range(of)]
                continue
            if pack and (size > room or len(pack) == TASK_RECORDS):
                out.append(_Part(pack))
                pack, room = [], self.bytes
            pack.append(record)
            room -= size
        return out + ([_Part(pack)] if pack or not out else [])

    def read(self, partition):
        rows, held = [], 0
        for record in partition.records:
            for row in self._record(record, partition.which, partition.of):
                rows.append(row)
                held += len(row[-1])
                if len(rows) == BATCH_ROWS or held >= BATCH_SAMPLES:
                    yield _chunk_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _chunk_batch(rows)

    def _record(self, record: str, which: int, of: int) -> Iterator[tuple]:
        """Rows of CHUNK_SCHEMA. Stretches that touch are read and decoded together, up to about SAMPLES frames."""
        header = wfdb.parse_header(storage.read_bytes(self.folder, f"{record}.hea").decode("utf-8", "replace"))
        if header.record != record:
            raise SignalError("malformed-header", f"the header of {record!r} is that of {header.record!r}")
        for name in dict.fromkeys(c.file for c in header.channels):
            own = [i for i, c in enumerate(header.channels) if c.file == name]
            chosen = [(k, _channel(record, header, i)) for k, i in enumerate(own) if self._is_wanted(i, header.channels[i])]
            fmt, frames = self._layout(record, header, name, own)
            starts = self.wanted.starts(frames, self.samples)
            starts = starts[len(starts) * which // of : len(starts) * (which + 1) // of]
            together = max(1, SAMPLES // self.samples)
            for part in (starts[k : k + together] for k in range(0, len(starts), together)) if chosen else ():
                first, count = part[0], min(frames, part[-1] + self.samples) - part[0]
                frame = wfdb.required_bytes(fmt, len(own), 1)
                data = storage.read_range(self.folder, name, first * frame, count * frame)
                decoded = wfdb.decode_212(data, count) if fmt == 212 else wfdb.decode_16(data, len(own), count)
                for s in part:
                    for k, channel in chosen:
                        yield (*channel, s, frames, decoded[k][s - first : s - first + self.samples])

    def _is_wanted(self, index: int, channel) -> bool:
        w = self.wanted
        return (w.indices is None or index in w.indices) and (w.names is None or (channel.name or f"channel-{index + 1}") in w.names)

    def _layout(self, record: str, header, name: str, own: list[int]) -> tuple[int, int]:
        """(format, frames) of a data file, whose length is looked up and not read."""
        formats, size = {header.channels[i].format for i in own}, storage.size_of(self.folder, name)
        if len(formats) > 1:
            raise SignalError("malformed-header", f"{name} mixes formats")
        fmt = formats.pop()
        if fmt == 212 and len(own) != 2:
            raise SignalError("malformed-header", f"{name} is of format 212, which takes two channels, and has {len(own)}")
        frames = header.samples if header.samples > 0 else size // wfdb.required_bytes(fmt, len(own), 1)
        if size != wfdb.required_bytes(fmt, len(own), frames):
            raise SignalError("malformed-header", f"{name} of record {record} is {size} bytes long; {frames} frames take {wfdb.required_bytes(fmt, len(own), frames)}")
        return fmt, frames


def _channel(record: str, header, i: int) -> tuple:
    """What rows of CHUNK_SCHEMA say of a channel."""
    c = header.channels[i]
    return record, i, c.name or f"channel-{i + 1}", wfdb.canonical_unit(c.units, record), header.rate_hz, c.gain, float(c.baseline)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    *columns, data = zip(*rows, strict=True)
    columns = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, data)]).astype(np.int32)), pa.array(np.concatenate(data).astype(np.int16)))
    return pa.RecordBatch.from_arrays([*columns, samples], names=names)


class WfdbChunks(DataSource):
    """spark.read.format("wfdb-chunks").option("samples", 65536).load(folder): CHUNK_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "wfdb-chunks"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def header_text(record: str, rate_hz: float, channels: list[dict], fmt: int) -> str:
    """The header of channels (channel_name, gain, baseline, adc_bits, samples) in one data file."""
    number = lambda x: f"{x:g}" if float(f"{x:g}") == x else repr(float(x))
    n = len(channels[0]["samples"])
    lines = [f"{record} {len(channels)} {number(rate_hz)} {n}"]
    for c in channels:
        x = np.asarray(c["samples"], np.int64)
        first, total = int(x[0]) if n else 0, int(x.sum()) & 0xFFFF
        lines.append(f"{record}.dat {fmt} {number(c['gain'])}({int(c['baseline'])})/mV {c['adc_bits']} 0 {first} {total - (1 << 16) if total >> 15 else total} 0 {c['channel_name']}")
    return "\n".join(lines) + "\n"


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.format = options["path"], int(options.get("signal_format", 16))
        if self.format not in wfdb.FORMATS:
            raise SignalError("unsupported-format", f"format {self.format} is not among {wfdb.FORMATS}")

    def write(self, iterator):
        attempt, files = uuid.uuid4().hex, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    channels = sorted(row["channels"], key=lambda c: c["channel_index"])
                    data = [np.asarray(c["samples"], np.int16) for c in channels]
                    encoded = wfdb.encode_212(*data) if self.format == 212 and len(data) == 2 else wfdb.encode_16(data) if self.format == 16 else None
                    if encoded is None:
                        raise SignalError("invalid-input", f"record {row['record_id']} has {len(data)} channels; format 212 takes two")
                    text = header_text(row["record_id"], row["sample_rate_hz"], channels, self.format)
                    for ext, content in (("dat", encoded), ("hea", text.encode())):
                        files.append((f"_attempt-{attempt}-{row['record_id']}.{ext}", f"{row['record_id']}.{ext}"))
                        storage.write_bytes(self.folder, files[-1][0], content)
        except BaseException:
            storage.remove(self.folder, [a for a, _ in files])
            raise
        return _Written(files)

    def commit(self, messages) -> None:
        """Data files get their names before headers do: a record that can be seen is whole."""
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise SignalError("invalid-input", "a record is written twice")
        for headers in (False, True):
            storage.rename_all(self.folder, [f for f in files if f[1].endswith(".hea") == headers])

    def abort(self, messages) -> None:
        storage.remove(self.folder, [a for m in messages if m for a, _ in m.files])


class WfdbRecords(DataSource):
    """df.write.format("wfdb-records").option("signal_format", 16 or 212).mode("append").save(folder): rows of RECORD_SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "wfdb-records"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise SignalError("invalid-input", "records are only added to a folder")
        return RecordWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known, and lets filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WfdbChunks)
    spark.dataSource.register(WfdbRecords)


def write_records(channels: DataFrame, folder: str, signal_format: int = 16) -> None:
    """channels (record_id, channel_index, channel_name, sample_rate_hz, gain, baseline, adc_bits, samples) as records of the folder, all or
    none. The channels of one record meet in one row."""
    register(channels.sparkSession)
    channel = F.struct(F.col("channel_index").cast("int").alias("channel_index"), "channel_name", F.col("gain").cast("double").alias("gain"), F.col("baseline").cast("double").alias("baseline"), F.col("adc_bits").cast("int").alias("adc_bits"), F.col("samples").cast("array<smallint>").alias("samples"))
    rows = channels.groupBy("record_id", F.col("sample_rate_hz").cast("double").alias("sample_rate_hz")).agg(F.collect_list(channel).alias("channels"))
    storage.make_folder(folder)
    rows.write.format("wfdb-records").option("signal_format", signal_format).mode("append").save(folder)


def read_chunks(spark: SparkSession, folder: str, samples: int = SAMPLES, task_bytes: int = TASK_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("wfdb-chunks").option("samples", samples).option("task_bytes", task_bytes).load(folder)


def view(chunks: DataFrame, start: int, end: int, samples: int = SAMPLES) -> DataFrame:
    """(record..., start, n, samples): the samples [start, end) of each channel of read_chunks, from the stretches that have them. The
    filter on start reaches the files: no other byte of them is read."""
    inside = chunks.where((F.col("start") >= start // samples * samples) & (F.col("start") < end))
    low = F.greatest(F.lit(0).cast("long"), F.lit(start) - F.col("start"))
    take = F.slice("samples", (low + 1).cast("int"), F.greatest(F.lit(0).cast("long"), F.lit(end) - F.col("start") - low).cast("int"))
    return inside.withColumn("samples", take).withColumn("start", F.col("start") + low).where(F.size("samples") > 0)
