"""WFDB records: headers, formats 212 and 16, annotation streams, the catalogue, and a data source."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.errors import SignalError
from pulsegrid.functions.naming import split_name
from pulsegrid.operators.events import STANDARD_SYMBOLS
from pulsegrid.sources.storage import list_folder, read_bytes

FORMATS = (212, 16)
DATASET = "wfdb"
_INTEGER = re.compile(r"-?\d+")


@dataclass(frozen=True)
class Channel:
    file: str
    format: int
    samples_per_frame: int
    skew: int | None
    byte_offset: int | None
    gain: float
    baseline: int
    units: str
    adc_bits: int
    adc_zero: int
    initial_value: int
    checksum: int
    block_size: int
    name: str


@dataclass(frozen=True)
class Header:
    record: str
    rate_hz: float
    samples: int
    base_time: str | None
    base_date: str | None
    channels: tuple[Channel, ...] = ()
    comments: tuple[str, ...] = field(default=())


def _malformed(message: str) -> SignalError:
    return SignalError("malformed-header", message)


def _integer(fields: list[str], at: int, label: str) -> int:
    if at >= len(fields) or not _INTEGER.fullmatch(fields[at]):
        raise _malformed(f"{label} must be an integer, received {fields[at] if at < len(fields) else '(missing)'!r}")
    return int(fields[at])


def parse_record_line(line: str) -> tuple[str, int, float, int, str | None, str | None]:
    """(name, signals, rate, samples or 0, base time, base date)."""
    fields = line.split()
    if not fields or not fields[0].partition("/")[0]:
        raise _malformed("a record line must begin with the record's name")
    signals = _integer(fields, 1, "the number of signals")
    rate = fields[2] if len(fields) > 2 else ""
    if not re.fullmatch(r"-?\d*\.?\d*", rate) or not re.search(r"\d", rate) or float(rate) <= 0:
        raise _malformed(f"the sampling frequency must be above zero, received {rate or '(missing)'!r}")
    samples = _integer(fields, 3, "the number of samples") if len(fields) > 3 else 0
    return fields[0].partition("/")[0], signals, float(rate), samples, *(fields[i] if len(fields) > i else None for i in (4, 5))


def parse_signal_line(line: str) -> Channel:
    """A gain of 0 means 200; the baseline is the ADC zero unless given, units are mV; a name may have spaces."""
    fields = line.split()
    if len(fields) < 3:
        raise _malformed("a signal line needs a file, a format and a gain")
    shape = re.fullmatch(r"(\d+)(?:x(\d+))?(?::(-?\d+))?(?:\+(\d+))?", fields[1])
    if not shape:
        raise _malformed(f"unreadable format {fields[1]!r}")
    if int(shape[1]) not in FORMATS:
        raise SignalError("unsupported-format", f"format {shape[1]} is not among {FORMATS}", meta={"format": int(shape[1])})
    scale = re.fullmatch(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:\((-?\d+)\))?(?:/(\S*))?", fields[2])
    if not scale or not (math.isfinite(float(scale[1])) and float(scale[1]) >= 0):
        raise _malformed(f"unreadable gain {fields[2]!r}")
    bits, zero, initial, checksum = (_integer(fields, 3 + i, x) for i, x in enumerate(("the ADC resolution", "the ADC zero", "the initial value", "the checksum")))
    rest = fields[7:]
    block = int(rest.pop(0)) if rest and _INTEGER.fullmatch(rest[0]) else 0
    number = lambda x: None if x is None else int(x)
    return Channel(fields[0], int(shape[1]), int(shape[2] or 1), number(shape[3]), number(shape[4]), float(scale[1]) or 200.0, zero if scale[2] is None else int(scale[2]), scale[3] or "mV", bits, zero, initial, checksum, block, " ".join(rest))


def parse_header(text: str) -> Header:
    lines = [x.strip() for x in text.splitlines()]
    comments = tuple(x for x in lines if x.startswith("#"))
    lines = [x for x in lines if x and not x.startswith("#")]
    if len(lines) < 2:
        raise _malformed("a header needs a record line and signal lines")
    name, signals, rate, samples, time, date = parse_record_line(lines[0])
    channels = tuple(parse_signal_line(x) for x in lines[1:])
    if signals != len(channels):
        raise _malformed(f"the record line declares {signals} signals but {len(channels)} signal lines follow")
    return Header(name, rate, samples, time, date, channels, comments)


def required_bytes(fmt: int, channels: int, frames: int) -> int:
    if fmt not in FORMATS:
        raise SignalError("unsupported-format", f"format {fmt} is not among {FORMATS}")
    return 3 * frames if fmt == 212 else 2 * channels * frames


def decode_212(data: bytes, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Two channels of 12-bit two's complement samples, three bytes a frame."""
    if len(data) != 3 * frames:
        raise _malformed(f"format 212 needs {3 * frames} bytes for {frames} frames, received {len(data)}")
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int16)
    both = np.stack((b[:, 0] | (b[:, 1] & 15) << 8, b[:, 2] | (b[:, 1] >> 4) << 8))
    both[both > 2047] -= 4096
    return both[0], both[1]


def encode_212(first: np.ndarray, second: np.ndarray) -> bytes:
    a, b = np.asarray(first, np.int64), np.asarray(second, np.int64)
    if a.shape != b.shape or len(a) and (min(a.min(), b.min()) < -2048 or max(a.max(), b.max()) > 2047):
        raise SignalError("invalid-input", "format 212 takes two channels of one length with samples in [-2048, 2047]")
    a, b = a & 4095, b & 4095
    return np.stack((a & 255, a >> 8 | (b >> 8) << 4, b & 255), axis=1).astype(np.uint8).tobytes()


def decode_16(data: bytes, channels: int, frames: int) -> list[np.ndarray]:
    """Little-endian 16-bit samples, the channels of a frame in turn."""
    if len(data) != 2 * channels * frames:
        raise _malformed(f"format 16 needs {2 * channels * frames} bytes for {frames} frames of {channels}, received {len(data)}")
    return list(np.frombuffer(data, "<i2").reshape(frames, channels).T.copy())


def encode_16(channels: list[np.ndarray]) -> bytes:
    if not channels or len({len(c) for c in channels}) > 1:
        raise SignalError("invalid-input", "format 16 takes at least one channel, all of one length")
    return np.stack([np.asarray(c, "<i2") for c in channels], axis=1).tobytes()


def parse_annotations(data: bytes) -> tuple[list[dict], float | None, list[dict]]:
    """(events, declared rate, custom labels) of an annotation stream of byte pairs.

    A pair holds a 10-bit step in samples and a 6-bit code. Codes 59 to 63 extend an event: 59 a 32-bit step
    before it, 60 to 62 fields that are passed over, 63 its note. The last pair never begins an event.
    Notes at sample 0 with code 22 define the time resolution and labels; labels are read while no resolution is known.
    """
    if len(data) % 2:
        raise SignalError("annotation-parse-error", f"{len(data)} bytes are not pairs")
    words = np.frombuffer(data, "<u2").tolist()
    n, at, now, raw = len(words), 0, 0, []
    code_of = lambda i: words[i] >> 10
    while at < n - 1:
        step = 0
        while at < n - 1 and code_of(at) == 59:
            if at + 2 >= n:
                raise SignalError("annotation-parse-error", "a skip ends before its step")
            wide = words[at + 1] << 16 | words[at + 2]
            step += wide - (1 << 32) if wide >> 31 else wide
            at += 3
        if at >= n - 1:
            break
        now += step + (words[at] & 1023)
        code, note = code_of(at), ""
        at += 1
        while at < n and code_of(at) > 59:
            if code_of(at) == 63:
                size = words[at] & 255
                if 2 * (at + 1) + size > len(data):
                    raise SignalError("annotation-parse-error", "a note runs past the end")
                note = data[2 * (at + 1) : 2 * (at + 1) + size].decode("latin-1")
                at += (size + 1) // 2
            at += 1
        raw.append((now, code, note))
    notes = [x[2] for x in raw if x[0] == 0 and x[1] == 22]
    rate, labels, defining = None, [], False
    for note in map(str.strip, notes):
        if defining:
            defining = note != "## end of definitions"
            m = re.fullmatch(r"(\d+) (\S+) (.+)", note) if defining else None
            if m:
                labels.append({"code": int(m[1]), "symbol": m[2], "description": m[3]})
        elif note.startswith("##") and rate is None:
            m = re.fullmatch(r"## time resolution: (\d+\.?\d*)", note)
            rate = float(m[1]) if m else None
            defining = note == "## annotation type definitions"
    own = {x["code"]: x["symbol"] for x in labels}
    kept = [x for x in raw if x[1] and not (x[0] == 0 and x[1] == 22)]
    return [{"sample_index": s, "code": c, "symbol": own.get(c, STANDARD_SYMBOLS.get(c, "")), "aux_note": t} for s, c, t in kept], rate, labels


def encode_annotations(events: list[tuple[int, int, str]]) -> bytes:
    """The stream of (sample, code, note), sorted by sample, with a skip before far events; for tests and exports."""
    out, before = [], 0
    for sample, code, note in events:
        step = sample - before
        if not 0 <= step <= 1023:
            out += [59 << 10, step >> 16 & 0xFFFF, step & 0xFFFF]
            step = 0
        out.append(code << 10 | step)
        if note:
            raw = note.encode("latin-1")
            out.append(63 << 10 | len(raw))
            out += np.frombuffer(raw + b"\0" * (len(raw) % 2), "<u2").tolist()
        before = sample
    return np.array([*out, 0], "<u2").tobytes()


def canonical_unit(units: str, record: str) -> str:
    if units.strip().lower() == "mv":
        return "mV"
    raise SignalError("unsupported-format", f"record {record} is in {units!r}; only millivolts can be read")


def decode_record(record: str, header: Header, content) -> list[dict]:
    """A row for each channel; content(name) gives a data file's bytes, and each file is decoded once."""
    if header.record != record:
        raise _malformed(f"the header of {record!r} declares {header.record!r}")
    decoded: dict[int, np.ndarray] = {}
    for name in dict.fromkeys(c.file for c in header.channels):
        own = [i for i, c in enumerate(header.channels) if c.file == name]
        formats, data = {header.channels[i].format for i in own}, content(name)
        if len(formats) > 1:
            raise _malformed(f"{name} has channels of several formats")
        fmt = formats.pop()
        if fmt == 212 and len(own) != 2:
            raise _malformed(f"{name} is of format 212 and needs two channels, not {len(own)}")
        frames = header.samples if header.samples > 0 else len(data) // required_bytes(fmt, len(own), 1)
        if len(data) != required_bytes(fmt, len(own), frames):
            raise _malformed(f"{name} has {len(data)} bytes; {frames} frames need {required_bytes(fmt, len(own), frames)}")
        for i, samples in zip(own, decode_212(data, frames) if fmt == 212 else decode_16(data, len(own), frames), strict=True):
            decoded[i] = samples
    rows = []
    for i, c in enumerate(header.channels):
        rows.append({"dataset_id": DATASET, "record_id": record, "subject_id": record, "channel_index": i, "channel_name": c.name or f"channel-{i + 1}", "unit": canonical_unit(c.units, record), "sample_rate_hz": header.rate_hz, "start_time_sec": 0.0, "gain": c.gain, "baseline": float(c.baseline), "adc_zero": c.adc_zero, "adc_bits": c.adc_bits, "initial_value": c.initial_value, "checksum": c.checksum, "block_size": c.block_size, "source_format": str(c.format), "samples": decoded[i], "comments": list(header.comments)})
    return rows


CHANNEL_SCHEMA = (
    "dataset_id string, record_id string, subject_id string, channel_index int, channel_name string, unit string, sample_rate_hz double, start_time_sec double, "
    "gain double, baseline double, adc_zero int, adc_bits int, initial_value int, checksum int, block_size int, source_format string, samples array<smallint>, comments array<string>"
)
EVENT_SCHEMA = "record_id string, ordinal int, sample_index long, code int, symbol string, aux_note string"


def declared_ids(text: str) -> list[str]:
    """Record ids of a RECORDS file, in its order: the first word of each line that isn't blank or a comment."""
    return [x.split()[0] for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def channel_batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows of decode_record as a batch of CHANNEL_SCHEMA; samples stay arrays."""
    names = [c.split()[0] for c in CHANNEL_SCHEMA.split(", ")]
    types = {"channel_index": pa.int32(), "sample_rate_hz": pa.float64(), "start_time_sec": pa.float64(), "gain": pa.float64(), "baseline": pa.float64(), "comments": pa.list_(pa.string())}
    types |= {n: pa.int32() for n in ("adc_zero", "adc_bits", "initial_value", "checksum", "block_size")}
    columns = [pa.array([r[n] for r in rows], types.get(n, pa.string())) if n != "samples" else None for n in names]
    data = [np.asarray(r["samples"], np.int16) for r in rows]
    offsets = np.cumsum([0, *map(len, data)]).astype(np.int32)
    columns[names.index("samples")] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(data) if data else np.empty(0, np.int16)))
    return pa.RecordBatch.from_arrays(columns, names=names)


def read_channels(files: DataFrame) -> DataFrame:
    """CHANNEL_SCHEMA of all records among files (name, content), from any source: each record decodes in one task.

    A file's bytes move to the record that needs them; where records lie in a folder, the data source reads
    each in its own task and moves nothing.
    """
    hea = files.where(F.lower("name").endswith(".hea")).select(F.regexp_replace("name", r"(?i)\.hea$", "").alias("record_id"), F.col("content").alias("header"))

    @F.arrow_udf("array<string>")
    def needed(headers: pa.Array) -> pa.Array:
        found = [parse_header(h.as_py().decode("utf-8", "replace")).channels for h in headers]
        return pa.array([list(dict.fromkeys(c.file for c in channels)) for channels in found], pa.list_(pa.string()))

    wanted = hea.select("record_id", F.explode(needed("header")).alias("name"))
    parts = wanted.join(files, "name", "left").groupBy("record_id").agg(F.collect_list(F.struct("name", "content")).alias("parts"))
    return _decoded(hea.join(parts, "record_id"))


def _decoded(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, header, parts in zip(*batch.columns, strict=True):
                record, have = record.as_py(), {p["name"].as_py(): p["content"] for p in parts}

                def content(name: str, have=have, record=record) -> bytes:
                    if name not in have or not have[name].is_valid:
                        raise SignalError("file-not-found", f"record {record} needs {name}")
                    return have[name].as_py()

                yield channel_batch(decode_record(record, parse_header(header.as_py().decode("utf-8", "replace")), content))

    return rows.select("record_id", "header", "parts").mapInArrow(run, CHANNEL_SCHEMA)


def read_events(files: DataFrame, enabled: bool = True) -> DataFrame:
    """EVENT_SCHEMA of all .atr files; not enabled: no rows, and no file is read."""
    atr = files.where(F.lower("name").endswith(".atr") & F.lit(enabled)).select(F.regexp_replace("name", r"(?i)\.atr$", "").alias("record_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield event_batch(record, parse_annotations(data.as_buffer().to_pybytes())[0])

    return atr.mapInArrow(run, EVENT_SCHEMA)


def event_batch(record: str, events: list[dict]) -> pa.RecordBatch:
    """The events of a record as a batch of EVENT_SCHEMA."""
    types = {"sample_index": pa.int64(), "code": pa.int32(), "symbol": pa.string(), "aux_note": pa.string()}
    columns = [pa.array([e[n] for e in events], t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array([record] * len(events), pa.string()), pa.array(range(len(events)), pa.int32()), *columns], names=["record_id", "ordinal", *types])


def catalogue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, unexpected file names): declared and discovered records with what they have and their first problem, never an error.

    records: record_id, position, in_records, has_header, has_data, has_annotations, readable, complete, problem; declared
    ids come first in their order, then other headers by name.
    """
    spark = files.sparkSession
    declared = files.where("name = 'RECORDS'").select("content").first()
    if declared is None:
        raise SignalError("file-not-found", "no file 'RECORDS'")
    ids = declared_ids(bytes(declared[0]).decode("utf-8", "replace"))
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "position int, record_id string")
    shape = F.regexp_extract("name", r"^([\s\S]+)\.([^.]*)$", 1)
    ext = F.lower(F.regexp_extract("name", r"^([\s\S]+)\.([^.]*)$", 2))
    rest = files.where("name <> 'RECORDS'").withColumn("stem", shape).withColumn("ext", ext)
    known = F.col("ext").isin("hea", "dat", "atr")
    has = rest.where(known).groupBy(F.col("stem").alias("record_id")).agg(*[F.max(F.col("ext") == e).alias(n) for e, n in (("hea", "has_header"), ("dat", "has_data"), ("atr", "has_annotations"))], F.max(F.when(F.col("ext") == "hea", F.col("content"))).alias("header"))
    found = listed.withColumn("in_records", F.lit(True)).join(has, "record_id", "full").where("in_records OR has_header")

    def one(record: str, header: bytes | None) -> dict:
        if header is None:
            return {"problem": "the record has no header file", "files": None}
        try:
            h = parse_header(header.decode("utf-8", "replace"))
            if h.record != record:
                raise _malformed(f"the header of {record!r} declares {h.record!r}")
            return {"problem": None, "files": list(dict.fromkeys(c.file for c in h.channels))}
        except SignalError as e:
            return {"problem": str(e), "files": None}

    @F.arrow_udf("struct<problem:string,files:array<string>>")
    def judge(records: pa.Array, headers: pa.Array) -> pa.Array:
        return pa.array([one(r.as_py(), h.as_py()) for r, h in zip(records, headers, strict=True)], pa.struct([("problem", pa.string()), ("files", pa.list_(pa.string()))]))

    judged = found.withColumn("j", judge("record_id", "header")).drop("header")
    names = rest.select(F.col("name").alias("file")).withColumn("there", F.lit(True))
    files_of = judged.select("record_id", F.posexplode("j.files").alias("k", "file")).join(names, "file", "left").where("there IS NULL")
    missing = files_of.groupBy("record_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "file"))), lambda s: s["file"]), ", ").alias("missing"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    readable = F.col("j.files").isNotNull()
    problem = F.coalesce("j.problem", F.when(F.col("missing").isNotNull(), F.concat(F.lit("data files that the header names are not there: "), "missing", F.lit("."))))
    records = judged.join(missing, "record_id", "left").select("record_id", "position", no("in_records"), no("has_header"), no("has_data"), no("has_annotations"), readable.alias("readable"), (readable & F.col("missing").isNull()).alias("complete"), problem.alias("problem"))
    return records.orderBy(F.col("position").asc_nulls_last(), "record_id"), rest.where(~known).select("name").orderBy("name")


class _Record(InputPartition):
    def __init__(self, record: str):
        self.record = record


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.table = options["path"], options.get("table", "channels")
        self.only = [x for x in options.get("records", "").split(",") if x]

    def partitions(self):
        names = list_folder(self.folder)
        ids = sorted({s for s, e in map(split_name, names) if e == "hea"})
        return [_Record(x) for x in ids if not self.only or x in self.only]

    def read(self, partition):
        record = partition.record
        if self.table == "events":
            try:
                data = read_bytes(self.folder, f"{record}.atr")
            except SignalError:
                return
            yield event_batch(record, parse_annotations(data)[0])
            return
        header = parse_header(read_bytes(self.folder, f"{record}.hea").decode("utf-8", "replace"))
        yield channel_batch(decode_record(record, header, lambda name: read_bytes(self.folder, name)))


class WfdbDataSource(DataSource):
    """spark.read.format("wfdb").option("table", "channels" or "events").load(folder): a partition for each record."""

    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return EVENT_SCHEMA if self.options.get("table") == "events" else CHANNEL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WfdbDataSource)
