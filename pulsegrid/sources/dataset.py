"""One door to recordings of any format: detect, list, read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.plans.experiment import analyse
from pulsegrid.sources import edf, files, synthetic, wfdb


@dataclass(frozen=True)
class Dataset:
    """Recordings of one format: their files, and their channels and events as DataFrames."""

    format: str
    record_ids: list[str]
    files: DataFrame

    def channels(self, *records: str) -> DataFrame:
        """All channels, or those of some records; an unknown record is file-not-found. Other records' files are not decoded."""
        for r in records:
            if r not in self.record_ids:
                raise SignalError("file-not-found", f"no record {r!r}")
        chosen = self.files
        if records and self.format == "edf":
            chosen = chosen.where(F.regexp_replace("name", r"(?i)\.edf$", "").isin(*records))
        if self.format == "edf":
            return edf.read_channels(chosen)
        if records:
            headers = F.lower("name").endswith(".hea")
            chosen = chosen.where(~headers | F.regexp_replace("name", r"(?i)\.hea$", "").isin(*records))
        return wfdb.read_channels(chosen)

    def events(self, enabled: bool = True) -> DataFrame:
        """Annotations; EDF recordings have none here, and a disabled read touches no file."""
        return wfdb.read_events(self.files, enabled and self.format == "wfdb")

    def analyse(self, level: int = 4, filter_spec: dict | None = None, rate_hz: float | None = None, *records: str) -> DataFrame:
        return analyse(self.channels(*records), level, filter_spec=filter_spec, rate_hz=rate_hz)


def prepare(found: DataFrame) -> Dataset:
    """Format detection, then record discovery, over files (name, content)."""
    kind, ids = files.discover(found)
    return Dataset(kind, ids, found)


def open_folder(spark: SparkSession, folder: str) -> Dataset:
    return prepare(files.folder_files(spark, folder))


def open_uploads(spark: SparkSession, entries) -> Dataset:
    return prepare(files.uploaded_files(spark, entries))


def default_records(spark: SparkSession) -> DataFrame:
    """The synthetic record `sync` as channel rows."""
    rows = synthetic.synthetic_record(spark).groupBy("record_id", "channel_index", "channel_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "adc"))), lambda s: s["adc"].cast("short")).alias("samples"))
    return rows.select(F.lit(synthetic.DATASET).alias("dataset_id"), "record_id", F.col("record_id").alias("subject_id"), "channel_index", "channel_name", F.lit("mV").alias("unit"), F.lit(synthetic.RATE_HZ).alias("sample_rate_hz"), F.lit(0.0).alias("start_time_sec"), F.lit(synthetic.GAIN).alias("gain"), F.lit(synthetic.BASELINE).alias("baseline"), "samples")
