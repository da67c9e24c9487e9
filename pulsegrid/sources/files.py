"""Files as rows (name, content): folders, uploads with unique bare names, format detection and record discovery."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.functions.naming import bare_name, bare_name_column, extension_column, split_name, stem_column

SCHEMA = "name string, content binary"


def memory_files(spark: SparkSession, files: dict[str, bytes | str]) -> DataFrame:
    """Files held in memory; a text is its UTF-8."""
    return spark.createDataFrame([(n, c.encode() if isinstance(c, str) else bytes(c)) for n, c in files.items()], SCHEMA)


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, on any file system that Spark reads; a missing folder is file-not-found."""
    try:
        rows = spark.read.format("binaryFile").load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SignalError("file-not-found", f"{folder} does not exist") from e
        raise
    return rows.select(F.url_decode(bare_name_column(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))).alias("name"), "content")


def uploaded_files(spark: SparkSession, entries: Iterable[tuple[str, bytes]]) -> DataFrame:
    """Files keyed by bare name; two with one bare name are refused."""
    found: dict[str, bytes] = {}
    for name, content in entries:
        bare = bare_name(name)
        if bare in found:
            raise SignalError("invalid-input", f"two files are named {bare!r}")
        found[bare] = content
    return memory_files(spark, found)


def read_file(files: DataFrame, name: str) -> bytes:
    row = files.where(F.col("name") == name).select("content").first()
    if row is None:
        raise SignalError("file-not-found", f"no file {name!r}")
    return bytes(row[0])


def count_extension(names: Iterable[str], extension: str) -> int:
    return sum(n.lower().endswith(extension.lower()) for n in names)


def detect_format(files: DataFrame) -> str:
    """wfdb or edf by the extensions .hea and .edf; both or neither is refused."""
    has = lambda e: F.count_if(F.lower("name").endswith(e))
    hea, edf = files.agg(has(".hea"), has(".edf")).first()
    if bool(hea) == bool(edf):
        raise SignalError("unsupported-format", f"{hea} .hea and {edf} .edf files: a folder must have one kind")
    return "wfdb" if hea else "edf"


def record_ids(files: DataFrame, extension: str) -> DataFrame:
    """Distinct stems of files with an extension, ascending."""
    stem = stem_column(F.col("name"))
    return files.where((extension_column(F.col("name")) == extension) & (stem != "")).select(stem.alias("record_id")).distinct().orderBy("record_id")


def discover(files: DataFrame) -> tuple[str, list[str]]:
    """(format, record ids) of a set of files."""
    kind = detect_format(files)
    return kind, [r[0] for r in record_ids(files, "hea" if kind == "wfdb" else "edf").collect()]


__all__ = ["SCHEMA", "bare_name", "count_extension", "detect_format", "discover", "folder_files", "memory_files", "read_file", "record_ids", "split_name", "uploaded_files"]
