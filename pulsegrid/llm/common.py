"""What the corpus operators share: reading tables, the shared folder, texts as bytes and memo tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.storage import materialise, shared_dir

__all__ = ["Memo", "encode", "kept", "keyed_text", "materialise", "read", "shared_dir", "slices"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and th, a hash of the text: (doc_id, th) tells rows apart even where ids repeat or are null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts (or bytes) of column `at` are of `most` bytes together, or one row: what a task makes of them stays bounded."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            room = (ends[start - 1] if start else 0) + most
            end = max(start + 1, int(np.searchsorted(ends, room, side="right")))
            yield batch.slice(start, end - start)
            start = end


class Memo(dict):
    """A dict that fills itself by make(key). At `most` entries it becomes the older generation of two, of which
    entries come back when they are asked for again, so that frequent keys stay. Keys of more than LONGEST characters
    are made each time: what it holds is bounded whatever the texts are like."""

    LONGEST = 64

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, self)
        if value is self:
            value = self.make(key)
        self[key] = value
        return value


_KEPT: dict = {}


def kept(key, make):
    """make() of this worker's process, once for each key: tasks that follow find its tables filled."""
    if key not in _KEPT:
        if len(_KEPT) >= 4:
            _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def encode(text: str | None) -> bytes:
    """UTF-8; null is empty, a lone surrogate becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")
