"""Quality classifier: which of two zstandard dictionaries, of good or of bad text, compresses a text better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode

#: Labelled rows that are fitted on, of each class at most: a random sample by a hash of doc_id.
ROWS_PER_CLASS = 1500
#: Bytes of a dictionary, of a block (each is compressed alone, so that long texts meet the dictionaries as short ones do), and the level.
DICT_BYTES, BLOCK, LEVEL = 65_536, 1024, 3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries, and a logistic calibration (slope, constant) of the size difference."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    constant: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: CompressionModel):
        self.model = model
        self.good, self.bad = self._packer(model.good), self._packer(model.bad)

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / the larger, of the whole text; 0 without text."""
        data = encode(text)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        if not blocks:
            return 0.0
        good, bad = (sum(map(len, map(p.compress, blocks))) for p in (self.good, self.bad))
        return (bad - good) / max(bad, good)

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.difference(text) + self.model.constant
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, counts: dict[int, int], ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(slope, constant) by Newton's steps; each class weighs as its count in the whole labelled table."""
    scale = max(1e-9, float(x.std()))
    x, w, total = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2), sum(counts.values())
    each = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) * len(y) / total
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, x.T @ (each * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on all blocks of the samples, as they are compressed later; of samples too few or too small to train on,
    their last bytes as they are."""
    blocks = [x[i : i + BLOCK] for x in samples for i in range(0, len(x), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICT_BYTES:].rjust(16)


def _of_text(texts: DataFrame, make, kind: str, arrow: pa.DataType):
    """(label, x) with x = make()(text) of texts (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(x.as_py()) for x in batch.column(1)], arrow)], names=["label", "x"])

    return texts.select("label", "text").mapInArrow(run, f"label int, x {kind}").collect()


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> CompressionModel:
    """Fits on docs (doc_id, text) of labels (doc_id, label 0 or 1): three of four sampled rows train the dictionaries, the fourth calibrates.

    At most `rows` rows of each class are chosen by a hash of doc_id (of repeated ids, the least text counts). The whole texts
    of those that train come to the driver; of the others, whose whole texts are measured, a number.
    With a class missing, the score is the share of the other; rows with another or null label are left out.
    """
    counts = {r[0]: r[1] for r in labels.where("label IN (0, 1)").groupBy("label").count().collect()}
    chosen = [labels.where(F.col("label") == k).select("doc_id", F.lit(k).alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").where("octet_length(text) > 0").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    trains = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(4)) > 0
    got = sorted((r.label, bytes(r.x)) for r in _of_text(texts.where(trains), lambda: encode, "binary", pa.binary()))
    good, bad = ([x for label, x in got if label == k] for k in (1, 0))
    sure = 4.0 if counts.get(1, 0) >= counts.get(0, 0) else -4.0
    if not (good and bad):
        return CompressionModel(b" " * 16, b" " * 16, 0.0, sure)
    model = CompressionModel(dictionary(good), dictionary(bad))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries: 2 * DICT_BYTES at most
    measured = sorted((r.label, r.x) for r in _of_text(texts.where(~trains), lambda: shared.value.scorer().difference, "double", pa.float64()))
    y, x = np.array([m[0] for m in measured]), np.array([m[1] for m in measured])
    if len(set(y.tolist())) < 2:
        return CompressionModel(model.good, model.bad, 0.0, sure)
    return CompressionModel(model.good, model.bad, *_logistic(x, y, counts))


def score_column(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """docs (text and others) and score, 0 to 1; a column score of docs is replaced. Null and empty texts get the score of no
    difference; repeated rows get equal scores, each its own row; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries: 2 * DICT_BYTES at most
    docs = docs.drop("score")
    at, names = docs.columns.index("text"), [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            out = [scorer.score(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=names)

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    return score_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "score")


def held_out() -> F.Column:
    """Rows that are never learned from: crc32 of doc_id as text, modulo 3, is 1. A null id is not held out, and has no labels."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(spark, sf_dir: str) -> CompressionModel:
    """A model of labels.quality from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return fit(docs, labels)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit_quality(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
