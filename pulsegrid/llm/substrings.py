"""Substring dedup: a count-min prefilter over all word windows, then an exact count of those it can't rule out."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode, materialise, shared_dir

#: Words of a window.
WINDOW = 35
#: Rows of the sketch. Each has at least two counters a window at any size, as a word and its space are two bytes at least.
DEPTH, LEAST_LOG = 2, 20
#: Counters of a shard, the unit that is merged (a byte a counter in the merging task).
SHARD_LOG = 24
#: Bytes of text in a bucket, about: what a task holds at once, with 16 bytes a window beside it.
BUCKET_BYTES = 8 << 20
#: Bits by which one exchange cuts the sketch, and counters meet shards: beyond 2**FAN_LOG shards, 2**FAN_LOG buckets are added up
#: before they are cut again, so that an exchange has 2**FAN_LOG blobs at most for each bucket of texts and row of the sketch.
FAN_LOG = 8

_BUCKETS = "spark.sql.sources.bucketing.maxBuckets"
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, x in ((up, base), (down, inverse)):
        out[0], out[1:] = 1, np.uint64(x)
        np.multiply.accumulate(out, out=out)
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Windows:
    """128-bit fingerprints of all windows of a word list, by rolling polynomials modulo 2**64, a stretch of windows at a time."""

    STRETCH = 1 << 16

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.tables = [_powers(b, self.STRETCH + window) for b in (_B1, _B2)]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, k = max(0, len(words) - self.window + 1), self.window
        out = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for at in range(0, n, self.STRETCH):
            h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words[at : at + self.STRETCH + k - 1])), ">u8").astype(np.uint64)
            total = np.zeros(h.size + 1, np.uint64)
            for into, x, (up, down) in zip(out, (h, _mix(h ^ np.uint64(_B2))), self.tables, strict=True):
                np.cumsum(x * up[: h.size], out=total[1:])
                into[at : at + self.STRETCH] = _mix((total[k:] - total[:-k]) * down[: h.size - k + 1])
        return out


def _pack(counters: np.ndarray) -> bytes:
    """Sorted counters of a part of the sketch: the bytes of a number, then the byte planes of their gaps."""
    width = 4 if not counters.size or int(counters[-1]) >> 32 == 0 else 8
    gaps = np.diff(counters, prepend=np.uint64(0)).astype(f"<u{width}")
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    width, planes = blob[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel(), dtype=f"u{width}")


def _first_of(s: np.ndarray) -> np.ndarray:
    first = np.ones(s.size, bool)
    first[1:] = s[1:] != s[:-1]
    return first


def _cut_up(counters: np.ndarray, log: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of sorted counters by parts of 2**log, each counter at most twice."""
    keep = np.ones(counters.size, bool)
    keep[2:] = counters[2:] != counters[:-2]
    s = counters[keep]
    part = s >> np.uint64(log)
    at = np.flatnonzero(_first_of(part))
    for k, own in zip(part[at].tolist(), np.split(s & np.uint64((1 << log) - 1), at[1:]), strict=False):
        yield k, _pack(own)


class Bucket:
    """The windows of all texts of a bucket, one text after the other: what each pass over it starts from."""

    def __init__(self, texts: pa.ChunkedArray, window: int, log: int):
        hashes, self.words, windows = Windows(window), [], []
        for x in texts:
            words = encode(x.as_py()).split()
            self.words.append(len(words))
            windows.append(hashes(words))
        self.h1, self.h2 = (np.concatenate([h[i] for h in windows]) if windows else np.empty(0, np.uint64) for i in range(2))
        self.starts = np.cumsum([0, *(h[0].size for h in windows)])
        self.log = log

    def counters(self, row: int) -> np.ndarray:
        return (self.h1, self.h2)[row] >> np.uint64(64 - self.log)

    def partial(self, shard_log: int) -> Iterator[tuple[int, int, bytes]]:
        """(row, shard, blob): the counters that the bucket has touched, each at most twice."""
        for row in range(DEPTH):
            for shard, blob in _cut_up(np.sort(self.counters(row)), shard_log):
                yield row, shard, blob

    def repeated(self, answers: dict[int, list[tuple[int, bytes]]]) -> np.ndarray:
        """Which windows have counters that were touched twice or more in every row, by the merged shards' answers."""
        out = np.ones(self.h1.size, bool)
        for row in range(DEPTH if out.size else 0):
            c = self.counters(row)
            order = np.argsort(c)
            first = _first_of(s := c[order])
            at = np.cumsum(first) - 1
            distinct = s[first]
            bits = np.zeros(distinct.size, bool)
            for shard, packed in answers.get(row, ()):
                a, e = np.searchsorted(distinct, np.array([shard, shard + 1], np.uint64) << np.uint64(self.shard_log))
                bits[a:e] = np.unpackbits(np.frombuffer(packed, np.uint8), count=e - a, bitorder="little")
            out[order] &= bits[at]
        return out

    shard_log = SHARD_LOG


def _merge(log: int):
    """Of a shard: adds up all buckets' partial sketches, and answers each with a bit for each counter that it has touched: twice or more in all?"""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << log, np.uint8)
        for blob in table["blob"]:
            s = _unpack(blob.as_py())
            first = _first_of(s)
            once = s[first]
            counts[once] = np.minimum(counts[once] + 1, 2)
            counts[s[~first]] = 2
        bits = []
        for blob in table["blob"]:
            s = _unpack(blob.as_py())
            bits.append(np.packbits(counts[s[_first_of(s)]] >= 2, bitorder="little").tobytes())
        return pa.table({"bucket": table["bucket"], "row": table["row"], "shard": table["shard"], "bits": pa.array(bits, pa.binary())})

    return run


def _added(span: int, log: int):
    """Of a part of 2**span counters: adds up the blobs of some buckets, one bucket from here on, and cuts the sum into parts of 2**log."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, row, part = (k.as_py() for k in key)
        cut = list(_cut_up(np.sort(np.concatenate([_unpack(b.as_py()).astype(np.uint64) for b in table["blob"]])), log))
        shards = [(part << (span - log)) + k for k, _ in cut]
        return pa.table({"bucket": pa.array([bucket] * len(cut), pa.int32()), "row": pa.array([row] * len(cut), pa.int32()), "shard": pa.array(shards, pa.int64()), "blob": pa.array([b for _, b in cut], pa.binary())})

    return run


def _passed_on(span: int, log: int):
    """What the sum of _added was answered, for each of the buckets that are in it."""

    def run(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        own = [x[_first_of(x)] for x in (_unpack(b.as_py()).astype(np.uint64) for b in blobs["blob"])]
        distinct = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        twice, mask = np.zeros(distinct.size, bool), (1 << (span - log)) - 1
        for shard, packed in zip(answers["shard"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            a, e = np.searchsorted(distinct, np.array([shard & mask, (shard & mask) + 1], np.uint64) << np.uint64(log))
            twice[a:e] = np.unpackbits(np.frombuffer(packed, np.uint8), count=e - a, bitorder="little")
        bits = [np.packbits(twice[np.searchsorted(distinct, x)], bitorder="little").tobytes() for x in own]
        return pa.table({"bucket": blobs["bucket"], "row": blobs["row"], "shard": blobs["shard"], "bits": pa.array(bits, pa.binary())})

    return run


def spans(log: int, shard_log: int, fan_log: int = FAN_LOG) -> list[int]:
    """Sizes (as powers of two) of the parts that a sketch of 2**log counters is cut into, one exchange after the other, down to shards."""
    return [max(shard_log, log - fan_log * i) for i in range(1, max(1, -(-(log - shard_log) // fan_log)) + 1)]


def answered(parts: DataFrame, sizes: list[int], fan_log: int = FAN_LOG) -> DataFrame:
    """(bucket, row, shard, bits) for each of parts (bucket, row, shard, blob): a bit for each distinct counter of the blob, touched twice or more in all?

    Parts are of 2**sizes[0] counters. Where those aren't shards yet, 2**fan_log buckets are added up first and cut into smaller parts, and
    the answers to the sum are dealt to its buckets: an exchange has 2**fan_log times as many parts as the one before, but as many fewer
    buckets, so that its blobs grow with the text and not with its square, and a shard merges few blobs at any size.
    """
    schema = "bucket int, row int, shard long, bits binary"
    if len(sizes) == 1:
        return parts.groupBy("row", "shard").applyInArrow(_merge(sizes[0]), schema)
    span, log = sizes[:2]
    parts = materialise(parts, "parts")
    whose = [F.shiftright("bucket", fan_log).alias("owner"), F.col("row").alias("owner_row"), F.col("shard").alias("part")]
    groups = parts.select("*", *whose).groupBy("owner", "owner_row", "part")
    sums = groups.applyInArrow(_added(span, log), "bucket int, row int, shard long, blob binary")
    got = materialise(answered(sums, sizes[1:], fan_log), "answers")
    of_sums = got.select("*", F.col("bucket").alias("owner"), F.col("row").alias("owner_row"), F.shiftright("shard", span - log).alias("part"))
    return groups.cogroup(of_sums.groupBy("owner", "owner_row", "part")).applyInArrow(_passed_on(span, log), schema)


def _partials(window: int, log: int, shard_log: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(Bucket(table["text"], window, log).partial(shard_log))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), **{n: pa.array(c, t) for n, c, t in zip(("row", "shard", "blob"), columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)}})

    return run


def _estimated(window: int, log: int, shard_log: int, texts: pa.Table, notes: pa.Table) -> tuple[Bucket, np.ndarray]:
    bucket, answers = Bucket(texts["text"], window, log), {}
    bucket.shard_log = shard_log
    for row, shard, bits in zip(*(notes[c].to_pylist() for c in ("row", "shard", "bits")), strict=True):
        answers.setdefault(row, []).append((shard, bits))
    once = [shard for shard, _ in answers.pop(-1, ())]
    repeated = bucket.repeated(answers)
    repeated[once] = False
    return bucket, repeated


def _candidates(window: int, log: int, shard_log: int):
    """The fingerprints of the windows that the sketch can't rule out; place: the bucket and the window's number in it."""

    def run(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        bucket, repeated = _estimated(window, log, shard_log, texts, notes)
        at = np.flatnonzero(repeated)
        place = (np.int64(key[0].as_py()) << np.int64(32)) + at
        return pa.table({"h1": bucket.h1[at].view(np.int64), "h2": bucket.h2[at].view(np.int64), "place": place})

    return run


def _cut(window: int, log: int, shard_log: int, as_text: bool):
    def run(key: tuple, texts: pa.Table, notes: pa.Table) -> pa.Table:
        bucket, repeated = _estimated(window, log, shard_log, texts, notes)
        removed, out = [], []
        for text, n, s, e in zip(texts["text"], bucket.words, bucket.starts[:-1].tolist(), bucket.starts[1:].tolist(), strict=True):
            words, own, gone = encode(text.as_py()).split(), repeated[s:e], 0
            if own.any():
                cover = np.zeros(n + 1, np.int64)
                cover[: own.size] += own
                cover[window : window + own.size] -= own
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
                gone = n - len(words)
            kept = b" ".join(words)
            removed.append(gone)
            out.append(kept.decode() if as_text else hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(bucket.words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(out, pa.string())})

    return run


def deal_out(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(bucket, doc_id and text of docs as a table of buckets in the shared folder; bytes of all texts).

    The passes that follow read a bucket as one task's group, without another shuffle of the texts. Rows are
    dealt by their place, so that no id or text can crowd a bucket. The catalogue keeps no entry of the table.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    if n > int(spark.conf.get(_BUCKETS)):
        spark.conf.set(_BUCKETS, str(n))
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    name, path = f"pulsegrid_buckets_{uuid.uuid4().hex}", shared_dir(spark, "buckets")
    rows.repartition(n, "bucket").write.option("path", path).option("compression", "zstd").bucketBy(n, "bucket").saveAsTable(name)
    dealt = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder, and dealt reads them
    return dealt, size


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, texts: bool = True, bucket_bytes: int = BUCKET_BYTES, shard_log: int = SHARD_LOG, fan_log: int = FAN_LOG) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row of docs (doc_id, text); kept: the words left, joined by a space, or their SHA-256.

    A word goes if a window of `window` words that covers it has the words of another window, of
    the same text or any other, as the input has them. Each bucket of texts sends the counters that its
    windows touch; shard by shard they are added up, and each bucket gets back which of its own were touched
    twice or more. The sketch is in no place as a whole and its load never grows. Windows with a counter that was touched
    but once are unique; the rest are counted exactly by 128-bit fingerprints, before which each
    task adds up its own, so that a passage in a third of all texts is a row for each task. Those
    that turn out to be unique after all go back to their buckets. Null or blank texts and texts shorter than
    a window lose nothing; repeated rows are copies of each other and lose all words that windows cover; null
    ids are kept as they are, and other columns are left out. An empty table gives no rows.
    """
    dealt, size = deal_out(docs, bucket_bytes)
    log = max(LEAST_LOG, int(size).bit_length())
    sizes = spans(log, min(shard_log, log), fan_log)
    groups, shard_log = dealt.groupBy("bucket"), sizes[0]
    parts = groups.applyInArrow(_partials(window, log, shard_log), "bucket int, row int, shard long, blob binary")
    answers = materialise(answered(parts, sizes, fan_log), "answers")
    found = groups.cogroup(answers.groupBy("bucket")).applyInArrow(_candidates(window, log, shard_log), "h1 long, h2 long, place long")
    once = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place")).where("n = 1")  # of a window that is there once, its place
    once = once.select(F.expr("cast(shiftright(place, 32) as int)").alias("bucket"), F.lit(-1).alias("row"), F.expr("place & 4294967295").alias("shard"), F.lit(None).cast("binary").alias("bits"))
    notes = answers.unionByName(materialise(once, "once"))
    return groups.cogroup(notes.groupBy("bucket")).applyInArrow(_cut(window, log, shard_log, texts), "doc_id long, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return out.withColumnRenamed("kept", "kept_sha256")


OP4_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM k WHERE g IN (SELECT g FROM k GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, {WINDOW}) AS t(j)),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
s AS (SELECT v.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM v ANTI JOIN c ON v.doc_id = c.doc_id AND v.p = c.p GROUP BY v.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)"""
