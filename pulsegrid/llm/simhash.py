"""SimHash near-duplicates: pigeonhole blocks of fingerprints, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode, keyed_text, materialise
from pulsegrid.llm.components import connected_components

#: Differing bits of two fingerprints that are linked.
DISTANCE = 4
#: A fingerprint is cut into DISTANCE + EQUAL blocks. Differing bits spoil DISTANCE of them at most, so a linked pair shares EQUAL.
EQUAL = 3
#: Members of a block that one task compares at once; larger blocks are compared as pairs of parts, in many tasks.
PART = 4096


def shingles(text: str | None, size: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, as uint64; a text with fewer words is one shingle."""
    words = encode(text).lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    votes, n = np.zeros(64, np.int64), hashes.size
    for at in range(0, n, 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 4) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    return majority(shingles(text, size)) if encode(text).split() else 0


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    return keyed_text(docs).select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th long, fp long")


def masks(distance: int = DISTANCE) -> list[int]:
    """One mask for each way to choose EQUAL of the blocks, as signed longs."""
    edges = [64 * i // (distance + EQUAL) for i in range(distance + EQUAL + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [x - (1 << 64) if (x := sum(c)) >> 63 else x for c in combinations(blocks, EQUAL)]


def spanning_links(x: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join each component of x (distinct uint64) under "at most `distance` bits differ": fewer than len(x)."""
    out, left = [], x
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            u = front.pop()
            near = np.bitwise_count(left ^ u) <= distance
            if near.any():
                found = left[near]
                out.append((np.full(found.size, u, np.uint64), found))
                front.extend(found)
                left = left[~near]
    return out


_OUT = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("g", pa.int64()), ("k", pa.int64()), ("part", pa.int32())])


def _rows(kind: int, a, b, g: int = 0, k: int = 0, part=0) -> pa.RecordBatch:
    n = len(a)
    full = lambda v, t: pa.array(np.full(n, v, t))
    parts = pa.array(np.asarray(part, np.int32)) if np.ndim(part) else full(part, np.int32)
    return pa.RecordBatch.from_arrays([full(kind, np.int8), pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)), full(g, np.int64), full(k, np.int64), parts], schema=_OUT)


def _links_of_sorted(distance: int, most: int | None):
    """Over rows sorted by (g, k): links (kind 0) of each group of up to `most` fingerprints.

    The rows of a larger group pass through as kind 1 with the number of their part, and a
    row of kind 2 says how many parts it has; such a group is never held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], 0

        def flush():
            if key is None:
                return
            x = np.concatenate(held) if held else np.empty(0, np.uint64)
            if most and seen > most:
                if x.size:
                    first = seen - x.size
                    yield _rows(1, x, x, *key, part=(first + np.arange(x.size)) // most)
                yield _rows(2, np.zeros(1, np.int64), np.zeros(1, np.int64), *key, part=-(-seen // most))
            elif x.size > 1:
                for a, b in spanning_links(np.unique(x), distance):
                    yield _rows(0, a, b)

        for batch in batches:
            g, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((g[1:] != g[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = np.concatenate(([0], edges, [len(g)]))
            size = np.diff(bounds)
            inner = np.zeros(size.size, bool)
            inner[1:-1] = True
            two = bounds[:-1][inner & (size == 2)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
            near = near[fp[near] != fp[near + 1]]
            if near.size:
                yield _rows(0, fp[near], fp[near + 1])
            for i in np.flatnonzero((size > 2) | ~inner):
                s, e = int(bounds[i]), int(bounds[i + 1])
                if s == e:
                    continue
                this = (int(g[s]), int(k[s]))
                if this != key:
                    yield from flush()
                    key, held, seen = this, [], 0
                held.append(fp[s:e])
                seen += e - s
                if most and seen > most:
                    x = np.concatenate(held)
                    yield _rows(1, x, x, *key, part=(seen - x.size + np.arange(x.size)) // most)
                    held = []
        yield from flush()

    return run


def block_links(fps: DataFrame, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """Links (a, b) whose components are those of "at most `distance` bits differ" over distinct fingerprints fps (fp)."""
    spark, schema = fps.sparkSession, "kind byte, a long, b long, g long, k long, part int"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = F.array(*[F.struct(F.lit(i).cast("long").alias("g"), F.lit(m).alias("m")) for i, m in enumerate(masks(distance))])
    rows = fps.select("fp", F.explode(ways).alias("w")).select(F.col("w.g").alias("g"), F.col("fp").bitwiseAND(F.col("w.m")).alias("k"), "fp")
    rows = rows.repartition(n, "g", "k").sortWithinPartitions("g", "k")
    found = materialise(rows.mapInArrow(_links_of_sorted(distance, part), schema), "blocks")
    links = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("g", "k", "part", F.col("a").alias("fp"))
    totals = found.where("kind = 2").select("g", "k", F.col("part").alias("parts"))
    if not totals.isEmpty():
        pairs = hot.join(totals, ["g", "k"]).select("g", "k", "part", "fp", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
        cell = F.xxhash64("g", "k", F.least("part", "other"), F.greatest("part", "other"))
        cells = pairs.select(cell.alias("g"), F.least("part", "other").cast("long").alias("k"), "fp").distinct()
        cells = cells.repartition(n, "g", "k").sortWithinPartitions("g", "k")
        links = links.unionByName(cells.mapInArrow(_links_of_sorted(distance, None), schema).select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links, itself included) of every row of docs.

    Equal fingerprints are one node, so exact copies never meet in pairs. Rows without words (null,
    empty or blank text) have fingerprint 0 and are linked like any other. Null ids get a component
    like other rows, and never name one while another id is there. An empty table gives no rows.
    """
    return _with_components(fingerprints(docs, size).drop("th"), distance).select("doc_id", "fp", "component_id")


def _with_components(fps: DataFrame, distance: int) -> DataFrame:
    """fps (doc_id, fp and others) with component_id."""
    fps = materialise(fps, "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(block_links(nodes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    members = materialise(nodes.join(comps, "fp").select("fp", "root", "first_id"), "members")
    # tables of their own, so that joins on the root of a large component or the fingerprint of many copies can be split
    least = materialise(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = members.join(least, "root").select("fp", "component_id")
    nodes = materialise(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    return fps.join(nodes, "fp")


def keep_first(docs: DataFrame, size: int = 4, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """One document for each component, that with the smallest doc_id; columns as in docs.

    With a similarity, links are those of `similar.near_copies`: candidates whose sets of shingles
    have at least that Jaccard similarity. Rows with a null id stay, and repeated rows that stay do
    too. Where an id stands on different texts, each goes or stays with its own component.
    """
    if similarity is None:
        found = _with_components(fingerprints(docs, size), distance)
    else:
        from pulsegrid.llm import similar

        found = similar.near_copies(docs, size, distance, similarity)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th")).distinct()
    same = (F.col("doc.doc_id").cast("long") == F.col("drop_id")) & (F.xxhash64("doc.text").eqNullSafe(F.col("drop_th")))
    return docs.select(F.struct(*docs.columns).alias("doc")).join(drop, same, "left_anti").select("doc.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
