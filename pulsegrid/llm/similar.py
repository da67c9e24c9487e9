"""Near copies by exact shingle similarity: candidates from SimHash links and min-hash bands, each verified before components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode, keyed_text, materialise
from pulsegrid.llm.components import connected_components
from pulsegrid.llm.simhash import block_links, majority, shingles

#: Bands of min-hashes and hashes in each: a pair of similarity 0.8 shares no band with probability 0.00007, one of 0.9 with 3e-10.
BANDS, HASHES = 24, 5
#: Members of a block that one task compares at once; larger blocks are compared part by part, and then as pairs of parts where that joined less than all.
PART = 1024

_RANDOM = np.random.default_rng(42)
_FLIP = _RANDOM.integers(0, 1 << 63, (BANDS * HASHES, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, (BANDS * HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key of each band of the min-hashes of a set, as signed longs."""
    least = np.full(BANDS * HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, 8192):
        least = np.minimum(least, ((hashes[at : at + 8192] ^ _FLIP) * _TIMES).min(axis=1))
    raw, step = least.tobytes(), 8 * HASHES
    keys = np.fromiter((xxhash.xxh64_intdigest(raw[i : i + step], 42) for i in range(0, len(raw), step)), np.uint64, BANDS)
    return keys.view(np.int64).tolist()


def node_of(text: str | None) -> int:
    """The node of a text, as a signed long: texts with the same words in lower case are one."""
    x = xxhash.xxh64_intdigest(b" ".join(encode(text).lower().split()), 42)
    return x - (1 << 64) if x >> 63 else x


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                h = shingles(text, size)
                nodes.append(node_of(text))
                fps.append(majority(h))
                keys.append(bands(h))
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "node", "fp", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x.as_py(), size)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])

    return run


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of the nodes under "their sets have at least this Jaccard similarity": fewer than nodes."""
    size = np.array([x.size for x in sets])
    start = np.cumsum(size) - size
    names, local = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(names.size, bool)
    a, b, left = [], [], np.arange(nodes.size)
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            u = front.pop()
            own = local[start[u] : start[u] + size[u]]
            mark[own] = True
            common = np.add.reduceat(mark[local], start, dtype=np.int64)[left]
            mark[own] = False
            near = common / (size[u] + size[left] - common) >= similarity
            found = left[near]
            a += [nodes[u]] * found.size
            b += nodes[found].tolist()
            front.extend(found)
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _links_of_sorted(similarity: float):
    """Over rows (g, k, p, node, grams) sorted by the first three: the spanning links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def flush():
            if len(held) > 1:
                links = spanning_links(np.fromiter(held, np.int64, len(held)), [np.frombuffer(x, np.uint64) for x in held.values()], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["a", "b"])

        for batch in batches:
            for *this, node, grams in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if this != key:
                    yield from flush()
                    key, held = this, {}
                held[node] = grams
        yield from flush()

    return run


def _verified(rows: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    rows = rows.join(sets, "node").select("g", "k", "p", "node", "grams")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "g", "k", "p").sortWithinPartitions("g", "k", "p")
    return materialise(rows.mapInArrow(_links_of_sorted(similarity), "a long, b long"), name)


def near_copies(docs: DataFrame, size: int, distance: int, similarity: float, part: int = PART) -> DataFrame:
    """doc_id, th (a hash of the text) and component_id (the smallest doc_id reachable by links) of every row of docs.

    A link is a pair of texts whose sets of `size`-word shingles (lower case) have at least this Jaccard
    similarity. Pairs are compared where the texts share a band of min-hashes or a fingerprint, or their
    fingerprints are linked within `distance` bits; each group that shares one is joined as all its
    pairs would join it. Null ids never name a component while another id is there.
    """
    rows = materialise(keyed_text(docs).select("doc_id", "text", "th").mapInArrow(_sketches(size), "doc_id long, th long, node long, fp long, bands array<long>"), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th", "fp", "bands")).alias("one"))
    nodes = materialise(nodes.select("node", "first_id", "one.*"), "nodes")
    by_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "by-fp")
    linked = block_links(by_fp.select("fp"), distance)
    linked = linked.join(by_fp.toDF("a", "na"), "a").join(by_fp.toDF("b", "nb"), "b").select(F.lit(-2).alias("g"), F.xxhash64("a", "b").alias("k"), F.explode(F.array("na", "nb")).alias("node"))
    blocks = nodes.select("node", F.posexplode("bands").alias("g", "k")).select("g", "k", "node")
    blocks = materialise(blocks.unionByName(nodes.select(F.lit(-1).alias("g"), F.col("fp").alias("k"), "node")).unionByName(linked), "bands")
    # of blocks with the same members, one is compared
    sums = blocks.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    chosen = sums.groupBy("n", "low", "high", "x").agg(F.min(F.struct("g", "k")).alias("one"))
    chosen = materialise(chosen.select("one.g", "one.k", F.ceil(F.col("n") / part).cast("long").alias("parts")), "chosen")
    members = materialise(blocks.join(chosen, ["g", "k"]).select("g", "k", "node", "parts", F.pmod(F.xxhash64("node"), "parts").alias("p")), "members")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("doc_id").alias("want_id"), F.col("th").alias("want_th"))
    texts = keyed_text(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("th") == F.col("want_th"))).select("node", "text")
    sets = materialise(texts.mapInArrow(_sets(size), "node long, grams binary").dropDuplicates(["node"]), "sets")
    links = _verified(members, sets, similarity, "verified")
    large = members.where("parts > 1")
    if not large.isEmpty():
        roots = materialise(connected_components(links), "part-roots")
        large = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = large.groupBy("g", "k").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("g", "k")
        cells = large.join(apart, ["g", "k"]).select("g", "k", "node", "p", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other")).where("p <> other")
        cells = cells.select("g", F.xxhash64("k", F.least("p", "other")).alias("k"), F.greatest("p", "other").alias("p"), "node")
        links = links.unionByName(_verified(cells, sets, similarity, "verified-cells"))
    comps = materialise(connected_components(links), "roots")
    named = nodes.join(comps, "node").select("node", "root", "first_id")
    least = materialise(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = materialise(comps.join(least, "root").select("node", "component_id"), "named")
    nodes = materialise(nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    return rows.join(nodes, "node").select("doc_id", "th", "component_id")
