"""Operators 4 and 10 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import SF, rows_of
from pyspark.sql import functions as F

from pulsegrid.llm import components, simhash, substrings


def brute_cut(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                stay[k : k + window] = [False] * window
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_windows_of_odd_rows(odd, odd_rows):
    got = [tuple(r) for r in substrings.remove_repeated_windows(odd, 35, texts=False).collect()]
    assert sorted(got, key=str) == brute_cut(odd_rows, 35)


def test_repeated_windows_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in substrings.op4_substring_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute_cut(rows, 35) and any(r[2] for r in got)


def test_repeated_windows_match_sql(spark, duck):
    assert rows_of(substrings.op4_substring_dedup(spark, SF).toPandas()) == rows_of(duck.execute(substrings.OP4_SQL).df())


def test_repeats_within_a_text_and_short_windows(spark):
    rows = [(1, "a b c a b c"), (2, "x y z"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.remove_repeated_windows(df, 2).collect()}
    assert got == {1: "", 2: "x y z", 3: ""}


def test_empty_substrings(empty):
    assert substrings.remove_repeated_windows(empty).count() == 0


@pytest.mark.parametrize("fan_log", [8, 3])
def test_many_buckets_and_shards_of_a_small_sketch(spark, odd, odd_rows, monkeypatch, fan_log):
    """Small shards and buckets, so that windows of all buckets meet in all shards, by one exchange or by several, and a sketch so small
    that it rules little out."""
    monkeypatch.setattr(substrings, "LEAST_LOG", 8)
    got = [tuple(r) for r in substrings.remove_repeated_windows(odd, 5, texts=False, bucket_bytes=20_000, shard_log=12, fan_log=fan_log).collect()]
    assert sorted(got, key=str) == brute_cut(odd_rows, 5)


def test_exchanges_grow_with_the_text(spark, monkeypatch):
    """Blobs of each exchange, at two sizes: by how often buckets were added up, at most as many as the buckets left times the parts, never buckets times shards."""
    monkeypatch.setattr(substrings, "LEAST_LOG", 8)
    fan_log, shard_log, of_bucket, write = 2, 12, 5_000, substrings.materialise

    def counted(df, name):
        out = write(df, name)
        if name == "parts":
            made.append(out.count())
        return out

    monkeypatch.setattr(substrings, "materialise", counted)
    for size in (32, 128):
        made = []
        rows = [(k, " ".join(f"{k}.{i}" for i in range(700))) for k in range(size)]
        rows[size // 2] = (size // 2, f"{rows[1][1]} end")
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 5, False, of_bucket, shard_log, fan_log).collect()}
        assert {k for k, n in got.items() if n} == {1, size // 2} and got[1] == 700
        size_of_all = sum(len(x) for _, x in rows)
        buckets, bits = -(-size_of_all // of_bucket), size_of_all.bit_length() - shard_log
        assert len(made) == -(-bits // fan_log) - 1 >= 2
        for level, n in enumerate(made):
            assert 0 < n <= substrings.DEPTH * -(-buckets // 2 ** (fan_log * level)) * 2 ** (fan_log * (level + 1))
        assert max(made) < substrings.DEPTH * buckets * 2**bits / 4


def test_no_tables_stay_in_the_catalogue(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    substrings.remove_repeated_windows(odd, 5, texts=False).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_spans_of_exchanges():
    assert substrings.spans(20, 20) == [20] and substrings.spans(30, 24) == [24] and substrings.spans(33, 24) == [25, 24] and substrings.spans(48, 24) == [40, 32, 24]
    some = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000).astype(np.uint64))
    assert (substrings._unpack(substrings._pack(some)) == some).all() and not substrings._unpack(substrings._pack(some[:0])).size


def test_sketch_never_underestimates():
    """Merged answers against plain counts: no repeated window is ruled out, and few others stay."""
    import pyarrow as pa

    log, shard_log = 17, 11
    texts = [" ".join(f"{k}.{i % (4000 - k)}" for i in range(4000 + 50 * k)) for k in range(6)]
    buckets = [substrings.Bucket(pa.chunked_array([texts[k : k + 2] + texts[:1]]), 3, log) for k in range(6)]
    shards = {}
    for b, x in enumerate(buckets):
        for row, shard, blob in x.partial(shard_log):
            shards.setdefault((row, shard), []).append((b, row, shard, blob))
    answers = {}
    for rows in shards.values():
        out = substrings._merge(shard_log)(None, pa.table({n: [r[i] for r in rows] for i, n in enumerate(("bucket", "row", "shard", "blob"))}))
        for r in out.to_pylist():
            answers.setdefault(r["bucket"], {}).setdefault(r["row"], []).append((r["shard"], r["bits"]))
    true = Counter(zip(np.concatenate([x.h1 for x in buckets]).tolist(), np.concatenate([x.h2 for x in buckets]).tolist(), strict=True))
    extra = 0
    for b, x in enumerate(buckets):
        x.shard_log = shard_log
        estimated = x.repeated(answers[b])
        twice = np.array([true[k] > 1 for k in zip(x.h1.tolist(), x.h2.tolist(), strict=True)])
        assert estimated[twice].all()
        extra += int((estimated & ~twice).sum())
    assert len(shards) == 2 << log - shard_log and extra < 0.1 * sum(true.values())
    some = np.unique(np.random.default_rng(0).integers(0, 1 << 24, 5000).astype(np.uint64))
    assert (substrings._unpack(substrings._pack(some)) == some).all()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    fp = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, f"{f:016x}", least[find(i)]) for i, ((doc, _), f) in enumerate(zip(rows, fp, strict=True))), key=str)


def test_near_duplicates_of_odd_rows(odd, odd_rows):
    rows = [r if len(r[1] or "") < 100_000 else (r[0], r[1]) for r in odd_rows]
    got = [(r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_near_duplicates_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in simhash.op10_simhash_near_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == brute_components(rows)


@pytest.mark.parametrize("part,distance", [(4096, 4), (8, 4), (4096, 6)])
def test_block_links_keep_components(spark, part, distance):
    """Clusters of near fingerprints, also where blocks are larger than a task compares at once."""
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(30):
            x = centre
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.block_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, part)
    got = {x.node: x.root for x in components.connected_components(links).collect()}
    parent = {x: x for x in signed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in signed:
        for j in signed:
            if i < j and bin((i ^ j) % (1 << 64)).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_components_of_chains_hubs_and_nulls(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *hub, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_keep_first(odd, empty):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    ids = sorted((r.doc_id for r in kept.select("doc_id").where(F.col("doc_id").isNotNull()).collect()))
    assert 1 in ids and 2 not in ids and rows_of(kept.where("doc_id IS NULL").select("text").toPandas())


def brute_similar(rows, size=5, least=0.8):
    """Component ids by all pairs' exact Jaccard similarity."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                old = root[i]
                root = [root[j] if x == old else x for x in root]
    first = {r: min((d for (d, _), x in zip(rows, root, strict=True) if x == r and d is not None), default=None) for r in set(root)}
    return [first[r] for r in root]


def near_rows():
    """Texts that share 0.8 or more of their five-word shingles far beyond 6 bits, and others below it."""
    r, rows = random.Random(5), []
    for i in range(40):
        words = [f"w{r.randrange(9000)}" for _ in range(150)]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 5):
            changed = list(words)
            for at in range(2, 150, 150 // (1 + j)):
                changed[at] = f"x{r.randrange(9000)}"
            rows.append((10 * i + j, " ".join(changed)))
    return rows


@pytest.mark.parametrize("part", [1024, 3])
def test_near_copies_are_linked_by_similarity(spark, odd, odd_rows, part):
    from pulsegrid.llm import similar

    rows = near_rows()
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 6, 0.8, part).collect()}
    want = {d: c for (d, _), c in zip(rows, brute_similar(rows), strict=True)}
    assert got == want and 40 < len(set(want.values())) < len(rows)
    got = [(r.doc_id, r.component_id) for r in similar.near_copies(odd, 5, 6, 0.8, part).collect()]
    assert sorted(got, key=str) == sorted(((d, c) for (d, _), c in zip(odd_rows, brute_similar(odd_rows), strict=True)), key=str)


def test_pipeline_stage_keeps_one_of_similar_texts(spark, empty):
    import corpus_pipeline

    rows = near_rows()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert kept == set(brute_similar(rows)) and corpus_pipeline.drop_near_copies(spark, empty, SF).count() == 0


def test_keep_first_tells_texts_of_an_id_apart(odd, odd_rows):
    kept = [r.text for r in simhash.keep_first(odd).collect()]
    assert odd_rows[3][1] in kept and odd_rows[1][1] in kept and simhash.keep_first(odd).where("doc_id = 2").count() == 0
