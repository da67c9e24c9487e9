"""Operators 11 to 13 against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import SF
from pyspark.sql import functions as F

from pulsegrid.llm import minhash, spelling, tries


def plain(frame) -> list[tuple]:
    """Rows by sorted column names, as comparable text."""
    names = sorted(frame.columns)
    return sorted((tuple("" if pd.isna(v) else v if isinstance(v, str) else str(int(v)) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=str)


# --- spelling ---------------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words: dict, ratio: int = 10) -> list[tuple]:
    forms, near = {}, {w: [v for v in words if w and v and one_edit(w, v)] for w in words}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n, len(near[w]), forms[w], words[forms[w]] if forms[w] is not None else None, root))
    return sorted(out, key=str)


def brute_counts(rows, misspell, least_length=7, least=2) -> dict:
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def variants(spark, words: dict) -> list[tuple]:
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def test_variants_of_many_close_words(spark):
    r = random.Random(1)
    words = {"".join(r.choice("aàb") for _ in range(r.randrange(1, 7))): 10 ** r.randrange(6) + r.randrange(3) for _ in range(400)}
    assert variants(spark, words) == brute_variants(words)


def test_variants_with_runs_ties_chains_and_odd_words(spark):
    words = {"aab": 5, "ab": 50, "aaab": 500, "b": 5000, "xy": 10, "xz": 100, "xw": 100, "x": 1, "": 7, "𝔘𝔫": 1, "𝔘𝔫𝔦": 40, "ünï": 3, "unï": 30, "q$": 2, "q": 20}
    assert variants(spark, words) == brute_variants(words)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([("a\0b", 9), ("ab", 1), (None, 3)], "word string, n long")).collect()}
    assert len(got) == 3 and all(r.n_near == 0 and r.form is None and r.root == w for w, r in got.items())


def test_word_counts_of_odd_rows(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 100)
    monkeypatch.setattr(spelling, "_MOST", 10)
    for misspell in (None, 3):
        got = {r.word: r.n for r in spelling.word_counts(odd, least_length=4, misspell=misspell).collect()}
        assert got == brute_counts(odd_rows, misspell, 4)


def test_op11_matches_brute_force_and_sql(spark, duck):
    got = spelling.op11_spelling_variants(spark, SF).toPandas()
    assert plain(got) == plain(duck.execute(spelling.OP11_SQL).df())
    words = brute_counts([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 31)
    assert dict(zip(got.word, got.n, strict=True)) == words
    near = {r[0]: r for r in brute_variants({w: words[w] for w in sorted(words)[:400]})}
    assert sum(v[2] for v in near.values()) <= got.n_near.sum()


def test_empty_words(spark, empty):
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------------------

M64 = (1 << 64) - 1


def spark_hash(*parts) -> int:
    """Spark's xxhash64 of texts, ints and longs, signed."""
    h = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True) if isinstance(p, np.int64) else p
        h = xxhash.xxh64_intdigest(raw, h) if not isinstance(p, int) or isinstance(p, np.int64) else xxhash.xxh64_intdigest(p.to_bytes(4, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text: str | None) -> list[int]:
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w] or [""]
    bins: dict[int, int] = {}
    for k in range(max(1, len(words) - minhash.SIZE + 1)):
        h = spark_hash(*words[k : k + minhash.SIZE])
        b = (h >> (64 - minhash.BIN_BITS)) + minhash.BINS // 2
        bins[b] = min(h, bins.get(b, h))
    out = []
    for i in range(minhash.BINS):
        at = next((b for b in [i, *(spark_hash(i, k) % minhash.BINS for k in range(minhash.DRAWS))] if b in bins), None)
        if at is None:
            at = min(bins, key=lambda b: spark_hash(i, b, "rest"))
        out.append(spark_hash(np.int64(bins[at]).item().to_bytes(8, "little", signed=True), i) & ((1 << minhash.BITS) - 1))
    per = 64 // minhash.BITS
    longs = [sum(x << (minhash.BITS * (per - 1 - k)) for k, x in enumerate(out[g : g + per])) for g in range(0, minhash.BINS, per)]
    return [x - (1 << 64) if x >> 63 else x for x in longs]


def test_fingerprints_of_odd_rows(odd, odd_rows):
    got = sorted(((r.doc_id, list(r.fingerprint)) for r in minhash.fingerprints(odd).collect()), key=str)
    assert got == sorted(((i, brute_fingerprint(t)) for i, t in odd_rows), key=str)


def test_likeness_follows_similarity(spark):
    r = random.Random(3)
    base = [str(r.randrange(10**9)) for _ in range(600)]
    rows = [(k, " ".join(base), " ".join(base[: 6 * k] + [str(r.randrange(10**9)) for _ in range(600 - 6 * k)])) for k in range(0, 101, 4)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {x.k: x.s for x in df.select("k", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).collect()}
    shared = lambda k: max(0, 6 * k - 4)
    errors = [got[k] - shared(k) / (2 * 596 - shared(k)) for k in got]
    assert got[100] == 1.0 and got[0] < 0.1 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    short = spark.createDataFrame([("one", "two"), ("a b", "c d"), ("x y z", "q"), ("only", "only")] * 1, "a string, b string")
    likes = [x.s for x in short.select(minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).collect()]
    assert max(likes[:3]) < 0.15 and likes[3] == 1.0


def brute_next(rows):
    """Rows in order with the one after each: doc_id falling, nulls last, then by the text's hash, falling."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1] or "")))
    return [(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]


def edit(text, after):
    text, after = text or "", after or ""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


@pytest.mark.parametrize("coarse", [1, 100])
def test_edited_of_odd_rows(odd, odd_rows, coarse, monkeypatch):
    monkeypatch.setattr(minhash, "COARSE", coarse)
    got = sorted((str(r.doc_id), r.edited) for r in minhash.edited(odd.select("doc_id", "text")).collect())
    assert got == sorted((str(i), edit(t, n)) for i, t, n in brute_next(odd_rows))


def test_edited_of_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [r.edited for r in minhash.edited(one).collect()] == ["abcdab"]
    assert minhash.edited(empty.select("doc_id", "text")).count() == 0
    nulls = spark.createDataFrame([(None, "abc"), (None, None)], "doc_id long, text string")
    assert sorted(r.edited for r in minhash.edited(nulls).collect()) == ["", "ab"]


def test_op12_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in minhash.op12_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    text = lambda fp: "".join(f"{x & M64:016x}" for x in fp)
    for i, t, n in brute_next(docs):
        e, r = edit(t, n), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if i % 5 == 0:
            assert r.fingerprint == text(brute_fingerprint(t)) and r.edited_fingerprint == text(brute_fingerprint(e))


def test_op12_plan_has_no_python_and_one_shuffle_of_texts(spark):
    plan = minhash.op12_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1


# --- tries ------------------------------------------------------------------------------------------------------


def brute_trie(convs: dict) -> list[tuple]:
    """convs: conv_id to a list of (turn, words)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, who in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in under)]
        saved = sum((len(members[n]) - 1) * n[-1][1] for n in under if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, sha))
    return sorted(out, key=str)


def trie(spark, convs: dict) -> list[tuple]:
    rows = [(c, [(k, hashlib.md5(str(t).encode()).hexdigest(), w) for k, (t, w) in enumerate(turns)]) for c, turns in convs.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<turn: int, id: string, words: long>>").repartition(3)
    return sorted((tuple(r) for r in tries.prefix_trie(df).collect()), key=str)


@pytest.mark.parametrize("run", [20_000, 1, 3])
def test_trie_of_many_shapes(spark, run, monkeypatch):
    monkeypatch.setattr(tries, "RUN_ROWS", run)
    r = random.Random(run)
    convs = {c * 3 - 50: [(x := r.randrange(3), x + 1) for _ in range(r.randrange(5))] for c in range(120)}
    convs |= {10**6: [(7, 2)] * 40, 10**6 + 1: [(7, 2)] * 41, 10**6 + 2: [(7, 2)] * 41}
    assert trie(spark, convs) == brute_trie(convs)


def test_trie_of_one_turnless_conversation(spark):
    assert trie(spark, {4: []}) == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def test_many_copies_are_put_together_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tries, "ID_RANGE", 7)
    convs = {c - 40: [(1, 5), (2, 3)] for c in range(150)} | {999: [(1, 5)]}
    assert trie(spark, convs) == brute_trie(convs)


def test_node_layouts_grow_and_keep_their_order():
    root, keys = tries.Node(b""), [bytes([a, b]) + b"tail" * 3 for a in range(256) for b in (0, 255, 7)]
    random.Random(2).shuffle(keys)
    sizes = set()
    for n, key in enumerate(keys):
        tries.insert(root, key, n)
        sizes.add(root.size)
    assert sizes == {4, 16, 48, 256}
    found, stack = [], [(root, b"")]
    while stack:
        node, above = stack.pop()
        if node.end is not None:
            found.append(keys[node.end])
        stack += [(c, above) for c in reversed(node.ordered())]
    assert found == sorted(keys)
    assert all(tries.shared(a, b) == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(keys, keys[1:], strict=False))


def test_conversations_of_odd_rows(spark):
    rows = [(1, None, "user", "hi  there"), (1, 2, None, None), (1, 1, "user", "x"), (1, 1, "user", "a"), (2, None, "user", "hi  there"), (None, 1, "user", "lost"), (3, 5, "", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, turns string")
    got = {r.conv_id: [(t.turn, t.words) for t in r.turns] for r in tries.turns_of(df).collect()}
    assert set(got) == {1, 2, 3} and [t for t, _ in got[1]] == [None, 1, 1, 2] and got[1][0][1] == 2 and got[3] == [(5, 0)]
    same = tries.turns_of(df).select("conv_id", F.get("turns", F.lit(0))["id"].alias("id")).where("conv_id < 3").select("id").distinct().count()
    assert same == 1
    assert tries.prefix_trie(tries.rebuilt(tries.turns_of(df.limit(0)))).count() == 0


def test_op13_matches_brute_force_and_sql(spark, duck):
    got = tries.op13_prefix_trie(spark, SF).toPandas()
    assert plain(got) == plain(duck.execute(tries.OP13_SQL).df())
    own = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn)):
        own[r.conv_id].append(((r.role, r.text), len(re.findall("[^\x20\x09-\x0d]+", r.text))))
    taken = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    convs = {c: own.get(c - c % 20, [])[: taken[c]] + own[c][taken[c] :] for c in own}
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = pd.DataFrame(brute_trie(convs), columns=names).astype(object)
    assert plain(got) == plain(want)
