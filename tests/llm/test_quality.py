"""Operators 1, 2 and 3."""

import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, rows_of
from pyspark.sql import functions as F

from pulsegrid.llm import compression, mixing, rules


def brute_base(text):
    text = text or ""
    words = text.encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)} if len(grams) < 3000 else None
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_base_columns(spark, odd, odd_rows):
    rows = [*odd_rows, (50, "a b c a b c d a b"), (51, "x\n x\nx\n\n\nx"), (52, "#*$ <b> ñ|")]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    got = rules.base_features(df).collect()
    want = {}
    for i, t in rows:
        want.setdefault((i, t or ""), brute_base(t))
    for r in got:
        w = want[r.doc_id, r.text]
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert have[:4] == w[:4] and w[4] in (None, have[4]), r.doc_id
    assert len(got) == len(rows)


def test_rules_match_sql(spark, duck):
    got = rules.op1_quality_rules(spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(rules.OP1_SQL).df())


def test_cascade_is_native_and_order_free(odd, empty):
    out = rules.quality_rules(odd)
    assert out.count() == 15 and not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    verdict = lambda rs: [tuple(r) for r in rules.base_features(odd).select("doc_id", "text", rules.cascade(rs).alias("k")).collect()]
    assert sorted(verdict(rules.RULES), key=str) == sorted(verdict(rules.RULES[::-1]), key=str)
    assert rules.quality_rules(empty).count() == 0


def test_order_is_by_rejections_per_cost(spark):
    """A dear rule comes after a cheap one that rejects as much, what another rule has rejected doesn't count again, and rows that
    fail the base rule don't count at all."""
    texts = [" ".join(f"w{i}x{j}" for j in range(80)) + (" #####" * 3 if i % 2 else "") + (" QQQQ" if i % 4 == 0 else "") for i in range(300)] + ["!!!"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dear = "size(filter(sequence(1, 300), i -> length(translate(text, 'w', '')) + i < 0)) > 0 OR text LIKE '%#%'"
    rules_ = (rules.Rule("dear", dear), rules.Rule("same", "text LIKE '%#####%'"), rules.Rule("other", "text LIKE '%QQQQ%'"), rules.Rule("short", "n_words < 10"))
    ordered = rules.order_rules(df, rules_, rows=10_000)
    names = [r.name for r, _, _ in ordered]
    cost = {r.name: ns for r, ns, _ in ordered}
    assert names[0] == "same" and names[1] == "other" and names[-1] == "dear" and cost["dear"] > 20 * cost["same"]
    assert {r.name: round(h, 6) for r, _, h in ordered} == {"same": 0.5, "other": 0.5, "short": 0.0, "dear": 0.0}
    assert {r.name for r, _, _ in rules.order_rules(df.limit(0), rules_)} == {r.name for r in rules_}


def test_costs_agree_between_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = ({r.name: ns for r, ns, _ in rules.order_rules(docs)} for _ in range(2))
    dear = [n for n in a if a[n] > 2000]
    assert dear and all(0.6 < a[n] / b[n] < 1.67 for n in dear)


def auc_of(score, good):
    rank = score.rank()
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_compression_scores(spark):
    """Held-out rows: the area under the ROC curve of the size difference alone."""
    q = compression.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc_of(q.score, q.quality == 1) > 0.95 and ((q.score >= 0.5).astype(int) == q.predicted).all() and q.score.between(0, 1).all()


def test_compression_query_against_plain_sizes(spark):
    """Every row's score from the two compressed sizes by plain zstandard, block by block."""
    import zstandard

    model = compression.fit_quality(spark, SF)
    packers = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = compression.op2_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        bad, good = (sum(len(p.compress(texts[r.doc_id][i : i + 1024])) for i in range(0, len(texts[r.doc_id]), 1024)) for p in packers)
        d = (bad - good) / max(bad, good, 1)
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * d + model.constant)))) < 1e-9
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)
    assert model.slope > 0


def test_dictionaries_take_whole_texts(monkeypatch):
    seen = []

    class Trained:
        def as_bytes(self):
            return b"trained"

    monkeypatch.setattr(compression.zstandard, "train_dictionary", lambda size, blocks, level: seen.extend(blocks) or Trained())
    texts = [bytes(97 + i // 40_000 for i in range(1_000_000)), b"short", b""]
    assert compression.dictionary(texts) == b"trained"
    assert b"".join(seen) == b"".join(texts) and max(map(len, seen)) <= compression.BLOCK


def test_held_out_rows_are_not_learned_from(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", compression.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_compression_of_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, ("good text number %d " % i if i % 2 else "#### $$$$ %d " % i) * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = compression.fit(docs, labels)
    got = compression.score(odd, model).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    assert compression.score(empty, model).count() == 0
    s = model.scorer()
    assert s.score("good text number 7 " * 9) > 0.5 > s.score("#### $$$$ 8 " * 9) and s.difference("") == s.difference(None) == 0
    one = compression.fit(docs, labels.where("label = 1"))
    assert one.scorer().score("x") > 0.5 and compression.fit(docs.limit(0), labels.limit(0)).scorer().score(None) >= 0
    assert compression.fit(docs.unionByName(docs), labels) == model
    scored = compression.score_column(odd, model)
    assert set(scored.columns) == set(odd.columns)


def mixed(spark, docs, model, targets):
    out = mixing.mix(docs, model, targets).collect()
    return out


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 400)
    n = rng.integers(10, 1000, 400)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    want = np.array([0.6, 0.3, 0.1]) * n.sum()
    steps, totals = mixing.fit_rates(soft, want)
    assert np.abs(totals - want).max() <= 1e-4 * n.sum()
    rate = np.array([r[0] for r in soft.select(mixing._rate(steps)).collect()])
    assert (rate >= 0).all() and np.allclose((rate * n) @ p, totals)


def test_targets_out_of_reach_are_least_squares(spark):
    soft = spark.createDataFrame([(10, [1.0, 0.0]), (20, [1.0, 0.0])], "n_tokens long, p array<double>")
    steps, totals = mixing.fit_rates(soft, np.array([60.0, 40.0]), most=20)
    assert abs(totals[0] - 60) < 1 and totals[1] == 0


def test_mixing_of_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, ("sun and sea " if i % 2 else "tax and law ") * (5 + i % 7)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "holiday" if i % 2 else "office") for i in range(80)], "doc_id long, domain string")
    model = mixing.fit_domains(docs, labels, ["holiday", "office"])
    assert model.posterior("the sun and sea")[1][0] > 0.5 > model.posterior("the tax and law")[1][0]
    out = mixed(spark, odd, model, {"holiday": 0.5, "office": 0.5})
    assert len(out) == 15 and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in out)
    assert {r.rate for r in out if r.n_tokens == 0} == {1.0}
    assert mixed(spark, empty, model, {"holiday": 0.5, "office": 0.5}) == []
    rate = {(r.doc_id, r.th): r.rate for r in out}
    taken = mixing.take(odd, model, {"holiday": 0.5, "office": 0.5})
    assert taken.columns == odd.columns and taken.schema == odd.schema
    got = Counter((r.doc_id, r.th) for r in taken.select("doc_id", F.xxhash64("text").alias("th")).collect())
    same = Counter((r.doc_id, r.th) for r in out)
    assert all(same[k] * int(rate[k]) <= got[k] <= same[k] * (int(rate[k]) + 1) for k in rate)
    none = mixing.fit_domains(docs, labels.limit(0), ["holiday", "office"])
    assert none.posterior("x")[1].tolist() == [0.5, 0.5]


def test_copies_follow_rates(spark):
    df = spark.range(4000).select("id", mixing.copies(F.lit(1.3), "id").alias("n"))
    mean, least, most = df.agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(mean - 1.3) < 0.03 and (least, most) == (1, 2)


@pytest.mark.parametrize("name", ["op3_mixing"])
def test_mixing_query(spark, name):
    rows = mixing.op3_mixing(spark, "/root/testdata/sf0.01").toPandas()
    tokens = rows.n_tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert abs((rows.rate * rows[f"p_{d}"] * rows.n_tokens).sum() / tokens - share) < 1e-3


def test_rates_against_projected_gradient_in_plain_numpy(spark):
    """The query's totals against an independent solution: plain projected gradient on the documents' own rates."""
    rows = mixing.op3_mixing(spark, SF).toPandas()
    a = rows[[f"p_{d}" for d in mixing.TARGETS]].to_numpy().T * rows.n_tokens.to_numpy()
    want = np.array(list(mixing.TARGETS.values())) * rows.n_tokens.sum()
    metric, r = np.linalg.inv(a @ a.T), np.ones(len(rows))
    for _ in range(20_000):
        r = np.maximum(0.0, r - 0.5 * a.T @ (metric @ (a @ r - want)))
    plain, ours = (np.abs(a @ x - want).max() / want.sum() for x in (r, rows.rate.to_numpy()))
    assert plain <= 5e-3 and ours <= min(plain, 1e-3) and (rows.rate >= 0).all()


def test_a_domain_taken_whole(spark):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([5, 1, 1], 300), rng.integers(10, 1000, 300)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    model = mixing.DomainModel(("a", "b", "c"), {}, np.zeros((7, 3)), np.ones(7))
    steps = mixing.fit_mixture(soft, model, {"a": 0.8, "b": 0.1, "c": 0.1}, whole="a")
    rate = np.array([r[0] for r in soft.select(mixing._rate(steps)).collect()])
    totals = (rate * n) @ p
    assert np.allclose(totals / totals.sum(), [0.8, 0.1, 0.1], atol=1e-3) and abs(totals[0] - n @ p[:, 0]) < 1e-3 * n.sum()
