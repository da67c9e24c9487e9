"""The pipeline's stages on their own input, and as a whole."""

from collections import Counter

import corpus_pipeline
import numpy as np
from helpers import SF

from pulsegrid.llm import compression, mixing, pieces, surrogates


def shingles_of(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least_of_similar(rows):
    """The smallest doc_id of each group of texts that links of similarity 0.8 or more join, by all pairs."""
    sets, root = [shingles_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old = root[i]
                root = [root[j] if x == old else x for x in root]
    return {min(d for (d, _), x in zip(rows, root, strict=True) if x == r) for r in set(root)}


def test_stages_take_effect(spark):
    """Each stage's decision on its own input, by plain code over the model's numbers or by all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns, name
        docs = out
    a, b = before["quality classifier"]
    scorer = compression.fit_quality(spark, SF).scorer()
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in a.collect() if scorer.score(r.text) >= 0.5}
    a, b = before["simhash near-dedup"]
    assert {r.doc_id for r in b.collect()} == least_of_similar([(r.doc_id, r.text) for r in a.collect()])
    a, b = before["pii surrogates"]
    got = {r.doc_id: r for r in b.collect()}
    for r in a.collect():
        found = surrogates.detect(r.text)
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text) and (got[r.doc_id].text == r.text) == (not found)
        assert not any(r.text[s:e] in got[r.doc_id].text for s, e, _ in found)
    a, b = before["mixing to target weights"]
    model = mixing.label_model(spark, SF)
    rows = [(r.doc_id, *model.posterior(r.text)) for r in a.collect()]
    n, p, got = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), Counter(r.doc_id for r in b.collect())
    taken = np.array([got[r[0]] for r in rows])
    share = (taken * n) @ p / (taken * n).sum()
    assert set(got) <= {r[0] for r in rows} and np.abs(share - np.array(list(mixing.TARGETS.values()))).max() < 0.03
    clean = p[:, 0] > 0.9
    assert (taken[clean] * n[clean]).sum() > 0.95 * n[clean].sum()
    a, b = before["sentencepiece"]
    coder = pieces.PieceCoder(pieces.model_proto())
    texts = {r.doc_id: r.text for r in a.collect()}
    assert all(coder.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in b.collect()) and b.count() == a.count()


def test_stages_stand_empty_input(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registered():
    import __spark_entry__

    names = [*__spark_entry__.queries()]
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
