"""Mixing to target weights: domain posteriors of every document, and nonnegative rates whose expected token totals match."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode, materialise

#: Labelled rows that are fitted on, of each domain at most; their whole texts count.
ROWS_PER_DOMAIN = 1500
#: Words that may be features, and the least G-squared that makes one (0.9999 of chance words stay below 15).
MOST_WORDS, LEAST_G2 = 400, 20.0
#: Steps of projected gradient, and the relative error of the totals at which they end.
MOST_STEPS, TOLERANCE = 60, 1e-4

#: The mixture, of the query and of the pipeline: domains of the labels table and their share of the tokens.
TARGETS = {"clean": 0.93, "toxic": 0.02, "low": 0.05}

_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_SIGNS = bytes(i for i in range(256) if i not in b"#*$%&|<>!@{}[]=")
_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)
_EDGES = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")


def _shape(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size = max(1, len(words)), max(1, len(data))
    return [1.0, distinct / n, len(data.translate(None, _UPPER)) / size, len(data.translate(None, _SIGNS)) / n, len(data.translate(None, _DIGITS)) / size, 10.0 / (10 + n), size / n / 10]


@dataclass(frozen=True)
class DomainModel:
    """A softmax regression on a text's shape and on which of the chosen words it has."""

    domains: tuple[str, ...]
    words: dict[bytes, int]
    weights: np.ndarray  # (shape features + words) x domains
    scale: np.ndarray

    def posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        """(words of the text, probability of each domain); a text without words has the posterior of its shape."""
        data = encode(text)
        words = data.split()
        have = set(words)
        shape = np.array(_shape(data, words, len(have))) / self.scale
        hits = {i for w in have if (i := self.words.get(w)) is not None or (i := self.words.get(_bare(w))) is not None}
        z = shape @ self.weights[: len(shape)] + self.weights[[len(shape) + i for i in sorted(hits)]].sum(axis=0)
        p = np.exp(z - z.max())
        return len(words), p / p.sum()


def _bare(word: bytes) -> bytes:
    return word if word[:1].isalnum() and word[-1:].isalnum() and word.islower() else _EDGES.sub(b"", word).lower()


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, words = [], []
        for x in batch.column(1):
            data = encode(x.as_py())
            split = data.split()
            shapes.append(_shape(data, split, len(set(split))))
            words.append(sorted({_bare(w) for w in split} - {b""}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.binary()))], names=["domain", "shape", "words"])


def _choose_words(sample: DataFrame, sizes: dict[str, int]) -> dict[bytes, int]:
    """The words whose presence tells the domains apart best, by G-squared against independence, over all sampled rows."""
    n, domains = sum(sizes.values()), [d for d in sizes if sizes[d]]
    seen = sample.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)])
    g = F.lit(0.0)
    for i, d in enumerate(domains):
        have, expected = F.col(f"d{i}"), F.col("all") * sizes[d] / n
        for x, e in ((have, expected), (sizes[d] - have, sizes[d] - expected)):
            g = g + F.when(x > 0, 2 * x * F.ln(x / e)).otherwise(0.0)
    best = seen.where("all >= 5").select("word", g.alias("g")).where(F.col("g") >= LEAST_G2).orderBy(F.desc(F.round("g", 6)), "word").limit(MOST_WORDS).collect()
    return {bytes(r.word): i for i, r in enumerate(best)}


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, priors: np.ndarray, ridge: float = 0.3, steps: int = 400) -> np.ndarray:
    """Accelerated gradient steps; each domain weighs as its share of the labelled table."""
    n, w = len(y), np.zeros((x.shape[1], k))
    each = (priors / np.maximum(1, np.bincount(y, minlength=k)))[y] * n
    rate = 1.0 / (0.5 * np.linalg.norm(x * np.sqrt(each)[:, None], 2) ** 2 + ridge)
    hot, ahead, before = np.eye(k)[y], w, w
    for t in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w = ahead - rate * (x.T @ (each[:, None] * (p - hot)) + ridge * ahead)
        ahead, before = w + t / (t + 3) * (w - before), w
    return w


def fit_domains(docs: DataFrame, labelled: DataFrame, domains, rows: int = ROWS_PER_DOMAIN) -> DomainModel:
    """Fits on docs (doc_id, text) of labelled (doc_id, domain).

    At most `rows` rows of each domain are chosen by a hash of doc_id (of repeated ids, the least text counts). Their features are
    found where the texts are; a vector of each comes to the driver. A domain without rows has posterior near 0; no rows at all:
    all domains are equally likely.
    """
    domains, spark = tuple(domains), docs.sparkSession
    counts = {r[0]: r[1] for r in labelled.where(F.col("domain").isin(*domains)).groupBy("domain").count().collect()}
    parts = [labelled.where(F.col("domain") == d).select("doc_id", "domain").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for d in domains]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))  # rows * domains ids
    sample = materialise(texts.select("domain", "text").mapInArrow(_sample_rows, "domain string, shape array<double>, words array<binary>"), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    k = len(domains)
    if not sizes:
        return DomainModel(domains, {}, np.zeros((7, k)), np.ones(7))
    words = _choose_words(sample, {d: sizes.get(d, 0) for d in domains})
    shared = spark.sparkContext.broadcast(words)  # MOST_WORDS words

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(i for w in ws.as_py() if (i := shared.value.get(w)) is not None) for ws in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.int32()))], names=["domain", "shape", "hits"])

    got = sorted((domains.index(r.domain), list(r.shape), list(r.hits)) for r in sample.mapInArrow(vectors, "domain string, shape array<double>, hits array<int>").collect())
    y, shape = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    scale = np.maximum(1e-6, shape.std(axis=0) + (np.arange(7) == 0))
    x = np.zeros((len(y), 7 + len(words)))
    x[:, :7] = shape / scale
    for i, (_, _, hits) in enumerate(got):
        x[i, [7 + h for h in hits]] = 1.0
    priors = np.array([counts.get(d, 0) for d in domains], float)
    return DomainModel(domains, words, _softmax_fit(x, y, k, priors / priors.sum()), scale)


def _posterior_columns(docs: DataFrame, model: DomainModel, text: bool) -> DataFrame:
    """Of docs (a text column and others): the others, n_tokens and p, and the text too if asked."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_WORDS words and weights
    at, names = docs.columns.index("text"), [c for c in docs.columns if text or c != "text"]
    keep = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.posterior(x.as_py()) for x in batch.column(at)]
            n = pa.array([g[0] for g in got], pa.int64())
            p = pa.array([g[1].tolist() for g in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), n, p], names=[*names, "n_tokens", "p"])

    schema = docs.select(*names, F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0.0)).alias("p")).schema
    return docs.mapInArrow(run, schema)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, th (a hash of the text), n_tokens and p (array<double>, in the order of the model's domains) of every row of docs."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return _posterior_columns(chosen, model, text=False)


def _rate(moved: np.ndarray) -> F.Column:
    """A document's rate: 1, moved along its own expected tokens by the sum of all gradient steps, and kept nonnegative."""
    along = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(v)) for v in moved]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(0.0), 1.0 - F.col("n_tokens") * along)


def fit_rates(soft: DataFrame, targets: np.ndarray, most: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(moved, totals): the sum of the steps of projected gradient on soft (n_tokens, p) toward the domains' token totals.

    Minimises |A r - T|^2, in a metric, over rates r >= 0 from r = 1, where A has each document's expected tokens by
    domain. The projection is lazy: steps A' M (A r - T) add up, and r is the projection of 1 less their sum, so that a
    document's rate is found from its own row and a number for each domain. M is the inverse of A A' over the documents that are
    not held at 0 (with a millionth of all documents'), for which a whole step is exact while none changes sides; a step after
    which the error didn't shrink is half as long. Only sums over documents reach the driver.
    """
    k = len(targets)
    own = [F.col("p")[i] * F.col("n_tokens") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure() -> tuple[np.ndarray, np.ndarray]:
        free = F.when(F.col("r") > 0, 1.0).otherwise(0.0)
        sums = [F.sum(free * own[i] * own[j]) for i, j in pairs] + [F.sum(F.col("r") * x) for x in own]
        row = [v or 0.0 for v in soft.withColumn("r", _rate(moved)).agg(*sums).first()]
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, row, strict=False):
            gram[i, j] = gram[j, i] = v
        return gram, np.array(row[len(pairs) :])

    moved, before = np.zeros(k), np.inf
    gram, totals = measure()
    whole = gram
    for _ in range(most):
        error = np.abs(totals - targets).max()
        if error <= TOLERANCE * max(1.0, targets.sum()):
            break
        moved = moved + (1.0 if error < before else 0.5) * np.linalg.pinv(gram + 1e-6 * whole, rcond=1e-12) @ (totals - targets)
        gram, totals = measure()
        before = error
    return moved, totals


def fit_mixture(soft: DataFrame, model: DomainModel, targets: dict[str, float], whole: str | None = None) -> np.ndarray:
    """The sum of the steps toward the targets' shares of all tokens of soft (n_tokens, p). With `whole`, a domain's name, the shares are of as
    many tokens as make that domain's share what it has: it is taken whole, and the others are thinned or repeated to match."""
    share = np.array([targets[d] for d in model.domains], float)
    share /= share.sum()
    i = model.domains.index(whole) if whole else None
    held = soft.agg(F.sum("n_tokens" if i is None else F.col("n_tokens") * F.col("p")[i])).first()[0] or 0
    return fit_rates(soft, share * (held if i is None else held / share[i]))[0]


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], whole: str | None = None) -> DataFrame:
    """doc_id, th, n_tokens, p and rate of every row of docs; the rates' expected totals are the targets' shares (see fit_mixture).

    Where the targets can't be met by rates >= 0, the rates are the least-squares ones. Null and blank texts have no
    tokens and keep rate 1; repeated rows have equal rates. An empty table gives no rows.
    """
    soft = materialise(posteriors(docs, model), "posteriors")
    return soft.withColumn("rate", _rate(fit_mixture(soft, model, targets, whole)))


def copies(rate: F.Column, *key: str) -> F.Column:
    """How often a document is taken: its rate, rounded up or down by a hash of the key, so that the mean is the rate."""
    chance = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def take(docs: DataFrame, model: DomainModel, targets: dict[str, float], whole: str | None = None) -> DataFrame:
    """docs, each row as often as its rate says; columns as in docs. A row's rate is found again from its own text and the
    fitted steps, so that no text is shuffled, and no id or text that many rows share can crowd a task."""
    moved = fit_mixture(materialise(posteriors(docs, model), "posteriors"), model, targets, whole)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    rated = _posterior_columns(rows, model, text=True).withColumn("n", copies(_rate(moved), "doc_id", "th"))
    again = rated.select("rest", "text", F.explode(F.expr("array_repeat(0, n)")).alias("i"))
    return again.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: low where quality is 0, else toxic or clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")


def label_model(spark, sf_dir: str) -> DomainModel:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fit_domains(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = label_model(spark, sf_dir)
    p = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return mix(docs, model, TARGETS).select("doc_id", "n_tokens", *p, "rate", copies(F.col("rate"), "doc_id", "th").alias("copies"))
