"""Quality rules as a short-circuit cascade of SQL predicates, cheapest rejection first."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample on which a rule's cost and selectivity are estimated, and how often a rule is timed on each.
SAMPLE_ROWS, RUNS = 1000, 2

#: Words of at least this many make a text; of 100 words at most this many may stand in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_WORDS = r"filter(split(text, '[ \t-\r]+'), w -> w <> '')"
_LINES = r"filter(split(text, '\n'), l -> l rlike '[^ \t-\r]')"
_SYMBOLS = "[#*$%&|<>]"

#: Words in 3-word windows found twice or more: windows sorted by a hash of their words stand beside their equals, which
#: the words themselves confirm; the starts of those that have an equal neighbour, in order, cover min(3, gap) words each. A bound
#: lambda variable (transform(array(x), v -> ...)) keeps each array computed once.
_SAME = "({0}.k <=> x.k AND w[{0}.i] = w[x.i] AND w[{0}.i + 1] = w[x.i + 1] AND w[{0}.i + 2] = w[x.i + 2])"
_BASE = f"""element_at(transform(array({_WORDS}), w -> named_struct('n_words', cast(size(w) as bigint), 'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)), 'n_repeat_words',
 CASE WHEN size(w) < 3 THEN 0L ELSE element_at(transform(
   array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS k, i AS i)))),
   s -> aggregate(
     sort_array(transform(filter(s, (x, j) -> coalesce({_SAME.format("get(s, j - 1)")}, false) OR coalesce({_SAME.format("get(s, j + 1)")}, false)), x -> x.i)),
     struct(-3 AS p, 0L AS c), (a, i) -> struct(i AS p, a.c + least(3, i - a.p) AS c), a -> a.c)), 1) END)), 1)"""


@dataclass(frozen=True)
class Rule:
    """A text fails where `fails` (SQL over text and the base columns) is true; null is not true."""

    name: str
    fails: str


def _count(sign: str) -> str:
    """How often a text has a sign of one byte; of a set of signs, regexp_count."""
    return f"(octet_length(text) - octet_length(replace(text, '{sign}', '')))"


#: The production rules. Integers only, so that any engine gives the same verdict.
RULES = (
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "4 * n_dup_lines > n_words OR n_dup_lines > 10 AND 10 * n_dup_lines > 3 * (octet_length(text) - octet_length(replace(text, '\n', '')) + 1)"),
    Rule("exclamations", f"5 * {_count('!')} > n_words"),
    Rule("capitals", "2 * regexp_count(text, '[A-Z]') > word_chars"),
    Rule("digits", "3 * regexp_count(text, '[0-9]') > word_chars"),
    Rule("brackets", f"5 * (regexp_count(text, '[{{}}=;]') + {_count('[')} + {_count(']')}) > n_words"),
    Rule("bullets", "2 * (length(text) - length(replace(text, '•', '')) + length(text) - length(replace(text, '…', ''))) > n_words"),
)


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); a null text counts as ''."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("b", F.expr(_BASE))
    return out.select(
        "doc_id",
        "text",
        "b.n_words",
        "b.word_chars",
        F.expr(f"cast(regexp_count(text, '{_SYMBOLS}') as bigint)").alias("n_symbols"),
        F.expr(f"element_at(transform(array({_LINES}), l -> cast(size(l) - size(array_distinct(l)) as bigint)), 1)").alias("n_dup_lines"),
        "b.n_repeat_words",
    ).withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


_NOW = "cast(java_method('java.lang.System', 'nanoTime') as bigint)"


def measure_rules(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS, runs: int = RUNS) -> dict[int, list[tuple[float, bool]]]:
    """Of each sampled row that passes the base rule, by its number: (nanoseconds, fails) of each rule.

    One job: each rule's expression runs `runs` times on each row between two readings of the clock, and the shortest
    counts, so that compilation and pauses don't. A random sample of about `rows` rows; its figures come to the driver.
    """
    total = docs.count()
    if not total or not rules:
        return {}
    sample = base_features(docs.sample(False, min(1.0, rows / total), 7)).where("NOT base_failed").withColumn("row", F.monotonically_increasing_id())
    n = len(rules) + 1  # the last is nothing at all: what reading the clock takes
    tried = sample.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(n * (runs + 1) - 1)))).withColumn("rule", F.expr(f"turn % {n}"))
    fails = "CASE rule " + " ".join(f"WHEN {i} THEN ({r.fails})" for i, r in enumerate(rules)) + " ELSE false END"
    timed = tried.select("row", "rule", "turn", F.expr(f"named_struct('a', {_NOW}, 'f', {fails}, 'b', {_NOW})").alias("t")).where(f"turn >= {n}")  # the first turn warms up
    best = timed.groupBy("row", "rule").agg(F.min(F.expr("t.b - t.a")).alias("ns"), F.bool_or(F.coalesce("t.f", F.lit(False))).alias("f"))
    out: dict[int, list] = {}
    for r in best.collect():
        out.setdefault(r["row"], [(0.0, False)] * n)[r["rule"]] = (float(r["ns"]), r["f"])
    return {row: [(max(1.0, ns - own[-1][0]), f) for ns, f in own[:-1]] for row, own in out.items()}


def order_rules(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS, runs: int = RUNS) -> list[tuple[Rule, float, float]]:
    """(rule, nanoseconds a row, rejected share), best first: each is the rule with the most rejections per cost on the sampled
    rows that those before it let pass.

    The order settles only how much work the cascade does, never a verdict. An empty table leaves the given order.
    """
    left, out, rest = list(measure_rules(docs, rules, rows, runs).values()), [], list(range(len(rules)))
    while rest:
        cost = {i: sum(own[i][0] for own in left) / max(1, len(left)) for i in rest}
        hits = {i: sum(own[i][1] for own in left) / max(1, len(left)) for i in rest}
        best = max(rest, key=lambda i: (hits[i] / max(1.0, cost[i]), -cost[i]))  # of rules that reject nothing more, the cheapest
        out.append((rules[best], cost[best], hits[best]))
        rest.remove(best)
        left = [own for own in left if not own[best][1]]
    return out


def cascade(rules) -> Column:
    """True where no rule fails; a rule runs only on rows that all before it let pass."""
    sql = "CASE " + " ".join(f"WHEN {r.fails} THEN false" for r in rules) + " ELSE true END" if rules else "true"
    return F.expr(sql)


def quality_rules(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base columns, base_failed and kept for every row of docs (doc_id, text); other columns are left out.

    Null and blank texts have no words and fail the base rule. Repeated rows and ids are judged one by one.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules, rows)]
    return base_features(docs).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered))).drop("text")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _duck(sql: str) -> str:
    """The same expression for DuckDB, which has no regexp_count."""
    sql = re.sub(r"regexp_count\(text, '\[(.*?)\]'\)", lambda m: f"length(regexp_replace(text, '[^{m[1]}]', '', 'g'))", sql)
    return sql.replace("octet_length(", "strlen(").replace("'\n'", "chr(10)")


OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM t),
k AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS k FROM w),
e AS (SELECT doc_id, text, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM k),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, sum(least(3, i - coalesce(p, -3)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id),
f AS (SELECT k.doc_id, k.text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(k.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM k LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join("(" + _duck(r.fails) + ")" for r in RULES)}) AS kept
FROM b
"""
