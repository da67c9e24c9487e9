"""URL filters: host and path rules first, then pattern rules found by their rarest literal token."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import kept, materialise

#: Host and path rules: (host/path, verdict). A rule fits its host and its subdomains where the path starts as its own; the longest wins.
SITES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Pattern rules that block, over the lower-cased URL: * is any text, ^ a character that is not a letter or digit, or an end.
PATTERNS = (
    "^utm_source=feed^", "^ref=affiliate^", "^sessionid=*^", "^phpsessid=*^", "^print=1^", "^replytocom=*^", "^doubleclick^", "^adserver^",
    "/ads/*.js^", "^banner^*^click^", "^casino^", "^poker^*^bonus^", "^porn^", "^xxx^", "^viagra^", "^torrent^*^download^", "^wp-login^php^",
    "/cart/add^", "/login?next=*", "/search?q=*", "^calendar^*^month=*", "m.*^en^*^html^", "blog.*^top^", "*.exe^", "*.zip^",
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def regex_of(pattern: str) -> str:
    """The pattern as a regular expression (as Python, Java and RE2 read it)."""
    parts = {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9]|\A|\z)"}
    return "".join(parts.get(c, re.escape(c) if not c.isalnum() and c not in "/=_&" else c) for c in pattern)


def tokens_of(pattern: str) -> list[str]:
    """Tokens (maximal runs of a-z, 0-9) that every URL that fits has whole: runs that end at a literal separator or ^ on both sides."""
    return [m[1] for m in re.finditer(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])", pattern) if m.start() > 0 and m.end() < len(pattern)]


def _python_regex(pattern: str) -> re.Pattern:
    # a * at an end of what is searched for says nothing, and would be tried from every place of a text
    return re.compile(regex_of(pattern.strip("*")).replace(r"\z", r"\Z"))


@dataclass(frozen=True)
class TokenIndex:
    """Patterns by their rarest token; those without a whole token are candidates of every URL."""

    by_token: dict[str, list[int]]
    always: list[int]


def build_index(urls: DataFrame, patterns=PATTERNS, url_col: str = "url") -> TokenIndex:
    """Counts the URLs that have each pattern token, over all urls, and indexes each pattern by its rarest (ties: the first by name)."""
    wanted = sorted({t for p in patterns for t in tokens_of(p)})
    lower = F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = F.array_intersect(F.split(lower, "[^a-z0-9]+"), F.array(*[F.lit(t) for t in wanted])) if wanted else F.array().cast("array<string>")
    seen = {r[0]: r[1] for r in urls.select(F.explode(has).alias("t")).groupBy("t").count().collect()}
    by_token: dict[str, list[int]] = {}
    always = []
    for i, p in enumerate(patterns):
        own = tokens_of(p)
        if own:
            by_token.setdefault(min(own, key=lambda t: (seen.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return TokenIndex(by_token, always)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty where the url is null or has no ://."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :]).groups()
    return host.translate(_LOWER), path


def rank(site: tuple[str, str]) -> tuple:
    """What sorts the rules (rule, verdict) that fit a URL, the one that counts first: the longest; of equal ones that of the longer
    host, then block, then the smaller text. So a rule that is listed with both verdicts blocks."""
    rule, verdict = site
    return -len(rule), -len(rule.partition("/")[0]), verdict != "block", rule


class Judge:
    """Rules in the memory of a worker: sites by host, patterns by token."""

    def __init__(self, sites, patterns, index: TokenIndex):
        self.sites: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(sites, key=rank):
            host, _, path = rule.partition("/")
            self.sites.setdefault(host, []).append(("/" + path, rule, verdict))
        self.index, self.patterns, self.regexes = index, patterns, {}

    def site(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule of the host or a domain above it: a look-up for each label of the host."""
        best: tuple[str | None, str | None] = (None, None)
        while host:
            fits = next(((r, v) for p, r, v in self.sites.get(host, ()) if path.startswith(p)), None)
            if fits and (best[0] is None or rank(fits) < rank(best)):
                best = fits
            host = host.partition(".")[2]
        return best

    def pattern(self, url: str | None) -> str | None:
        """The first pattern in the given order that fits; only candidates run their expression."""
        if not url:
            return None
        low = url.translate(_LOWER)
        found = set(self.index.always)
        for t in set(re.split("[^a-z0-9]+", low)):
            found.update(self.index.by_token.get(t, ()))
        return next((self.patterns[i] for i in sorted(found) if self.regex(i).search(low)), None)

    def regex(self, i: int) -> re.Pattern:
        """Compiled at its first use, and kept by the worker."""
        if i not in self.regexes:
            self.regexes[i] = _python_regex(self.patterns[i])
        return self.regexes[i]


#: Bytes of rules up to which each worker holds them all; beyond, rules and URLs meet in joins.
MOST_BYTES = 64 << 20


def filter_urls(pages: DataFrame, sites=SITES, patterns=PATTERNS, most: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, pattern and verdict of every row of pages (page_id, url); other columns are left out.

    sites and patterns are sequences, or tables (rule, verdict) and (pattern, position) of any size. Rules of up to `most` bytes
    are held by each worker; larger ones are joined, by the domains of a host and by the rarest token of a pattern.
    Of the rules that fit, the longest counts; then that of the longer host; then block. Both ways judge alike, with repeated rules, rules
    of both verdicts and any number of patterns without a whole token.
    A url that is null, empty or without :// has an empty host and path; patterns still see its text.
    Repeated rows and ids are judged one by one. An empty table gives no rows.
    """
    spark = pages.sparkSession
    if not isinstance(sites, DataFrame):
        sites = spark.createDataFrame(list(sites), "rule string, verdict string")
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame(list(zip(patterns, range(len(patterns)), strict=True)), "pattern string, position int")
    size = sum(t.agg(F.sum(F.octet_length(c))).first()[0] or 0 for t, c in ((sites, "rule"), (patterns, "pattern")))
    if size > most:
        return _joined(pages, sites, patterns)
    listed = [r[0] for r in patterns.orderBy("position", "pattern").select("pattern").collect()]
    judge = Judge([tuple(r) for r in sites.select("rule", "verdict").collect()], listed, build_index(pages, listed))

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("urls", name), lambda: judge)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = own.site(host, path)
                pattern = own.pattern(url)
                rows.append((host, path, rule, pattern, verdict or ("block" if pattern else "allow")))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return chosen.mapInArrow(run, "page_id long, host string, path string, rule string, pattern string, verdict string")


def _joined(pages: DataFrame, sites: DataFrame, patterns: DataFrame) -> DataFrame:
    """filter_urls by joins: distinct URLs have a row for each domain of their host, and for each of their tokens that some pattern has as its rarest."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.when(F.contains("url", F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    urls = pages.select("url").distinct().withColumn("rest", rest).withColumn("low", F.translate("url", upper, lower))
    urls = urls.select("url", "low", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), upper, lower).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    urls = materialise(urls, "urls")
    domains = urls.where("host <> ''").select("url", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")).alias("domain"))
    by_host = sites.select("rule", F.col("verdict").alias("ruling"), F.substring_index("rule", "/", 1).alias("domain"), F.expr("substring(rule, locate('/', rule))").alias("under")).distinct()
    # a URL looks up the starts of its path that are as long as some rule of the domain is: no domain's rules meet all of its URLs
    lengths = by_host.groupBy("domain").agg(F.collect_set(F.char_length("under")).alias("lengths"))
    starts = domains.join(lengths, "domain").withColumn("length", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))))
    fits = starts.withColumn("under", F.substring(F.col("path"), F.lit(1), F.col("length"))).join(by_host, ["domain", "under"])
    order = F.struct(-F.char_length("rule"), -F.char_length("domain"), F.col("ruling") != "block", F.col("rule"))
    ruled = fits.groupBy("url").agg(F.min_by(F.struct("rule", "ruling"), order).alias("r"))
    tokens = urls.select("url", F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+"))).alias("token")).where("token <> ''")
    with_tokens = materialise(patterns.mapInArrow(_pattern_rows, "pattern string, position int, regex string, tokens array<string>"), "patterns")
    wanted = with_tokens.select("pattern", F.explode("tokens").alias("token"))
    seen = tokens.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(seen, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    indexed = with_tokens.join(rarest, "pattern").select("pattern", "position", "regex", "token")
    found = tokens.join(indexed, "token").select("url", "pattern", "position", "regex")
    hit = found.join(urls.select("url", "low"), "url").where(F.expr("low rlike regex")).groupBy("url").agg(F.min(F.struct("position", "pattern")).alias("hit"))
    hits = [hit, *_hits_of_all(urls, with_tokens.where("size(tokens) = 0"))]
    hit = functools.reduce(DataFrame.unionByName, hits).groupBy("url").agg(F.min("hit").alias("hit"))
    judged = urls.join(ruled, "url", "left").join(hit, "url", "left").select("url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.ruling").alias("ruling"), F.col("hit.pattern").alias("pattern"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("of")).join(materialise(judged, "judged"), F.col("of") == F.col("url"), "left")
    verdict = F.coalesce("ruling", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", "pattern", verdict.alias("verdict"))


#: Patterns without a whole token that a worker holds at once in the joined way.
ALWAYS_PART = 1000


def _hits_of_all(urls: DataFrame, patterns: DataFrame) -> list[DataFrame]:
    """(url, hit) of patterns that have no whole token to be looked up by, so that every URL is held against them: a pass over the distinct
    URLs for each ALWAYS_PART of them, by position."""
    total = patterns.count()
    out, after = [], None
    for _ in range(-(-total // ALWAYS_PART)):
        rest = patterns if after is None else patterns.where((F.col("position") > after[0]) | (F.col("position") == after[0]) & (F.col("pattern") > after[1]))
        part = [(r["position"], r["pattern"]) for r in rest.select("position", "pattern").orderBy("position", "pattern").limit(ALWAYS_PART).collect()]
        if not part:
            break
        after, name = part[-1], uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], part=part, name=name) -> Iterator[pa.RecordBatch]:
            compiled = kept(("patterns", name), lambda: [_python_regex(p) for _, p in part])
            for batch in batches:
                found = [next((part[i] for i, x in enumerate(compiled) if x.search(low)), None) for low in batch.column(1).to_pylist()]
                at = [i for i, f in enumerate(found) if f]
                hit = pa.StructArray.from_arrays([pa.array([found[i][0] for i in at], pa.int32()), pa.array([found[i][1] for i in at], pa.string())], names=["position", "pattern"])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), hit], names=["url", "hit"])

        out.append(urls.where("low IS NOT NULL").select("url", "low").mapInArrow(run, "url string, hit struct<position:int,pattern:string>"))
    return out


def _pattern_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns = batch.column("pattern").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("pattern"), batch.column("position"), pa.array(map(regex_of, patterns), pa.string()), pa.array(map(tokens_of, patterns), pa.list_(pa.string()))], names=["pattern", "position", "regex", "tokens"])


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    def fit(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(starts_with(path, '/{path}') AND (host = '{host}' OR ends_with(host, '.{host}')))"

    longest = sorted(SITES, key=lambda x: -len(x[0]))
    cases = " ".join(f"WHEN {fit(r)} THEN '{r}'" for r, _ in longest)
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in longest)
    patterns = " ".join(f"WHEN regexp_matches(low, '{regex_of(p)}') THEN '{p}'" for p in PATTERNS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {cases} END AS rule, CASE {patterns} END AS pattern FROM h)
SELECT page_id, host, path, rule, pattern,
  CASE {verdicts} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r"""


OP7_SQL = _sql()
