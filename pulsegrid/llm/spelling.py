"""Spelling variants: words that differ by one edit, found by sorting the rotations of terminator-marked words.

A word's rotations stand for all ways to look at it from one place. Of a rotation, the last character is the one that an
edit at that place touches: rotations that agree before it are words that differ by a replacement there, and a rotation
that ends before it is the word without the character. So each rotation goes to the sorted table as itself and without its
last character, and the neighbours of a word stand side by side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.llm.common import materialise, read, slices

#: The mark of a word's end in its rotations; words that have it themselves have no neighbours.
END = "\x00"
#: A word takes a neighbour for its form from this many times its own count on.
RATIO = 10
#: Latin letters of one byte stay, A-Z as a-z; every other byte becomes a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Bytes of a text that are split at once, and words that a task counts before it sends them on.
_PIECE, _MOST = 4 << 20, 200_000


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw cut at blanks, in pieces of about _PIECE bytes: a long text is never a list of all its words."""
    start = 0
    while len(raw) - start > _PIECE:
        end = raw.find(b" ", start + _PIECE)
        if end < 0:
            break
        yield raw[start:end]
        start = end
    yield raw[start:] if start else raw


def word_counts(docs: DataFrame, least_length: int = 7, least: int = 2, misspell: int | None = None) -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF of all whole texts of docs (doc_id, text), A-Z lower-cased, of at
    least `least_length` code points and `least` occurrences.

    With `misspell`, a run loses the code point h % length if misspell divides h, the crc32 of "<doc_id>:<run>" (a null id
    is empty): planted errors, the same each time. Null and empty texts have no words; repeated rows count each time;
    other columns are not looked at. A task holds the counts of at most 200,000 words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def take() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in slices(batches, 1):
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                head = zlib.crc32(b"%s:" % (b"" if not key.is_valid else str(key.as_py()).encode()))
                for piece in _pieces(text.as_py().encode("latin-1", "replace").translate(_LETTERS)):
                    for w, n in Counter([w for w in piece.split() if len(w) >= least_length]).items():
                        if misspell:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                            if h % misspell == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least_length:
                                    continue
                        found[w] += n
                    if len(found) > _MOST:
                        yield take()
        if found:
            yield take()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, n) of words (word, n): every rotation of the word and END as key with '' as skipped, and each that
    doesn't end with END without its last character, which is skipped."""
    w, size = F.col("word"), F.char_length("word")
    before = lambda s: F.substring(w, F.lit(1), s)
    after = lambda s: F.substring(w, s + 1, size)
    whole = F.transform(F.sequence(F.lit(0), size), lambda s: F.struct(F.concat(after(s), F.lit(END), before(s)).alias("key"), F.lit("").alias("skipped")))
    shorter = F.transform(F.sequence(F.lit(1), size), lambda s: F.struct(F.concat(after(s), F.lit(END), before(s - 1)).alias("key"), F.substring(w, s, F.lit(1)).alias("skipped")))
    plain = words.where((size > 0) & ~F.contains(w, F.lit(END)))
    return plain.select("n", F.explode(F.concat(whole, shorter)).alias("r")).select("r.key", "r.skipped", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): the number of words one inserted, deleted or replaced code point away, and of the one with
    the largest n (ties: the smallest in code-point order) struct<less, word>, less being -n. words (word, n) are distinct.

    best is left out where no neighbour has more than the word's own n. Groups of equal keys have at most as many rows as
    the alphabet has characters, and one; they are scanned as sorted, and no pair is ever made. A character
    that could be deleted from several places of a run of equal ones counts at the first.
    """
    at = F.instr("key", END)
    key = F.col("key")
    word = F.concat(F.substring(key, at + 1, F.char_length(key)), F.col("skipped"), F.substring(key, F.lit(1), at - 1))
    group = W.Window.partitionBy("key")
    skips = F.col("skipped") != ""
    first = skips & (F.substring(key, F.char_length(key), F.lit(1)) != F.col("skipped"))
    rows = rotations(words).repartition("key").withColumn("word", word).withColumn("first", first)
    number = lambda c: F.sum(c.cast("long")).over(group)
    rows = rows.select("word", "n", "first", skips.alias("skips"), F.count(F.lit(1)).over(group).alias("rows"), number(skips).alias("skipping"), number(F.col("first")).alias("firsts"), F.min(F.struct((-F.col("n")).alias("less"), "word")).over(group).alias("best"))
    rows = rows.where("rows > 1")
    near = F.when(F.col("skips"), F.col("skipping") - 1 + F.when(F.col("first"), F.col("rows") - F.col("skipping")).otherwise(0)).otherwise(F.col("firsts"))
    found = rows.select("word", "n", near.alias("near"), F.when(F.col("best.word") != F.col("word"), F.col("best")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(alone).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which have no circles: the last word that forms lead to. Each round doubles the
    steps taken, so rounds are few; each is written to the shared folder."""
    chain = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not chain.where("moved").isEmpty():
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        chain = chain.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        chain = materialise(chain, "forms")
    return chain.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n): a word's form is its neighbour of largest n, where
    that is at least ratio (above 1) times its own; root is where forms lead to, the word itself without a form.

    An empty table gives no rows. A null or empty word, or one with U+0000, has no neighbours; words are compared as they are.
    """
    near = materialise(neighbours(materialise(words, "words")), "near")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    found = near.select("word", "n", "n_near", form["word"].alias("form"), (-form["less"]).alias("form_n"))
    rooted = roots(found.where("form IS NOT NULL").select("word", "form"))
    return found.join(rooted, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(read(spark, sf_dir, "documents"), misspell=31)).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 by table, eight shifts an entry, over the bytes of the hexadecimal form.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"


def crc32_sql(text: str) -> str:
    """DuckDB SQL of crc32(text), beside a row of CRC_TABLE."""
    return _CRC.format(text)


OP11_SQL = f"""WITH RECURSIVE t AS ({CRC_TABLE}),
found AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7),
runs AS (SELECT doc_id, r, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT r, n, {crc32_sql("(doc_id || ':' || r)")} AS h FROM runs, t),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed f JOIN last USING (word)"""
