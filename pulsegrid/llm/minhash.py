"""Document fingerprints by one-permutation MinHash, in SQL functions alone.

Each shingle of a text is hashed once; the hash's upper bits choose one of BINS bins, and a bin keeps its least hash. An
empty bin takes the value of another by optimal densification: its own random draws of bins, the same for all texts, until
one has a value. Each bin's value is hashed with the bin's number and leaves its low BITS bits, sixteen bins to a long. Bins of
unequal values agree with a chance of 2^-BITS, which `likeness` takes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.llm.common import materialise, read

#: 256 bins of 4 bits are 128 bytes a text, and a likeness of 0.5 has a standard error of 0.033.
BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
#: Words of a shingle.
SIZE = 5
#: Draws of an empty bin before it compares all bins that have a value: the next draws in their order, found at once.
DRAWS = 8
_BLANK = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, size: int = SIZE) -> Column:
    """array<bigint>: the xxhash64 of every run of `size` words of a text; one of all its words where it has fewer, none
    included. Words are what stands between blanks (U+0009 to U+000D and U+0020)."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), _BLANK)
    return _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size))))


def _bin(h: Column) -> Column:
    """The bin of a hash, rising with its signed value."""
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def _least(hashes: Column) -> Column:
    """Of sorted hashes the first of each bin."""
    return _let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1)))))


def _spread(least: Column) -> Column:
    """array<bigint> of BINS values; null where a bin is empty."""
    nulls = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    before = lambda i: F.when(i > 0, _bin(F.get(least, i - 1))).otherwise(-1)
    filled = F.flatten(F.transform(least, lambda h, i: F.concat(nulls(_bin(h) - before(i) - 1), F.array(h))))
    return F.concat(filled, nulls(BINS - 1 - _bin(F.element_at(least, -1))))


def _dense(least: Column, bins: Column) -> Column:
    """array<bigint> of BINS values, the empty bins filled. Bin i takes the value of the first filled bin in an order of all
    bins that depends on i alone: DRAWS independent draws, then all by the hash of both numbers."""

    def value(i: Column) -> Column:
        draws = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(DRAWS)]
        rest = F.array_min(F.transform(least, lambda h: F.struct(F.xxhash64(i, _bin(h), F.lit("rest")).alias("order"), h.alias("h"))))["h"]
        return F.coalesce(F.get(bins, i), *draws, rest)

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """array<bigint> of BINS * BITS / 64 longs. Equal texts have equal ones; null is as the empty text."""
    per = 64 // BITS
    low = lambda v: F.transform(v, lambda h, i: F.xxhash64(h, i).bitwiseAND(F.lit((1 << BITS) - 1)))
    pack = lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda g: F.aggregate(F.slice(b, g * per + 1, per), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x)))
    return _let(_least(shingle_hashes(text, size)), lambda least: _let(_spread(least), lambda bins: _let(low(_dense(least, bins)), pack)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingle sets by their fingerprints, 0 to 1: the share of bins that agree,
    less what agrees by chance."""
    bits = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(BITS - 1)), x, lambda acc, k: acc.bitwiseOR(F.call_function("shiftrightunsigned", x, k)))
    ones = sum(1 << k for k in range(0, 64, BITS))
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(bits(x.bitwiseXOR(y)).bitwiseAND(F.lit(ones)))), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - unlike / float(BINS) - chance) / (1 - chance))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every row, repeated rows and null ids too. No shuffle; an empty table gives no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), size).alias("fingerprint"))


#: Ranges of doc_id by quantiles, each cut into even parts.
COARSE = 100
#: Rows of a part, about, once there are more parts than eight for each shuffle partition.
PART_ROWS = 20_000


def _parts(docs: DataFrame) -> Column:
    """A bigint that doesn't fall as doc_id rises and has about as many rows for each value; -1 for a null. Only COARSE + 1 numbers
    reach the driver."""
    spark, i = docs.sparkSession, F.col("doc_id")
    row = docs.agg(F.percentile_approx("doc_id", [k / COARSE for k in range(COARSE + 1)], 100 * COARSE).alias("q"), F.count("doc_id").alias("n")).first()
    if not row["n"]:
        return F.lit(-1).cast("bigint")
    parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), row["n"] // PART_ROWS)
    fine = -(-parts // COARSE)
    edges = F.array(*[F.lit(int(q)).cast("bigint") for q in row["q"]])
    inner = F.array(*[F.lit(int(q)).cast("bigint") for q in row["q"][1:-1]])
    coarse = F.size(F.filter(inner, lambda q: q <= i))

    def part(c: Column) -> Column:
        low, high = F.get(edges, c).cast("double"), F.get(edges, c + 1).cast("double")
        share = F.floor((i.cast("double") - low) * fine / F.greatest(high - low, F.lit(1.0)))
        return c.cast("bigint") * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), share))

    return F.coalesce(F.when(i.isNotNull(), _let(coarse, part)), F.lit(-1).cast("bigint"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id bigint, th, columns...) with next_<column>: those of the next row by descending doc_id (nulls last), then th; of the
    first row after the last.

    Rows are dealt once, by parts of the range of doc_id; each part also gets the rows with the first doc_id of the part after
    it, so that its last row finds its next. Rows of one doc_id meet in one task. docs is read once whole, and twice for doc_id alone.
    """
    part = _parts(docs)
    heads = docs.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head"))
    # one row a part: its number, and the part before it, which for the first is the last
    order = W.Window.orderBy(F.col("part").desc())
    heads = heads.withColumn("before", F.lag("part").over(order)).withColumn("last", F.min("part").over(W.Window.partitionBy()))
    heads = materialise(heads.select(F.col("part").alias("head_of"), "head", F.coalesce("before", "last").alias("before")), "heads")
    placed = docs.withColumn("part", part).join(F.broadcast(heads), (F.col("part") == F.col("head_of")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    here, there = F.struct(F.lit(0).alias("guest"), F.col("part").alias("part")), F.struct(F.lit(1).alias("guest"), F.col("before").alias("part"))
    both = placed.withColumn("_to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    both = both.select("doc_id", "th", *columns, F.col("_to.guest").alias("_guest"), F.col("_to.part").alias("_part"))
    order = W.Window.partitionBy("_part").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    found = both.select("doc_id", *columns, "_guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return found.where("_guest = 0").drop("_guest")


def edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fingerprint, next_text and next_fingerprint of the next document by descending doc_id, and edited: the text
    with the last third of its code points replaced by the first as many of the next text. Null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    found = with_next(rows, ["text", "fingerprint"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    first = lambda c, k: F.substring(F.col(c), F.lit(1), k)
    return found.withColumn("edited", F.concat(first("text", n - third), first("next_text", third)))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = edited(read(spark, sf_dir, "documents"))
    found = found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return found.select("doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("fingerprint")).alias("fingerprint"), hexadecimal(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
