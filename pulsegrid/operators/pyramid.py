"""Min/max pyramids: views of long signals that read a number of nodes that goes with their columns, not with their samples.

Level 1 has a node for each BLOCK samples, with the samples; a node of a level above has FAN of the level below. A view's bucket is a
range of positions. It falls into at most two pieces of blocks and, on each level, nodes at its two ends that the level above
doesn't have whole. All of them are looked up by one equi-join on (keys, level, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.operators import chunks as C

#: Samples of a node of level 1, and nodes of a node of the level above.
BLOCK, FAN = 64, 8
#: Levels that there may be: the last has nodes of BLOCK * FAN^(LEVELS - 1) samples, over 10^14.
LEVELS = 15


def _widths(block: int, fan: int) -> list[int]:
    """Samples of a node by level; level 0 are the samples themselves."""
    return [1, *(block * fan**k for k in range(LEVELS) if block * fan**k < 1 << 60)]


def pyramid(chunks: DataFrame, keys: list[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(keys..., level, node, lo, hi, data) of chunk form (keys..., start, n, data); data is null above level 1. A channel has the
    levels of which it fills a node. Two shuffles: samples to blocks, and the blocks' extremes to nodes, added up before."""
    widths = _widths(block, fan)
    many = max(1, C.SIZE // block)
    cells = C.exchange(chunks, keys, block * many, 0, 0)
    samples = F.flatten(F.transform(F.array_sort("pieces"), lambda p: p["data"]))
    rows = cells.select(*keys, "cell", "n", samples.alias("_x"))
    parts = F.sequence(F.lit(0), F.floor((F.size("_x") - 1) / block).cast("int"))
    rows = rows.select(*keys, "cell", "n", F.posexplode(F.transform(parts, lambda k: F.slice("_x", k * block + 1, block))).alias("_k", "data"))
    base = rows.select(*keys, F.lit(1).alias("level"), (F.col("cell") * many + F.col("_k")).alias("node"), F.array_min("data").alias("lo"), F.array_max("data").alias("hi"), "data", "n")
    base = C.materialise(base, "blocks")
    above = F.filter(F.sequence(F.lit(2), F.lit(len(widths) - 1)), lambda level: F.pow(F.lit(float(fan)), level - 1) * block <= F.col("n"))
    nodes = base.select(*keys, "lo", "hi", "node", F.explode(above).alias("level"))
    nodes = nodes.groupBy(*keys, "level", F.floor(F.col("node") / F.pow(F.lit(float(fan)), F.col("level") - 1)).cast("long").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return base.drop("n").unionByName(nodes.withColumn("data", F.lit(None).cast("array<double>")))


def pieces_of(a: Column, b: Column, block: int = BLOCK, fan: int = FAN) -> Column:
    """array<struct<level, node, s, e>> that together are the positions [a, b): whole nodes, and parts [s, e) of blocks (level 1)."""
    widths = _widths(block, fan)
    first = [F.ceil(a / w).cast("long") for w in widths]
    after = [F.floor(b / w).cast("long") for w in widths]
    none = F.array().cast("array<struct<level:int,node:bigint,s:int,e:int>>")
    null = F.lit(None).cast("int")
    long = lambda x: F.lit(x).cast("long")

    def run(s: Column, e: Column, level: int) -> Column:
        """Whole nodes [s, e) of a level; of level 0, the parts of the blocks that hold the samples [s, e)."""
        if level:
            made = lambda node: F.struct(F.lit(level).alias("level"), node.alias("node"), null.alias("s"), null.alias("e"))
            return F.when(e > s, F.transform(F.sequence(s, e - 1), made)).otherwise(none)
        part = lambda k: F.struct(F.lit(1).alias("level"), k.alias("node"), F.greatest(long(0), s - k * block).cast("int").alias("s"), F.least(long(block), e - k * block).cast("int").alias("e"))
        return F.when(e > s, F.transform(F.sequence(F.floor(s / block).cast("long"), F.floor((e - 1) / block).cast("long")), part)).otherwise(none)

    def up(level: int) -> Column:
        """The pieces of this level and those above. Without a whole node above, this level has all, and no higher one is looked at."""
        if level + 1 == len(widths):
            return run(first[level], after[level], level)
        ratio = widths[level + 1] // widths[level]
        ends = F.concat(run(first[level], first[level + 1] * ratio, level), run(after[level + 1] * ratio, after[level], level), up(level + 1))
        return F.when(after[level + 1] > first[level + 1], ends).otherwise(run(first[level], after[level], level))

    return up(0)


def buckets_of(windows: DataFrame, columns: int) -> DataFrame:
    """windows (..., win_start, win_end) with bucket and its positions [_a, _b), edges being floor(j * span / columns)."""
    if isinstance(columns, bool) or not isinstance(columns, int) or columns < 1:
        raise SignalError("invalid-input", f"a view has a whole number of columns above 0, not {columns!r}")
    span = F.col("win_end") - F.col("win_start")
    rows = windows.where("win_end > win_start").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    edge = lambda j: (F.col("win_start") + F.floor(j * span / columns)).cast("long")
    return rows.withColumn("_a", edge(F.col("bucket"))).withColumn("_b", edge(F.col("bucket") + 1))


def lookups(windows: DataFrame, columns: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """What a view asks of a pyramid: windows with bucket, level, node, s and e, a row for each node or part of a block."""
    rows = buckets_of(windows, columns).withColumn("_p", F.explode(pieces_of(F.col("_a"), F.col("_b"), block, fan)))
    return rows.drop("_a", "_b").select("*", "_p.*").drop("_p")


def view(nodes: DataFrame, windows: DataFrame, keys: list[str], columns: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(window columns..., bucket, min, max, populated): the envelope of each window (keys..., win_start, win_end, others) within
    [0, n), as `signals.envelope` has it from all samples. Buckets without samples are (0, 0, false)."""
    by = [c for c in windows.columns if c not in keys]
    asked = lookups(windows, columns, block, fan)
    found = asked.join(nodes.select(*keys, "level", "node", "lo", "hi", "data"), [*keys, "level", "node"], "left")
    part = F.slice("data", F.col("s") + 1, F.greatest(F.lit(0), F.col("e") - F.col("s")))
    found = found.withColumn("lo", F.when(F.col("s").isNull(), F.col("lo")).otherwise(F.array_min(part))).withColumn("hi", F.when(F.col("s").isNull(), F.col("hi")).otherwise(F.array_max(part)))
    seen = found.groupBy(*keys, *by, "bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    empty = buckets_of(windows, columns).where("_a >= _b").select(*keys, *by, "bucket", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    zero = F.lit(0.0)
    every = seen.unionByName(empty)
    return every.select(*keys, *by, "bucket", F.coalesce("lo", zero).alias("min"), F.coalesce("hi", zero).alias("max"), F.col("lo").isNotNull().alias("populated"))


def write_pyramid(nodes: DataFrame, keys: list[str], path: str) -> None:
    """As Parquet sorted by (keys, level, node): a view with literal keys reads the row groups of its nodes alone."""
    nodes.repartitionByRange(*keys, "level", "node").sortWithinPartitions(*keys, "level", "node").write.parquet(path)


def read_view(path: str, spark, window: dict, columns: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One window's envelope from a written pyramid. window: the keys' values, win_start and win_end. The filters on keys and on each
    level's range of nodes reach the Parquet scan."""
    keys = [k for k in window if k not in ("win_start", "win_end")]
    names = spark.read.parquet(path)
    one = spark.createDataFrame([tuple(window.values())], ", ".join(f"{k} {names.schema[k].dataType.simpleString() if k in keys else 'long'}" for k in window))
    asked = lookups(one, columns, block, fan).select("level", "node").distinct().collect()  # a few rows for each column
    chosen = F.lit(False)
    for level in sorted({r.level for r in asked}):
        own = [r.node for r in asked if r.level == level]
        chosen = chosen | ((F.col("level") == level) & F.col("node").between(min(own), max(own)) & F.col("node").isin(own))
    for k in keys:
        names = names.where(F.col(k) == F.lit(window[k]))
    return view(names.where(chosen), one, keys, columns, block, fan)
