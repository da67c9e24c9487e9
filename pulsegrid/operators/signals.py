"""Signals as tables: long and array form, validation, segmentation, normalisation and statistics.

Long form has a row (keys..., i, x) for each sample; array form a row (keys..., data) for each channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.errors import SignalError
from pulsegrid.functions.naming import normalisation_name
from pulsegrid.functions.timeaxis import UNITS

POLICIES = ("drop", "pad-zero", "error")


def indexed(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """Long form of rows that a unique order sorts within keys: i counts from 0."""
    i = (F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    return df.select(*keys, i.alias("i"), F.col(x).cast("double").alias("x"))


def to_long(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    return df.select(*keys, F.posexplode(data).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def to_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    """Array form; a channel's samples must fit one task, as any order-dependent filter needs."""
    pairs = F.sort_array(F.collect_list(F.struct("i", "x")))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias("data"))


def select_channel(channels: Column, name: str | None) -> Column:
    """Of array<struct<name, ...>> the named one; the first where the name is unknown or not given."""
    found = F.filter(channels, lambda c: c["name"] == F.lit(name))
    return F.coalesce(F.get(found, F.lit(0)), F.get(channels, F.lit(0)))


def signal_problems(id_: Column, rate_hz: Column, start_sec: Column, channels: Column) -> Column:
    """array<string> of all that is wrong with a signal; channels: array<struct<name, unit, data>>."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    names, sizes = F.transform(channels, lambda c: c["name"]), F.transform(channels, lambda c: F.size(c["data"]))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(id_) == "", F.lit(True)), F.lit("id must not be empty")),
            F.when(F.coalesce(bad(rate_hz) | (rate_hz <= 0), F.lit(True)), F.lit("sample rate must be positive")),
            F.when(F.coalesce(bad(start_sec), F.lit(True)), F.lit("start time must be finite")),
            F.when(F.coalesce(F.size(channels) < 1, F.lit(True)), F.lit("at least one channel is needed")),
            F.when(F.exists(channels, lambda c: ~F.coalesce(c["unit"].isin(*UNITS), F.lit(False))), F.lit("unit must be adc, mV or normalized")),
            F.when(F.exists(channels, lambda c: F.exists(c["data"], lambda x: F.coalesce(bad(x), F.lit(True)))), F.lit("samples must be finite")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("channel names must be unique")),
            F.when(F.size(F.array_distinct(sizes)) > 1, F.lit("channels must be of one length")),
        )
    )


def record_problems(row: dict[str, Column]) -> Column:
    """array<string> of all that is wrong with a record.

    row: dataset_id, record_id, subject_id, rate_hz, start_sec, sample_count, channels (array<struct<name, unit, gain,
    baseline, samples>>) and annotations (array<struct<sample_index, symbol>>).
    """
    c, a = row["channels"], row["annotations"]
    empty = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    names = F.transform(c, lambda x: x["name"])
    at = F.transform(a, lambda x: x["sample_index"])
    return F.array_compact(
        F.array(
            F.when(empty(row["dataset_id"]) | empty(row["record_id"]), F.lit("identity must not be empty")),
            F.when(empty(row["subject_id"]), F.lit("subject must not be empty")),
            F.when(F.coalesce(F.isnan(row["rate_hz"]) | (row["rate_hz"] <= 0), F.lit(True)), F.lit("sample rate must be positive")),
            F.when(F.coalesce(F.isnan(row["start_sec"]), F.lit(True)), F.lit("start time must be finite")),
            F.when(F.coalesce(F.size(c) < 1, F.lit(True)), F.lit("at least one channel is needed")),
            F.when(F.exists(c, lambda x: F.coalesce(F.isnan(x["gain"]) | (x["gain"] <= 0), F.lit(True))), F.lit("gain must be above zero")),
            F.when(F.exists(c, lambda x: ~F.coalesce(x["unit"].isin(*UNITS), F.lit(False))), F.lit("unit must be adc, mV or normalized")),
            F.when(F.exists(c, lambda x: F.size(x["samples"]) != row["sample_count"]), F.lit("channels must have the declared length")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("channel names must be unique")),
            F.when(F.exists(at, lambda x: F.coalesce(x < 0, F.lit(True))), F.lit("annotations must not be before the start")),
            F.when(at != F.array_sort(at), F.lit("annotations must be sorted")),
            F.when(F.exists(a, lambda x: F.coalesce(x["symbol"] == "", F.lit(True))), F.lit("annotation symbols must not be empty")),
        )
    )


def refuse_problems(df: DataFrame, problems: Column, code: str = "malformed-signal") -> DataFrame:
    """df, or a failed query that names all problems of the first bad row it meets."""
    text = F.concat(F.lit(f"[{code}] "), F.array_join(F.col("_problems"), "; "))
    return df.withColumn("_problems", problems).where(F.when(F.size("_problems") > 0, F.raise_error(text).cast("boolean")).otherwise(True)).drop("_problems")


def sorted_annotations(annotations: Column) -> Column:
    """Sorted by sample; equal samples keep their order."""
    pairs = F.transform(annotations, lambda a, i: F.struct(a["sample_index"].alias("s"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(pairs), lambda p: p["a"])


def _check_window(width: int, stride: int, policy: str) -> None:
    for value, label in ((width, "window length"), (stride, "stride")):
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise SignalError("invalid-input", f"{label} has to be a whole number above 0, not {value!r}")
    if policy not in POLICIES:
        raise SignalError("invalid-input", f"remainder policy must be one of {', '.join(POLICIES)}, received {policy!r}.")


def window_starts(n: Column, width: int, stride: int, policy: str) -> Column:
    """array<bigint> of the starts that windows of a channel of n samples have, the partial one of pad-zero included."""
    _check_window(width, stride, policy)
    n, none = n.cast("long"), F.array().cast("array<bigint>")
    full = F.when(n >= width, F.sequence(F.lit(0).cast("long"), n - width, F.lit(stride).cast("long"))).otherwise(none)
    after = F.size(full).cast("long") * stride
    left = after < n
    if policy == "error":
        text = F.concat(F.lit("[invalid-input] segmentation leaves "), (n - after).cast("string"), F.lit(" trailing sample(s)"))
        return F.when(left, F.raise_error(text).cast("array<bigint>")).otherwise(full)
    return F.when(left, F.array_append(full, after)).otherwise(full) if policy == "pad-zero" else full


def segment(df: DataFrame, keys: list[str], width: int, stride: int, policy: str = "drop", data: str = "data") -> DataFrame:
    """(keys, start, length, is_partial, source_samples, data): count windows of every channel, in array form."""
    n = F.size(data)
    rows = df.select(*keys, data, F.explode(window_starts(n, width, stride, policy)).alias("start"))
    have = F.least(F.lit(width).cast("long"), F.size(data) - F.col("start"))
    part = F.slice(F.col(data), (F.col("start") + 1).cast("int"), F.lit(width))
    zeros = F.array_repeat(F.lit(0.0), (F.lit(width) - have).cast("int"))
    return rows.select(*keys, "start", F.lit(width).cast("long").alias("length"), (have < width).alias("is_partial"), have.cast("long").alias("source_samples"), F.concat(part, zeros).alias("data"))


def segment_summary(df: DataFrame, width: int, stride: int, policy: str = "drop", data: str = "data") -> DataFrame:
    """One row: full_windows, padded_windows and dropped_samples; drop counts from the first start that doesn't fit."""
    n = F.size(data).cast("long")
    _check_window(width, stride, policy)
    full = F.when(n >= width, F.floor((n - width) / stride) + 1).otherwise(0)
    rest = F.greatest(F.lit(0), n - full * stride)
    padded = F.when(rest > 0, 1).otherwise(0) if policy == "pad-zero" else F.lit(0)
    dropped = rest if policy == "drop" else F.lit(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.select(full.alias("f"), padded.alias("p"), dropped.alias("d")).agg(total("f").alias("full_windows"), total("p").alias("padded_windows"), total("d").alias("dropped_samples"))


def basic_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """count, min, max, mean, rms, and the first index and value of the largest magnitude."""
    peak = F.min_by("i", F.struct(-F.abs("x"), "i"))
    out = long.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), peak.alias("peak_index"), F.min_by("x", F.struct(-F.abs("x"), "i")).alias("peak_value"))
    return out


def fit_normalisation(long: DataFrame, record: list[str], channel: list[str], strategy: str, scope: str = "per-channel", described: str = "unknown") -> DataFrame:
    """A fit for each channel: (record, channel, a, b); x maps to (x - a) / b. scope global pools a record's channels.

    z-score has the population deviation by mean square less squared mean, at least 0. A fit without spread is refused.
    """
    if strategy not in ("min-max", "z-score") or scope not in ("per-channel", "global"):
        raise SignalError("invalid-input", f"unknown normalisation {strategy!r} / {scope!r}")
    by = record + (channel if scope == "per-channel" else [])
    if strategy == "min-max":
        fit = long.groupBy(*by).agg(F.min("x").alias("a"), (F.max("x") - F.min("x")).alias("b"))
    else:
        fit = long.groupBy(*by).agg(F.avg("x").alias("a"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"))).alias("b"))
    flat = F.raise_error(F.lit(f"[numerical-failure] {normalisation_name(strategy, scope)} of a channel without spread")).cast("double")
    fit = fit.withColumn("b", F.when((F.col("b") == 0) | F.isnan("b"), flat).otherwise(F.col("b"))).withColumn("fitted_on", F.lit(described))
    return fit if scope == "per-channel" or not channel else long.select(*record, *channel).distinct().join(fit, record)


def apply_normalisation(long: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """The stored fit on other samples; channels without a fit are refused."""
    joined = long.join(fit.select(*by, "a", "b"), by, "left")
    missing = F.raise_error(F.lit("[invalid-input] a channel has no stored fit")).cast("double")
    return joined.withColumn("x", F.when(F.col("b").isNull(), missing).otherwise((F.col("x") - F.col("a")) / F.col("b"))).drop("a", "b")


def zero_crossing_hz(long: DataFrame, keys: list[str], rate_hz: float) -> DataFrame:
    """Rate over the mean gap of upward crossings (x below 0, then not); null with fewer than two."""
    before = F.lag("x").over(W.Window.partitionBy(*keys).orderBy("i"))
    up = long.withColumn("up", F.when((before < 0) & (F.col("x") >= 0), F.col("i")))
    gap = (F.max("up") - F.min("up")) / F.nullif(F.count("up") - 1, F.lit(0))
    return up.groupBy(*keys).agg(F.count("up").alias("crossings"), F.when(F.count("up") >= 2, rate_hz / F.nullif(gap, F.lit(0.0))).alias("frequency_hz"))


def cross_correlation(a: Column, b: Column, shift: int) -> Column:
    """Sum of a[i] * b[i - shift] over the indices that both have."""
    terms = F.transform(a, lambda x, i: x * F.coalesce(F.get(b, i - shift), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def arrays_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal lengths and elements; NaN equals NaN."""
    close = F.forall(F.zip_with(a, b, lambda x, y: (F.abs(x - y) <= tolerance) | (F.isnan(x) & F.isnan(y))), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & close


def reduce_range(data: Column, start: Column, end: Column) -> Column:
    """struct<min, max, populated> of the samples in [start, end), clamped."""
    s, e = F.greatest(F.lit(0), start), F.least(F.size(data), end)
    part = F.when(e > s, F.slice(data, (s + 1).cast("int"), (e - s).cast("int")))
    return F.struct(F.coalesce(F.array_min(part), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(part), F.lit(0.0)).alias("max"), part.isNotNull().alias("populated"))


def bucket_of(i: Column, start: Column, end: Column, buckets: int) -> Column:
    """The bucket of [start, end) with edges floor(j * span / buckets) that has sample i; null outside."""
    inside = (i >= start) & (i < end)
    return F.when(inside, F.floor(((i - start + 1) * buckets - 1) / F.nullif(end - start, F.lit(0)))).cast("int")


def envelope(long: DataFrame, keys: list[str], buckets: int, bounds: DataFrame | None = None) -> DataFrame:
    """(keys, bucket, min, max, populated): every bucket of every key; those without samples are (0, 0, false).

    The window is [0, n) of each key, or the columns win_start and win_end of bounds (keys, win_start, win_end).
    """
    if isinstance(buckets, bool) or not isinstance(buckets, int) or buckets <= 0:
        raise SignalError("invalid-input", f"the number of columns has to be a whole number above 0, not {buckets!r}")
    if bounds is None:
        bounds = long.groupBy(*keys).agg(F.lit(0).cast("long").alias("win_start"), (F.max("i") + 1).alias("win_end"))
    rows = long.join(bounds, keys).withColumn("bucket", bucket_of(F.col("i"), F.col("win_start"), F.col("win_end"), buckets)).where("bucket IS NOT NULL")
    found = rows.groupBy(*keys, "bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spine = bounds.where("win_end > win_start").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    zero = F.lit(0.0)
    return spine.join(found, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("lo", zero).alias("min"), F.coalesce("hi", zero).alias("max"), F.col("lo").isNotNull().alias("populated"))


def coefficient_envelope(bands: DataFrame, keys: list[str], ranges: DataFrame, buckets: int) -> DataFrame:
    """The envelope of one band in long form (keys, i, x) over the coefficient ranges (keys, win_start, win_end) that a view reaches."""
    return envelope(bands, keys, buckets, ranges)


def amplitude_bounds(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, min, max) over populated buckets; (0, 0) where none is."""
    full = lambda c: F.when(F.col("populated"), F.col(c))
    return columns.groupBy(*keys).agg(F.coalesce(F.min(full("min")), F.lit(0.0)).alias("min"), F.coalesce(F.max(full("max")), F.lit(0.0)).alias("max"))
