"""Signals longer than a task: chunk form, and the order-dependent operators over it.

Chunk form has a row (keys..., start, n, data) for each stretch of a channel: data are its samples from position `start` on, and n is
the channel's whole length. Stretches are of any lengths. An operator deals the samples to cells of equal length, each with as many
samples of its neighbours as its kernel reaches (`exchange`), and runs a numpy kernel on each cell: one shuffle an operator, whose
rows are keyed by channel and cell, so that one long channel is as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pulsegrid.errors import SignalError
from pulsegrid.functions import kernels as K
from pulsegrid.operators.signals import POLICIES
from pulsegrid.plans.storage import materialise

#: Samples of a cell, and of a stretch where nothing else cuts it.
SIZE = 65_536
#: Samples of cells that a Python worker fills and filters at once, whatever the length of the batches it gets.
AT_ONCE = 1 << 20
EDGES = ("zero", "mirror", "wrap")


def _size(value: int, label: str = "the number of samples") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise SignalError("invalid-input", f"{label} has to be a whole number above 0, not {value!r}")
    return value


# --- chunk form ---------------------------------------------------------------------------------------------------


def _cut(keys: list[str], fields: pa.Schema, size: int):
    """Over rows (keys..., x) of a partition, sorted: stretches (keys..., _run, _at, data) of at most `size` samples. _run counts the
    partition's keys, _at the samples of the key before it in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, at, held, have = None, -1, 0, [], 0
        out: list = []

        def close() -> None:
            nonlocal at, held, have
            if have:
                out.append((now, number, at, np.concatenate(held)))
                at, held, have = at + have, [], 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in out], fields.field(i).type) for i in range(len(keys))]
            columns += [pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), K.flat_lists([r[3] for r in out])]
            batch = pa.RecordBatch.from_arrays(columns, schema=fields)
            out.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(len(keys)).null_count:
                raise SignalError("malformed-signal", "a signal has a missing sample")
            x = batch.column(len(keys)).to_numpy()
            turn = np.zeros(batch.num_rows, bool)
            for i in range(len(keys)):
                a, b = batch.column(i).slice(1), batch.column(i).slice(0, batch.num_rows - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                turn[1:] |= differ.to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                key = tuple(batch.column(i)[s].as_py() for i in range(len(keys)))
                if key != now:
                    close()
                    now, number, at = key, number + 1, 0
                while s < e:
                    take = min(e - s, size - have)
                    held.append(x[s : s + take])
                    have, s = have + take, s + take
                    if have == size:
                        close()
            if out:
                yield rows()
        close()
        if out:
            yield rows()

    return run


def of_rows(df: DataFrame, keys: list[str], order: list[str], x: str, size: int = SIZE) -> DataFrame:
    """Chunk form of rows that a unique order sorts within keys; null keys are a key. A null x is refused.

    Rows are dealt by ranges of (keys, order), so a key with most of the rows is spread over many tasks. Positions are those inside
    a range partition, and the counts of the partitions before: a row for each key and partition, never one for each sample.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(x).cast("double").alias("_x"))
    by = [*names, *[f"_o{i}" for i in range(len(order))]]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*names, "_x")
    own = [f for f in sorted_rows.schema.fields if f.name != "_x"]
    schema = StructType([*own, StructField("_run", LongType()), StructField("_at", LongType()), StructField("data", ArrayType(DoubleType()))])
    arrow = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in own], ("_run", pa.int64()), ("_at", pa.int64()), ("data", pa.list_(pa.float64()))])
    cut = sorted_rows.mapInArrow(_cut(names, arrow, _size(size)), schema).withColumn("_part", F.spark_partition_id())
    cut = materialise(cut, "stretches")
    counts = cut.groupBy("_part", "_run", *names).agg(F.sum(F.size("data")).alias("_n"))
    before = W.Window.partitionBy(*names).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = counts.select("_part", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.Window.partitionBy(*names)).alias("n"))
    # (_part, _run) is one key in one partition: no side of this join has more rows of it than a partition
    placed = cut.join(counts, ["_part", "_run"])
    return placed.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], (F.col("_before") + F.col("_at")).alias("start"), "n", "data")


def of_arrays(df: DataFrame, keys: list[str], data: str = "data", size: int = SIZE) -> DataFrame:
    """Chunk form of array form; a null or empty array has no rows."""
    n = F.size(data).cast("long")
    starts = df.where(F.size(data) > 0).select(*keys, F.col(data).alias("_data"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(_size(size)).cast("long"))).alias("start"))
    return starts.select(*keys, "start", "n", F.slice("_data", (F.col("start") + 1).cast("int"), size).cast("array<double>").alias("data"))


def positions(chunks: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Long form (keys..., i, x)."""
    return chunks.select(*keys, "start", F.posexplode("data").alias("_i", x)).select(*keys, (F.col("start") + F.col("_i")).alias("i"), x)


def indexed(df: DataFrame, keys: list[str], order: list[str], x: str, size: int = SIZE) -> DataFrame:
    """Long form of rows that a unique order sorts within keys, i from 0: as `signals.indexed`, but a key may be of any size."""
    return positions(of_rows(df, keys, order, x, size), keys)


# --- cells with their neighbours' samples ---------------------------------------------------------------------------


def _images(start: Column, end: Column, n: Column, left: int, right: int, edge: str) -> Column:
    """array<struct<at, upto, back>>: where the samples of [start, end) stand, the places that an edge rule gives them beyond the
    ends included; back says that they stand in reverse there."""

    def image(at: Column, upto: Column, back: bool) -> Column:
        return F.struct(at.cast("long").alias("at"), upto.cast("long").alias("upto"), F.lit(back).alias("back"))

    here = F.array(image(start, end, False))
    if edge == "zero":
        return here
    folds = lambda reach: F.sequence(F.lit(0).cast("long"), F.floor((F.lit(reach) - 1) / n).cast("long"))
    none = F.array().cast("array<struct<at:bigint,upto:bigint,back:boolean>>")
    if edge == "mirror":
        below = F.transform(folds(left), lambda k: image(-end - k * n, -start - k * n, True)) if left else none
        above = F.transform(folds(right), lambda k: image(2 * n - end + k * n, 2 * n - start + k * n, True)) if right else none
    else:
        below = F.transform(folds(left), lambda k: image(start - (k + 1) * n, end - (k + 1) * n, False)) if left else none
        above = F.transform(folds(right), lambda k: image(start + (k + 1) * n, end + (k + 1) * n, False)) if right else none
    return F.concat(here, below, above)


def exchange(chunks: DataFrame, keys: list[str], stride: int, left: int, right: int, edge: str = "zero", reach: tuple[int, int] | None = None) -> DataFrame:
    """(keys..., cell, n, pieces): of each channel the cells [cell * stride - left, (cell + 1) * stride + right), with what there is of
    them as pieces array<struct<at, data>>, at counted from the cell's first place.

    Beyond the ends stand mirrored samples (half-sample, folding modulo n where the channel is shorter) or the channel again, up
    to `reach` places (left and right unless given); nothing with edge zero. right may be negative: cells with gaps between.
    """
    if edge not in EDGES:
        raise SignalError("invalid-input", f"unknown edge {edge!r}")
    before, after = reach or (left, max(0, right))
    end = F.col("start") + F.size("data")
    rows = chunks.where(F.size("data") > 0).select(*keys, "start", "n", "data", F.explode(_images(F.col("start"), end, F.col("n"), before, after, edge)).alias("_m"))
    low, high = F.greatest(F.col("_m.at"), F.lit(-before)), F.least(F.col("_m.upto"), F.col("n") + after)
    rows = rows.withColumn("_low", low).withColumn("_high", high).where("_low < _high")
    first = F.greatest(F.lit(0), F.floor((F.col("_low") - right) / stride))
    last = F.least(F.floor((F.col("n") - 1) / stride), F.ceil((F.col("_high") + left) / stride) - 1)
    rows = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).where("_first <= _last").withColumn("cell", F.explode(F.sequence("_first", "_last")))
    base = F.col("cell") * stride - left
    s, e = F.greatest(F.col("_low"), base), F.least(F.col("_high"), base + (left + stride + right))
    rows = rows.withColumn("_s", s).withColumn("_e", e).where("_s < _e")
    skip = F.when(F.col("_m.back"), F.col("_m.upto") - F.col("_e")).otherwise(F.col("_s") - F.col("_m.at"))
    part = F.slice("data", (skip + 1).cast("int"), (F.col("_e") - F.col("_s")).cast("int"))
    part = F.when(F.col("_m.back"), F.reverse(part)).otherwise(part)
    pieces = rows.select(*keys, "cell", "n", F.struct((F.col("_s") - base).cast("int").alias("at"), part.alias("data")).alias("_piece"))
    return pieces.groupBy(*keys, "cell").agg(F.first("n").alias("n"), F.collect_list("_piece").alias("pieces"))


def _filled(pieces: pa.Array, width: int) -> list[np.ndarray]:
    """An array of `width` samples for each row of pieces; zero where none stands. A sample that isn't finite is refused."""
    ends, flat = pieces.offsets.to_numpy(), pieces.values
    at = flat.field("at").to_numpy()
    data = flat.field("data")
    bounds, samples = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
    if len(bounds) and not np.isfinite(samples[bounds[ends[0]] : bounds[ends[-1]]]).all():
        raise SignalError("malformed-signal", "a signal has a sample that is not finite")
    out = []
    for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        x = np.zeros(width)
        for p in range(s, e):
            x[at[p] : at[p] + bounds[p + 1] - bounds[p]] = samples[bounds[p] : bounds[p + 1]]
        out.append(x)
    return out


def over_cells(cells: DataFrame, keys: list[str], width: int, kernel: Callable[[np.ndarray, int, int], list[tuple[int, int, np.ndarray]]], bands: bool = False) -> DataFrame:
    """Chunk form (keys..., [band,] start, n, data) of what kernel(samples, cell, n) gives for each cell: (band, start, data) rows, and n
    as the last of them says; kernel returns rows (band, start, n, data)."""
    own = [f for f in cells.schema.fields if f.name in keys]
    own = [next(f for f in own if f.name == k) for k in keys]
    extra = [StructField("band", LongType())] if bands else []
    schema = StructType([*own, *extra, StructField("start", LongType()), StructField("n", LongType()), StructField("data", ArrayType(DoubleType()))])

    many = max(1, AT_ONCE // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, many) for b in batches for i in range(0, b.num_rows, many)):
            cell, n = (batch.column(c).to_pylist() for c in ("cell", "n"))
            found, source = [], []
            for i, x in enumerate(_filled(batch.column("pieces"), width)):
                rows = kernel(x, cell[i], n[i])
                found += rows
                source += [i] * len(rows)
            take = pa.array(source, pa.int64())
            columns = [batch.column(k).take(take) for k in keys]
            numbers = [pa.array([r[c] for r in found], pa.int64()) for c in ((0, 1, 2) if bands else (1, 2))]
            yield pa.RecordBatch.from_arrays([*columns, *numbers, K.flat_lists([r[3] for r in found])], names=schema.names)

    return cells.mapInArrow(run, schema)


# --- filters --------------------------------------------------------------------------------------------------------


def filtered(chunks: DataFrame, keys: list[str], spec: dict, rate_hz: float, size: int = SIZE) -> DataFrame:
    """Chunk form of the filtered channels, as `kernels.filter_column` has them in array form: causal, or forward and backward
    over a signal mirrored at both ends by half the filter's length."""
    taps = K.design_fir(spec, rate_hz)
    reach, size = len(taps) - 1, _size(size)
    if spec.get("phase") != "zero":
        cells = exchange(chunks, keys, size, reach, 0)

        def causal(x: np.ndarray, cell: int, n: int) -> list:
            start = cell * size
            return [(0, start, n, K.convolve(x, taps)[reach : reach + min(size, n - start)])]

        return over_cells(cells, keys, reach + size, causal)
    pad = reach // 2
    cells = exchange(chunks, keys, size, reach, reach, "mirror", (pad, pad))

    def both_ways(x: np.ndarray, cell: int, n: int) -> list:
        start = cell * size
        there = min(size + reach, n + pad - start)  # beyond the mirrored end there is nothing to filter back from
        forward = K.convolve(x, taps)[reach : reach + there]
        back = K.convolve(forward[::-1], taps)[:there][::-1]
        return [(0, start, n, back[: min(size, n - start)])]

    return over_cells(cells, keys, size + 2 * reach, both_ways)


def resampled(chunks: DataFrame, keys: list[str], rate_hz: float, target_hz: float, radius: int = 8, edge: str = "reflect", size: int = SIZE) -> DataFrame:
    """Chunk form of the channels at another rate, as `kernels.resample_column` has them in array form. An output belongs to the cell of
    the input sample at or before it."""
    ratio, _ = K.resample_grid(rate_hz, target_hz, radius, edge)
    reach, size = radius + 1, _size(size)
    cells = exchange(chunks, keys, size, reach, reach, "mirror" if edge == "reflect" else "zero", (reach, reach))

    def near(x: np.ndarray, cell: int, n: int) -> list:
        start, count = cell * size, K.resampled_length(n, ratio)
        m = np.arange(max(0, int(start * ratio) - 2), min(count, int((start + size) * ratio) + 3))
        owner = np.clip(K.resample_centres(m, rate_hz, target_hz, radius), 0, n - 1)
        m = m[(owner >= start) & (owner < start + size)]
        return [(0, int(m[0]), count, K.resample_at(x, start - reach, m, rate_hz, target_hz, radius))] if m.size else []

    return over_cells(cells, keys, size + 2 * reach, near)


# --- wavelets -------------------------------------------------------------------------------------------------------


def _level(chunks: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """(keys..., band, start, n, data) of one periodic level: band 0 is the approximation, 1 the detail."""
    bank = K.wavelet(name)
    taps = len(bank["dec_lo"])
    half = taps // 2
    left, right = taps - 1 - half, half
    cells = exchange(chunks, keys, 2 * size, left, right, "wrap")
    filters = np.array([bank["dec_lo"], bank["dec_hi"]])

    def split(x: np.ndarray, cell: int, n: int) -> list:
        count = min(size, n // 2 - cell * size)
        # the sample that tap k meets at output i stands at 2 i + half - k, and x begins at -left
        first = left + half
        shifted = np.stack([x[first - k : first - k + 2 * count : 2] for k in range(taps)])
        a, d = filters @ shifted
        return [(0, cell * size, n // 2, a), (1, cell * size, n // 2, d)]

    return over_cells(cells, keys, left + 2 * size + right, split, bands=True)


def decomposed(chunks: DataFrame, keys: list[str], level: int, name: str = "db4", size: int = SIZE) -> DataFrame:
    """(keys..., band, start, n, data): details 1 to level and the approximation as level + 1, n being the band's length.

    Each level goes to the shared folder, as half as many samples as the one before; it is the next one's input. A channel whose
    length doesn't allow the level is refused.
    """
    taps = len(K.wavelet(name)["dec_lo"])
    _size(level, "the level")
    n = F.col("n")
    fits = (n % 2**level == 0) & (n / 2 ** (level - 1) >= taps)
    text = F.concat(F.lit(f"[invalid-input] level {level} is not possible for "), n.cast("string"), F.lit(" samples"))
    rest = chunks.withColumn("n", F.when(fits, n).otherwise(F.raise_error(text).cast("long")))
    out = None
    for k in range(1, level + 1):
        pair = materialise(_level(rest, keys, _size(size), name), "bands")
        detail = pair.where("band = 1").withColumn("band", F.lit(k).cast("long"))
        out = detail if out is None else out.unionByName(detail)
        rest = pair.where("band = 0").drop("band")
    return out.unionByName(rest.withColumn("band", F.lit(level + 1).cast("long")).select(*out.columns))


def _joined(rest: DataFrame, detail: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """The inverse of _level."""
    bank = K.wavelet(name)
    lo, hi = np.array(bank["dec_lo"]), np.array(bank["dec_hi"])
    taps = len(lo)
    half = taps // 2
    # output p is met by coefficients i with 2 i + half - k = p: from (p - half) / 2 to (p - half + taps - 1) / 2
    left, right = (half + 1) // 2, (taps - 1 - half + 1) // 2
    width = left + size + right
    _b = lambda df, b: exchange(df, keys, size, left, right, "wrap").select(*keys, "cell", "n", F.lit(b).alias("_b"), "pieces")
    both = _b(rest, 0).unionByName(_b(detail, 1)).groupBy(*keys, "cell").agg(F.max("n").alias("n"), F.min("n").alias("_least"), F.count(F.lit(1)).alias("_both"), F.flatten(F.collect_list(F.transform("pieces", lambda p: F.struct((p["at"] + F.col("_b") * width).alias("at"), p["data"].alias("data"))))).alias("pieces"))
    unfit = F.raise_error(F.lit("[invalid-input] the levels of a decomposition don't fit together")).cast("long")
    both = both.withColumn("n", F.when((F.col("n") == F.col("_least")) & (F.col("_both") == 2), F.col("n")).otherwise(unfit)).select(*keys, "cell", "n", "pieces")

    def merge(x: np.ndarray, cell: int, n: int) -> list:
        count = 2 * min(size, n - cell * size)
        wide = np.zeros(2 * width + 2 * taps)
        for k in range(taps):
            at = taps + half - k
            wide[at : at + 2 * width : 2] += lo[k] * x[:width] + hi[k] * x[width:]
        return [(0, 2 * cell * size, 2 * n, wide[taps + 2 * left : taps + 2 * left + count])]

    return over_cells(both, keys, 2 * width, merge)


def reconstructed(bands: DataFrame, keys: list[str], level: int, name: str = "db4", size: int = SIZE) -> DataFrame:
    """Chunk form of the channels that `decomposed` gave bands of."""
    rest = bands.where(F.col("band") == level + 1).drop("band")
    for k in range(level, 0, -1):
        rest = materialise(_joined(rest, bands.where(F.col("band") == k).drop("band"), keys, _size(size), name), "joined")
    return rest


# --- segments -------------------------------------------------------------------------------------------------------


def segments(chunks: DataFrame, keys: list[str], width: int, stride: int, policy: str = "drop", size: int = SIZE) -> DataFrame:
    """(keys..., start, length, is_partial, source_samples, data): the count windows of `signals.segment`, across stretches.

    A cell has as many windows as begin in about `size` samples, and takes what the last of them reaches from its neighbours.
    What the rest of a channel becomes follows from its length alone, so it is settled alike in every cell.
    """
    _size(width, "the window's length"), _size(stride, "the stride")
    if policy not in POLICIES:
        raise SignalError("invalid-input", f"unknown remainder policy {policy!r}")
    many = max(1, _size(size) // stride)
    cell_size = many * stride
    n = F.col("n")
    if policy == "error":
        full = F.when(n >= width, F.floor((n - width) / stride) + 1).otherwise(0)
        text = F.concat(F.lit("[invalid-input] segmentation leaves "), (n - full * stride).cast("string"), F.lit(" trailing sample(s)"))
        chunks = chunks.withColumn("n", F.when(n - full * stride > 0, F.raise_error(text).cast("long")).otherwise(n))
    cells = exchange(chunks, keys, cell_size, 0, width - stride)
    reach = cell_size + width - stride

    def cut(x: np.ndarray, cell: int, n: int) -> list:
        full = (n - width) // stride + 1 if n >= width else 0
        count = full + (policy == "pad-zero" and full * stride < n)
        return [(0, k * stride, min(width, n - k * stride), x[k * stride - cell * cell_size :][:width]) for k in range(cell * many, min((cell + 1) * many, count))]

    found = over_cells(cells, keys, reach, cut)
    have = F.col("n")
    return found.select(*keys, "start", F.lit(width).cast("long").alias("length"), (have < width).alias("is_partial"), have.alias("source_samples"), "data")


# --- zero crossings -------------------------------------------------------------------------------------------------


def crossing_states(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., start, upto, head, tail, crossings, first_up, last_up): what a stretch knows of its upward crossings (x below 0, then
    not), with the samples at its ends. States of stretches that touch add up by `merged_states`."""
    data = F.col("data")
    ups = F.filter(F.sequence(F.lit(1), F.size(data) - 1), lambda i: (F.get(data, i - 1) < 0) & (F.get(data, i) >= 0))
    ups = F.when(F.size(data) > 1, ups).otherwise(F.array().cast("array<int>"))
    rows = chunks.where(F.size("data") > 0).withColumn("_ups", ups)
    at = lambda i: (F.col("start") + F.get("_ups", i)).cast("long")
    return rows.select(*keys, "start", (F.col("start") + F.size("data")).alias("upto"), F.get("data", F.lit(0)).alias("head"), F.element_at("data", -1).alias("tail"), F.size("_ups").cast("long").alias("crossings"), at(F.lit(0)).alias("first_up"), at(F.size("_ups") - 1).alias("last_up"))


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., crossings, first_up, last_up) of whole channels. A crossing between two stretches is found by an equi-join of ends with
    starts; the rest is sums, least and largest: no window over a channel."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = states.alias("a").join(states.alias("b"), [*same, F.col("a.upto") == F.col("b.start")]).where("a.tail < 0 AND b.head >= 0")
    between = met.select(*[F.col(f"b.{k}").alias(k) for k in keys], F.lit(1).cast("long").alias("crossings"), F.col("b.start").alias("first_up"), F.col("b.start").alias("last_up"))
    every = states.select(*keys, "crossings", "first_up", "last_up").unionByName(between)
    return every.groupBy(*keys).agg(F.sum("crossings").alias("crossings"), F.min("first_up").alias("first_up"), F.max("last_up").alias("last_up"))


def zero_crossing_hz(chunks: DataFrame, keys: list[str], rate_hz: float) -> DataFrame:
    """(keys..., crossings, frequency_hz): the rate over the mean gap of upward crossings; null with fewer than two."""
    gap = (F.col("last_up") - F.col("first_up")) / F.nullif(F.col("crossings") - 1, F.lit(0))
    found = merged_states(crossing_states(chunks, keys), keys)
    return found.select(*keys, "crossings", F.when(F.col("crossings") >= 2, rate_hz / F.nullif(gap, F.lit(0.0))).alias("frequency_hz"))
