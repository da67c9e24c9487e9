"""Numeric kernels over one array of samples, and Arrow column functions that run them batch by batch."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError

#: The low-pass decomposition taps of the db4 wavelet.
DB4_LOW = (
    0.230377813308855, 0.714846570552542, 0.63088076792959, -0.027983769416984,
    -0.187034811718881, 0.030841381835987, 0.032883011666983, -0.010597401784997,
)

#: From so many taps on, a filter runs by transforms.
FFT_TAPS = 256


def qmf_highpass(low) -> list[float]:
    n = len(low)
    return [(-1) ** k * low[n - 1 - k] for k in range(n)]


def reconstruction(taps) -> list[float]:
    return list(taps)[::-1]


@lru_cache
def wavelet(name: str) -> dict[str, tuple[float, ...]]:
    """The filter bank of a wavelet of the catalogue, which has db4 only."""
    if name != "db4":
        raise SignalError("invalid-input", f"wavelet {name!r} isn't in the catalogue (db4)")
    high = qmf_highpass(DB4_LOW)
    return {"dec_lo": DB4_LOW, "dec_hi": tuple(high), "rec_lo": tuple(reconstruction(DB4_LOW)), "rec_hi": tuple(reconstruction(high))}


def assert_filter_bank(low, high) -> None:
    if len(low) != len(high) or len(low) % 2 or not len(low):
        raise SignalError("invalid-input", "a filter bank needs two filters of one even length")


def sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def hamming(k: int, n: int) -> float:
    return 0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1))


def cutoffs_of(spec: dict, rate_hz: float) -> list[float]:
    """The checked cutoffs of a filter {type, cutoff_hz, taps, phase}."""
    kind, cut = spec["type"], spec["cutoff_hz"]
    if kind not in ("lowpass", "highpass", "bandpass"):
        raise SignalError("invalid-input", f"unknown filter type {kind!r}")
    pair = isinstance(cut, (list, tuple))
    if pair != (kind == "bandpass") or pair and len(cut) != 2:
        raise SignalError("invalid-input", f"a {kind} filter takes {'[low, high]' if kind == 'bandpass' else 'one cutoff'}")
    cuts = [float(c) for c in (cut if pair else [cut])]
    if not all(math.isfinite(c) and 0 < c < rate_hz / 2 for c in cuts) or pair and cuts[0] >= cuts[1]:
        raise SignalError("invalid-input", f"cutoffs {cuts} must be ordered and inside (0, {rate_hz / 2}) Hz")
    return cuts


def design_fir(spec: dict, rate_hz: float) -> np.ndarray:
    """Hamming-windowed sinc taps with unit gain where the filter passes: at DC, or DC removed."""
    if not (math.isfinite(rate_hz) and rate_hz > 0):
        raise SignalError("invalid-input", f"a filter needs a positive sample rate, received {rate_hz!r}")
    n = spec["taps"]
    if isinstance(n, bool) or not isinstance(n, int) or n < 5 or n % 2 == 0:
        raise SignalError("invalid-input", f"the number of taps must be odd and at least 5, received {n!r}")
    cuts, middle = cutoffs_of(spec, rate_hz), (n - 1) // 2

    def lowpass(hz: float) -> np.ndarray:
        fc = hz / rate_hz
        taps = np.array([hamming(k, n) * 2 * fc * sinc(2 * fc * (k - middle)) for k in range(n)])
        gain = 0.0
        for t in taps:
            gain += t
        if gain == 0 or not math.isfinite(gain):
            raise SignalError("invalid-input", "the filter's prototype has no gain at DC")
        return taps / gain

    if spec["type"] == "lowpass":
        return lowpass(cuts[0])
    if spec["type"] == "highpass":
        return (np.arange(n) == middle).astype(float) - lowpass(cuts[0])
    return lowpass(cuts[1]) - lowpass(cuts[0])


def reflected(x: np.ndarray, index: np.ndarray) -> np.ndarray:
    """x at indices that a half-sample mirror folds in once; beyond that they wrap modulo n."""
    n = len(x)
    i = np.where(index < 0, -index - 1, np.where(index >= n, 2 * n - index - 1, index))
    return x[i % n]


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The whole convolution, len(x) + len(taps) - 1 samples. Many taps are met by overlap-add: transforms of blocks of some eight filter
    lengths, so that neither time nor memory grows with the product."""
    if len(taps) < FFT_TAPS or len(x) < FFT_TAPS:
        return np.convolve(x, taps)
    block = 1 << (8 * len(taps)).bit_length()
    step = block - len(taps) + 1
    blocks = -(-len(x) // step)
    wide = np.zeros(blocks * step)
    wide[: len(x)] = x
    each = np.fft.irfft(np.fft.rfft(wide.reshape(blocks, step), block) * np.fft.rfft(taps, block), block)
    out = np.zeros(blocks * step + block)
    for k in range(blocks):
        out[k * step : k * step + block] += each[k]
    return out[: len(x) + len(taps) - 1]


def fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Causal: zeros stand before the first sample."""
    return convolve(x, taps)[: len(x)] if len(x) else x


def fir_zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Forward and backward over the signal, mirrored at both ends by half the filter's length."""
    if not len(x):
        return x
    pad = (len(taps) - 1) // 2
    wide = reflected(x, np.arange(-pad, len(x) + pad))
    return fir(fir(wide, taps)[::-1], taps)[::-1][pad : pad + len(x)]


def resample_grid(rate_hz: float, target_hz: float, radius: int = 8, edge: str = "reflect") -> tuple[float, float]:
    """(ratio, cutoff in cycles a sample) of a checked resampling."""
    if not (math.isfinite(target_hz) and target_hz > 0):
        raise SignalError("invalid-input", f"the target rate must be positive, received {target_hz!r}")
    if isinstance(radius, bool) or not isinstance(radius, int) or radius < 2:
        raise SignalError("invalid-input", f"the kernel radius must be an integer of at least 2, received {radius!r}")
    if edge not in ("reflect", "zero"):
        raise SignalError("invalid-input", f"unknown edge mode {edge!r}")
    ratio = target_hz / rate_hz
    return ratio, 0.5 * min(1.0, ratio)


def _weights(d: np.ndarray, cutoff: float, radius: int) -> np.ndarray:
    w = (0.54 + 0.46 * np.cos(np.pi * d / radius)) * 2 * cutoff * np.sinc(2 * cutoff * d)
    return np.where(np.abs(d) > radius, 0.0, w)


def resample(x: np.ndarray, rate_hz: float, target_hz: float, radius: int = 8, edge: str = "reflect") -> np.ndarray:
    """Weighted means under a Hamming-windowed sinc of `radius` input samples, at any ratio.

    Where the rates are in a ratio of small whole numbers, the weights repeat after as many outputs, and are computed once.
    """
    ratio, cutoff = resample_grid(rate_hz, target_hz, radius, edge)
    n = len(x)
    count = max(0, math.ceil(n * ratio - 1e-9))
    if not count:
        return np.empty(0)
    at = np.arange(count) / ratio
    period = Fraction(target_hz / rate_hz).limit_denominator(100_000)
    repeats = period.numerator if abs(float(period) - ratio) <= 1e-15 * ratio and period.numerator < count else count
    centre = np.floor(at + 1e-9 * (repeats < count)).astype(np.int64)
    part = (at - centre)[:repeats]
    wide = x[np.clip(np.arange(-radius - 1, n + radius + 2), 0, n - 1)] if edge == "zero" else reflected(x, np.arange(-radius - 1, n + radius + 2))
    if edge == "zero":
        wide[: radius + 1] = wide[radius + 1 + n :] = 0.0
    total, weights = np.zeros(count), np.zeros(repeats)
    for off in range(-radius, radius + 1):
        w = _weights(part - off, cutoff, radius)
        weights += w
        total += np.resize(w, count) * wide[centre + (off + radius + 1)]
    return total / np.resize(weights, count)


def resampled_length(n: int, ratio: float) -> int:
    return max(0, math.ceil(n * ratio - 1e-9))


@lru_cache
def _phases(rate_hz: float, target_hz: float, radius: int) -> np.ndarray | None:
    """The weights (phase, tap) of outputs whose weights repeat; None where the rates are in no ratio of small whole numbers."""
    ratio, cutoff = resample_grid(rate_hz, target_hz, radius)
    period = Fraction(ratio).limit_denominator(100_000)
    if abs(float(period) - ratio) > 1e-15 * ratio:
        return None
    at = np.arange(period.numerator) / ratio
    part = at - np.floor(at + 1e-9)
    return _weights(part[:, None] - np.arange(-radius, radius + 1), cutoff, radius)


def resample_centres(m: np.ndarray, rate_hz: float, target_hz: float, radius: int = 8) -> np.ndarray:
    """The input sample at or before each output number m."""
    known = _phases(rate_hz, target_hz, radius) is not None
    return np.floor(m / (target_hz / rate_hz) + 1e-9 * known).astype(np.int64)


def resample_at(wide: np.ndarray, first: int, m: np.ndarray, rate_hz: float, target_hz: float, radius: int = 8) -> np.ndarray:
    """Outputs number m of a resampling whose input stands in wide from position `first` on, with `radius` samples to spare at both ends."""
    table, ratio, centre = _phases(rate_hz, target_hz, radius), target_hz / rate_hz, resample_centres(m, rate_hz, target_hz, radius)
    offsets = np.arange(-radius, radius + 1)
    w = _weights((m / ratio - centre)[:, None] - offsets, 0.5 * min(1.0, ratio), radius) if table is None else table[m % len(table)]
    return np.einsum("ij,ij->i", w, wide[(centre - first)[:, None] + offsets]) / w.sum(axis=1)


def analyse(x: np.ndarray, name: str = "db4") -> tuple[np.ndarray, np.ndarray]:
    """(approximation, detail) of one periodic level; the length must be even."""
    bank = wavelet(name)
    lo, hi = bank["dec_lo"], bank["dec_hi"]
    n, half = len(x), len(lo) // 2
    wide = x[np.arange(-half, n + half) % n]
    a, d = np.zeros(n // 2), np.zeros(n // 2)
    for tap in range(len(lo)):
        s = wide[2 * half - tap : 2 * half - tap + n : 2]
        a += lo[tap] * s
        d += hi[tap] * s
    return a, d


def synthesise(a: np.ndarray, d: np.ndarray, name: str = "db4") -> np.ndarray:
    """The inverse of analyse."""
    bank = wavelet(name)
    lo, hi = bank["dec_lo"], bank["dec_hi"]
    n, half = 2 * len(a), len(lo) // 2
    wide = np.zeros(n + 2 * len(lo))
    for tap in range(len(lo)):
        first = len(lo) + half - tap
        wide[first : first + n : 2] += lo[tap] * a + hi[tap] * d
    out = wide[len(lo) : len(lo) + n].copy()
    lost = np.concatenate((np.arange(len(lo)), np.arange(len(lo) + n, len(wide))))
    np.add.at(out, (lost - len(lo)) % n, wide[lost])
    return out


def most_levels(n: int, taps: int = 8) -> int:
    level = 0
    while n > 0 and n % 2 == 0 and n >= taps:
        n, level = n // 2, level + 1
    return level


def assert_levels(n: int, level: int, taps: int = 8) -> None:
    if isinstance(level, bool) or not isinstance(level, int) or level < 1 or level > most_levels(n, taps):
        raise SignalError("invalid-input", f"level {level!r} is not possible for {n} samples (at most {most_levels(n, taps)})")


def decompose(x: np.ndarray, level: int, name: str = "db4") -> list[np.ndarray]:
    """[detail 1, ..., detail L, approximation]."""
    assert_levels(len(x), level, len(wavelet(name)["dec_lo"]))
    out, rest = [], x
    for _ in range(level):
        rest, detail = analyse(rest, name)
        out.append(detail)
    return [*out, rest]


def reconstruct(bands: list[np.ndarray], name: str = "db4") -> np.ndarray:
    *details, rest = bands
    for detail in reversed(details):
        if len(detail) != len(rest):
            raise SignalError("invalid-input", "the levels of a decomposition don't fit together")
        rest = synthesise(rest, detail, name)
    return rest


def _lists(values: pa.Array) -> list[np.ndarray | None]:
    """The lists of values as views of one buffer; a null or non-finite sample is refused."""
    flat, ends = values.values, values.offsets.to_numpy()
    if flat.null_count:
        raise SignalError("malformed-signal", "a signal has a missing sample")
    flat = flat.to_numpy(zero_copy_only=False)
    if not np.isfinite(flat[ends[0] : ends[-1]]).all():
        raise SignalError("malformed-signal", "a signal has a sample that is not finite")
    return [flat[s:e] if ok else None for s, e, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), values.is_valid().to_pylist(), strict=True)]


def _list_array(parts: list, values: pa.Array) -> pa.Array:
    """Lists of the sizes of parts over values; None is a null."""
    offsets = np.cumsum([0, *(0 if p is None else len(p) for p in parts)])
    missing = np.array([p is None for p in parts], bool)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=pa.array(missing) if missing.any() else None)


def flat_lists(parts: list[np.ndarray | None]) -> pa.Array:
    """A list array of the parts; None is a null."""
    have = [p for p in parts if p is not None]
    return _list_array(parts, pa.array(np.concatenate(have) if have else np.empty(0)))


def _each(values: pa.Array, f: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """f over every list of values; null stays null."""
    return flat_lists([None if x is None else f(x) for x in _lists(values)])


def array_function(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function array<double> -> array<double> that moves whole Arrow batches."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return _each(values, f)

    return run


def filter_column(data: Column, spec: dict, rate_hz: float) -> Column:
    """A filtered array column; the taps are designed once, on the driver."""
    taps = design_fir(spec, rate_hz)
    kernel = fir_zero_phase if spec.get("phase") == "zero" else fir
    return array_function(lambda x: kernel(x, taps))(data)


def resample_column(data: Column, rate_hz: float, target_hz: float, radius: int = 8, edge: str = "reflect") -> Column:
    resample_grid(rate_hz, target_hz, radius, edge)
    return array_function(lambda x: resample(x, rate_hz, target_hz, radius, edge))(data)


def normalise(x: np.ndarray, strategy: str) -> np.ndarray:
    """(x - a) / b of a channel's own fit: its least sample and span, or its mean and population deviation; no spread is refused."""
    if strategy == "min-max":
        a = x.min() if x.size else 0.0
        b = x.max() - a if x.size else 0.0
    else:
        a = x.mean() if x.size else 0.0
        b = np.sqrt(max(0.0, float(x @ x) / x.size - a * a)) if x.size else 0.0
    if not b > 0:
        raise SignalError("numerical-failure", f"{strategy} of a channel without spread")
    return (x - a) / b


def normalise_column(data: Column, strategy: str) -> Column:
    """An array column normalised by each array's own fit: nothing is shuffled."""
    if strategy not in ("min-max", "z-score"):
        raise SignalError("invalid-input", f"unknown normalisation {strategy!r}")
    return array_function(lambda x: normalise(x, strategy))(data)


def decompose_column(data: Column, level: int, name: str = "db4") -> Column:
    """array<array<double>>: detail 1 to L, then the approximation."""
    wavelet(name)

    @F.arrow_udf("array<array<double>>")
    def run(values: pa.Array) -> pa.Array:
        bands = [None if x is None else decompose(x, level, name) for x in _lists(values)]
        return _list_array(bands, flat_lists([b for own in bands if own is not None for b in own]))

    return run(data)


def band_column(data: Column, level: int, band: int, name: str = "db4") -> Column:
    """One band of a decomposition: detail `band` from 1 to level, or the approximation at level + 1."""
    return array_function(lambda x: decompose(x, level, name)[band - 1])(data)


def round_trip_column(data: Column, level: int, name: str = "db4") -> Column:
    """The reconstruction of a decomposition."""
    return array_function(lambda x: reconstruct(decompose(x, level, name), name))(data)


def reconstruct_column(bands: Column, name: str = "db4") -> Column:
    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        inner, ends = _lists(values.values), values.offsets.to_numpy().tolist()
        return flat_lists([reconstruct(inner[s:e], name) if ok else None for s, e, ok in zip(ends[:-1], ends[1:], values.is_valid().to_pylist(), strict=True)])

    return run(bands)


def _tap_sum(data: Column, taps, place: Callable[[Column, int], Column], count: Column) -> Column:
    terms = lambda i: [F.lit(float(t)) * place(i, k) for k, t in enumerate(taps)]

    def total(i: Column) -> Column:
        first, *rest = terms(i)
        for t in rest:
            first = first + t
        return first

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), total)).otherwise(F.slice(data, 1, 0))


def fir_sql(data: Column, taps) -> Column:
    """The causal filter in SQL alone; data must be a stored column, not an expression, which would be computed anew for each sample."""
    return _tap_sum(data, taps, lambda i, k: F.coalesce(F.get(data, i - k), F.lit(0.0)), F.size(data))


def analyse_sql(data: Column, high: bool, name: str = "db4") -> Column:
    """One periodic level in SQL alone (see fir_sql): the approximation, or the detail where high is set."""
    taps = wavelet(name)["dec_hi" if high else "dec_lo"]
    n = F.size(data)
    return _tap_sum(data, taps, lambda i, k: F.get(data, F.pmod(2 * i + len(taps) // 2 - k, n)), F.floor(n / 2))


def detail_band_hz(level: Column | int, rate_hz: Column | float) -> Column:
    level, rate = F.lit(level) if isinstance(level, int) else level, F.lit(rate_hz) if not isinstance(rate_hz, Column) else rate_hz
    return F.struct((rate / F.pow(F.lit(2.0), level + 1)).alias("low_hz"), (rate / F.pow(F.lit(2.0), level)).alias("high_hz"))


def approximation_band_hz(level: Column | int, rate_hz: Column | float) -> Column:
    return F.struct(F.lit(0.0).alias("low_hz"), detail_band_hz(level, rate_hz)["low_hz"].alias("high_hz"))


def band_text(band: Column) -> Column:
    """≈ low–high Hz."""
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("≈ "), text(band["low_hz"]), F.lit("–"), text(band["high_hz"]), F.lit(" Hz"))


def stride_samples(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def stride_sec(level: Column, rate_hz: Column | float) -> Column:
    return stride_samples(level) / rate_hz


def coefficient_range(window: Column, level: Column, count: Column) -> Column:
    """struct<start, end>: the coefficients of a level that a sample window reaches, within the band."""
    stride, zero = stride_samples(level), F.lit(0).cast("long")
    clamp = lambda x: F.greatest(zero, F.least(count.cast("long"), x))
    start, end = clamp(F.floor(window["start"] / stride)), clamp(F.ceil(window["end"] / stride))
    some = window["end"] > window["start"]
    return F.struct(F.when(some, start).otherwise(zero).alias("start"), F.when(some, F.greatest(start, end)).otherwise(zero).alias("end"))


def filter_problems(kind: Column, low: Column, high: Column, taps: Column, rate_hz: Column) -> Column:
    """array<string> of what keeps the filter of a row from being designed, by the rules of `design_fir`: a rate, a type, taps and
    cutoffs. low is the cutoff, or the lower one of a band; high is null but for a band."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    inside = lambda x: finite(x) & (x > 0) & (x < rate_hz / 2)
    known, band = F.coalesce(kind.isin("lowpass", "highpass", "bandpass"), F.lit(False)), F.coalesce(kind == "bandpass", F.lit(False))
    rate = finite(rate_hz) & (rate_hz > 0)
    shaped = low.isNotNull() & (band == high.isNotNull())
    ordered = inside(low) & (~band | inside(high) & (low < high))
    problems = (
        (rate, "the sample rate must be above zero"),
        (F.coalesce((taps >= 5) & (taps % 2 == 1), F.lit(False)), "the number of taps must be odd and at least 5"),
        (known, "the type must be lowpass, highpass or bandpass"),
        (~known | shaped, "a band takes two cutoffs, other filters one"),
        (~(known & rate & shaped) | ordered, "cutoffs must be ordered and between zero and half the rate"),
    )
    return F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for ok, text in problems]))


def bank_problems(low: Column, high: Column) -> Column:
    """array<string> of what keeps two arrays of taps from being a filter bank, as `assert_filter_bank`."""
    size = F.coalesce(F.size(low), F.lit(0))
    fits = (size > 0) & (size % 2 == 0) & F.coalesce(F.size(high) == size, F.lit(False))
    return F.array_compact(F.array(F.when(~fits, F.lit("a filter bank needs two filters of one even length"))))
