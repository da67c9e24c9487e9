"""Units, the time axis, and sample ranges as column expressions.

Arguments named *_hz, *_sec, n, i are Columns or plain numbers. Rounding is half toward plus
infinity (floor(x + 0.5)), which Spark's round() is not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError, refuse_where

UNITS = ("adc", "mV", "normalized")
Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(x: Num) -> Column:
    """True for numbers other than NaN and infinities; null stays null."""
    x = col(x).cast("double")
    return ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def positive(x: Num) -> Column:
    return finite(x) & (col(x) > 0)


def assert_finite(value: float, label: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise SignalError("invalid-input", f"{label} is not a finite number: {value!r}.")
    return value


def assert_positive(value: float, label: str) -> float:
    if assert_finite(value, label) <= 0:
        raise SignalError("invalid-input", f"{label} is not above zero: {value!r}.")
    return value


def is_unit(unit: Column) -> Column:
    return F.coalesce(unit.isin(*UNITS), F.lit(False))


def assert_unit(unit: str) -> str:
    if unit not in UNITS:
        raise SignalError("invalid-input", f"amplitude unit must be one of {', '.join(UNITS)}, received {unit!r}.")
    return unit


def round_half_up(x: Num) -> Column:
    return F.floor(col(x) + F.lit(0.5))


def adc_to_millivolt(adc: Num, gain: Num, baseline: Num) -> Column:
    ok = finite(adc) & positive(gain) & finite(baseline)
    return refuse_where(~ok, "invalid-input", "calibration needs finite numbers and a gain above zero", (col(adc).cast("double") - col(baseline)) / col(gain))


def millivolt_to_adc(mv: Num, gain: Num, baseline: Num) -> Column:
    ok = finite(mv) & positive(gain) & finite(baseline)
    return refuse_where(~ok, "invalid-input", "calibration needs finite numbers and a gain above zero", col(mv).cast("double") * col(gain) + col(baseline))


def samples_to_millivolt(samples: Column, gain: Num, baseline: Num) -> Column:
    """An array of raw samples in millivolts."""
    return F.transform(samples, lambda s: (s.cast("double") - col(baseline)) / col(gain))


def sampling(rate_hz: Num, start_sec: Num = 0.0) -> Column:
    ok = positive(rate_hz) & finite(start_sec)
    rate = refuse_where(~ok, "invalid-input", "sampling needs a positive rate and a finite start", col(rate_hz).cast("double"))
    return F.struct(rate.alias("sample_rate_hz"), col(start_sec).cast("double").alias("start_time_sec"))


def same_sampling(a: Column, b: Column) -> Column:
    return (a["sample_rate_hz"] == b["sample_rate_hz"]) & (a["start_time_sec"] == b["start_time_sec"])


def assert_compatible_rates(a_hz: float, b_hz: float) -> None:
    if a_hz != b_hz:
        raise SignalError("incompatible-sample-rate", f"Sample rates {a_hz} Hz and {b_hz} Hz differ.")


def rates_equal(a: Num, b: Num) -> Column:
    return F.abs(col(a) - col(b)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(col(a)), F.abs(col(b)))


def duration_sec(n: Num, rate_hz: Num) -> Column:
    """The acquisition window n / rate, not (n - 1) / rate."""
    return col(n) / col(rate_hz)


def time_of_sample(i: Num, rate_hz: Num, start_sec: Num = 0.0) -> Column:
    return col(i) / col(rate_hz) + col(start_sec)


def sample_of_time(t_sec: Num, rate_hz: Num, start_sec: Num = 0.0, policy: str = "round") -> Column:
    """The sample index of a time, not clamped; policy: floor, ceil or round."""
    exact = (col(t_sec) - col(start_sec)) * col(rate_hz)
    how = {"floor": F.floor, "ceil": F.ceil, "round": round_half_up}.get(policy)
    if how is None:
        raise SignalError("invalid-input", f"unknown rounding policy {policy!r}")
    return how(exact).cast("long")


def sample_window(start_sec: Num, duration: Num, rate_hz: Num, record_start_sec: Num, n: Num) -> Column:
    """struct<start, end>: the half-open samples of a time span within [0, n); no duration is the empty [0, 0)."""
    n = col(n).cast("long")
    clamp = lambda x: F.greatest(F.lit(0).cast("long"), F.least(n, x))
    first = clamp(sample_of_time(start_sec, rate_hz, record_start_sec, "floor"))
    last = clamp(sample_of_time(col(start_sec) + col(duration), rate_hz, record_start_sec, "ceil"))
    some = (col(duration) > 0) & (last > first)
    zero = F.lit(0).cast("long")
    return F.struct(F.when(col(duration) > 0, first).otherwise(zero).alias("start"), F.when(some, last).when(col(duration) > 0, first).otherwise(zero).alias("end"))


def whole_record(rate_hz: Num, start_sec: Num, n: Num) -> Column:
    return F.struct(col(start_sec).cast("double").alias("start_sec"), duration_sec(n, rate_hz).alias("duration_sec"))


def clamp_range(x: Num, low: Num, high: Num) -> Column:
    x, low, high = col(x), col(low), col(high)
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def clamp_fraction(f: Num) -> Column:
    """f within [0, 1]; NaN, which Spark sorts above all numbers, is 0."""
    f = col(f).cast("double")
    return F.when(F.isnan(f) | ~(f > 0), 0.0).when(f > 1, 1.0).otherwise(f)


def reflected_index(i: Num, n: Num) -> Column:
    """The index that a half-sample mirror puts in place of i; beyond one mirror it wraps modulo n."""
    i, n = col(i), col(n)
    once = F.when(i < 0, -i - 1).when(i >= n, 2 * n - i - 1).otherwise(i)
    return F.pmod(once, n)


def max_periodic_level(n: Num) -> Column:
    """How often n can be halved exactly."""
    n = col(n).cast("long")
    return F.when(n > 0, F.log2(n.bitwiseAND(-n)).cast("int")).otherwise(0)


def max_orthogonal_level(n: Num, taps: Num = 8) -> Column:
    """max_periodic_level, lowered until the last level's input is at least as long as the filter."""
    top = max_periodic_level(n)
    fits = lambda j: col(n) / F.pow(F.lit(2.0), j - 1) >= col(taps)
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), top), lambda j: (j == 0) | fits(j))), F.lit(0))
