"""Viewports as struct<start_sec, duration_sec> columns: clamp, zoom, pan, presets, read-outs and captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.functions.timeaxis import Num, clamp_fraction, clamp_range, col, duration_sec, sample_of_time

#: Fixed values of the interactions.
ZOOM_STEP, PAN_STEP, LEAST_SAMPLES, PRESET_SEGMENTS, MARGIN = 0.5, 0.25, 2, 4, 0.08
IDLE_CURSOR, IDLE_ANNOTATION = "Cursor: —", "Annotation: —"


def viewport(start_sec: Num, duration: Num) -> Column:
    return F.struct(col(start_sec).cast("double").alias("start_sec"), col(duration).cast("double").alias("duration_sec"))


def bounds_of(rate_hz: Num, start_sec: Num, n: Num) -> Column:
    return viewport(start_sec, duration_sec(n, rate_hz))


def least_duration(rate_hz: Num) -> Column:
    return duration_sec(LEAST_SAMPLES, rate_hz)


def _least(bounds: Column, least: Num) -> Column:
    return F.least(col(least).cast("double"), bounds["duration_sec"])


def _placed(start: Column, duration: Column, bounds: Column) -> Column:
    last = bounds["start_sec"] + bounds["duration_sec"] - duration
    return viewport(clamp_range(start, bounds["start_sec"], last), duration)


def clamp_viewport(view: Column, bounds: Column, least: Num) -> Column:
    """The duration is clamped first, then the start."""
    return _placed(view["start_sec"], clamp_range(view["duration_sec"], _least(bounds, least), bounds["duration_sec"]), bounds)


def zoom(view: Column, bounds: Column, factor: Num, anchor: Num, least: Num) -> Column:
    """Scales the duration and keeps the time at the anchor (a fraction of the view) in place."""
    now, at = clamp_viewport(view, bounds, least), clamp_fraction(anchor)
    duration = clamp_range(now["duration_sec"] * col(factor), _least(bounds, least), bounds["duration_sec"])
    held = now["start_sec"] + at * now["duration_sec"]
    return _placed(held - at * duration, duration, bounds)


def pan(view: Column, bounds: Column, fraction: Num) -> Column:
    """Shifts by a fraction of the view."""
    duration = F.least(view["duration_sec"], bounds["duration_sec"])
    return _placed(view["start_sec"] + col(fraction) * duration, duration, bounds)


def from_fractions(bounds: Column, a: Num, b: Num, least: Num) -> Column:
    """The view between two fractions of the bounds, given in any order."""
    a, b = clamp_fraction(a), clamp_fraction(b)
    low = F.least(a, b)
    duration = clamp_range((F.greatest(a, b) - low) * bounds["duration_sec"], _least(bounds, least), bounds["duration_sec"])
    return clamp_viewport(viewport(bounds["start_sec"] + low * bounds["duration_sec"], duration), bounds, least)


def readout(fraction: Num, view: Column, rate_hz: Num, record_start_sec: Num) -> Column:
    """struct<time_sec, sample>: what is under a cursor at a fraction of the view; the sample is at least 0."""
    at = view["start_sec"] + clamp_fraction(fraction) * view["duration_sec"]
    return F.struct(at.alias("time_sec"), F.greatest(F.lit(0).cast("long"), sample_of_time(at, rate_hz, record_start_sec)).alias("sample"))


def presets(rate_hz: Num, start_sec: Num, n: Num, segments: int = PRESET_SEGMENTS) -> Column:
    """array<struct<label, start_sec, duration_sec>>: the full record and equal segments; empty without samples."""
    if isinstance(segments, bool) or not isinstance(segments, int) or segments <= 0:
        raise SignalError("invalid-input", f"the number of segments has to be a whole number above 0, not {segments!r}")
    total, start = duration_sec(n, rate_hz), col(start_sec).cast("double")
    part = total / segments
    item = lambda label, s, d: F.struct(label.alias("label"), s.alias("start_sec"), d.alias("duration_sec"))

    def segment(k: Column) -> Column:
        s = start + (k - 1) * part
        return item(F.format_string("%.2f–%.2f s", s, s + part), s, part)

    every = F.concat(F.array(item(F.lit("Full record"), start, total)), F.transform(F.sequence(F.lit(1), F.lit(segments)), segment))
    return F.when(col(n) > 0, every).otherwise(F.slice(every, 1, 0))


def padded_domain(low: Num, high: Num) -> Column:
    """struct<min, max>: 8 % beyond both ends; without a span, half the magnitude or 0.5."""
    low, high = col(low), col(high)
    span = high - low
    flat = F.when(F.abs(high) > 0, F.abs(high) * 0.5).otherwise(0.5)
    margin = F.when(span > 0, span * MARGIN).otherwise(flat)
    return F.struct((low - margin).alias("min"), (high + margin).alias("max"))


def format_cursor(time_sec: Column, sample: Column, symbol: Column | None = None) -> Column:
    base = F.format_string("Cursor: %.2f s · sample %d", time_sec, sample)
    near = F.coalesce(symbol, F.lit("")) if symbol is not None else F.lit("")
    return F.when(time_sec.isNull(), IDLE_CURSOR).when(near != "", F.concat(base, F.lit(" · nearest "), near)).otherwise(base)


def format_annotation(symbol: Column, sample: Column, note: Column) -> Column:
    base = F.concat(F.lit("Annotation: "), symbol, F.lit(" · sample "), sample.cast("string"))
    return F.when(sample.isNull(), IDLE_ANNOTATION).when(F.coalesce(note, F.lit("")) != "", F.concat(base, F.lit(" · "), note)).otherwise(base)


def format_list_caption(shown: Column, visible: Column, truncated: Column) -> Column:
    first = F.concat(F.lit("Showing first "), shown.cast("string"), F.lit(" of "), visible.cast("string"), F.lit(" in view"))
    return F.when(visible == 0, "No annotations in view").when(truncated, first).otherwise(F.concat(visible.cast("string"), F.lit(" in view")))


def format_marker_summary(visible: Column, merged: Column) -> Column:
    base = F.concat(visible.cast("string"), F.lit(" annotation(s)"))
    return F.when(merged > 0, F.concat(base, F.lit(", "), merged.cast("string"), F.lit(" merged"))).otherwise(base)


def format_amplitude(value: Column) -> Column:
    return F.when(F.abs(value) >= 100, F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))


def format_frequency(value: Column) -> Column:
    """The shortest decimal, without a trailing .0."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")
