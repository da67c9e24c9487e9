"""Events on a signal's time axis: markers, lists, symbol filters, interval and nearest-event joins.

Events are rows (keys..., sample_index, symbol, aux_note, ordinal); ordinal is their input order within keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.errors import SignalError
from pulsegrid.functions.timeaxis import Num, clamp_fraction, col, sample_window, time_of_sample
from pulsegrid.plans.storage import materialise

#: How near a cursor an event must be, as a share of the view's width, and how many rows a list shows.
TOLERANCE, LIST_LIMIT = 0.02, 200

#: The symbols of annotation codes 0 to 63; codes left out have none.
STANDARD_SYMBOLS = {
    0: " ", 1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q",
    14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D", 22: '"', 23: "=", 24: "p", 25: "B", 26: "^", 27: "t", 28: "+",
    29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(", 40: ")", 41: "r",
}


def _positive(value: int, label: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise SignalError("invalid-input", f"{label} has to be a whole number above 0, not {value!r}")
    return value


def symbols_of_codes(events: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """events (code, ...) with symbol: a custom label of its keys' file first, then the standard table, else ''."""
    pairs = [F.lit(x) for kv in STANDARD_SYMBOLS.items() for x in kv]
    standard = F.try_element_at(F.create_map(*pairs), F.col("code"))
    if custom is None:
        return events.withColumn("symbol", F.coalesce(standard, F.lit("")))
    by = [c for c in custom.columns if c not in ("code", "symbol")]
    chosen = custom.select(*by, "code", F.col("symbol").alias("_custom"))
    return events.join(chosen, [*by, "code"], "left").withColumn("symbol", F.coalesce("_custom", standard, F.lit(""))).drop("_custom")


def in_view(events: DataFrame, start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num) -> DataFrame:
    """Events of the half-open sample window of a view, which may be columns of the events or numbers."""
    w = sample_window(start_sec, duration, rate_hz, record_start, n)
    return events.where((F.col("sample_index") >= w["start"]) & (F.col("sample_index") < w["end"]))


def view_fraction(sample: Column, start_sec: Num, duration: Num, rate_hz: Num, record_start: Num) -> Column:
    return clamp_fraction((time_of_sample(sample, rate_hz, record_start) - col(start_sec)) / col(duration))


def markers(events: DataFrame, keys: list[str], start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num, columns: int) -> DataFrame:
    """(keys, column, sample_index, symbol, x, merged): a marker for each pixel column that has events.

    The marker shows the column's earliest event; of equal samples, the first by ordinal.
    """
    _positive(columns, "column count")
    x = view_fraction(F.col("sample_index"), start_sec, duration, rate_hz, record_start)
    rows = in_view(events, start_sec, duration, rate_hz, record_start, n).withColumn("x", x)
    rows = rows.withColumn("column", F.least(F.lit(columns - 1), F.floor(F.col("x") * columns).cast("int")))
    first = F.min_by(F.struct("sample_index", "symbol", "x"), F.struct("sample_index", "ordinal"))
    return rows.groupBy(*keys, "column").agg(first.alias("m"), F.count(F.lit(1)).alias("merged")).select(*keys, "column", "m.sample_index", "m.symbol", "m.x", "merged")


def marker_summary(events: DataFrame, keys: list[str], start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num, columns: int) -> DataFrame:
    """(keys, visible, merged, symbols): the counts and the distinct symbols of a view, sorted."""
    _positive(columns, "column count")
    x = view_fraction(F.col("sample_index"), start_sec, duration, rate_hz, record_start)
    seen = in_view(events, start_sec, duration, rate_hz, record_start, n).withColumn("_column", F.least(F.lit(columns - 1), F.floor(x * columns).cast("int")))
    found = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("visible"), F.size(F.collect_set("_column")).alias("_markers"), F.sort_array(F.collect_set("symbol")).alias("symbols"))
    return found.select(*keys, "visible", (F.col("visible") - F.col("_markers")).alias("merged"), "symbols")


def event_list(events: DataFrame, keys: list[str], start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num, limit: int = LIST_LIMIT) -> DataFrame:
    """The first `limit` events of each key's view by (sample, symbol), with position, visible and truncated."""
    _positive(limit, "list limit")
    seen = in_view(events, start_sec, duration, rate_hz, record_start, n)
    order = W.Window.partitionBy(*keys).orderBy("sample_index", "symbol", "ordinal")
    top = seen.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    total = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("visible"))
    return top.join(total, keys).withColumn("truncated", F.col("visible") > limit)


def filter_symbols(events: DataFrame, symbols: list[str] | None) -> DataFrame:
    """Events of the symbols; no symbols (or only an empty one) means all events."""
    chosen = [s for s in symbols or [] if s is not None]
    return events.where(F.col("symbol").isin(chosen)) if chosen else events


def with_symbols(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Events whose symbol is a row of symbols (symbol)."""
    return events.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def filter_symbol(events: DataFrame, symbol: str | None) -> DataFrame:
    return filter_symbols(events, [symbol] if symbol else [])


def resolve_symbols(active: Column, available: Column) -> Column:
    """The active symbols that are available, in the order of available."""
    return F.filter(available, lambda s: F.array_contains(active, s))


def resolve_symbol(active: Column, available: Column) -> Column:
    return F.when(F.array_contains(available, active) & (active != ""), active)


def in_windows(events: DataFrame, windows: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Interval join: events with windows (keys, win_start, win_end) of the same keys that have their sample.

    Both sides meet on cells of `cell` samples: a window has a row for each cell that it reaches, so the join is
    an equi-join and no pair outside a cell is looked at. Choose cells about as wide as windows are.
    """
    _positive(cell, "cell")
    spread = windows.where("win_end > win_start").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("win_start") / cell), F.floor((F.col("win_end") - 1) / cell))))
    placed = events.withColumn("_cell", F.floor(F.col("sample_index") / cell))
    joined = placed.join(spread, [*keys, "_cell"])
    return joined.where((F.col("sample_index") >= F.col("win_start")) & (F.col("sample_index") < F.col("win_end"))).drop("_cell")


def nearest(events: DataFrame, cursors: DataFrame, keys: list[str], cursor: str, start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num, tolerance: float = TOLERANCE) -> DataFrame:
    """Of each cursor (keys, cursor, fraction) the nearest event in view within the tolerance; cursors without one are left out.

    Ties go to the lower sample, then the smaller symbol. Cursors and events meet on cells of the view as wide as
    the tolerance (a cursor looks into its own and both neighbours), so only events near a cursor are compared.
    """
    if not 0 <= tolerance < float("inf"):
        raise SignalError("invalid-input", f"the tolerance must be a finite fraction of at least 0, received {tolerance!r}.")
    width = max(tolerance, 1e-6)
    x = view_fraction(F.col("sample_index"), start_sec, duration, rate_hz, record_start)
    seen = in_view(events, start_sec, duration, rate_hz, record_start, n).withColumn("x", x).withColumn("_cell", F.floor(F.col("x") / width))
    at = cursors.select(*keys, cursor, clamp_fraction(F.col("fraction")).alias("_at"))
    at = at.withColumn("_cell", F.explode(F.expr(f"sequence(floor(_at / {width}D) - 1, floor(_at / {width}D) + 1)")))
    pairs = seen.join(at, [*keys, "_cell"]).withColumn("distance", F.abs(F.col("x") - F.col("_at"))).where(F.col("distance") <= tolerance)
    best = F.min_by(F.struct("sample_index", "symbol", "aux_note", "distance"), F.struct("distance", "sample_index", "symbol", "ordinal"))
    return pairs.groupBy(*keys, cursor).agg(best.alias("b")).select(*keys, cursor, "b.sample_index", "b.symbol", "b.aux_note", "b.distance")


def nearest_sorted(events: DataFrame, cursors: DataFrame, keys: list[str], cursor: str, start_sec: Num, duration: Num, rate_hz: Num, record_start: Num, n: Num, tolerance: float = TOLERANCE) -> DataFrame:
    """As `nearest`, at any tolerance and any number of events and cursors a key.

    Events and cursors are sorted together by ranges of (keys, place). Inside a range, a cursor's events before and after it come from two
    scans; where a range has none, they are the last of the ranges before and the first of those after, which a row for
    each key and range carries. No event is compared with more than the cursors it is next to.
    """
    if not 0 <= tolerance < float("inf"):
        raise SignalError("invalid-input", f"a tolerance is a finite fraction of at least 0, not {tolerance!r}")
    x = view_fraction(F.col("sample_index"), start_sec, duration, rate_hz, record_start)
    first = F.min(F.struct("sample_index", "symbol", "ordinal", "aux_note"))
    seen = in_view(events, start_sec, duration, rate_hz, record_start, n).withColumn("_p", x).groupBy(*keys, "_p").agg(first.alias("_e"))
    at = cursors.select(*keys, F.col(cursor).alias("_cursor"), clamp_fraction(F.col("fraction")).alias("_p"))
    event = F.struct(F.col("_p").alias("x"), "_e.*")
    both = seen.select(*keys, "_p", F.lit(False).alias("_is_cursor"), event.alias("_e")).unionByName(at.withColumn("_is_cursor", F.lit(True)), allowMissingColumns=True)
    both = both.repartitionByRange(*keys, "_p").withColumn("_part", F.spark_partition_id())
    both = materialise(both, "events-and-cursors")
    part = W.Window.partitionBy("_part", *keys)
    rows = both.withColumn("_left", F.last("_e", ignorenulls=True).over(part.orderBy("_p", "_is_cursor")))
    rows = rows.withColumn("_right", F.last("_e", ignorenulls=True).over(part.orderBy(F.col("_p").desc(), "_is_cursor"))).where("_is_cursor")
    ends = both.groupBy("_part", *keys).agg(F.min("_e").alias("_first"), F.max("_e").alias("_last"))
    before = W.Window.partitionBy(*keys).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    after = W.Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.select("_part", *keys, F.last("_last", ignorenulls=True).over(before).alias("_from_left"), F.last("_first", ignorenulls=True).over(after).alias("_from_right"))
    rows = rows.join(ends, ["_part", *keys])
    near = lambda e: F.when(e.isNotNull(), F.struct(F.abs(e["x"] - F.col("_p")).alias("distance"), e["sample_index"].alias("sample_index"), e["symbol"].alias("symbol"), e["ordinal"].alias("ordinal"), e["aux_note"].alias("aux_note")))
    best = F.least(near(F.coalesce("_left", "_from_left")), near(F.coalesce("_right", "_from_right")))
    found = rows.withColumn("_b", best).where(F.col("_b.distance") <= tolerance)
    return found.select(*keys, F.col("_cursor").alias(cursor), "_b.sample_index", "_b.symbol", "_b.aux_note", "_b.distance")
