"""Registered queries over long signals: one key has nine tenths of the rows, and stretches and cells are kept small."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import kernels as K
from pulsegrid.functions import timeaxis
from pulsegrid.operators import chunks, events, pyramid, signals
from pulsegrid.plans.registry import query, r6
from pulsegrid.plans.storage import shared_dir
from pulsegrid.plans.views import RATE_HZ, read
from pulsegrid.sources import ranged

#: Samples of stretches and cells here: small and no power of two, so that every operator works across their edges.
SIZE = 999
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
#: A tenth of the lines go by supplier, the rest is key 0; the wave swings about zero.
_KEY = "CASE WHEN l_orderkey % 10 = 0 THEN l_suppkey ELSE 0 END"
_WAVE = f"SELECT {_KEY} AS k, (row_number() OVER (PARTITION BY {_KEY} ORDER BY {', '.join(_ORDER)}) - 1)::BIGINT AS i, l_extendedprice - 30000 AS x FROM lineitem"
_LONG = f"WITH s AS ({_WAVE})"


def _wave(spark, sf_dir: str):
    rows = read(spark, sf_dir, "lineitem").withColumn("k", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_suppkey")).otherwise(0).cast("long")).withColumn("x", F.col("l_extendedprice") - 30000)
    return chunks.of_rows(rows, ["k"], _ORDER, "x", SIZE)


def _long(df, *keys):
    return chunks.positions(df, ["k", *keys], "y").select("k", *keys, "i", (F.round("y", 4) + 0.0).alias("y"))


def _cut_to(df, multiple: int, least: int):
    """The channels cut to a whole multiple of samples; those left with fewer than least go."""
    n = F.col("n") - F.col("n") % multiple
    whole = df.withColumn("n", n).where((F.col("n") >= least) & (F.col("start") < F.col("n")))
    return whole.withColumn("data", F.slice("data", F.lit(1), F.least(F.size("data").cast("long"), F.col("n") - F.col("start")).cast("int")))


@query(f"{_LONG} SELECT k, i, round(x, 4) + 0.0 AS y FROM s")
def long_positions(spark, sf_dir):
    return _long(_wave(spark, sf_dir))


@query(f"""{_LONG} SELECT k, count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 4) + 0.0 AS mean, round(sqrt(avg(x * x)), 4) + 0.0 AS rms,
  arg_min(i, {{'a': -abs(x), 'i': i}}) AS peak_index, max(abs(x)) AS peak_value FROM s GROUP BY k""")
def long_basic_stats(spark, sf_dir):
    s = signals.basic_stats(chunks.positions(_wave(spark, sf_dir), ["k"]), ["k"])
    return s.select("k", "n", "min", "max", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("rms", 4) + 0.0).alias("rms"), "peak_index", F.abs("peak_value").alias("peak_value"))


_FIR = {"type": "bandpass", "cutoff_hz": [4.0, 12.0], "taps": 15, "phase": "forward"}


def _shifted(numbers, place, column: str) -> str:
    """SQL of the sum of numbers[t] times the column place(t) rows further, in window o; rows that aren't there count as zero."""
    at = lambda t: f"coalesce({'lead' if place(t) > 0 else 'lag'}({column}, {abs(place(t))}) OVER o, 0)"
    return " + ".join(f"({float(h)!r}::DOUBLE) * {at(t)}" for t, h in enumerate(numbers))


_TAPS = K.design_fir(_FIR, RATE_HZ)
_OVER = "WINDOW o AS (PARTITION BY k ORDER BY {})"


@query(f"{_LONG} SELECT k, i, round({_shifted(_TAPS, lambda t: -t, 'x')}, 4) + 0.0 AS y FROM s {_OVER.format('i')}")
def long_fir(spark, sf_dir):
    return _long(chunks.filtered(_wave(spark, sf_dir), ["k"], _FIR, RATE_HZ, SIZE))


@query(f"""{_LONG}, c AS (SELECT k, count(*) AS n FROM s GROUP BY k HAVING count(*) >= 7),
w AS (SELECT k, i + 7 AS j, x FROM s UNION ALL SELECT k, 6 - i, x FROM s WHERE i < 7 UNION ALL SELECT k, 2 * n - 1 - i + 7, x FROM s JOIN c USING (k) WHERE i >= n - 7),
f AS (SELECT k, j, {_shifted(_TAPS, lambda t: -t, 'x')} AS y FROM w {_OVER.format('j')}),
g AS (SELECT k, j, {_shifted(_TAPS, lambda t: t, 'y')} AS y FROM f {_OVER.format('j')})
SELECT k, j - 7 AS i, round(y, 4) + 0.0 AS y FROM g JOIN c USING (k) WHERE j >= 7 AND j < n + 7""")
def long_fir_zero_phase(spark, sf_dir):
    wave = _wave(spark, sf_dir).where("n >= 7")
    return _long(chunks.filtered(wave, ["k"], {**_FIR, "phase": "zero"}, RATE_HZ, SIZE))


_LEVELS = 3
_EVEN = f"{_LONG}, c AS (SELECT k, count(*) - count(*) % 8 AS n FROM s GROUP BY k HAVING count(*) >= 32), a0 AS (SELECT s.k, i, x, n FROM s JOIN c USING (k) WHERE i < n)"


def _dwt_sql() -> str:
    """Each level over the band before it, set forth by four samples at both ends as a circle has them."""
    bank, out = K.wavelet("db4"), _EVEN
    for j in range(1, _LEVELS + 1):
        out += f""", w{j} AS (SELECT k, i, x, n FROM a{j - 1} UNION ALL SELECT k, i + n, x, n FROM a{j - 1} WHERE i < 4 UNION ALL SELECT k, i - n, x, n FROM a{j - 1} WHERE i >= n - 4)"""
        for band, taps in ((f"a{j}", "dec_lo"), (f"d{j}", "dec_hi")):
            out += f""", {band} AS (SELECT k, i // 2 AS i, x, n // 2 AS n FROM (SELECT k, i, n, {_shifted(bank[taps], lambda t: 4 - t, 'x')} AS x FROM w{j} {_OVER.format('i')}) WHERE i % 2 = 0 AND i >= 0 AND i < n)"""
    bands = [*(f"d{j}" for j in range(1, _LEVELS + 1)), f"a{_LEVELS}"]
    return out + " " + " UNION ALL ".join(f"SELECT k, {b}::BIGINT AS band, i::BIGINT AS i, round(x, 4) + 0.0 AS y FROM {t}" for b, t in enumerate(bands, 1))


@query(_dwt_sql())
def long_dwt(spark, sf_dir):
    return _long(chunks.decomposed(_cut_to(_wave(spark, sf_dir), 8, 32), ["k"], _LEVELS, size=SIZE), "band")


@query(f"{_EVEN} SELECT k, i, round(x, 4) + 0.0 AS y FROM a0")
def long_idwt(spark, sf_dir):
    bands = chunks.decomposed(_cut_to(_wave(spark, sf_dir), 8, 32), ["k"], _LEVELS, size=SIZE)
    return _long(chunks.reconstructed(bands, ["k"], _LEVELS, size=SIZE))


@query(f"""{_LONG}, c AS (SELECT k, count(*) AS n FROM s GROUP BY k), w AS (SELECT k, n, unnest(range(0, n, 70)) AS start FROM c),
v AS (SELECT * FROM w WHERE start <= greatest(0, CASE WHEN n >= 200 THEN ((n - 200) // 70 + 1) * 70 ELSE 0 END))
SELECT v.k, v.start, 200::BIGINT AS length, n - v.start < 200 AS is_partial, least(200, n - v.start) AS source_samples, round(sum(x), 4) + 0.0 AS total,
  arg_min(x, i) AS head FROM v JOIN s ON s.k = v.k AND s.i >= v.start AND s.i < v.start + 200 GROUP BY v.k, v.start, n""")
def long_segments(spark, sf_dir):
    """Windows longer than the stretches that they are cut from: 200 samples of stretches of 64."""
    rows = chunks.segments(_wave(spark, sf_dir), ["k"], 200, 70, "pad-zero", 64)
    total = F.aggregate("data", F.lit(0.0), lambda s, x: s + x)
    return rows.select("k", "start", "length", "is_partial", "source_samples", (F.round(total, 4) + 0.0).alias("total"), F.get("data", F.lit(0)).alias("head"))


@query(f"""{_LONG}, u AS (SELECT k, i, x, lag(x) OVER (PARTITION BY k ORDER BY i) AS b FROM s),
c AS (SELECT k, count(*) FILTER (b < 0 AND x >= 0) AS n, max(i) FILTER (b < 0 AND x >= 0) AS z, min(i) FILTER (b < 0 AND x >= 0) AS a FROM u GROUP BY k)
SELECT k, n AS crossings, CASE WHEN n >= 2 THEN round({RATE_HZ} * (n - 1) / (z - a), 6) + 0.0 END AS frequency_hz FROM c""")
def long_zero_crossings(spark, sf_dir):
    return chunks.zero_crossing_hz(_wave(spark, sf_dir), ["k"], RATE_HZ).select("k", "crossings", r6("frequency_hz").alias("frequency_hz"))


@query(f"""{_LONG}, c AS (SELECT k, count(*) AS n FROM s GROUP BY k), m AS (SELECT k, n, unnest(range(0, CAST(ceil(n * 25 / 32.0 - 1e-9) AS BIGINT))) AS m FROM c WHERE n >= 9),
o AS (SELECT k, n, m, m * 32 // 25 AS centre, unnest(range(-8, 9)) AS off FROM m),
w AS (SELECT k, m, off, m * 32 % 25 / 25.0::DOUBLE - off AS d, CASE WHEN centre + off < 0 THEN -(centre + off) - 1 WHEN centre + off >= n THEN 2 * n - (centre + off) - 1 ELSE centre + off END AS i FROM o),
v AS (SELECT k, m, i, CASE WHEN abs(d) > 8 THEN 0 ELSE (0.54 + 0.46 * cos(pi() * d / 8)) * 0.78125::DOUBLE * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * 0.78125::DOUBLE * d) / (pi() * 0.78125::DOUBLE * d) END END AS w FROM w)
SELECT v.k, v.m AS i, round(sum(w * x) / sum(w), 4) + 0.0 AS y FROM v JOIN s ON s.k = v.k AND s.i = v.i GROUP BY v.k, v.m""")
def long_resample(spark, sf_dir):
    return _long(chunks.resampled(_wave(spark, sf_dir).where("n >= 9"), ["k"], RATE_HZ, 50.0, size=SIZE))


@query(f"""{_LONG}, c AS (SELECT k, count(*) AS n FROM s GROUP BY k),
w AS (SELECT k, 'whole' AS name, 0::BIGINT AS a, n::BIGINT AS b FROM c UNION ALL SELECT k, 'middle', n // 7, n // 7 + (n * 3) // 5 FROM c UNION ALL SELECT k, 'short', n // 3, least(n, n // 3 + 30) FROM c),
p AS (SELECT w.k, name, a, b, unnest(range(0, 48))::INT AS bucket FROM w WHERE b > a),
f AS (SELECT w.k, name, ((i - a + 1) * 48 - 1) // (b - a) AS bucket, min(x) AS lo, max(x) AS hi FROM w JOIN s ON s.k = w.k AND i >= a AND i < b GROUP BY ALL)
SELECT p.k, p.name, p.a AS win_start, p.b AS win_end, p.bucket, coalesce(lo, 0.0) AS min, coalesce(hi, 0.0) AS max, lo IS NOT NULL AS populated FROM p LEFT JOIN f ON f.k = p.k AND f.name = p.name AND f.bucket = p.bucket""")
def long_pyramid_view(spark, sf_dir):
    """Three views of each channel from one pyramid, of blocks of 16 samples in fours."""
    wave = _wave(spark, sf_dir)
    n = wave.groupBy("k").agg(F.max("n").alias("n"))
    window = lambda name, a, b: F.struct(F.lit(name).alias("name"), F.expr(a).cast("long").alias("win_start"), F.expr(b).cast("long").alias("win_end"))
    three = F.array(window("whole", "0", "n"), window("middle", "n div 7", "n div 7 + (n * 3) div 5"), window("short", "n div 3", "least(n, n div 3 + 30)"))
    windows = n.select("k", F.explode(three).alias("w")).select("k", "w.*")
    return pyramid.view(pyramid.pyramid(wave, ["k"], 16, 4), windows, ["k"], 48, 16, 4)


_HOT = "SELECT CASE WHEN user_id % 10 = 0 THEN user_id ELSE 0 END AS k, event_id % 5000 AS sample_index, event_id AS ordinal, event_type AS symbol, props AS aux_note FROM events"


@query(f"""WITH v AS (SELECT k, sample_index / 4000.0::DOUBLE AS x, (min((sample_index, symbol, ordinal))) AS e FROM ({_HOT}) WHERE sample_index < 4000 GROUP BY ALL),
c AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN user_id ELSE 0 END AS k, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS f FROM events),
b AS (SELECT event_id, c.k, c.f - v.x AS d, v.e FROM c ASOF JOIN v ON c.k = v.k AND c.f >= v.x UNION ALL SELECT event_id, c.k, v.x - c.f, v.e FROM c ASOF JOIN v ON c.k = v.k AND c.f <= v.x),
m AS (SELECT k, event_id, d, e[1] AS sample_index, e[2] AS symbol FROM b WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY k, event_id ORDER BY d, e) = 1)
SELECT k, event_id AS cursor, sample_index, symbol, round(d, 6) + 0.0 AS distance FROM m""")
def nearest_any_distance(spark, sf_dir):
    """The nearest event of every cursor, however far: a cursor for each event, and one key with nine tenths of both."""
    e = read(spark, sf_dir, "events").withColumn("k", F.when(F.col("user_id") % 10 == 0, F.col("user_id")).otherwise(0).cast("long"))
    marks = e.select("k", (F.col("event_id") % 5000).cast("long").alias("sample_index"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("symbol"), F.col("props").alias("aux_note"))
    cursors = e.select("k", F.col("event_id").alias("cursor"), (F.col("event_id") * 7919 % 10007 / F.lit(10007.0)).alias("fraction"))
    found = events.nearest_sorted(marks, cursors, ["k"], "cursor", start_sec=0.0, duration=62.5, rate_hz=RATE_HZ, record_start=0.0, n=4000, tolerance=1.0)
    return found.select("k", "cursor", "sample_index", "symbol", r6("distance").alias("distance"))


@query("""SELECT vec_id::VARCHAR AS record_id, c AS channel_index, (k - 1)::BIGINT AS i, round((floor(embedding[k] * 100 + 0.5) * (1 - 2 * c) - 8) / 200.0::DOUBLE, 6) + 0.0 AS mv
FROM (SELECT *, unnest(range(21, 51)) AS k FROM (SELECT vec_id, embedding, unnest([0, 1]) AS c FROM embeddings))""")
def record_view_read(spark, sf_dir):
    """Each embedding and its mirror image written as a record of format 212 by the committing sink, and samples 20 to 50 read back by ranges of 16."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("record_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel_index"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 100 + 0.5).cast("short")).alias("data"))
    samples = F.when(F.col("channel_index") == 1, F.transform("data", lambda x: (-x).cast("short"))).otherwise(F.col("data"))
    channels = rows.select("record_id", "channel_index", F.concat(F.lit("lead "), F.col("channel_index").cast("string")).alias("channel_name"), F.lit(RATE_HZ).alias("sample_rate_hz"), F.lit(200.0).alias("gain"), F.lit(8.0).alias("baseline"), F.lit(12).alias("adc_bits"), samples.alias("samples"))
    folder = shared_dir(spark, "records")
    ranged.write_records(channels, folder, 212)
    found = ranged.view(ranged.read_chunks(spark, folder, 16), 20, 50, 16)
    long = found.select("record_id", "channel_index", "start", "gain", "baseline", F.posexplode("samples").alias("k", "adc"))
    return long.select("record_id", "channel_index", (F.col("start") + F.col("k")).alias("i"), r6(timeaxis.adc_to_millivolt(F.col("adc"), F.col("gain"), F.col("baseline"))).alias("mv"))
