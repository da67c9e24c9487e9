"""Generated signals: the two-lead synthetic record, and the seven canonical recipes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.functions.kernels import flat_lists, wavelet
from pulsegrid.functions.timeaxis import Num, col, round_half_up

#: The default record.
DATASET, RATE_HZ, SAMPLES, GAIN, BASELINE = "synthetic", 360.0, 3600, 200.0, 1024.0
LEADS = (("lead-a", 1.0), ("lead-b", 1.2))
#: The bumps of a synthetic beat (seconds from its centre, deviation in seconds, share of the amplitude).
BEAT = ((-0.26, 0.026, 0.12), (-0.055, 0.01, -0.12), (0.0, 0.013, 1.0), (0.045, 0.01, -0.3), (0.24, 0.055, 0.35))
SPREAD = 5


def lead_millivolt(t: Column, hz: Num, amplitude: Num = 1.0, phase: Num = 0.0) -> Column:
    base = 2 * math.pi * col(hz)
    return col(amplitude) * (0.6 * F.sin(base * t + phase) + 0.4 * 0.5 * F.sin(2 * base * t + 2 * phase))


def synthetic_records(specs: DataFrame) -> DataFrame:
    """Long form (record_id, channel_index, channel_name, i, adc, mv) of specs, a row for each lead: record_id, channel_index, channel_name, n,
    rate_hz, frequency_hz, amplitude, phase, gain and baseline. Samples, a rate or a gain that aren't above zero are refused."""
    c = F.col
    wrong = (c("n") <= 0) | (c("rate_hz") <= 0) | (c("gain") <= 0)
    refused = F.raise_error(F.lit("[invalid-input] a synthetic record needs samples, a rate and a gain above zero")).cast("long")
    last = F.when(F.coalesce(wrong, F.lit(True)), refused).otherwise(c("n").cast("long") - 1)
    rows = specs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    mv = lead_millivolt(c("i") / c("rate_hz"), c("frequency_hz"), c("amplitude"), c("phase"))
    rows = rows.withColumn("adc", round_half_up(mv * c("gain") + c("baseline")).cast("int"))
    return rows.select("record_id", "channel_index", "channel_name", "i", "adc", ((c("adc") - c("baseline")) / c("gain")).alias("mv"))


def synthetic_channels(specs: DataFrame) -> DataFrame:
    """Channel rows (array form) of specs, as the readers of recordings give them."""
    keys = ["record_id", "channel_index", "channel_name"]
    samples = F.transform(F.sort_array(F.collect_list(F.struct("i", "adc"))), lambda s: s["adc"].cast("short"))
    rows = synthetic_records(specs).groupBy(*keys).agg(samples.alias("samples")).join(specs.select(*keys, "rate_hz", "gain", "baseline"), keys)
    return rows.select(F.lit(DATASET).alias("dataset_id"), "record_id", F.col("record_id").alias("subject_id"), "channel_index", "channel_name", F.lit("mV").alias("unit"), F.col("rate_hz").alias("sample_rate_hz"), F.lit(0.0).alias("start_time_sec"), "gain", "baseline", "samples")


def synthetic_record(spark: SparkSession, record: str = "sync", leads=LEADS, n: int = SAMPLES, rate_hz: float = RATE_HZ, gain: float = GAIN, baseline: float = BASELINE) -> DataFrame:
    """Long form (record_id, channel_index, channel_name, i, adc, mv) of a record of sine pairs; nothing is read."""
    if n <= 0 or rate_hz <= 0 or gain <= 0:
        raise SignalError("invalid-input", "a synthetic record needs samples, a rate and a gain above zero")
    rows = None
    for c, (name, hz) in enumerate(leads):
        mv = lead_millivolt(F.col("i") / rate_hz, hz)
        part = spark.range(n).select(F.lit(record).alias("record_id"), F.lit(c).alias("channel_index"), F.lit(name).alias("channel_name"), F.col("id").alias("i")).withColumn("adc", round_half_up(mv * gain + baseline).cast("int"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("mv", (F.col("adc") - baseline) / gain)


class SyntheticRecords:
    """A registry of synthetic records by id."""

    def __init__(self, specs: dict[str, dict]):
        self.specs = specs

    def ids(self) -> list[str]:
        return sorted(self.specs)

    def read(self, spark: SparkSession, record: str) -> DataFrame:
        if record not in self.specs:
            raise SignalError("file-not-found", f"no synthetic record {record!r}")
        return synthetic_record(spark, record, **self.specs[record])


class UniformRng:
    """The 32-bit generator of the recorded noise: a Weyl step and two multiply-xorshift rounds."""

    def __init__(self, seed: int):
        self.state = seed % (1 << 32)

    def next(self) -> float:
        word = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & word
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & word
        t ^= (t + ((t ^ t >> 7) * (t | 61) & word)) & word
        return ((t ^ t >> 14) & word) / (1 << 32)


class GaussianRng:
    """Standard normal numbers in pairs by the polar angle of two uniform ones."""

    def __init__(self, seed: int):
        self.uniform, self.spare = UniformRng(seed), None

    def next(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        u = self.uniform.next()
        while u == 0:
            u = self.uniform.next()
        radius, angle = math.sqrt(-2 * math.log(u)), 2 * math.pi * self.uniform.next()
        self.spare = radius * math.sin(angle)
        return radius * math.cos(angle)


def _need(recipe: dict, *names: str) -> list:
    for name in names:
        values = recipe.get(name) if isinstance(recipe.get(name), (list, tuple)) else [recipe.get(name)]
        if not values or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in values):
            raise SignalError("invalid-input", f"recipe {recipe.get('kind')!r} needs a finite {name}")
    return [recipe[name] for name in names]


def generate(recipe: dict) -> np.ndarray:
    """The samples of a recipe: impulse, constant, sine, multi-frequency, chirp, noise or synthetic-ecg."""
    kind, n = recipe.get("kind"), recipe.get("length")
    rate, offset = recipe.get("sample_rate_hz", RATE_HZ), recipe.get("offset", 0.0)
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise SignalError("invalid-input", f"a recipe's length has to be a whole number above 0, not {n!r}")
    if not (isinstance(rate, (int, float)) and math.isfinite(rate) and rate > 0):
        raise SignalError("invalid-input", f"a recipe's rate must be above zero, received {rate!r}")
    t = np.arange(n) / rate
    if kind == "impulse":
        amplitude, at = _need(recipe, "amplitude", "at_index")
        if not isinstance(at, int) or not 0 <= at < n:
            raise SignalError("invalid-input", f"the impulse's index {at!r} is outside [0, {n})")
        return np.where(np.arange(n) == at, float(amplitude), 0.0)
    if kind == "constant":
        return np.full(n, float(_need(recipe, "offset")[0]))
    if kind == "sine":
        amplitude, hz = _need(recipe, "amplitude", "frequency_hz")
        return offset + amplitude * np.sin(2 * math.pi * hz * t + recipe.get("phase_rad", 0.0))
    if kind == "multi-frequency":
        amplitudes, hz = _need(recipe, "amplitudes", "frequencies_hz")
        if len(amplitudes) != len(hz):
            raise SignalError("invalid-input", "amplitudes and frequencies must be as many")
        return offset + sum(a * np.sin(2 * math.pi * f * t) for a, f in zip(amplitudes, hz, strict=True))
    if kind == "chirp":
        amplitude, f0, f1 = _need(recipe, "amplitude", "f0_hz", "f1_hz")
        sweep = (f1 - f0) / ((n - 1) / rate) if n > 1 else 0.0
        return offset + amplitude * np.sin(2 * math.pi * (f0 * t + 0.5 * sweep * t * t))
    if kind == "noise":
        std, seed = _need(recipe, "std", "seed")
        if std < 0 or not isinstance(seed, int):
            raise SignalError("invalid-input", "noise needs a deviation of at least 0 and an integer seed")
        rng = GaussianRng(seed)
        return np.array([offset + rng.next() * std for _ in range(n)])
    if kind == "synthetic-ecg":
        (bpm,) = _need(recipe, "heart_rate_bpm")
        if bpm <= 0:
            raise SignalError("invalid-input", "the heart rate must be above zero")
        out, gap = np.zeros(n), max(1, math.floor(rate * 60 / bpm + 0.5))
        for beat in range(0, n, gap):
            for at, deviation, share in BEAT:
                centre, sigma = beat + at * rate, deviation * rate
                i = np.arange(max(0, math.ceil(centre - SPREAD * sigma)), min(n, math.floor(centre + SPREAD * sigma) + 1))
                out[i] += recipe.get("amplitude", 1.0) * share * np.exp(-0.5 * ((i - centre) / sigma) ** 2)
        return out
    raise SignalError("invalid-input", f"unknown recipe kind {kind!r}")


def generated(recipe: Column) -> Column:
    """array<double> of the recipe in each row, a struct with the fields that `generate` takes; those that are null are not given."""

    @F.arrow_udf("array<double>")
    def run(recipes: pa.Array) -> pa.Array:
        given = lambda r: {k: v for k, v in r.items() if v is not None}
        return flat_lists([None if r is None else generate(given(r)) for r in recipes.to_pylist()])

    return run(recipe)


#: The canonical recipes, by id.
RECIPES = {
    "impulse-1": {"kind": "impulse", "length": 720, "amplitude": 1.0, "at_index": 5},
    "constant-1": {"kind": "constant", "length": 360, "offset": 0.5},
    "sine-1": {"kind": "sine", "length": 3600, "frequency_hz": 1.0, "amplitude": 1.0, "phase_rad": 0.0, "offset": 0.0},
    "multi-frequency-1": {"kind": "multi-frequency", "length": 3600, "amplitudes": [1.0, 0.5, 0.25], "frequencies_hz": [1.0, 3.0, 5.0]},
    "chirp-1": {"kind": "chirp", "length": 3600, "amplitude": 1.0, "f0_hz": 0.5, "f1_hz": 20.0},
    "noise-1": {"kind": "noise", "length": 2048, "std": 0.05, "seed": 20260903},
    "synthetic-ecg-1": {"kind": "synthetic-ecg", "length": 2160, "heart_rate_bpm": 60.0, "amplitude": 1.0},
}


def canonical_signals(spark: SparkSession) -> DataFrame:
    """(id, kind, sample_rate_hz, length, data) of the canonical recipes."""
    rows = [(k, r["kind"], RATE_HZ, r["length"], generate(r).tolist()) for k, r in RECIPES.items()]
    return spark.createDataFrame(rows, "id string, kind string, sample_rate_hz double, length int, data array<double>")


def wavelet_bank(spark: SparkSession) -> DataFrame:
    """The db4 filter bank with its invariants, one row."""
    bank = wavelet("db4")
    lo, hi = np.array(bank["dec_lo"]), np.array(bank["dec_hi"])
    row = ("db4", 4, len(lo), *(list(bank[k]) for k in ("dec_lo", "dec_hi", "rec_lo", "rec_hi")), float(lo.sum()), float((lo * lo).sum()), float(hi.sum()), float((hi * hi).sum()))
    taps = ", ".join(f"{k} array<double>" for k in ("dec_lo", "dec_hi", "rec_lo", "rec_hi"))
    sums = ", ".join(f"{k} double" for k in ("sum_dec_lo", "sum_squares_dec_lo", "sum_dec_hi", "sum_squares_dec_hi"))
    return spark.createDataFrame([row], f"wavelet string, order int, tap_count int, {taps}, {sums}")


def write_fixtures(spark: SparkSession, folder: str, overwrite: bool = False) -> dict[str, bool]:
    """The canonical signals and the wavelet bank as JSON below folder, and whether each was written; existing ones stay unless overwrite is set."""
    written = {}
    for name, table in (("signals", canonical_signals(spark)), ("wavelet", wavelet_bank(spark))):
        try:
            table.coalesce(1).write.mode("overwrite" if overwrite else "error").json(f"{folder}/{name}")
            written[name] = True
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            written[name] = False
    return written
