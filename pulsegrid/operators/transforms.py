"""Whole-signal transforms: a row (signal_id, channel, data, sample_rate_hz, start_time_sec, unit, provenance) for each
channel in, the same out, with a derived id and one more step of provenance, the oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pulsegrid.errors import SignalError
from pulsegrid.functions import kernels as K
from pulsegrid.functions import naming


def provenance(source: Column) -> Column:
    """A provenance without steps."""
    none = F.array().cast("array<struct<name:string,parameters:map<string,string>,applied_at_iso:string>>")
    return F.struct(source.cast("string").alias("source"), none.alias("transforms"))


def _step(df: DataFrame, name: str, parameters: dict) -> DataFrame:
    return df.withColumn("signal_id", naming.derived_id(F.col("signal_id"), name)).withColumn("provenance", naming.with_transform(F.col("provenance"), name, parameters))


def _one_rate(df: DataFrame, rate_hz: float) -> DataFrame:
    same = F.when(F.col("sample_rate_hz") == rate_hz, True).otherwise(F.raise_error(F.lit(f"[incompatible-sample-rate] a signal is not at {rate_hz} Hz")).cast("boolean"))
    return df.where(same)


def calibrate_signals(df: DataFrame) -> DataFrame:
    """Channel rows (samples, gain, baseline, unit) in millivolts; other units are refused."""
    other = F.raise_error(F.concat(F.lit("[unsupported-format] a channel is in "), F.col("unit"))).cast("array<double>")
    mv = F.transform("samples", lambda s: (s.cast("double") - F.col("baseline")) / F.col("gain"))
    out = df.withColumn("data", F.when(F.col("unit") == "mV", mv).otherwise(other)).drop("samples")
    return out.withColumn("provenance", naming.with_transform(F.col("provenance"), "adc-to-millivolt"))


def filter_signals(df: DataFrame, spec: dict, rate_hz: float) -> DataFrame:
    """Filtered by {type, cutoff_hz, taps, phase: forward or zero}; the taps are designed once for all signals of the rate."""
    out = _one_rate(df, rate_hz).withColumn("data", K.filter_column(F.col("data"), spec, rate_hz))
    return _step(out, naming.filter_name(spec), {"type": spec["type"], "numTaps": spec["taps"], "phase": spec["phase"], "sampleRateHz": rate_hz})


def resample_signals(df: DataFrame, rate_hz: float, target_hz: float, radius: int = 8, edge: str = "reflect") -> DataFrame:
    out = _one_rate(df, rate_hz).withColumn("data", K.resample_column(F.col("data"), rate_hz, target_hz, radius, edge)).withColumn("sample_rate_hz", F.lit(float(target_hz)))
    return _step(out, naming.resample_name(target_hz), {"fromHz": rate_hz, "toHz": target_hz, "kernelRadiusSamples": radius, "edgeMode": edge})


def normalise_signals(df: DataFrame, strategy: str, scope: str = "per-channel") -> DataFrame:
    """Fit and applied on each channel itself, or (global) on all channels of a signal_id together; no spread is refused."""
    if strategy not in ("min-max", "z-score") or scope not in ("per-channel", "global"):
        raise SignalError("invalid-input", f"unknown normalisation {strategy!r} / {scope!r}")
    if scope == "per-channel":
        out = df.withColumn("data", K.normalise_column(F.col("data"), strategy))
    else:
        total = lambda f: F.aggregate(F.transform("data", f), F.lit(0.0), lambda s, x: s + x)
        own = F.struct(F.array_min("data").alias("low"), F.array_max("data").alias("high"), F.size("data").alias("n"), total(lambda x: x).alias("sum"), total(lambda x: x * x).alias("squares"))
        over, part = W.Window.partitionBy("signal_id"), df.withColumn("_own", own)
        mean = F.sum("_own.sum").over(over) / F.sum("_own.n").over(over)
        deviation = F.sqrt(F.greatest(F.lit(0.0), F.sum("_own.squares").over(over) / F.sum("_own.n").over(over) - mean * mean))
        low, span = F.min("_own.low").over(over), F.max("_own.high").over(over) - F.min("_own.low").over(over)
        part = part.withColumn("_a", low if strategy == "min-max" else mean).withColumn("_b", span if strategy == "min-max" else deviation)
        flat = F.raise_error(F.lit("[numerical-failure] a signal without spread")).cast("array<double>")
        out = part.withColumn("data", F.when(F.col("_b") > 0, F.transform("data", lambda x: (x - F.col("_a")) / F.col("_b"))).otherwise(flat)).drop("_own", "_a", "_b")
    return _step(out.withColumn("unit", F.lit("normalized")), naming.normalisation_name(strategy, scope), {"strategy": strategy, "scope": scope})


def decompose_signals(df: DataFrame, level: int, wavelet: str = "db4") -> DataFrame:
    """With bands (detail 1 to level, then the approximation) in place of data; the source's id and samples stay known."""
    out = df.withColumn("bands", K.decompose_column(F.col("data"), level, wavelet)).withColumn("source_samples", F.size("data")).drop("data")
    return _step(out, naming.dwt_name(wavelet, level), {"wavelet": wavelet, "level": level, "extensionMode": "periodic"})


def reconstruct_signals(df: DataFrame, level: int, wavelet: str = "db4") -> DataFrame:
    """The signals of decompose_signals; bands that don't give the source's length are refused."""
    wrong = F.raise_error(F.lit("[invalid-input] the bands don't give the signal's length")).cast("array<double>")
    data = K.reconstruct_column(F.col("bands"), wavelet)
    out = df.withColumn("data", data).withColumn("data", F.when(F.size("data") == F.col("source_samples"), F.col("data")).otherwise(wrong)).drop("bands", "source_samples")
    return _step(out, naming.idwt_name(wavelet, level), {"wavelet": wavelet, "level": level})
